"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

from .cluster_layout import OP13_SQL, op13_clustered_layout
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .html_extract import op2_html_extract
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .language_id import op3_language_id
from .lm_score import op10_lm_score
from .media import op8_media
from .mixing import OP5_SQL, op5_mixing
from .packing import op6_packing
from .quality_vote import op12_quality_vote
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_html_extract,
        op3_language_id,
        op4_exact_dedup,
        op5_mixing,
        op6_packing,
        op7_jaccard_join,
        op8_media,
        op9_toxicity,
        op10_lm_score,
        op11_fill_in_middle,
        op12_quality_vote,
        op13_clustered_layout,
    )
}

ORACLES = {"op1_substring_dedup": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op13_clustered_layout": OP13_SQL}


def pipeline(spark, sf_dir: str):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
