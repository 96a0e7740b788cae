"""Similarity of texts by token embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_match(candidate: np.ndarray, reference: np.ndarray) -> tuple[float, float, float]:
    """(precision, recall, f1): each token takes its best cosine on the other side."""
    if not len(candidate) or not len(reference):
        return 0.0, 0.0, 0.0
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    cosine = unit(candidate) @ unit(reference).T
    p, r = float(cosine.max(axis=1).mean()), float(cosine.max(axis=0).mean())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")]))
def bert_score(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Over array<array<double>> columns of token embeddings."""
    rows = [greedy_match(np.array([*map(np.asarray, a)]), np.array([*map(np.asarray, b)])) for a, b in zip(candidate, reference, strict=True)]
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


#: Tokens of a block, which is what one task holds of each side.
BLOCK = 1024


def token_scores(tokens: DataFrame, by: str, id: str, vector: str, reference: str, block: int = BLOCK) -> DataFrame:
    """(by, precision, recall, f1) as bert_score, from a row for each token.

    ``reference`` names a boolean column: true for the reference's tokens. Each side of
    a group is dealt into blocks and each pair of blocks is one task, so a group needs
    not fit into one cell. Repeated rows count as often as they come; a null group is a
    group; null vectors are no tokens, and a group with one side only scores 0."""
    side = F.coalesce(F.col(reference), F.lit(False))
    own = tokens.where(F.col(vector).isNotNull()).select(F.col(by).alias("_by"), F.col(id).alias("_id"), side.alias("_ref"), F.col(vector).cast("array<double>").alias("_v"))
    own = own.groupBy("_by", "_id", "_ref", "_v").agg(F.count(F.lit(1)).alias("_n"))
    blocks = own.groupBy("_by").agg(*(F.ceil(F.sum(F.col("_ref").eqNullSafe(F.lit(r)).cast("long")) / block).cast("int").alias(c) for r, c in ((False, "_rows"), (True, "_columns"))))
    blocks = blocks.withColumnRenamed("_by", "_group")
    dealt = own.join(blocks, F.col("_by").eqNullSafe(F.col("_group"))).withColumn("_key", F.xxhash64("_id", "_v"))
    mine = F.pmod("_key", F.when(F.col("_ref"), F.col("_columns")).otherwise(F.col("_rows"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("_ref"), F.col("_rows")).otherwise(F.col("_columns")) - 1))
    both = dealt.where("_rows > 0 AND _columns > 0").withColumn("_mine", mine).withColumn("_other", other)
    pairs = both.select("_by", "_id", "_ref", "_v", "_n", F.when(F.col("_ref"), F.col("_other")).otherwise(F.col("_mine")).alias("_a"), F.when(F.col("_ref"), F.col("_mine")).otherwise(F.col("_other")).alias("_b"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ref = pdf["_ref"].to_numpy(bool)
        x, y = pdf[~ref], pdf[ref]
        if x.empty or y.empty:  # a block that the hash left empty
            return pd.DataFrame({"_row": [], "_best": []}).astype({"_row": "int64", "_best": "float64"})
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        cosine = unit(np.stack(x["_v"].to_list())) @ unit(np.stack(y["_v"].to_list())).T
        return pd.DataFrame({"_row": np.concatenate([x["_row"], y["_row"]]), "_best": np.concatenate([cosine.max(axis=1), cosine.max(axis=0)])})

    keyed = pairs.withColumn("_row", F.xxhash64("_by", "_id", "_ref", "_v"))
    found = keyed.select("_by", "_a", "_b", "_row", "_ref", "_v").groupBy("_by", "_a", "_b").applyInPandas(best, "_row long, _best double").groupBy("_row").agg(F.max("_best").alias("_best"))
    rows = own.withColumn("_row", F.xxhash64("_by", "_id", "_ref", "_v")).join(found, "_row", "left")
    mean = lambda r: F.coalesce(F.try_divide(F.sum(F.when(F.col("_ref") == r, F.col("_best") * F.col("_n"))), F.sum(F.when(F.col("_ref") == r, F.col("_n")))), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    scores = rows.groupBy("_by").agg(mean(False).alias("precision"), mean(True).alias("recall"))
    return scores.select(F.col("_by").alias(by), "precision", "recall", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def model_score(score: Callable[[list[str], list[str], list[str]], list[float]]):
    """A column function (candidate, reference, source) over any scorer of batches, for
    neural metrics whose models aren't part of this repository."""

    @F.pandas_udf(T.DoubleType())
    def run(candidate: pd.Series, reference: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series(score(candidate.fillna("").tolist(), reference.fillna("").tolist(), source.fillna("").tolist()), dtype="float64")

    return run
