"""Each stage of the corpus pipeline against brute force on a small table with clashing
and missing ids, and the whole run."""

from __future__ import annotations

import importlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ophelion.llm import mixing

corpus_pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = list(corpus_pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    texts = [prose(rng.randint(10, 120)) for _ in range(30)]
    out = [(k, t, "en", "abc"[k % 3], len(t)) for k, t in enumerate(texts)]
    out += [(100, texts[0], "en", "b", 1), (101, texts[0], None, None, None), (7, texts[1], "en", "a", 5), (7, prose(40), "en", "a", 5)]
    out += [(None, texts[2], "en", "a", 3), (None, prose(30), None, "c", 3), (None, prose(50), "en", None, 3)]
    changed = texts[3].split()
    out += [(200, None, "en", "a", None), (201, "", "en", "a", 0), (202, "123 !", "en", "a", 5), (203, " ".join([*changed[:-1], "changed"]), "en", "a", 9)]
    out += [out[5], out[5]]  # repeated rows
    out.append((204, prose(9000), "en", "c", 9))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df.withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("key", F.lit(None).cast("string"))


def collected(df):
    assert df.columns == COLUMNS
    return Counter(map(tuple, df.collect()))


def test_language_keeps_what_has_a_letter(spark, docs, rows):
    out = collected(corpus_pipeline.language(spark, docs, ""))
    want = Counter((i, t, lang or "en", s, n) for i, t, lang, s, n in rows if t and any(c.isalpha() for c in t))
    assert out == want


def test_exact_keeps_one_row_of_equal_texts(spark, docs, rows):
    out = collected(corpus_pipeline.exact(spark, docs, ""))
    assert set(out.values()) == {1} and set(out) <= set(rows)
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert {(r[1] or "", -1 if r[0] is None else r[0]) for r in out} == set(best.items())
    assert len(out) == len(best)


def test_near_keeps_one_of_each_class(spark, docs, rows):
    out = collected(corpus_pipeline.near(spark, docs, ""))
    shingles = lambda t: frozenset(tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4)) if w)
    sets = [shingles(r[1]) for r in rows]
    linked = lambda a, b: a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8
    parent = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if linked(a, b):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    order = lambda i: 2**63 if rows[i][0] is None else rows[i][0]
    least = {}
    for i, p in enumerate(parent):
        least[p] = min(least.get(p, 2**63), order(i))
    kept_classes = Counter()
    for r in out:
        i = rows.index(r)
        assert order(i) == least[parent[i]]
        kept_classes[parent[i]] += 1
    assert set(kept_classes) == set(parent)  # every class has a row left
    assert all(len({rows[i][1] for i in range(len(rows)) if parent[i] == p and rows[i] in out}) == 1 for p in kept_classes)


def test_mix_takes_each_row_by_its_own_size(spark, docs, rows):
    out = collected(corpus_pipeline.mix(spark, docs, ""))
    want = Counter()
    for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), keep=tuple(COLUMNS)).collect():
        k, size, taken = r["kept"], r["size"], r["taken"]
        if not taken:
            continue
        want[k["doc_id"], k["text"], k["lang"], k["source"], len(k["text"])] += taken // size
        if taken % size:
            part = " ".join(k["text"].split()[: taken % size])
            want[k["doc_id"], part, k["lang"], k["source"], len(part)] += 1
    assert out == +want
    words = Counter()
    for (_, text, _, source, _), n in out.items():
        words[source] += n * len(text.split())
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    assert {s: int(t) for s, t in targets.items() if int(t)} == dict(words)


def test_run_and_empty_tables(spark, docs, tmp_path):
    docs.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out[0].asDict())
    room = Counter()
    for r in out:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0
