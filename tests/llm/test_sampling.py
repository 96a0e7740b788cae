"""What classifiers learn from rows without ids of their own, and again in another order;
and second implementations of decoding and of one step of the risk."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ophelion.llm import language_id, toxicity

LETTERS = {"xx": "abcdef", "yy": "ghijkl", "zz": "mnopqr"}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        lang = ["xx", "xx", "xx", "xx", "yy", "zz"][k % 6]
        rows.append((k, " ".join("".join(rng.choices(LETTERS[lang], k=4)) for _ in range(rng.randint(3, 30))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("one_id", [None, 3])
def test_languages_of_rows_without_own_ids(texts, one_id):
    df = texts.withColumn("doc_id", F.lit(one_id).cast("long"))
    told = df.withColumn("true", F.col("lang"))
    model = language_id.train(language_id.training_rows(df), 30)
    assert model.langs == ["xx", "yy", "zz"]
    found = language_id.predict(told, model, "true").collect()
    assert len(found) == 300 and all(r["lang_pred"] == r["true"] for r in found)


def test_languages_are_learned_alike_in_any_order(texts):
    one = language_id.train(texts, 60)
    two = language_id.train(texts.unionByName(texts).repartition(7), 60)
    assert one.langs == two.langs and (one.weights == two.weights).all() and (one.trust == two.trust).all()
    assert language_id.train(texts, 60, max_langs=2).langs == ["xx", "yy"]


def test_decoding(texts):
    """The codeword of least weighted loss, text by text and bit by bit."""
    model = language_id.train(texts, 60)
    for text in ["abc abc ghi", "mno", "zzz", "gggg hhhh abab"]:
        x = language_id.features(text)
        bits = [float(np.dot(x, model.weights[:, b]) + model.bias[b]) for b in range(model.code.shape[1])]
        losses = [sum(model.trust[k][b] * np.log1p(np.exp(-model.code[k][b] * bits[b])) for b in range(len(bits))) for k in range(3)]
        best, _, margin = model.decode(x[None, :])
        assert best[0] == int(np.argmin(losses)) and margin[0] == pytest.approx(sorted(losses)[1] - min(losses), abs=1e-5)


def toxic_rows(spark, ids):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(240):
        words = ["".join(rng.choices("abcdef", k=4)) for _ in range(20)]
        if k % 4 == 0:
            words[3], words[9] = "venom", "bile"
        rows.append((k if ids or k % 4 == 0 or k % 4 == 1 else None, " ".join(words), k % 4 == 0))
        if k % 4 < 2:
            labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, bad boolean"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_unlabelled_rows_without_ids_are_drawn_by_text(spark):
    """Half of the rows have no id; the sample takes a share of them, not all or none."""
    df, told = toxic_rows(spark, False)
    out = toxicity.score_toxicity(df, told, max_unlabelled=80).collect()
    bad = {r["text"]: r["bad"] for r in df.collect()}
    model = toxicity.train(df, told, max_unlabelled=80)
    scores = model.scores([t.encode() for t in bad])
    assert all((s >= 0.5) == b for s, b in zip(scores, bad.values()))
    assert len(out) == 240


def test_toxicity_is_learned_alike_in_any_order(spark):
    df, told = toxic_rows(spark, True)
    one, two = toxicity.train(df, told, 20, 60), toxicity.train(df.unionByName(df).repartition(5), told, 20, 60)
    assert (one.slots == two.slots).all() and one.weights == pytest.approx(two.weights, abs=1e-6)


def test_one_step_of_the_risk():
    """The first step goes against the gradient of pi R_p+ + max(0, R_u- - pi R_p-)."""
    rng = np.random.default_rng(0)
    strong, base = np.uint32(7), [np.uint32(x) for x in (11, 12)]
    positive = [np.array(sorted({strong, base[k % 2]}), np.uint32) for k in range(40)]
    unlabelled = [np.array(sorted({base[k % 2], *([strong] if rng.random() < 0.1 else [])}), np.uint32) for k in range(90)]
    model = toxicity.fit(positive, unlabelled, 0.1, rounds=1, rate=0.05, l2=0.0)
    has = lambda rows, s: np.array([s in r for r in rows], float)

    def risk(w, b):
        loss = lambda rows, y: np.mean([np.log1p(np.exp(-y * (b + sum(wk * (s in r) for wk, s in zip(w, model.slots))))) for r in rows])
        return 0.1 * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - 0.1 * loss(positive, -1))

    zero = np.zeros(len(model.slots))
    slopes = [(risk(zero + 1e-6 * (np.arange(len(zero)) == k), 0.0) - risk(zero, 0.0)) / 1e-6 for k in range(len(zero))]
    assert strong in model.slots and has(positive, strong).all()
    assert model.weights == pytest.approx([-0.05 * np.sign(g) for g in slopes], rel=1e-3)  # Adam's first step is the rate
