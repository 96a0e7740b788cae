"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other training documents count as
unlabelled, whatever their label, with the class prior estimated from the labels. A
linear classifier over word presence is trained with numpy on the class-prior
corrected risk: pi * loss(P as 1) + max(0, loss(U as 0) - pi * loss(P as 0)); where
the second term is negative the step goes up it instead, as in non-negative PU
learning, so that the classifier can't overfit the positives among the unlabelled.

Training reads a bounded sample (``max_positive`` and ``max_unlabelled`` rows, whole
texts); the prior is counted over all labelled training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import chunk_words, chunked, id_fold, small_batches

DIMS, FEATURES, MAX_POSITIVE, MAX_UNLABELLED = 1 << 18, 2048, 2500, 7500
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def word_slots(text: bytes) -> bytes:
    return text.translate(_LETTERS)


def _present(texts: list[bytes]):
    """For each text the sorted distinct hashed words."""
    clean = [word_slots(x) for x in texts]
    for lo, hi in chunked(clean):
        hashes, cut = chunk_words(clean[lo:hi])
        slots = (hashes % np.uint64(DIMS)).astype(np.uint32)
        for i in range(hi - lo):
            yield np.unique(slots[cut[i] : cut[i + 1]])


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@dataclass
class NnPu:
    slots: np.ndarray  # sorted hashed words used
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, own in enumerate(_present(texts)):
            out[i] += self.weights[np.isin(self.slots, own, assume_unique=True)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _matrix(rows: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(slots)), np.float32)
    for i, own in enumerate(rows):
        x[i, np.isin(slots, own, assume_unique=True)] = 1
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> NnPu:
    """Trains on sets of hashed words. The features are the words whose document
    rates differ most, in standard errors, between positives and unlabelled."""
    p_rate = np.bincount(np.concatenate(positive), minlength=DIMS) / len(positive)
    u_rate = np.bincount(np.concatenate(unlabelled), minlength=DIMS) / len(unlabelled)
    pooled = (p_rate * len(positive) + u_rate * len(unlabelled) + 1) / (len(positive) + len(unlabelled) + 2)
    z = np.abs(p_rate - u_rate) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / len(positive) + 1 / len(unlabelled)))
    strong = np.flatnonzero(z > 4.5)  # beyond chance among this many words
    slots = np.sort(strong[np.argsort(-z[strong], kind="stable")][:FEATURES]).astype(np.uint32)
    xp, xu = _matrix(positive, slots), _matrix(unlabelled, slots)
    w, b = np.zeros(len(slots)), 0.0
    m, v = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    for k in range(1, rounds + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(xp @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(xu @ w + b, -30, 30)))
        # logistic loss: -log s as 1, -log(1 - s) as 0
        gp1, gp0, gu0 = (sp - 1) / len(sp), sp / len(sp), su / len(su)
        negative_risk = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        rest_w, rest_b = xu.T @ gu0 - prior * (xp.T @ gp0), gu0.sum() - prior * gp0.sum()
        if negative_risk >= 0:
            gw, gb = prior * (xp.T @ gp1) + rest_w, prior * gp1.sum() + rest_b
        else:
            gw, gb = -rest_w, -rest_b
        g = np.append(gw + l2 * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return NnPu(slots, w, float(b))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> NnPu | None:
    """Learns from rows whose fold (crc32 of the id modulo 5) is not 0."""
    texts = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(id_fold(F.col("doc_id"), 5) != 0)
    told = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(id_fold(F.col("doc_id"), 5) != 0)
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # repeated labels of one id count once
    counted = told.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    n_docs = texts.count()
    if not counted["n"] or not counted["toxic"] or not n_docs:
        return None
    draw = lambda *by: F.xxhash64(*by, F.lit("toxicity"))
    # about 1.5 times max_positive ids pass the first test, so that few are put in order
    some = told.where("toxic = 1").withColumn("draw", F.pmod(draw("doc_id"), F.lit(1 << 40))).where(F.col("draw") < F.lit(int(min(1.0, 1.5 * max_positive / counted["toxic"]) * (1 << 40))))
    ids = some.orderBy("draw", "doc_id").limit(max_positive).select("doc_id")
    # bounded by the limit, so that texts stay where they are
    positive = texts.join(F.broadcast(ids), "doc_id").select(draw("doc_id", "text").alias("draw"), "text", F.lit(1).alias("kind"))
    unlabelled = texts.select(draw("doc_id", "text").alias("draw"), "text", F.lit(0).alias("kind"))

    def run(batches):
        for batch in batches:
            sets = [x.tobytes() for x in _present(_bytes(batch["text"]))]
            yield pa.RecordBatch.from_arrays([batch["kind"], pa.array(sets, pa.binary())], ["kind", "slots"])

    def sample(df: DataFrame, most: int) -> list[bytes]:
        """The rows of least draw, repeated ones once: the same ones in every run."""
        last = df.select("draw").distinct().orderBy("draw").limit(most).agg(F.max("draw")).first()[0]
        return [] if last is None else df.where(F.col("draw") <= last).dropDuplicates(["draw"]).select("kind", "text").mapInArrow(run, "kind int, slots binary").toPandas()["slots"].tolist()

    p, u = (sorted(sample(d, n)) for d, n in ((positive, max_positive), (unlabelled, max_unlabelled)))
    if not p or not u:
        return None
    as_sets = lambda rows: [np.frombuffer(x, np.uint32) for x in rows]
    return fit(as_sets(p), as_sets(u), counted["toxic"] / counted["n"])


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the score of the bias. Where no
    training label is toxic, or no training document exists, every score is 0. A
    null toxic label is no label; repeated labels of one id count once as positive.
    Rows are drawn for training by id and text, repeated ones once, so that null and
    common ids are drawn by their texts. Whole texts count, however long; equal texts
    have equal scores. Repeated rows each give a row; null ids count as '' for the fold;
    an empty table gives no rows; extra columns are ignored.
    """
    model = train(docs, labels, **bounds)
    rows = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), (id_fold(docs["doc_id"].cast("long"), 5) == 0).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            scores = model.scores(_bytes(batch["text"])) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
