"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text is counted into terms: hashed words, the shapes of words (runs of capitals,
small letters and digits as one character each, punctuation as it is), pairs of shapes,
and how much of the text repeats itself. A bounded sample of labelled documents gives
the terms' weights (log-entropy) and, by singular value decomposition, the latent space;
the sample's own vectors there carry the labels. They are broadcast, and every document
is compared with all of them in blocks of exact cosine products. The nearest ones vote
with their similarity as weight.

The sample has at most ``max_labelled`` documents, so that the model's size doesn't
depend on the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import chunk_words, chunked, id_fold, mix, released, small_batches, texts_of

WORD_SLOTS, SHAPE_SLOTS, LATENT, NEIGHBOURS, MAX_LABELLED = 1024, 1024, 32, 15, 4000
#: Terms of a text: word slots, shape slots, then words repeated, words equal to the one before, lines repeated.
TERMS = WORD_SLOTS + SHAPE_SLOTS + 3
#: Documents compared at once, and the weight of the labels' mean in a vote, so that a text unlike all others has one.
BLOCK, PRIOR_WEIGHT = 512, 1e-3

_SHAPE = np.array([32 if c in b" \t\n\x0b\x0c\r" else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
_RUNS = np.isin(np.arange(256), (65, 97, 48))


def shapes(text: bytes) -> bytes:
    """Each run of capitals, small letters (or bytes over 127) or digits as one character."""
    a = _SHAPE[np.frombuffer(text, np.uint8)]
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & _RUNS[a[1:]]
    return a[~again].tobytes()


def _counted(owner: np.ndarray, slots: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(owner * width + slots.astype(np.int64), minlength=n * width).reshape(n, width)


def term_rates(texts: list[bytes]) -> np.ndarray:
    """A row for each text: the square roots of its terms' counts by words; zeros where
    it has no word."""
    words, cut = chunk_words(texts)
    forms, form_cut = chunk_words([shapes(x) for x in texts])
    n, sizes = len(texts), np.diff(cut)
    owner = np.repeat(np.arange(n), sizes)  # a word and its shape share their places
    assert np.array_equal(cut, form_cut)
    same_text = owner[1:] == owner[:-1]
    pairs = mix(forms[1:] * np.uint64(3) + forms[:-1])[same_text]
    out = np.zeros((n, TERMS))
    out[:, :WORD_SLOTS] = _counted(owner, words % np.uint64(WORD_SLOTS), n, WORD_SLOTS)
    out[:, WORD_SLOTS:-3] = _counted(owner, forms % np.uint64(SHAPE_SLOTS), n, SHAPE_SLOTS) + _counted(owner[1:][same_text], pairs % np.uint64(SHAPE_SLOTS), n, SHAPE_SLOTS)
    out[:, -2] = np.bincount(owner[1:][same_text & (words[1:] == words[:-1])], minlength=n)
    for i, text in enumerate(texts):
        own = words[cut[i] : cut[i + 1]]
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, -3] = len(own) - len(np.unique(own))
        out[i, -1] = len(own) * (len(lines) - len(set(lines))) / max(1, len(lines))
    return np.sqrt(out / np.maximum(1, sizes)[:, None])


@dataclass
class Votes:
    project: np.ndarray  # terms to the latent space, weights included
    vectors: np.ndarray  # of length 1, a labelled document each
    labels: np.ndarray

    def latent(self, rates: np.ndarray) -> np.ndarray:
        x = rates @ self.project
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def scores(self, rates: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The labels of the nearest vectors, weighted by cosine. All that are as near as
        the last of them vote too, so that their order doesn't matter; cosines are
        rounded to five places for that, and ones below 0 weigh nothing."""
        cosines = np.round(self.latent(rates) @ self.vectors.T, 5)
        k = min(neighbours, cosines.shape[1])
        last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        weights = np.where(cosines >= last, np.maximum(cosines, 0), 0).astype(np.float64)
        return (weights @ self.labels + PRIOR_WEIGHT * self.labels.mean()) / (weights.sum(axis=1) + PRIOR_WEIGHT)


def singular_vectors(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """The k right singular vectors of greatest value, as columns, by block iteration."""
    k = min(k, *x.shape)
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(k + 16, *x.shape)))
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:k].T


def fit(rates: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> Votes:
    """Log-entropy weights, then the ``latent`` greatest singular vectors. A term spread
    evenly over the documents weighs nearly nothing."""
    share = rates / np.maximum(rates.sum(axis=0), 1e-12)
    entropy = -(share * np.log(np.maximum(share, 1e-300))).sum(axis=0) / np.log(max(2, len(rates)))
    weights = 1.05 - entropy
    project = weights[:, None] * singular_vectors(rates * weights, latent)
    return Votes(project, Votes(project, None, None).latent(rates), labels.astype(np.float64))


def _rates_of(batch: pa.RecordBatch):
    texts = texts_of(batch["text"])
    for lo, hi in chunked(texts):
        for at in range(lo, hi, BLOCK):
            yield term_rates(texts[at : min(hi, at + BLOCK)])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Votes | None:
    """Learns from rows whose fold (crc32 of the id modulo 5) is not 0. Labels belong to
    ids: ids are drawn by hash, those of least draw are taken, and of their different texts,
    should an id have several, those of least draw again; repeated rows count once."""
    told = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(id_fold(F.col("doc_id"), 5) != 0)
    there = docs.where("text is not null").select(docs["doc_id"].cast("long").alias("doc_id"))
    told = told.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).join(there, "doc_id", "left_semi")
    n = told.count()
    if not n:
        return None
    draw = lambda *by: F.pmod(F.xxhash64(*by, F.lit("quality")), F.lit(1 << 40))
    # about 1.5 times as many pass the first test, so that few rows meet to be put in order
    some = told.withColumn("draw", draw("doc_id")).where(F.col("draw") < F.lit(int(min(1.0, 1.5 * max_labelled / n) * (1 << 40))))
    ids = some.orderBy("draw", "doc_id").limit(max_labelled).select("doc_id", "quality")
    texts = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(ids), "doc_id")  # at most max_labelled ids: texts stay where they are

    def run(batches):
        for batch in batches:
            rates = [x.astype(np.float32) for x in _rates_of(batch)]
            rows = np.concatenate(rates) if rates else np.zeros((0, TERMS), np.float32)
            yield pa.RecordBatch.from_arrays([batch["draw"], batch["quality"], pa.array([r.tobytes() for r in rows], pa.binary())], ["draw", "quality", "rates"])

    # the draws of texts say which rows are read, before any is counted
    drawn = picked.select(draw("doc_id", "text").alias("draw"), "quality", "text")
    last = drawn.select("draw").distinct().orderBy("draw").limit(max_labelled).agg(F.max("draw")).first()[0]
    if last is None:
        return None
    rows = drawn.where(F.col("draw") <= last).dropDuplicates(["draw"]).mapInArrow(run, "draw long, quality int, rates binary").toPandas().sort_values("draw")
    return fit(np.stack([np.frombuffer(r, np.float32) for r in rows["rates"]]).astype(np.float64), rows["quality"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, neighbours: int = NEIGHBOURS, **bounds: int) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null, empty and wordless texts are like no other and get the mean of the labels in
    the sample; where there are no training labels, or no text has one, every score is 0.
    A null label is none; repeated labels of one id count as their rounded mean. Whole
    texts count, however long. Repeated rows each give a row and equal texts equal
    scores, up to rounding; null ids count as '' for the fold. An empty table gives no
    rows; extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    rows = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), (id_fold(docs["doc_id"].cast("long"), 5) == 0).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches):
        for batch in released(batches):
            if model.value is None:
                scores = np.zeros(batch.num_rows)
            else:
                scores = np.concatenate([np.zeros(0), *(model.value.scores(x, neighbours) for x in _rates_of(batch))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_quality_vote(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
