"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary linear classifier over
hashed byte n-grams (1 to 3 bytes of the lower-cased letters) is trained with numpy.
A text is decoded to the codeword of least loss, the losses of the bits weighted by
how well the bit's classifier told the language's training rows (loss-weighted
decoding); a small distance to the second codeword flags the text as ambiguous.

Training reads a bounded sample: at most ``max_rows`` labelled rows in all, an equal
share per language, whole texts. Everything else reads all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import id_fold, release, small_batches

DIMS, MAX_N, MAX_ROWS, MAX_LANGS = 4096, 3, 3200, 200
#: Loss margin to the second codeword below which a text is ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"

#: Everything in ASCII that is no letter becomes a space; the rest is text.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIER = (np.uint32(1), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def ngram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams over the whole text, in pieces of bounded size."""
    out = np.zeros(dims, np.int64)
    for at in range(0, len(text), _PIECE):
        # pieces overlap by MAX_N - 1 characters
        data = b" ".join(text[at : at + _PIECE + MAX_N - 1].lower().encode("utf-8", "replace").translate(_LETTERS).split())
        codes = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, MAX_N + 1):
            if len(codes) < n:
                break
            gram = (gram[: len(codes) - n + 1] << np.uint32(8)) | codes[n - 1 :]
            slot = ((gram + np.uint32(n << 28)) * _MULTIPLIER[1] ^ (gram * _MULTIPLIER[2] >> np.uint32(13))) >> np.uint32(16)
            out += np.bincount(slot % np.uint32(dims), minlength=dims)
    return out


def features(text: str, dims: int = DIMS) -> np.ndarray:
    """Square roots of relative frequencies: a vector of length 1."""
    counts = ngram_counts(text, dims)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all distinct splits for up to 6 languages, else the
    best of random codes by the least distance between two words."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        splits = [[1 if k == 0 or not (s >> (k - 1)) & 1 else -1 for k in range(n)] for s in range(1, 2 ** (n - 1))]
        return np.array(splits, np.float32).T
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > most:
            best, most = code, least
    return best


@dataclass
class Ecoc:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    trust: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 30.0, l2: float = 1e-5) -> Ecoc:
        """Logistic regression for every bit at once, by accelerated gradient steps;
        every language weighs the same."""
        target = self.code[y]
        each = 1.0 / np.maximum(1, np.bincount(y, minlength=len(self.langs)))[y].astype(np.float32) / len(self.langs)
        w, b = np.zeros((x.shape[1], self.code.shape[1]), np.float32), np.zeros(self.code.shape[1], np.float32)
        w_ahead, b_ahead = w, b
        for k in range(rounds):
            f = x @ w_ahead + b_ahead
            g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * each[:, None]
            w_next, b_next = w_ahead - rate * (x.T @ g + l2 * w_ahead), b_ahead - rate * g.sum(axis=0)
            push = k / (k + 3)
            w_ahead, b_ahead = w_next + push * (w_next - w), b_next + push * (b_next - b)
            w, b = w_next, b_next
        self.weights, self.bias = w, b
        right = (np.sign(x @ w + b) == target).astype(np.float64)
        trust = np.zeros(self.code.shape)
        for k in range(len(self.langs)):
            mine = right[y == k]
            trust[k] = (mine.sum(axis=0) + 1) / (len(mine) + 2)
        self.trust = trust / trust.sum(axis=1, keepdims=True)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, loss margin to the second codeword)."""
        n = len(x)
        if self.code.shape[1] == 0:
            return np.zeros(n, np.int64), np.ones(n), np.full(n, np.inf)
        f = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -c * f) * t).sum(axis=1) for c, t in zip(self.code, self.trust, strict=True)], axis=1)
        best = loss.argmin(axis=1)
        odds = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        ranked = np.partition(loss, 1, axis=1)
        return best, 1 / odds.sum(axis=1), ranked[:, 1] - ranked[:, 0]


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, dims: int = DIMS, max_langs: int = MAX_LANGS) -> Ecoc | None:
    """Fits on (doc_id, text, lang). The ``max_langs`` commonest languages are learned,
    each from its max_rows / languages rows of smallest hash of id and text; repeated
    rows count once. Which rows these are depends on nothing else, so a rerun takes the
    same ones, and rows without an id or with a common one are drawn by their texts."""
    usable = small_batches(labelled).where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return None
    share = max(1, max_rows // len(counts))
    drawn = usable.where(F.col("lang").isin([r["lang"] for r in counts])).withColumn("draw", F.xxhash64("doc_id", "text", F.lit("language")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    lasts = drawn.select("lang", "draw").distinct().withColumn("turn", turn).where(F.col("turn") <= share).groupBy("lang").agg(F.max("draw").alias("last")).collect()
    limits = F.create_map(*[x for r in lasts for x in (F.lit(r["lang"]), F.lit(r["last"]))])
    sample = drawn.where(F.col("draw") <= limits[F.col("lang")]).dropDuplicates(["lang", "draw"])

    def run(batches):
        for batch in batches:
            langs_, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            rows = [(k, features(x, dims).astype(np.float16).tobytes()) for k, x in zip(langs_, texts, strict=True) if has_letter(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    x = np.stack([np.frombuffer(b, np.float16) for b in rows["x"]]).astype(np.float32)
    y = np.searchsorted(langs, rows["lang"])
    return Ecoc(langs, codewords(len(langs))).fit(x, y)


def predict(docs: DataFrame, model: Ecoc | None, *keep: str | Column, dims: int = DIMS) -> DataFrame:
    """Adds lang_pred, score, ambiguous to the ``keep`` columns of every document. The
    text goes to Python once, kept or not."""
    kept = small_batches(docs).select(*keep)
    names = kept.columns
    read = "text" if "text" in names and dict(kept.dtypes)["text"] == "string" else "__text"
    columns = kept if read == "text" else docs.select(*keep, docs["text"].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for batch in batches:
            texts = batch[read].to_pylist()
            langs, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, x in enumerate(texts) if has_letter(x)] if model else []
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                best, score, margin = model.decode(np.stack([features(texts[i], dims) for i in part]))
                for i, k, s, m in zip(part, best, score, margin, strict=True):
                    langs[i], scores[i], unsure[i] = model.langs[k], float(s), bool(m < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])
        release()

    return columns.mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double, ambiguous boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(id_fold(F.col("doc_id"), 4) != 2)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Null texts and texts without a letter are ``und`` with score 0, and so is every
    text where no labelled row with a letter exists. With one language learned, all
    other texts are that one. Of languages that fit equally well the first by name is
    taken. Very long texts are counted whole, in pieces. Null doc_ids count as '' for the
    fold. Repeated rows each give a row; an empty table gives none; extra columns are
    ignored.
    """
    model = train(training_rows(docs), max_rows)
    fold = id_fold(docs["doc_id"].cast("long"), 4)
    return predict(docs, model, docs["doc_id"].cast("long").alias("doc_id"), (fold == 2).alias("held_out"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
