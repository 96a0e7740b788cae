"""Substring deduplication by level-wise doubling over word windows.

A window is ``length`` consecutive words of one document. Level by level the
windows that occur in more than one document survive, and only they are
extended to twice the length, until the target length is reached or no
candidates survive:

* base level (``length / 2`` words): of the base windows inside each target
  window it is enough to test one, as a target window can only repeat if each
  window in it repeats. The one with the smallest hash is taken; equal target
  windows pick equal ones, so nothing is lost, and about one base window in
  thirteen is shuffled instead of every one.
* target level: only target windows whose base window survived are hashed again
  (128 bits) and compared across documents. The smallest doc_id of each window owns
  it; in every other document that holds it its words are covered.
* beyond (``repeat_lengths``): the windows of the target level that repeat are
  doubled on, 100, 200, ... words, until none survives, which tells how long the
  repeats of a document are.

Only hashes, ids and the texts once (by doc_id) are shuffled. Windows are combined
before the shuffle and only their owners come back, so a passage of many documents
is no hot key; the join on base windows is a plain equi-join that adaptive execution
may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import NULL_ID, chunk_words, chunked, rolling, signed, staged, texts_of, windows, with_key

TARGET = 50


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (width at most len(values))."""
    span, best = 1, values
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    rest = width - span
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def _anchors(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """For each target window of one document, the smallest hash of its base windows."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    at = np.arange(n - base + 1)
    return sliding_min(rolling(hashes, at, at + base), length - base + 1)


def _per_document(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    texts = texts_of(batch["text"])
    for lo, hi in chunked(texts):
        hashes, cut = chunk_words(texts[lo:hi])
        for i in range(hi - lo):
            yield lo + i, hashes[cut[i] : cut[i + 1]]


def _base_windows(docs: DataFrame, length: int, base: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found, owners, sizes = [], [], []
            for i, hashes in _per_document(batch):
                best = _anchors(hashes, length, base)
                if len(best):
                    best = best[np.concatenate([[True], best[1:] != best[:-1]])]
                    found.append(best)
                    owners.append(i)
                    sizes.append(len(best))
            if found:
                row = pa.array(np.repeat(owners, sizes))
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(found)), batch["key"].take(row), batch["part"].take(row)], ["window", "key", "part"])

    return docs.select("key", "part", "text").mapInArrow(run, "window long, key long, part long")


def _repeated(records: DataFrame, on: list[str]) -> DataFrame:
    """Windows seen in two documents or more, with the smallest document key."""
    return (
        records.groupBy(*on)
        .agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .where("first < last")
        .select(*on, "first")
    )


def _target_windows(docs: DataFrame, marked: DataFrame, length: int, base: int) -> DataFrame:
    """128-bit hashes of the target windows whose base window survived."""

    def run(batches):
        for batch in batches:
            marks = batch["marks"]
            out: list[list[np.ndarray]] = [[], [], []]
            for i, hashes in _per_document(batch):
                best = _anchors(hashes, length, base)
                wanted = marks[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(np.isin(best, wanted))
                if len(at):
                    out[0].append(rolling(hashes, at, at + length, 0))
                    out[1].append(rolling(hashes, at, at + length, 1))
                    out[2].append(np.full(len(at), i, np.int64))
            if out[0]:
                hi, lo, row = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([signed(hi), signed(lo), batch["key"].take(pa.array(row)), batch["part"].take(pa.array(row))], ["hi", "lo", "key", "part"])

    # the same columns as in dedup_substrings, so that one shuffle of the texts serves both
    joined = docs.join(marked, ["key", "part"], "left").where("marks is not null")
    return joined.select("doc_id", "key", "part", "text", "marks").mapInArrow(run, "hi long, lo long, key long, part long")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, part, text): rows without an id have one key, by which none is
    smaller than another, and a part each text, by which their windows are gathered."""
    return with_key(docs).withColumn("part", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))


def candidates_and_owners(docs: DataFrame, length: int = TARGET) -> tuple[DataFrame, DataFrame]:
    """(key, part, marks) with the surviving base windows of each document, and (key, part,
    own) with the candidate target windows whose smallest document it is. A candidate
    window that a document holds but doesn't own also starts in a smaller one; rows
    without an id all own what no other row holds. ``docs`` is of ``_rows``."""
    base = max(1, (length + 1) // 2)
    records = _base_windows(docs, length, base)
    # written first: a join of two plain shuffles is one that can be split where a window is hot
    repeated = staged(_repeated(records, ["window"]).select("window"), "repeated")
    survivors = records.join(repeated, "window")
    marked = staged(survivors.groupBy("key", "part").agg(F.collect_set("window").alias("marks")), "base")
    # one row a window comes back, to its owner: a window of many documents is no hot key
    targets = _target_windows(docs, marked, length, base)
    firsts = targets.groupBy("hi", "lo").agg(F.min("key").alias("key"), F.min("part").alias("part"), F.max("part").alias("last"))
    owned = firsts.select("hi", "key", F.when(F.col("key") == NULL_ID, F.col("part")).otherwise(F.lit(0)).alias("part"), "last")
    if not marked.where(F.col("key") == NULL_ID).isEmpty():
        # windows that rows without an id alone hold, in several texts, come back to each
        # (a real document of that largest id has part 0 and is one of them)
        firsts = staged(firsts, "firsts")
        several = (F.col("key") == NULL_ID) & (F.col("part") < F.col("last"))
        of_null = _target_windows(docs.where(F.col("key") == NULL_ID), marked, length, base).select("hi", "lo", "part").distinct()
        shared = of_null.join(firsts.where(several).select("hi", "lo"), ["hi", "lo"]).select("hi", F.lit(NULL_ID).alias("key"), "part")
        owned = firsts.where(~several).select("hi", "key", F.when(F.col("key") == NULL_ID, F.col("part")).otherwise(F.lit(0)).alias("part")).unionByName(shared)
    return marked, owned.groupBy("key", "part").agg(F.collect_set("hi").alias("own"))


def covered_words(hashes: np.ndarray, marks: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """Flags the words of one document that a repeated window covers: a window whose
    base window is marked and which the document doesn't own."""
    n = len(hashes)
    if n < length or not len(marks):
        return np.zeros(n, np.bool_)
    at = np.flatnonzero(np.isin(_anchors(hashes, length, max(1, (length + 1) // 2)), marks))
    at = at[~np.isin(rolling(hashes, at, at + length, 0), own)]
    steps = np.zeros(n + 1, np.int64)
    steps[at] += 1
    steps[at + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def dedup_substrings(docs: DataFrame, length: int = TARGET) -> DataFrame:
    """Removes from each document the words covered by windows of ``length`` words
    that also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (binary, the kept words joined by one
    space). Windows are judged on the input. Null text: no words. A null doc_id
    counts as the largest id; rows that share a doc_id are one document as far as
    order goes (none is smaller than the other), each still gives its own row.
    Texts under ``length`` words and empty tables pass unchanged; other columns
    are ignored.
    """
    rows = _rows(docs)
    marked, owned = candidates_and_owners(rows, length)
    values = lambda column, i: column[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if column[i].is_valid else np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            texts, marks, own = texts_of(batch["text"]), batch["marks"], batch["own"]
            counts, removed, kept = [], [], []
            for lo, hi in chunked(texts):
                hashes, cut = chunk_words(texts[lo:hi])
                for i in range(hi - lo):
                    words = texts[lo + i].split()
                    if marks[lo + i].is_valid:
                        gone = covered_words(hashes[cut[i] : cut[i + 1]], values(marks, lo + i), values(own, lo + i), length)
                        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        left = words
                    counts.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(marked, ["key", "part"], "left").join(owned, ["key", "part"], "left").select("doc_id", "text", "marks", "own")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def repeat_lengths(docs: DataFrame, length: int = TARGET) -> DataFrame:
    """(doc_id, longest): the greatest ``length * 2**k`` at which the document still
    holds a window that another document holds too; documents without one are absent.
    Doubles until no candidates survive. Null and repeated ids as in dedup_substrings."""
    rows = with_key(docs)
    found: DataFrame | None = None
    size = length
    while True:
        def run(batches, size=size):
            for batch in batches:
                keys = batch["key"].to_pylist()
                for i, hashes in _per_document(batch):
                    at, first = windows(hashes, np.array([0, len(hashes)]), size)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([signed(first), signed(rolling(hashes, at, at + size, 1)), pa.array(np.full(len(at), keys[i]))], ["hi", "lo", "key"])

        # only documents that survived the level before are extended
        pool = rows if found is None else rows.join(found.select("key"), "key", "left_semi")
        records = pool.select("key", "text").mapInArrow(run, "hi long, lo long, key long")
        level = staged(records.join(_repeated(records, ["hi", "lo"]), ["hi", "lo"]).select("key").distinct().select("key", F.lit(size).cast("long").alias("longest")), f"level{size}")
        if level.isEmpty():
            break
        found = level if found is None else level.unionByName(found.join(level, "key", "left_anti"))
        size *= 2
    if found is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("longest")).limit(0)
    return rows.select("doc_id", "key").distinct().join(found, "key").select("doc_id", "longest")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


#: All 50-word windows of all documents, word by word; the smallest doc_id of each.
OP1_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) u(i)),
hit AS (SELECT r, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT r, p FROM hit, unnest(range(i, i + 50)) u(p)),
word AS (SELECT r, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) u(p)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGET)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
