"""Exact deduplication against a historical index: a minimal perfect hash over the
distinct digests seen so far, whose slots hold the full digest and the winner.

The index is cut by the first bits of the digest into shards of bounded size; each
shard is one row with a minimal perfect hash (hash and displace: buckets, largest
first, get the first seed that sends all their digests to free slots) and an array
of slots. A lookup computes the slot of a digest, compares all 32 bytes, and either
returns the slot's winner or says that the digest is no member. Nonmembers are
grouped separately, among themselves.

A table without a history of its own is cut in two by a hash of the id: one half is
indexed as what is stored already, the other is looked up in it, and winners and counts
of both are merged by digest.

Hot shards (a third of all rows may be copies of one text) are looked up in as many
pieces as their rows need: the shard's row is sent to each piece, rows are dealt
among them by a hash of their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import NULL_ID, mix, staged

#: Digests a shard should hold, the greatest number of shard bits, those up to which the
#: table of shards is broadcast, and rows that one lookup task group should get.
SHARD_DIGESTS, MAX_BITS, BROADCAST_BITS, LOOKUP_ROWS = 1 << 11, 24, 16, 1 << 14
_BUCKET = 4


def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers from the last 16 bytes of 32-byte digests."""
    low = np.ascontiguousarray(digests).view(np.uint8).reshape(-1, 32)[:, 16:].copy().view(np.uint64)
    return low[:, 0], low[:, 1]


def build_mph(digests: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash over distinct 32-byte digests (dtype S32 as void)."""
    n = len(digests)
    n_buckets = max(1, (n + _BUCKET - 1) // _BUCKET)
    a, b = _parts(digests)
    bucket = (a % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    seeds = np.zeros(n_buckets, np.uint32)
    taken = np.zeros(n, np.bool_)
    for k in np.argsort(-sizes, kind="stable"):
        if not sizes[k]:
            break
        mine = b[order[begins[k] : begins[k + 1]]]
        first, step = 0, 64
        while True:
            tries = np.arange(first, first + step, dtype=np.uint64)
            slots = (mix(mine[None, :] ^ mix(tries + np.uint64(1))[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            if len(mine) > 1:
                ranked = np.sort(slots, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            hits = np.flatnonzero(good)
            if len(hits):
                seeds[k] = first + hits[0]
                taken[slots[hits[0]]] = True
                break
            first, step = first + step, min(step * 2, 4096)
    return seeds


def mph_slots(digests: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    a, b = _parts(digests)
    seed = seeds[(a % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64)
    return (mix(b ^ mix(seed + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def _as_digests(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), "V32") if len(values) else np.zeros(0, "V32")


def _shard(digest, bits: int):
    """Number of a digest's shard: its first ``bits`` bits (MAX_BITS at most)."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, MAX_BITS // 8)), 16, 10).cast("int"), MAX_BITS - bits)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): sha-256 of the text's UTF-8; null counts as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest: its winner (largest doc_id) and count."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The index over the distinct digests of ``rows`` (doc_id, digest): one row a
    shard with its seeds and slots, and the number of shard bits."""
    return index_of(staged(_groups(rows), "groups"))


def index_of(groups: DataFrame) -> tuple[DataFrame, int]:
    """The same from the groups (digest, winner, n)."""
    n = groups.count()
    bits = min(MAX_BITS, max(0, int(np.ceil(np.log2(max(1, n) / SHARD_DIGESTS)))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _as_digests(pdf["digest"])
        seeds = build_mph(digests)
        slot = mph_slots(digests, seeds, len(digests))
        table = np.zeros(len(digests), [("digest", "V32"), ("winner", "<i8"), ("n", "<i8")])
        table["digest"][slot] = digests
        table["winner"][slot] = pdf["winner"].fillna(-NULL_ID).astype("int64")
        table["n"][slot] = pdf["n"]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "rows": [int(pdf["n"].sum())], "seeds": [seeds.tobytes()], "slots": [table.tobytes()]})

    cut = groups.withColumn("shard", _shard(F.col("digest"), bits)).withColumn("winner", F.coalesce("winner", F.lit(-NULL_ID)))
    return cut.groupBy("shard").applyInPandas(build, "shard int, rows long, seeds binary, slots binary"), bits


def lookup(rows: DataFrame, index: DataFrame, bits: int) -> DataFrame:
    """(doc_id, digest, winner, n, member) for every row of (doc_id, digest)."""
    index = staged(index, "index")
    rows = rows.withColumn("shard", _shard(F.col("digest"), bits))
    # a row for each shard: up to BROADCAST_BITS small enough to broadcast whatever the data
    small = F.broadcast if bits <= BROADCAST_BITS else (lambda df: df)
    asked = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("asked"))
    pieces = staged(asked.select("shard", F.ceil(F.col("asked") / LOOKUP_ROWS).cast("int").alias("pieces")), "pieces")
    counted = pieces.select(F.col("shard").alias("of"), F.col("pieces").alias("cuts"))
    dealt = rows.join(small(counted), F.col("shard") == F.col("of")).withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("cuts")).cast("int"))
    copies = index.join(small(pieces), "shard", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).select("shard", "piece", "seeds", "slots")

    def probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        digests = _as_digests(asked["digest"])
        winner = np.full(len(digests), -NULL_ID)
        n = np.zeros(len(digests), np.int64)
        member = np.zeros(len(digests), np.bool_)
        if len(shard) and len(digests):
            table = np.frombuffer(shard["slots"].iloc[0], [("digest", "V32"), ("winner", "<i8"), ("n", "<i8")])
            slot = mph_slots(digests, np.frombuffer(shard["seeds"].iloc[0], np.uint32), len(table))
            member = table["digest"][slot] == digests  # all 32 bytes
            winner, n = np.where(member, table["winner"][slot], -NULL_ID), np.where(member, table["n"][slot], 0)
        return pd.DataFrame({"doc_id": asked["doc_id"], "digest": asked["digest"], "winner": winner, "n": n, "member": member})

    # the id travels as text-free long; null ids are told apart by a flag value
    coded = dealt.select("shard", "piece", F.coalesce("doc_id", F.lit(-NULL_ID)).alias("doc_id"), "digest")
    found = coded.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece")).applyInPandas(probe, "doc_id long, digest binary, winner long, n long, member boolean")
    decoded = lambda c: F.when(F.col(c) != -NULL_ID, F.col(c)).alias(c)
    return found.select(decoded("doc_id"), "digest", decoded("winner"), "n", "member")


def dedup_exact(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` (doc_id, text) is what is already stored. Rows whose digest the index
    holds take its winner; the others are grouped separately. Without ``history``
    half of the documents is indexed as such and the other half looked up, and the
    winners of both are merged: the largest doc_id of equal texts stays and group_size
    counts the rows; with it, members are repeats of stored documents (kept only if they
    are the winner's own row) and group_size counts the stored ones.

    Null text equals empty text. A null doc_id never wins against an id; where all
    ids of a group are null, keep_id is null and its rows are kept. Rows that share
    the winning doc_id are all kept. Other columns are ignored.
    """
    if history is not None:
        index, bits = build_index(keyed(history))
        found = staged(lookup(keyed(docs), index, bits), "found")
        others = found.where("not member").select("doc_id", "digest")
        out = found.where("member").drop("member").unionByName(others.join(_groups(others), "digest").select("doc_id", "digest", "winner", "n"))
    else:
        rows = staged(keyed(docs).withColumn("old", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "digests")
        stored = staged(_groups(rows.where("old")), "groups")
        index, bits = index_of(stored)
        found = staged(lookup(rows.where("not old").drop("old"), index, bits), "found")
        # members by the slot's winner, nonmembers among themselves: either way a row a digest
        news = found.groupBy("digest", "member").agg(F.greatest(F.max("doc_id"), F.max("winner")).alias("winner"), F.count(F.lit(1)).alias("n"))
        totals = staged(stored.unionByName(news.select("digest", "winner", "n")).groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n")), "totals")
        out = rows.join(totals, "digest")
    return out.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
