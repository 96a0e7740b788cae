"""N-gram Jaccard self join by MinHash banding.

1. Each document becomes its set of five-word shingles (a shorter text: all its
   words, one shingle). Documents with equal sets are one class from the start and
   stand behind one representative; a hot group of copies costs one row from here.
   A set is named by its own hash through all steps, never by a doc_id: rows without
   an id, or with the same one, are documents of their own.
2. Each representative gets ``bands`` band hashes of ``rows`` MinHash values; both
   numbers follow from the target recall at the threshold. Bands are shuffled on
   their hash; each bucket links its members to its smallest one, so a bucket of m
   documents gives m - 1 edges and not m * m / 2 pairs.
3. Connected components of these edges hold every candidate pair. Each component is
   cut into blocks of similar set size, and every pair of blocks whose sizes can
   reach the threshold is one task that verifies all its pairs on the full shingle
   sets by counting common shingles. A task emits link counts and the edges of a
   spanning forest, never the pairs: its output grows with its documents.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import NULL_ID, chunk_words, chunked, mix, release, rolling, signed, staged, texts_of, windows, with_key

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Documents and shingles of a block at most (a longer document is a block of its own),
#: and shingles verified at once within one pair of blocks.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 1 << 14


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands needed so that a pair at the threshold shares one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, words)
    at = np.arange(n - size + 1)
    return np.unique(rolling(hashes, at, at + size))


def _sets(batch: pa.RecordBatch, words: int):
    texts = texts_of(batch["text"])
    for lo, hi in chunked(texts):
        hashes, cut = chunk_words(texts[lo:hi])
        for i in range(hi - lo):
            yield lo + i, shingles(hashes[cut[i] : cut[i + 1]], words)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, digest, set_hi, set_lo, bands): 128 bits that name the shingle set,
    and its band hashes (none for a document without words)."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            names, found, sizes = np.zeros((2, n), np.uint64), [], np.zeros(n + 1, np.int32)
            for i, own in _sets(batch, words):
                if not len(own):
                    continue
                for k in (0, 1):
                    names[k, i] = rolling(own, np.array([0]), np.array([len(own)]), k)[0]
                best = np.full(bands * rows, 2**64 - 1, np.uint64)
                for at in range(0, len(own), 2048):
                    part = own[at : at + 2048]
                    for j in range(0, bands * rows, 8):
                        np.minimum(best[j : j + 8], (part[None, :] * a[j : j + 8, None] + b[j : j + 8, None]).min(axis=1), out=best[j : j + 8])
                band = np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band ^ best[r::rows])
                found.append(band)
                sizes[i + 1] = bands
            values = signed(np.concatenate(found)) if found else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], batch["digest"], signed(names[0]), signed(names[1]), lists], ["doc_id", "key", "digest", "set_hi", "set_lo", "bands"])
        release()

    return docs.select("doc_id", "key", "digest", "text").mapInArrow(run, "doc_id long, key long, digest long, set_hi long, set_lo long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b), root the smallest node.

    First every node keeps one edge, to its smallest neighbour below it; its other
    neighbours below are tied to that one instead, an edge that it shares with all nodes
    that have the same two: stars with several centres, or the same links found in many
    places, shrink to about an edge a node. Then, each round, every node takes the
    smallest root among itself and its neighbours, and then its root's root; rounds end
    when nothing changes."""
    lower = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    kept = lower.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("below"))
    own, tied = F.struct("a", F.col("least").alias("b")), F.transform(F.array_except("below", F.array("least")), lambda x: F.struct(x.alias("a"), F.col("least").alias("b")))
    few = staged(kept.select(F.explode(F.concat(F.array(own), tied)).alias("e")).select("e.*").distinct(), "few")
    both = staged(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    roots = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        lower = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a root that has moved pulls the nodes behind it along
        # (written, so that the join on a root of many nodes can be split)
        moved = staged(lower.where("root < old").groupBy(F.col("old").alias("was")).agg(F.min("root").alias("now")), "moved")
        hopped = lower.join(moved, F.col("root") == F.col("was"), "left").select("node", "old", F.least("root", F.coalesce("now", "root")).alias("root"))
        jump = staged(hopped, "roots")
        above = jump.select(F.col("node").alias("up"), F.col("root").alias("top"))
        roots = staged(jump.join(above, jump["root"] == above["up"], "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "roots")
        if roots.where("root <> old").isEmpty():
            return roots.select("node", "root")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles for each pair of sets, by blocks of shingles."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    lo = np.repeat(np.arange(len(left)), [len(x) for x in left])
    ro = np.repeat(np.arange(len(right)), [len(x) for x in right])

    def places(values, owners):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owners[hit][order]

    if not len(shared):
        return out
    (lc, lo), (rc, ro) = places(lv, lo), places(rv, ro)
    for c in range(0, len(shared), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        s = slice(*np.searchsorted(lc, [c, c + COLUMNS]))
        x[lo[s], lc[s] - c] = 1
        s = slice(*np.searchsorted(rc, [c, c + COLUMNS]))
        y[ro[s], rc[s] - c] = 1
        out += x @ y.T
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j) over n documents."""
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i, j in pairs.tolist():
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))
    return edges


def _verify(threshold: float):
    """One pair of blocks: link counts of its documents and a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "key"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        sizes, keys, copies = np.array([len(x) for x in sets], np.float64), pdf["key"].to_numpy(), pdf["copies"].to_numpy()
        own = (pdf["block"] == pdf["low"]).to_numpy()
        n, m = len(sets), int(own.sum())
        same = (pdf["low"].iloc[0] == pdf["high"].iloc[0]) if n else True
        a, b = (range(n), range(n)) if same else (range(m), range(m, n))
        common = _common([sets[i] for i in a], [sets[j] for j in b])
        total = sizes[list(a)][:, None] + sizes[list(b)][None, :] - common
        linked = common >= threshold * total - 1e-9
        if same:
            np.fill_diagonal(linked, False)
        texts, documents = np.zeros(n, np.int64), np.zeros(n, np.int64)
        texts[list(a)] += linked.sum(axis=1)
        documents[list(a)] += linked @ copies[list(b)]
        if not same:
            texts[list(b)] += linked.sum(axis=0)
            documents[list(b)] += linked.T @ copies[list(a)]
        i, j = np.nonzero(np.triu(linked) if same else linked)
        edges = _forest(n, np.stack([i + a.start, j + b.start], axis=1))
        hit = np.flatnonzero(texts)
        if sizes.sum() > BLOCK_SHINGLES:
            del common, total, linked
            release()
        return pd.DataFrame(
            {
                "key": np.concatenate([keys[hit], keys[[e[0] for e in edges]]]).astype("int64"),
                "other": np.concatenate([keys[hit], keys[[e[1] for e in edges]]]).astype("int64"),
                "texts": np.concatenate([texts[hit], np.zeros(len(edges))]).astype("int64"),
                "documents": np.concatenate([documents[hit], np.zeros(len(edges))]).astype("int64"),
            }
        )

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class),
    n_links (other documents whose shingle sets have a Jaccard similarity of
    ``threshold`` or more, copies counted), n_texts (the different sets among them),
    copies (documents with the same set, itself included).

    Classes are the connected components of the links. Documents without words
    (null or white text) have the empty set and are copies of each other. A null
    doc_id counts as the largest id; class_id is null where no document of the class
    has an id. Rows that share a doc_id, or have none, are documents of their own, each
    in the class of its own text. Extra columns are ignored; empty tables give no rows.
    """
    return _classified(docs, words, threshold, recall, rows).select("doc_id", F.when(F.col("first.key") != NULL_ID, F.col("first.key")).alias("class_id"), "n_links", "n_texts", "copies")


def first_rows(docs: DataFrame) -> DataFrame:
    """(key, digest) of the document that stands for each class: the smallest doc_id (null
    the largest) and, where that has several texts, the smallest digest of the text."""
    found = _classified(docs, WORDS, THRESHOLD, RECALL, ROWS)
    return found.where((F.col("key") == F.col("first.key")) & (F.col("digest") == F.col("first.digest"))).select("key", "digest").distinct()


def digest_of(text):
    return F.xxhash64(text.cast("string"))


def _classified(docs: DataFrame, words: int, threshold: float, recall: float, rows: int) -> DataFrame:
    """(doc_id, key, digest, first, n_links, n_texts, copies); first is the struct (key,
    digest) of the document that stands for the class."""
    base = with_key(docs).withColumn("digest", digest_of(F.col("text")))
    found = staged(signatures(base, words, bands_for(threshold, recall, rows), rows), "signatures")
    # written first: a join of two plain shuffles is one that can be split where a set is hot
    one = F.min(F.struct("key", "digest", "bands"))
    classes = staged(found.groupBy("set_hi", "set_lo").agg(one.alias("one"), F.count(F.lit(1)).alias("copies")).select("set_hi", "set_lo", F.struct("one.key", "one.digest").alias("rep"), "copies", "one.bands"), "classes")
    members = staged(found.select("doc_id", "key", "digest", "set_hi", "set_lo").join(classes.drop("bands"), ["set_hi", "set_lo"]).select("doc_id", "key", "digest", F.col("set_hi").alias("set"), "rep", "copies"), "members")
    reps = classes.select(F.col("set_hi").alias("key"), "rep", "copies")
    banded = classes.select(F.col("set_hi").alias("key"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("band", "first")
    edges = banded.join(buckets, "band").where("key > first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
    pools = components(edges)
    blocks = staged(_blocks(pools, base, reps, words), "blocks")
    counts = staged(_pairs_of_blocks(blocks, threshold).groupBy("pool", "low", "high").applyInPandas(_verify(threshold), "key long, other long, texts long, documents long"), "links")
    links = counts.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = components(counts.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")))
    roots = staged(roots.withColumnRenamed("node", "key"), "roots")
    names = staged(roots.join(reps, "key").groupBy("root").agg(F.min("rep").alias("first")), "names")
    linked = staged(links.join(roots, "key").join(names, "root").select(F.col("key").alias("set"), "first", "documents", "texts"), "linked")
    return members.join(linked, "set", "left").select(
        "doc_id",
        "key",
        "digest",
        F.coalesce("first", "rep").alias("first"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
        "copies",
    )


def _blocks(pools: DataFrame, base: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(pool, block, smallest, largest, key, copies, shingles) of all representatives
    that have candidates. Blocks follow set size, about BLOCK documents
    or BLOCK_SHINGLES shingles each."""

    def sets(batches):
        for batch in batches:
            own = [b""] * batch.num_rows
            size = [0] * batch.num_rows
            for i, x in _sets(batch, words):
                own[i], size[i] = x.tobytes(), len(x)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["pool"], batch["copies"], pa.array(size, pa.int64()), pa.array(own, pa.binary())], ["key", "pool", "copies", "size", "shingles"])
        release()

    wanted = pools.select(F.col("node").alias("key"), F.col("root").alias("pool")).join(reps, "key").select("pool", "copies", F.col("key").alias("set"), F.col("rep.key").alias("key"), F.col("rep.digest").alias("digest"))
    # id and text: rows of the same id and another text aren't taken; equal rows are one
    texts = base.join(wanted, ["key", "digest"]).select(F.col("set").alias("key"), "pool", "copies", "text")
    with_sets = staged(texts.mapInArrow(sets, "key long, pool long, copies long, size long, shingles binary").dropDuplicates(["key"]), "sets")
    sizes = with_sets.groupBy("pool", "size").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("pool").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # blocks that all documents of one size need, by documents and by shingles
    need = F.col("n") * F.greatest(F.lit(1.0 / BLOCK), F.col("size") / F.lit(float(BLOCK_SHINGLES)))
    # per pool a row for each set size; a size with many documents is cut by hash
    starts = sizes.withColumn("need", need).select(
        "pool",
        "size",
        "need",
        F.ceil("need").cast("int").alias("cuts"),
        F.floor(F.coalesce(F.sum("need").over(before), F.lit(0.0))).alias("small_block"),
    )
    placed = with_sets.join(starts, ["pool", "size"])
    # small sizes share block numbers by running need, large ones have their own
    number = F.when(F.col("need") > 1, F.concat_ws("-", F.lit("b"), F.col("size"), F.pmod(F.xxhash64("key"), F.col("cuts")))).otherwise(F.concat_ws("-", F.lit("s"), F.col("small_block")))
    return placed.select("pool", number.alias("block"), "size", "key", "copies", "shingles")


def _pairs_of_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """Each document once for every pair of blocks that its own belongs to."""
    spans = staged(blocks.groupBy("pool", "block").agg(F.min("size").alias("least"), F.max("size").alias("most")), "spans")
    a = spans.select("pool", F.col("block").alias("low"), F.col("least").alias("l1"), F.col("most").alias("m1"))
    b = spans.select("pool", F.col("block").alias("high"), F.col("least").alias("l2"), F.col("most").alias("m2"))
    reach = (F.col("m1") >= threshold * F.col("l2")) & (F.col("m2") >= threshold * F.col("l1"))
    pairs = staged(a.join(b, "pool").where((F.col("low") <= F.col("high")) & reach).select("pool", "low", "high"), "pairs")
    sides = pairs.select("pool", "low", "high", F.col("low").alias("block")).unionByName(pairs.where("low <> high").select("pool", "low", "high", F.col("high").alias("block")))
    return blocks.join(sides, ["pool", "block"]).select("pool", "low", "high", "block", "key", "copies", "shingles")


#: Every pair of shingle sets that share a shingle, without bands; the empty set is the
#: set of one empty shingle.
OP7_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM d),
named AS (SELECT doc_id, s, md5(array_to_string(s, chr(10))) AS k FROM own),
class AS (SELECT k, any_value(s) AS s, min(doc_id) AS first, count(*) AS copies FROM named GROUP BY k),
sh AS (SELECT k, len(s) AS n, unnest(s) AS g FROM class),
link AS (SELECT a.k AS a, b.k AS b FROM sh a JOIN sh b ON a.g = b.g AND a.k <> b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT k, k FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT reach.a AS k, min(first) AS class_id FROM reach JOIN class ON reach.b = class.k GROUP BY reach.a),
counted AS (SELECT a AS k, sum(copies) AS documents, count(*) AS texts FROM link JOIN class ON b = k GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(documents, 0) + copies - 1 AS BIGINT) AS n_links, coalesce(texts, 0) AS n_texts, copies FROM named JOIN class USING (k) JOIN root USING (k) LEFT JOIN counted USING (k)"""


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
