"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over the whole training corpus are quantised on a
log scale; a word or pair of level q is put into a Bloom filter q times, with the
numbers 1 to q. A worker that holds the filter finds a count by probing with 1, 2,
... until a probe fails. Pair probabilities are smoothed towards word probabilities
(Dirichlet prior), word probabilities as in the base score.

The filter grows with the distinct words and pairs, those seen once included: it is
made in parts by the first bits of the fingerprint, each with ``BITS`` bits an entry
or more, and no part is ever on the driver. Whole texts are tokenised once, into
chunks of numbered words; counting, probing and scoring read the chunks. A chunk
sends its distinct words and pairs to the segments of the filter (a run of parts
each), and their levels come back to it. A segment that is asked for much is dealt in
pieces, each with the segment's parts, so that no task holds all that a segment is
asked for.

Beside its bits a part holds the exact counts of its words, named by 96-bit hashes;
they answer the base score along the same way.
"""

from __future__ import annotations

import gc
import math
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import chunk_words_by, id_fold, mix, release, small_batches, staged, texts_of

#: Bytes of text in a chunk (a longer text is a chunk of its own): more tokens share
#: the probes of their words. N-grams that a task counts before it gives them out.
CHUNK, COUNTED = 1 << 23, 1 << 22
BITS, PROBES, BASE, PRIOR = 8, 4, 1.5, 1000.0
#: Segments are 2**SEGMENT_BITS until one would stand for more than SEGMENT_TOKENS; a
#: part stands for PART_TOKENS; a piece of a segment answers chunks of PIECE_TOKENS.
SEGMENT_BITS, SEGMENT_TOKENS, PART_TOKENS, PIECE_TOKENS = 6, 1 << 25, 1 << 21, 1 << 28
MAX_SEGMENT_BITS, MAX_PART_BITS = 14, 20
#: Counts go to 2**COARSE_BITS parts at once; more parts are cut in a second step, so
#: that what a task gives out never falls into very many small rows.
COARSE_BITS = 10
#: Fingerprints probed at once in a segment.
PROBED = 1 << 20
_FINGERPRINT = 48
_UPPER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
_START = np.uint64(0x5354415254)
#: The 96 bits that name the end token.
_END = (np.uint64(0x454E44), np.uint32(0x444E45))


def lowered(texts: list[bytes]) -> list[bytes]:
    return [x.translate(_UPPER) for x in texts]


# ------------------------------------------------------------- packed numbers


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the greatest needs: the width, then byte
    planes, which compress well where neighbours are alike."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    """uint64 numbers of _pack."""
    if not blob:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob), dtype=np.uint64)


# ------------------------------------------------------ fingerprints of n-grams


def _word_prints(words: np.ndarray) -> np.ndarray:
    """Fingerprints of words by their first 64 bits; the last bit tells pairs from words.
    They rise with the hash, so that a chunk's words are in segments in their order."""
    return (words >> np.uint64(64 - _FINGERPRINT)) & ~np.uint64(1)


def _pair_prints(words: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each token with the one before it in its text."""
    here = words[tokens]
    before = np.concatenate([[_START], here[:-1]])
    before[first[:-1]] = _START
    return (mix(here ^ mix(before * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - _FINGERPRINT)) | np.uint64(1)


def _bounds(prints: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of sorted fingerprints begins and ends."""
    return np.searchsorted(prints, np.arange(1 << bits, dtype=np.uint64) << np.uint64(_FINGERPRINT - bits)).tolist() + [len(prints)]


# ---------------------------------------------------------------------- chunks

_CHUNK = "chunk long, n_tokens long, ids binary, flags binary, sizes binary, hi binary, lo binary, tokens binary"


def chunks_of(rows: DataFrame) -> DataFrame:
    """Documents (doc_id, held_out, text) as chunks: the ids (8 bytes each), a flag byte
    each (1: has an id, 2: held out) and numbers of tokens; the distinct words as hashes
    of 64 and 32 bits, sorted by the first, and which of them each token is. ``chunk`` names
    a chunk within one run: to be staged."""
    from pyspark import TaskContext

    def chunk(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        (high, low), cut = chunk_words_by(texts, (0, 1))
        n = np.diff(cut)
        first = np.concatenate([[0], np.cumsum(n + 1)])
        at = np.arange(len(high)) + np.repeat(np.arange(len(n)), n)
        tokens = np.full(first[-1], _END[0], np.uint64)
        tokens[at] = high
        words, where, which = np.unique(tokens, return_index=True, return_inverse=True)
        second = np.full(first[-1], _END[1], np.uint32)
        second[at] = low >> np.uint64(32)
        if (second[where][which] != second).any():
            raise RuntimeError("two words of one chunk share the first 64 bits of their hash")
        blobs = (
            np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([(i is not None) + 2 * bool(h) for i, h in zip(ids, held, strict=True)], np.uint8).tobytes(),
            _pack(np.diff(first)),
            _pack_sorted(words),
            second[where].tobytes(),
            _pack(which),
        )
        names = ["chunk", "n_tokens", "ids", "flags", "sizes", "hi", "lo", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(tokens)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), lowered(texts_of(batch["text"])), strict=True):
                if size and size + len(text) > CHUNK:
                    yield chunk(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(text)
                size += len(text) + 1
        if texts:
            yield chunk(number, ids, held, texts)
        release()

    return rows.mapInArrow(run, _CHUNK)


class Chunk:
    """What counting, probing and scoring read of a chunk."""

    def __init__(self, sizes: bytes, hi: bytes, lo: bytes, tokens: bytes):
        self.first = np.concatenate([[0], np.cumsum(_unpack(sizes).astype(np.int64))])
        self.hi, self.lo = _unpack_sorted(hi), np.frombuffer(lo, np.uint32)
        self.tokens = _unpack(tokens).astype(np.int64)
        self.pairs = _pair_prints(self.hi, self.tokens, self.first)


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


# ------------------------------------------------------------------ the filter


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (given as columns, the first the main one), sorted, with the sums of
    their counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, counts = [k[order] for k in keys], counts[order]
    new = np.zeros(len(counts), np.bool_)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts, at) if len(at) else counts


def filter_parts(chunks: DataFrame, part_bits: int) -> DataFrame:
    """(part, n_words, n, bits, hi, lo, counts): the filter of the training counts over
    the whole corpus, all words and pairs included, and the exact counts of the words.
    A part has as many bits as its own entries need."""
    schema = {"part": pa.int32(), "hi": pa.binary(), "lo": pa.binary(), "n": pa.binary(), "prints": pa.binary(), "times": pa.binary()}

    def parts(gathered: list[tuple], bits: int) -> pa.RecordBatch:
        hi, lo, n, prints, times = map(np.concatenate, zip(*gathered, strict=True))
        (hi, lo), n = summed([hi, lo], n)
        (prints,), times = summed([prints], times)
        of_words, of_pairs = _bounds(_word_prints(hi), bits), _bounds(prints, bits)
        rows = []
        for k in range(1 << bits):
            a, b, c, d = *of_words[k : k + 2], *of_pairs[k : k + 2]
            if b > a or d > c:
                rows.append((k, _pack_sorted(hi[a:b]), lo[a:b].tobytes(), _pack(n[a:b]), _pack_sorted(prints[c:d]), _pack(times[c:d])))
        return _rows(schema, rows)

    def run(batches):
        gathered: list[tuple] = []
        size = 0
        for batch in batches:
            for flags, *blobs in zip(*(batch[c].to_pylist() for c in ("flags", "sizes", "hi", "lo", "tokens")), strict=True):
                c = Chunk(*blobs)
                learned = np.repeat(np.frombuffer(flags, np.uint8) & 2 == 0, np.diff(c.first))
                n = np.bincount(c.tokens[learned], minlength=len(c.hi))
                seen = n > 0
                prints, times = np.unique(c.pairs[learned], return_counts=True)
                gathered.append((c.hi[seen], c.lo[seen], n[seen], prints, times))
                size += len(prints) + int(seen.sum())
                if size > COUNTED:
                    yield parts(gathered, coarse)
                    gathered, size = [], 0
        if size:
            yield parts(gathered, coarse)
        release()

    def refine(batches):
        gathered: list[tuple] = []
        size = 0
        for batch in batches:
            for hi, lo, n, prints, times in zip(*(batch[c].to_pylist() for c in list(schema)[1:]), strict=True):
                gathered.append((_unpack_sorted(hi), np.frombuffer(lo, np.uint32), _unpack(n), _unpack_sorted(prints), _unpack(times)))
                size += len(gathered[-1][0]) + len(gathered[-1][3])
                if size > COUNTED:
                    yield parts(gathered, part_bits)
                    gathered, size = [], 0
        if size:
            yield parts(gathered, part_bits)
        release()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, f: np.concatenate([f(x) for x in pdf[c]])
        (hi, lo), n = summed([join("hi", _unpack_sorted), join("lo", lambda x: np.frombuffer(x, np.uint32))], join("n", _unpack))
        (pairs,), times = summed([join("prints", _unpack_sorted)], join("times", _unpack))
        # words that share a fingerprint (47 of their 96 bits) count together in the filter
        (words,), together = summed([_word_prints(hi)], n) if len(hi) else ([hi], n)
        bits = part_of(np.concatenate([words, pairs]), levels_of(np.concatenate([together, times]), 1))
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n_words": [len(hi)], "n": [int(n.sum())], "bits": [bits.tobytes()], "hi": [_pack_sorted(hi)], "lo": [lo.tobytes()], "counts": [_pack(n)]})

    kinds = ", ".join(f"{c} {'int' if c == 'part' else 'binary'}" for c in schema)
    coarse = min(part_bits, COARSE_BITS)
    counted = chunks.select("flags", "sizes", "hi", "lo", "tokens").mapInArrow(run, kinds)
    if part_bits > coarse:
        counted = counted.repartition("part").mapInArrow(refine, kinds)
    return counted.groupBy("part").applyInPandas(merge, "part int, n_words long, n long, bits binary, hi binary, lo binary, counts binary")


def part_of(prints: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A part of the filter as bytes, for distinct fingerprints and their levels."""
    size = 1 << math.ceil(math.log2(max(64, int(levels.sum()) * BITS)))
    bits = np.zeros(size, np.bool_)
    for level in range(1, int(levels.max(initial=0)) + 1):
        bits[CountFilter.places(prints[levels >= level], level, size).ravel()] = True
    return np.packbits(bits, bitorder="little")


def levels_of(counts: np.ndarray, first: int) -> np.ndarray:
    """Level of a count: 0 under ``first``, then one more for each factor BASE."""
    counts = counts.astype(np.float64)
    safe = np.maximum(counts, first) / first
    return np.where(counts >= first, 1 + np.floor(np.log(safe) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def count_of(levels: np.ndarray, first: int) -> np.ndarray:
    """The middle of the whole counts of a level; 0 for level 0."""
    low = np.ceil(first * BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(first * BASE ** levels.astype(float) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


class CountFilter:
    """A Bloom filter in parts chosen by the first ``part_bits`` of the fingerprint: all
    of them, or an aligned run of a power of two. Each has its own size, a power of two."""

    def __init__(self, parts, first_word: int = 1, first_pair: int = 1, part_bits: int = 8):
        widths = np.array([len(x) for x in parts], np.int64)
        self.bits, self.starts, self.masks = np.concatenate(list(parts)), np.cumsum(widths) - widths, (widths * 8 - 1).astype(np.uint64)
        self.first_word, self.first_pair, self.part_bits = first_word, first_pair, part_bits

    @staticmethod
    def _halves(prints: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(prints * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1342543DE82EF95 % 2**64))
        return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)

    @staticmethod
    def places(prints: np.ndarray, level: int, size: int) -> np.ndarray:
        """Bit numbers (PROBES x n) inside the fingerprint's segment of ``size`` bits, a
        power of two."""
        a, b = CountFilter._halves(prints, level)
        return np.stack([(a + np.uint64(i) * b) & np.uint64(size - 1) for i in range(PROBES)])

    def levels(self, prints: np.ndarray) -> np.ndarray:
        """The greatest q such that the probes for 1..q all succeed; a probe ends at its
        first bit that isn't set."""
        part = (prints >> np.uint64(_FINGERPRINT - self.part_bits)).astype(np.int64) & (len(self.starts) - 1)
        start, mask = self.starts[part], self.masks[part]
        out = np.zeros(len(prints), np.int64)
        alive, level = np.arange(len(prints)), 1
        while len(alive):
            a, b = self._halves(prints[alive], level)
            for _ in range(PROBES):
                at = a & mask[alive]
                hit = np.flatnonzero(self.bits[start[alive] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if len(hit) < len(alive):
                    alive, a, b = alive[hit], a[hit], b[hit]
                a = a + b
            out[alive] = level
            level += 1
        return out


# --------------------------------------------------------------------- scoring


def exact_counts(hi: np.ndarray, lo: np.ndarray, of_hi: np.ndarray, of_lo: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of words (hi, lo) from a table sorted by hi, then lo; 0 for others."""
    out = np.zeros(len(hi), np.int64)
    at, left = np.searchsorted(of_hi, hi), np.arange(len(hi))
    while len(left):  # one round, but for words that share their first 64 bits
        inside = at < len(of_hi)
        inside[inside] = of_hi[at[inside]] == hi[left[inside]]
        at, left = at[inside], left[inside]
        hit = of_lo[at] == lo[left]
        out[left[hit]] = counts[at[hit]]
        at, left = at[~hit] + 1, left[~hit]
    return out


def _probes(chunks: DataFrame, segment_bits: int) -> DataFrame:
    """(chunk, segment, hi, lo, prints): the distinct words and pairs of each chunk that
    a segment is asked for, sorted."""
    schema = {"chunk": pa.int64(), "segment": pa.int32(), "hi": pa.binary(), "lo": pa.binary(), "prints": pa.binary()}

    def run(batches):
        for batch in batches:
            for chunk, *blobs in zip(*(batch[c].to_pylist() for c in ("chunk", "sizes", "hi", "lo", "tokens")), strict=True):
                c = Chunk(*blobs)
                prints = np.unique(c.pairs)
                of_words, of_pairs = _bounds(_word_prints(c.hi), segment_bits), _bounds(prints, segment_bits)
                rows = []
                for k in range(1 << segment_bits):
                    a, b, e, f = *of_words[k : k + 2], *of_pairs[k : k + 2]
                    if b > a or f > e:
                        rows.append((chunk, k, _pack_sorted(c.hi[a:b]), c.lo[a:b].tobytes(), _pack_sorted(prints[e:f])))
                yield _rows(schema, rows)
        release()

    return chunks.select("chunk", "sizes", "hi", "lo", "tokens").mapInArrow(run, "chunk long, segment int, hi binary, lo binary, prints binary")


def _answers(probes: DataFrame, parts: DataFrame, part_bits: int, segment_bits: int, pieces: int) -> DataFrame:
    """(chunk, segment, counts, words, pairs) of the probes, in their order: exact counts
    and levels of the words, levels of the pairs."""
    run_of = 1 << (part_bits - segment_bits)

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        bits = [np.zeros(8, np.uint8)] * run_of
        for part, x in zip(own["part"], own["bits"], strict=True):
            bits[part % run_of] = np.frombuffer(x, np.uint8)
        model = CountFilter(bits, part_bits=part_bits)
        table = np.concatenate([np.zeros(0, np.uint64), *map(_unpack_sorted, own["hi"])]), np.frombuffer(b"".join(own["lo"]), np.uint32)
        counts = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x) for x in own["counts"])]).astype(np.int64)
        out: list[tuple] = []
        waiting: list[tuple] = []

        def probe():
            hi, lo, prints = (np.concatenate([w[i] for w in waiting]) for i in range(3))
            sizes = np.cumsum([[len(w[0]), len(w[2])] for w in waiting], axis=0)[:-1].T
            found = exact_counts(hi, lo, *table, counts), model.levels(_word_prints(hi)).astype(np.uint8), model.levels(prints).astype(np.uint8)
            for exact, words, pairs in zip(*(np.split(x, s) for x, s in zip(found, (sizes[0], sizes[0], sizes[1]), strict=True)), strict=True):
                out.append((_pack(exact), words.tobytes(), pairs.tobytes()))
            waiting.clear()

        size = 0
        for hi, lo, prints in zip(asked["hi"], asked["lo"], asked["prints"], strict=True):
            waiting.append((_unpack_sorted(hi), np.frombuffer(lo, np.uint32), _unpack_sorted(prints)))
            size += len(waiting[-1][0]) + len(waiting[-1][2])
            if size > PROBED:
                probe()
                size = 0
        if waiting:
            probe()
        release()
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pd.DataFrame({"chunk": asked["chunk"], "segment": asked["segment"], "counts": columns[0], "words": columns[1], "pairs": columns[2]})

    placed = parts.select(F.shiftright("part", part_bits - segment_bits).alias("segment"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), "part", "bits", "hi", "lo", "counts")
    dealt = probes.withColumn("piece", F.pmod(F.xxhash64("chunk"), F.lit(pieces)).cast("int"))
    return placed.groupBy("segment", "piece").cogroup(dealt.groupBy("segment", "piece")).applyInPandas(run, "chunk long, segment int, counts binary, words binary, pairs binary")


def model_scores(chunks: DataFrame, answers: DataFrame, total: int, distinct: int, n_docs: int, prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of each document."""
    mass = total + 0.5 * (distinct + 1)

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            raise RuntimeError("answers without their chunk")
        r = own.iloc[0]
        c = Chunk(r["sizes"], r["hi"], r["lo"], r["tokens"])
        found = answers.sort_values("segment")
        exact = np.concatenate([_unpack(x) for x in found["counts"]]).astype(np.int64)
        level = np.concatenate([np.frombuffer(x, np.uint8) for x in found["words"]]).astype(np.int64)
        pair_level = np.concatenate([np.frombuffer(x, np.uint8) for x in found["pairs"]]).astype(np.int64)
        prints, which = np.unique(c.pairs, return_inverse=True)
        if len(exact) != len(c.hi) or len(pair_level) != len(prints):
            raise RuntimeError(f"{len(c.hi)} words and {len(prints)} pairs asked, {len(exact)} and {len(pair_level)} answered")
        word, pair = count_of(level, 1)[c.tokens], count_of(pair_level, 1)[which]
        context = np.concatenate([[0.0], word[:-1]])
        context[c.first[:-1]] = n_docs
        p = (np.minimum(pair, context) + prior * (word + 0.5) / mass) / (context + prior)
        per_text = lambda x: np.add.reduceat(x, c.first[:-1])
        flags = np.frombuffer(r["flags"], np.uint8)
        ids = [int(i) if f & 1 else None for i, f in zip(np.frombuffer(r["ids"], np.int64), flags, strict=True)]
        out = pd.DataFrame(
            {
                "doc_id": pd.array(ids, "Int64"),
                "held_out": flags & 2 > 0,
                "n_tokens": np.diff(c.first),
                "n_known": per_text((exact > 0).astype(np.int64)[c.tokens]),
                "base_score": per_text(np.log10((exact + 0.5) / mass)[c.tokens]),
                "score": per_text(np.log10(np.minimum(p, 1.0))),
            }
        )
        del c, word, pair, context, p, which
        release()
        return out

    return chunks.drop("n_tokens").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def _release(spark) -> None:
    """Shuffle files of steps that have ended stay on disk until the driver's JVM
    collects its garbage; here that is the shuffles of the counts and of the probes."""
    for _ in range(2):  # the second round finds what the first one's clean-up let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def score_corpus(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Learns from documents whose crc32 of the id modulo 5 is not 1; null ids count as
    '' for the fold. Null and empty texts are the end token alone. Repeated rows each
    give a row and each count in training; ties have no order to break. A text longer
    than a chunk is a chunk of its own, and one task holds it. An empty corpus gives no
    rows; with no training rows every count is 0. Extra columns are ignored.
    """
    rows = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), (id_fold(docs["doc_id"].cast("long"), 5) == 1).alias("held_out"), docs["text"].cast("string").alias("text"))
    chunks = staged(chunks_of(rows), "chunks")
    tokens = int(chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"])
    bits_for = lambda each: math.ceil(math.log2(max(1, tokens) / each))
    segment_bits = min(MAX_SEGMENT_BITS, max(SEGMENT_BITS, bits_for(SEGMENT_TOKENS)))
    part_bits = min(MAX_PART_BITS, max(segment_bits, bits_for(PART_TOKENS)))
    parts = staged(filter_parts(chunks, part_bits), "filter")
    _release(docs.sparkSession)
    of_end = int(_word_prints(np.array([_END[0]]))[0]) >> (_FINGERPRINT - part_bits)
    seen = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("v")).first()
    n_docs = _end_count(parts.where(F.col("part") == of_end))
    pieces = max(1, math.ceil(tokens / (PIECE_TOKENS << segment_bits)))
    answers = staged(_answers(_probes(chunks, segment_bits), parts, part_bits, segment_bits, pieces), "answers")
    _release(docs.sparkSession)
    scored = model_scores(chunks, answers, int(seen["n"]), int(seen["v"]), n_docs, prior)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(seen["n"])).cast("long").alias("train_tokens"), "base_score", "score")


def _end_count(part: DataFrame) -> int:
    """Training documents: the exact count of the end token, from the part that holds it."""

    def run(batches):
        for batch in batches:
            for hi, lo, counts in zip(*(batch[c].to_pylist() for c in ("hi", "lo", "counts")), strict=True):
                n = exact_counts(np.array([_END[0]]), np.array([_END[1]]), _unpack_sorted(hi), np.frombuffer(lo, np.uint32), _unpack(counts).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(n)], ["n"])

    return sum(r["n"] for r in part.select("hi", "lo", "counts").mapInArrow(run, "n long").collect())


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
