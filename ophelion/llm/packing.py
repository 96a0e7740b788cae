"""Best-fit packing of tokenised documents by minimum bin slack.

Texts become token ids in the executors. What the packing depends on is only how
many pieces there are of each length, a table of at most ``capacity`` rows, so the
plan is made once on the driver whatever the size of the corpus: per bin, a bitset
dynamic programme over the available lengths finds the fullest feasible
combination, which is removed as often as it is available. The plan then goes back
as ranges of ranks within each length, and pieces are ranked in parallel (ranges of
a hash per length, so that a length held by many copies is no hot task).
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import release, small_batches, staged, texts_of

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that a range of ranks should hold.
RANGE_PIECES = 1 << 10
#: Bounds of the caches of one Python worker (about 80 MB each), emptied after its task.
#: A full half becomes the older one and what was older goes, so frequent words stay.
WORDS_KEPT, PIECES_KEPT = 400_000, 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of texts, word by word with a bounded cache.

    The tokenizer drops white space and never joins across it, so ids of a text are
    the ids of its words in order. Words of common letters (below U+0250, where NFC
    changes nothing) are cut by the tokenizer's own pattern and looked up piece by
    piece; any other word, and any that holds a special token's text, goes through
    the whole tokenizer.
    """

    #: Fixed value: the pre-tokenizer's pattern in the tokenizer's file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(self.PATTERN).findall
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # how the byte-level alphabet shows each byte that occurs in common letters
        self.shown = shown.pre_tokenize_str
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.older_pieces.get(piece)
            if got is None:
                alphabet = piece if piece.isascii() else self.shown(piece)[0][0]
                got = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(alphabet)])
            if len(self.pieces) >= PIECES_KEPT // 2:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def _word(self, word: bytes) -> bytes:
        ids = self.older_words.get(word)
        if ids is None:
            ids = self._cut_word(word)
        if len(self.words) >= WORDS_KEPT // 2:
            self.older_words = dict(self.words)
            self.words.clear()  # the dictionary that ``ids`` looks words up in stays the same one
        self.words[word] = ids
        return ids

    def _cut_word(self, word: bytes) -> bytes:
        if word.isalpha():  # letters of ASCII only: one piece, as are other words of letters
            return self._piece(word.lower().decode())
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isprintable() or max(text) < "ɐ" and unicodedata.is_normalized("NFC", text) and text.isprintable():
            low = text.lower()
            if low.isalpha():
                return self._piece(low)
            if "<|" not in text:
                return b"".join([self._piece(x) for x in self.cut(low)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Empties the caches: a worker lives on after its task."""
        for cache in (self.words, self.pieces, self.older_words, self.older_pieces):
            cache.clear()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        get, new = self.words.get, self._word
        return b"".join([get(w) or new(w) for w in text.split()])


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place): the pieces of each document's
    ids, its end id included, cut only where longer than ``capacity``. ``place`` tells
    equal rows apart within one run; to be staged."""
    from pyspark import TaskContext

    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = _tokenizer(path).ids
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(ids, texts_of(batch["text"]), strict=True):
                tokens = memoryview(encode(text) + end)
                n = len(tokens) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = tokens[4 * at : 4 * (at + capacity)]
                    for column, value in zip(out, (doc_id, k, at, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            places = pa.array(np.arange(place, place + len(out[0])))
            place += len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds, strict=True)), places], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])
        _tokenizer(path).forget()
        release()

    rows = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the combination of available lengths that fills ``room``
    as far as possible. Bit i of a state says that i can be filled."""
    mask = (1 << (room + 1)) - 1
    states, used = [1], []
    for length in order:
        if length > room:
            continue
        state, left, step = states[-1], min(counts[length], room // length), 1
        while left:  # bounded copies by binary splitting
            k = min(step, left)
            state |= (state << (length * k)) & mask
            left, step = left - k, step * 2
        states.append(state)
        used.append(length)
        if state >> room & 1:
            break
    at, chosen = states[-1].bit_length() - 1, []
    for length, before in zip(reversed(used), reversed(states[:-1]), strict=True):
        n = 0
        while not before >> at & 1:
            at, n = at - length, n + 1
        if n:
            chosen.append((length, n))
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination, repetitions)] that use up the histogram of lengths. Each bin
    takes the longest length left and the combination that leaves least slack."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    order = sorted(counts, reverse=True)
    bins = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        combination = dict(fullest(counts, [x for x in order if counts[x]], capacity - longest))
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in combination.items())
        bins.append((sorted(combination.items(), reverse=True), times))
        for k, n in combination.items():
            counts[k] -= n * times
        order = [x for x in order if counts[x]]
    return bins


def _places(bins: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """Ranges of ranks within a length, and where they go. At most about
    sqrt(2 * capacity) rows for each combination, whatever the corpus."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for combination, times in bins:
        offset = 0
        for length, n in combination:
            begin = ranks.get(length, 0)
            ranks[length] = begin + n * times
            rows.append((length, begin, ranks[length], n, first, offset))
            offset += length * n
        first += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "each", "first_sequence", "first_offset"]).astype("int64")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32,
    place, which differs between rows).

    A table without rows gives none. A length has as many ranges of ranks as its number
    of pieces needs, and pieces are dealt among them by their place, so neither a common
    length nor copies of one row make a hot range."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = spark.createDataFrame([(k, -(-n // RANGE_PIECES)) for k, n in histogram.items()], "of long, ranges int")
    names = "length long, rank_from long, rank_to long, each long, first_sequence long, first_offset long"
    places = spark.createDataFrame(_places(plan_bins(histogram, capacity)), names)
    # a row for each length, ``capacity`` at most: small enough to broadcast whatever the corpus
    ranged = pieces.join(F.broadcast(ranges), pieces["length"] == F.col("of")).withColumn("range", F.pmod(F.xxhash64("place"), F.col("ranges")).cast("int")).drop("of", "ranges")
    sizes = ranged.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "range").orderBy("place")
    ranked = ranged.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["length", "range"]).withColumn("rank", F.col("before") + F.col("nth"))
    p, r = places.alias("p"), ranked.alias("r")
    step = F.col("r.rank") - F.col("p.rank_from")
    return r.join(F.broadcast(p), (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.rank_from")) & (F.col("r.rank") < F.col("p.rank_to"))).select(
        "r.doc_id",
        "r.piece",
        "r.start",
        "r.length",
        "r.ids_crc32",
        (F.col("p.first_sequence") + F.floor(step / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.first_offset") + (step % F.col("p.each")) * F.col("r.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs all documents; one row per piece.

    Null and empty texts are the end id alone. Rows that share a doc_id, or have
    none, are packed like any other. Extra columns are ignored."""
    return pack(staged(tokenise(docs, tokenizer_path or default_tokenizer(), capacity), "pieces"), capacity)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
