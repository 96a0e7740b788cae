"""Helpers shared by the operators of this subpackage: staging of intermediate
tables, and vectorised word hashing over Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text, which is exactly how
``bytes.split()`` cuts; a null text has no words.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator: a null id counts as the largest.
NULL_ID = 2**63 - 1
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 1000
CHUNK_BYTES = 1 << 20
#: Bytes hashed at once: the arrays of one block stay in the processor's cache.
BLOCK_BYTES = 1 << 18
#: Bytes that the Parquet writer of a staged table gathers before it writes them out.
ROW_GROUP_BYTES = 1 << 25

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session, or a temporary one where that is unset in local mode (tests). On a
    cluster it must be set: executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="ophelion-")
    return _own_dir[app]


def _drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder and reads it back.

    This cuts the lineage with files that outlive any executor. The table is
    removed when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}/{name}"
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    atexit.register(_drop_path, spark, path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, in a session whose Arrow batches have ARROW_ROWS rows at most.

    Texts are long: the default of 10,000 rows a batch holds tens of MB in the JVM and
    again in each Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def with_key(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, ``key`` (never null) and text, without any other column."""
    doc_id = docs["doc_id"].cast("long")
    return small_batches(docs).select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(NULL_ID)).alias("key"),
        docs["text"].cast("string").alias("text"),
        *(docs[c] for c in more),
    )


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --------------------------------------------------------------- numpy side


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.ones(256, np.bool_)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
#: Odd multipliers of the rolling hashes and their inverses modulo 2**64.
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BLOCK_BYTES:  # what longer ranges need isn't kept
            _powers[base] = have
    return have[:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each range [start, end) of ``values`` (uint64), equal for equal contents."""
    base = _BASES[which]
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on
    between tasks, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(batches: Iterator) -> Iterator:
    """The items of an iterator, with ``release`` at its end."""
    yield from batches
    release()


def word_hashes(data: bytes, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its 64-bit hash). Works in blocks cut at white space."""
    starts, hashes = word_hashes_by(data, (which,))
    return starts, hashes[0]


def word_hashes_by(data: bytes, which: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(start of each word, for each of ``which`` a 64-bit hash)."""
    whole = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(whole):
        end = min(len(whole), at + BLOCK_BYTES)
        while end < len(whole):  # never cut a word; a giant word makes the block longer
            gaps = np.flatnonzero(~_IS_WORD[whole[end : end + BLOCK_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(whole), end + BLOCK_BYTES)
        block = whole[at:end]
        flags = np.zeros(len(block) + 2, np.int8)
        flags[1:-1] = _IS_WORD[block]
        edges = np.flatnonzero(np.diff(flags))
        s, e = edges[0::2], edges[1::2]
        starts.append(s + at)
        values = _BYTE[block]
        hashes.append([rolling(values, s, e, k) for k in which])
        at = end
    if not starts:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in which]
    return np.concatenate(starts), [np.concatenate(x) for x in zip(*hashes, strict=True)]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes, one row at least."""
    first = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


def chunk_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry ends the last)."""
    hashes, cut = chunk_words_by(texts, (0,))
    return hashes[0], cut


def chunk_words_by(texts: list[bytes], which: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The same for each hash of ``which``."""
    starts, hashes = word_hashes_by(b"\n".join(texts), which)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(starts, bounds)
    cut[-1] = len(starts)
    return hashes, cut


def windows(hashes: np.ndarray, cut: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each run of ``size`` words that lies inside one text."""
    n = np.diff(cut)
    room = np.maximum(n - size + 1, 0)
    at = np.repeat(cut[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    return at, rolling(hashes, at, at + size, which)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
