"""Media columns: interleaved document sequences.

A page's HTML becomes an ordered sequence of text and media-reference structs:
``(position, kind, text, digest, caption)``. References name a payload by the
SHA-256 of its bytes (``src="sha256:..."``); a join on the digest resolves them
against a media store, and the result goes back to its position, so captions stay
with their media. The store holds each payload losslessly as an 8-bit grey PNG of
192 samples a row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import release, small_batches, staged, texts_of

WIDTH = 192
_PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def payload_of(text: bytes) -> bytes:
    """Spaces up to a positive multiple of the row width."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """The payload as samples of a grey 8-bit PNG, rows of WIDTH samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG as encode_png writes it; raises ValueError on any other."""
    if not media.startswith(_PNG):
        raise ValueError("not a PNG")
    at, packed, header = len(_PNG), [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if not header or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(header[1], header[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def sample_feature(payload: bytes) -> str:
    """Size, mean, and an average hash of 8 x 8 cells over the samples."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bounds = np.linspace(0, len(samples), 9).astype(int)
    bands = [samples[a : max(b, a + 1)] if a < len(samples) else samples[-1:] for a, b in zip(bounds, bounds[1:], strict=False)]
    cells = np.array([x.reshape(len(x), 8, -1).mean(axis=(0, 2)) for x in bands])
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{WIDTH}x{len(samples)};mean={samples.mean():.3f};ahash={bits}"


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE = frozenset("a abbr b bdi bdo cite code dfn em i kbd mark q s samp small span strong sub sup u var".split())
_MEDIA = frozenset("img video audio source embed".split())


def parse_sequence(html: str | None) -> list[dict]:
    """Text and media references of a page in order. A figure's caption (else the
    reference's alt text) becomes the caption of the media in the figure."""
    items: list[dict] = []
    text: list[str] = []
    figure: list[int] | None = None
    in_caption = False

    def flush():
        nonlocal text
        joined = " ".join(unescape("".join(text)).split())
        text = []
        if not joined:
            return
        if in_caption and figure is not None:
            for i in figure:
                items[i]["caption"] = joined
        else:
            items.append({"position": len(items), "kind": "text", "text": joined, "digest": None, "caption": None})

    at = 0
    html = html or ""
    for m in _TAG.finditer(html):
        text.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name or name in _INLINE:
            continue
        flush()
        if name == "figure":
            figure = None if m[2] else []
        elif name == "figcaption":
            in_caption = not m[2]
        elif name in _MEDIA and not m[2]:
            attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            source = attributes.get("src", "")
            digest = source.removeprefix("sha256:") if source.startswith("sha256:") else hashlib.sha256(source.encode()).hexdigest()
            if figure is not None:
                figure.append(len(items))
            items.append({"position": len(items), "kind": "media", "text": None, "digest": digest, "caption": attributes.get("alt")})
    text.append(html[at:])
    flush()
    return items


def interleave(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``items``, the ordered sequence of each page's html.
    Null html gives an empty sequence."""
    rows = small_batches(pages).select(*keep, pages["html"].cast("string").alias("__html"))
    kept = rows.columns[:-1]
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "caption"))]))

    def run(batches):
        for batch in batches:
            items = pa.array([parse_sequence(x) for x in batch["__html"].to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), items], [*kept, "items"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}items {SEQUENCE}")


def resolve(sequences: DataFrame, store: DataFrame, *keep: str) -> DataFrame:
    """Joins every media reference with the store row of its digest.

    Returns ``keep``, position, caption, digest and the store's other columns (null
    where the store lacks the digest). ``store`` has one row a digest. References
    are small rows; copies of one payload share it, and adaptive execution may split
    a hot digest, as this is a plain equi-join."""
    refs = sequences.select(*keep, F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = refs.select(*keep, "item.position", "item.caption", "item.digest")
    return refs.join(store, "digest", "left")


def media_store(docs: DataFrame) -> DataFrame:
    """Writes the payload of every text to the store: (digest, n_bytes, media), digest
    of the payload; read back from the written files."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # few payloads in memory at once
                texts = texts_of(batch["text"].slice(lo, 256))
                payloads = [payload_of(x) for x in texts]
                columns = [
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([encode_png(x) for x in payloads], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n_bytes", "media"])
        release()

    return staged(small_batches(docs).select(docs["text"].cast("string").alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


def media_features(store: DataFrame) -> DataFrame:
    """Decodes the stored bytes; one row for each (digest, n_bytes)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in batch["media"].to_pylist():
                payload = decode_png(media)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), sample_feature(payload))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["digest"], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        release()

    found = store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # equal digests have equal rows; copies combine before the shuffle. Written, so that
    # the join with the references is of two plain shuffles, which can be split
    return staged(found.dropDuplicates(["digest"]), "features")


def document_media(docs: DataFrame) -> DataFrame:
    """Each document as a page with one figure, its text the figure's payload.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption. Null text counts as empty (a payload of
    192 spaces). Null and repeated doc_ids each give their row; extra columns are
    ignored; equal texts give equal values, so ties have no order to break. A payload is
    stored whole in one row, however long the text; an empty table gives no rows.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(text)
    padded = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int") * WIDTH
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        n.cast("long").alias("n_bytes"),
        F.sha2(F.rpad(text, padded, F.lit(b" ")), 256).alias("digest"),
    )
    html = F.concat(F.lit('<figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    sequences = interleave(rows.withColumn("html", html), "doc_id", "n_bytes")
    return resolve(sequences, media_features(media_store(docs)), "doc_id", "n_bytes").drop("digest")


def op8_media(spark, sf_dir: str) -> DataFrame:
    out = document_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
