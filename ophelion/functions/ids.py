"""Identifiers and names as Column expressions.

An id is ``[record-]name[_yyMMdd][_yyMMddHHmmss]``. Blank text counts as missing and
functions that return text return '' for it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIRTH, TEST = r"^\d{6}$", r"^\d{12}$"
_SEPARATORS = r"[,\-_/]+"
#: Letters without a canonical decomposition.
_LETTERS = {"ß": "ss", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}


def blank_to_null(value: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def empty_like_to_null(value: Column) -> Column:
    """Null for blank text and for the spellings of a missing value."""
    text = F.trim(value.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none", "null", "<na>", "nat"), text)


def clean_name(value: Column) -> Column:
    """Without the prefix of copied files; U+FFFD stands where a c with cedilla was."""
    return F.replace(F.regexp_replace(text_or_empty(value), r"(?i)^c[oó]pia\s+de\s+", ""), F.lit("�"), F.lit("c"))


def _normalise(text: str | None) -> str:
    out = "".join(_LETTERS.get(c, c) for c in text or "")
    out = "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9]", "", out).lower()


@F.pandas_udf(T.StringType())
def _normalise_all(names: pd.Series) -> pd.Series:
    return names.map(_normalise)


def normalize_name(value: Column, unicode: bool = True) -> Column:
    """Lower-case ASCII letters and digits. Full Unicode decomposition needs a pandas
    UDF; ``unicode=False`` stays in the JVM and covers the Latin-1 letters."""
    name = clean_name(value)
    if unicode:
        return _normalise_all(name)
    for letter, plain in _LETTERS.items():
        name = F.replace(name, F.lit(letter), F.lit(plain))
    accented = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "".join(unicodedata.normalize("NFD", c)[0] for c in accented)
    return F.lower(F.regexp_replace(F.translate(name, accented, plain), "[^A-Za-z0-9]", ""))


def normalize_record_number(value: Column) -> Column:
    """The first run of digits."""
    return F.regexp_extract(text_or_empty(value), "[0-9]+", 0)


def record_and_name(field: Column) -> tuple[Column, Column]:
    """(record number, name) of a field that may hold both; null where missing."""
    text = blank_to_null(field)
    led = text.rlike(r"^\d{3,10}")
    parts = F.split(text, _SEPARATORS, 2)
    split = (F.size(parts) == 2) & F.trim(parts[0]).rlike(r"^\d+$")
    after = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)^\d{3,10}(.*)$", 1), r"^[\s,\-_/]+", ""))
    record = F.when(led, F.regexp_extract(text, r"^(\d{3,10})", 1)).when(split, F.trim(parts[0]))
    return record, F.when(led, after).when(split, F.trim(F.get(parts, F.lit(1)))).otherwise(text)


def parse_id(value: Column, unicode: bool = True) -> Column:
    """struct(record, name, birth, test) of an id; all null for blank text."""
    text = blank_to_null(value)
    parts = F.filter(F.split(text, "_"), lambda p: p != "")
    at = lambda k: F.get(parts, F.lit(k))
    left, n = at(0), F.size(parts)
    dash = F.instr(left, "-")
    head = F.substring_index(left, "-", 1)
    tail = F.when(dash > 0, F.substring(left, dash + 1, F.length(left)))
    dashed = dash > 0
    digits = head.rlike(r"^\d+$")
    spread = ~dashed & left.rlike(r"^\d+$") & (n >= 2) & ~at(1).rlike(BIRTH)
    # a record and its name as two parts count as one dashed part
    birth_first = ~dashed & ~spread & (n >= 2) & at(1).rlike(BIRTH)
    named = ~dashed & ~spread & ~birth_first & (n >= 3)
    record = F.when(dashed & digits, head).when(n > 0, left)
    name = F.when(dashed & digits, tail).when(spread, at(1)).when(named, at(1))
    shifted = spread | named
    birth = F.when(shifted, at(2)).when(dashed | birth_first, at(1))
    test = F.when(shifted, at(3)).when(dashed | birth_first, at(2))
    return F.struct(record.alias("record"), F.when(name.isNotNull(), normalize_name(name, unicode)).alias("name"), birth.alias("birth"), test.alias("test"))


def build_id(record: Column, name: Column, birth: Column, test: Column, unicode: bool = True) -> Column:
    """Joins the parts that are there; ``unknown`` without record and name. ``birth``
    and ``test`` are yyMMdd and yyMMddHHmmss texts or ''."""
    gone = lambda c: F.nullif(c, F.lit(""))
    who = F.concat_ws("-", gone(normalize_record_number(record)), gone(normalize_name(name, unicode)))
    return F.concat_ws("_", F.coalesce(gone(who), F.lit("unknown")), gone(birth), gone(test))


def canonical_id(value: Column, unicode: bool = True) -> Column:
    """record_name_birth_test, tolerant of stray dashes and underscores."""
    parts = parse_id(value, unicode)
    compact = F.regexp_replace(F.regexp_replace(F.regexp_replace(text_or_empty(value), r"\s+", ""), "^_+|_+$", ""), "_+", "_")
    joined = F.concat_ws("_", parts["record"], F.nullif(parts["name"], F.lit("")), F.when(parts["birth"].rlike(BIRTH), parts["birth"]), F.nullif(parts["test"], F.lit("")))
    return F.when(parts["record"].isNotNull(), joined).otherwise(compact)


#: File names that identify an exam, tried in order: record-name_birth_test,
#: record-name_test, name_birth_test, name_birth.
FILE_PATTERNS = (
    r"^(\d+)-(.+?)_(\d{6})_(\d{12})$",
    r"^(\d+)-(.+?)_()(\d{12})$",
    r"^()(.+?)_(\d{6})_(\d{12})$",
    r"^()(.+?)_(\d{6})()$",
)


def identity_from_file_name(path: Column) -> Column:
    """struct(record, name, birth, test, confident) from a file's name."""
    stem = clean_name(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)\.csv$", ""))
    field = lambda g: F.coalesce(*[F.when(stem.rlike(p), F.regexp_extract(stem, p, g)) for p in FILE_PATTERNS])
    known = F.coalesce(*[F.when(stem.rlike(p), F.lit(True)) for p in FILE_PATTERNS], F.lit(False))
    out = [F.when(known, field(g)).otherwise(F.lit("") if g != 2 else stem).alias(a) for g, a in ((1, "record"), (2, "name"), (3, "birth"), (4, "test"))]
    return F.struct(*out, known.alias("confident"))


def prefer(confident: Column, first: Column, second: Column) -> Column:
    """The first non-blank value, ``first`` leading where it is trusted."""
    a, b = blank_to_null(first), blank_to_null(second)
    return F.when(confident, F.coalesce(a, b)).otherwise(F.coalesce(b, a))


def name_tokens(value: Column, unicode: bool = True) -> Column:
    """Normalised words of two characters or more."""
    if unicode:
        return _tokens_all(F.coalesce(value.cast("string"), F.lit("")))
    words = F.split(text_or_empty(value), r"\s+")
    return F.filter(F.transform(words, lambda w: normalize_name(w, False)), lambda w: F.length(w) >= 2)


def _strip_copy(text: str) -> str:
    return re.sub(r"(?i)^c[oó]pia\s+de\s+", "", text.strip()).replace("�", "c")


@lru_cache(1 << 14)
def _token(word: str) -> str:
    return _normalise(_strip_copy(word))


def tokens_of(name: str) -> list[str]:
    return [t for t in map(_token, name.split()) if len(t) >= 2]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens_all(names: pd.Series) -> pd.Series:
    return names.map(tokens_of)


#: A name of n other words has up to 2**n choices of initials. Beyond INITIALS words they
#: are made in pieces, 2**SPLITS of them at most.
INITIALS, SPLITS = 14, 12


def _choices(letters: str, piece: int = 0, bits: int = 0) -> Iterator[tuple[str, int]]:
    """The distinct choices of letters in their order, the empty one too, each with the
    place behind its last letter. A choice is made by the first places that give it, so
    none has to be kept to be known again. A piece has those that take of the first
    ``bits`` letters the ones whose bits its number has."""
    base, end = "", 0
    for i in range(bits):
        if piece >> i & 1:
            if letters.find(letters[i], end) < i:
                return
            base, end = base + letters[i], i + 1
    yield base, end
    nearest: dict[str, int] = {}
    after = [()]  # the next place of each letter, from the end on
    for i in range(len(letters) - 1, -1, -1):
        nearest[letters[i]] = i
        after.append(tuple(nearest.values()))
    after.reverse()
    stack = [(base, i) for i in after[end] if i >= bits]
    while stack:
        text, i = stack.pop()
        text += letters[i]
        yield text, i + 1
        stack += [(text, k) for k in after[i + 1]]


def _within(part: str, text: str) -> bool:
    rest = iter(text)
    return all(c in rest for c in part)


def _whole_words(tokens: list[str], spaced: bool) -> set[str]:
    """The forms that aren't made by choices of initials."""
    first, rest = tokens[0], tokens[1:]
    some = [(), *((t,) for t in rest), *combinations(rest, 2)]
    out = {"".join(tokens), "".join([t[0] for t in tokens]) if rest else first}
    out.update([first + "".join(c) for c in some])
    if spaced:
        out.add(" ".join(tokens))
        out.update([" ".join((first, *c)) for c in some])
    return out


def _few(tokens: list[str], spaced: bool) -> set[str]:
    """The forms of a name of few words, by doubling."""
    if not tokens:
        return set()
    out, choices = _whole_words(tokens, spaced), [""]
    for k, w in enumerate(tokens[1:], 2):
        if k == len(tokens):
            out.update([tokens[0] + c + w for c in choices if c])
        choices += [c + w[0] for c in choices]
    out.update([tokens[0] + c for c in choices])
    return out


def forms_of(name: str, spaced: bool = False, piece: int = 0, bits: int = 0) -> Iterator[str]:
    """Plausible forms of a name, all starting with its first word: the whole, the
    first with one or two others, with initials of any others, with middle initials
    and the last word, and the initials alone; ``spaced`` adds forms with spaces. Each
    comes once, and those of initials are not kept. The pieces of some ``bits`` have all
    forms together."""
    tokens = tokens_of(name)
    if len(tokens) <= INITIALS + 1:
        if not piece:
            yield from _few(tokens, spaced)
        return
    first, rest = tokens[0], tokens[1:]
    bits = min(bits, len(rest) - 1)
    if piece >> bits:
        return
    letters = "".join([t[0] for t in rest])
    yield from (first + c for c, _ in _choices(letters, piece, bits))
    last = rest[-1]
    room = len(letters)  # up to here the letters of the last word follow as initials
    for c in reversed(last):
        room = letters.rfind(c, 0, max(room, 0))
    yield from (first + c + last for c, end in _choices(letters[:-1], piece, bits) if c and end > room)
    for form in () if piece else _whole_words(tokens, spaced):
        tail = form[len(first) :]
        told = form.startswith(first) and (_within(tail, letters) or tail.endswith(last) and tail != last and _within(tail[: -len(last)], letters[:-1]))
        if not told:
            yield form


def variations_of(name: str, spaced: bool = False) -> set[str]:
    """``forms_of`` a name at once."""
    return set(forms_of(name, spaced))


def name_forms(df: DataFrame, key: str, name: Column, spaced: bool = False) -> DataFrame:
    """(key, form) of every name. A long name's forms are made by many tasks, and never
    held together in one cell."""
    bits = F.least(F.greatest(F.size(F.split(text_or_empty(name), r"(?U)\s+")) - 1 - INITIALS, F.lit(0)), F.lit(SPLITS))
    rows = df.select(F.col(key), text_or_empty(name).alias("_name"), bits.alias("_bits"))
    pieces = rows.select(key, "_name", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, _bits)") - 1)).alias("_piece"), "_bits")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, forms = [], []
            made = lambda: pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(forms, pa.string())], [key, "form"])  # noqa: B023, E731
            for k, how in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for some in batched(forms_of(how[0], spaced, how[1], how[2]), 10_000):
                    at += [k] * len(some)
                    forms += some
                    if len(forms) >= 10_000:
                        yield made()
                        at, forms = [], []
            yield made()

    # a table in one file is read by few tasks
    return pieces.repartition(F.xxhash64(key, "_piece")).mapInArrow(make, T.StructType([df.schema[key], T.StructField("form", T.StringType())]))


def name_heads(value: Column) -> Column:
    """The forms that all forms of a name start with: its first word, and the initials."""
    words = name_tokens(value)
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.array_compact(F.array(F.get(words, F.lit(0)), F.when(F.size(words) > 1, initials)))


def encode_id(number: Column) -> Column:
    """URL-safe base64 of the decimal digits, without padding."""
    return F.rtrim(F.translate(F.base64(number.cast("string").cast("binary")), "+/", "-_"), F.lit("="))


def decode_id(text: Column) -> Column:
    """The number of an encoded id; a plain number is taken as it is, else null."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    valid = plain.rlike("^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1)
    decoded = F.when(valid, F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.coalesce(F.when(decoded.rlike(r"^\d+$"), decoded.try_cast("long")), text.try_cast("long"))


def split_list(text: str | None) -> list[str]:
    """Items of a comma list given as an argument."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def hashed_name(path: str, suffix: str = "_hashed") -> str:
    """Name of the output file for an input file."""
    stem, dot, kind = path.rpartition(".")
    return f"{stem or kind}{suffix}{dot + kind if dot and stem else ''}"
