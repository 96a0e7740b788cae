"""Text measures and readability indices as Column expressions.

Words are runs of characters that are no Unicode white space, sentences are runs of
``.!?``, syllables runs of the vowels a e i o u in lower case (an accented vowel ends
a run), letters are Unicode letters, digits and the underscore. The number of complex
words is 0 unless a column with it is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space: the Unicode property and the separators U+001C to U+001F.
WORD = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
INDICES = (
    "flesch_reading_ease",
    "gulpease_index",
    "flesch_kincaid_grade_level",
    "gunning_fog_index",
    "automated_readability_index",
    "coleman_liau_index",
    "final_readability_score",
)


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def count_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?]+"))


def count_syllables(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[aeiou]+"))


def count_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def text_counts(text: Column) -> dict[str, Column]:
    return {"words": count_words(text), "sentences": count_sentences(text), "syllables": count_syllables(text), "letters": count_letters(text)}


def readability(words: Column, sentences: Column, syllables: Column, letters: Column, complex_words: Column | None = None) -> dict[str, Column]:
    """The seven indices from counts. An index whose denominator is 0 is 0."""
    cw = F.lit(0) if complex_words is None else complex_words
    some = (words > 0) & (sentences > 0)
    guarded = lambda ok, value: F.when(ok, value).otherwise(F.lit(0.0))
    ws, sw = F.try_divide(words, sentences), F.try_divide(syllables, words)
    lw, s_w = F.try_divide(letters, words), F.try_divide(sentences, words)
    out = {
        "flesch_reading_ease": guarded(some, 226 - 1.04 * ws - 72 * sw),
        "gulpease_index": guarded(words > 0, 89 + F.try_divide(300 * sentences - 10 * letters, words)),
        "flesch_kincaid_grade_level": guarded(some, 0.36 * ws + 10.4 * sw - 18),
        "gunning_fog_index": guarded(some, 0.49 * ws + 19 * F.try_divide(cw, words)),
        "automated_readability_index": guarded(some, 4.6 * lw + 0.44 * ws - 20),
        "coleman_liau_index": guarded(words > 0, 5.4 * lw - 21 * s_w - 14),
    }
    grades = [out[k] for k in INDICES[2:6]]
    out["final_readability_score"] = (grades[0] + grades[1] + grades[2] + grades[3]) / 4
    return out


def preview(text: Column, n: int) -> Column:
    """The first n characters and an ellipsis where the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def slugify(text: Column) -> Column:
    """Lower case, other characters to single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def has_markup(text: Column) -> Column:
    """Whether the text holds an HTML tag."""
    return F.coalesce(text.rlike(r"<[a-zA-Z/][^>]*>"), F.lit(False))


def escape_html(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(needle.lower()))
