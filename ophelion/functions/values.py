"""Dates, numbers, labels and sexes as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import BIRTH, TEST, text_or_empty

#: Two-digit years below this are 20xx.
CENTURY = 30
#: Date layouts in the order they are tried: month first, then day first.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm")

TRUE_WORDS = ("sim", "s", "yes", "y", "tem", "true", "1")
FALSE_WORDS = ("não", "nao", "nâo", "não tem", "nao tem", "nâo tem", "n", "no", "false", "0")


def century(yy: Column) -> Column:
    return F.when(yy < CENTURY, yy + 2000).otherwise(yy + 1900)


def parse_time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in (*TIME_FORMATS, *DATE_FORMATS)])


def birth_text(value: Column) -> Column:
    """yyMMdd; '' where the value is no date."""
    text = text_or_empty(value)
    return F.when(text.rlike(BIRTH), text).otherwise(F.coalesce(F.date_format(parse_time(text), "yyMMdd"), F.lit("")))


def test_text(value: Column) -> Column:
    """yyMMddHHmmss; '' where the value is no time."""
    text = text_or_empty(value)
    return F.when(text.rlike(TEST), text).otherwise(F.coalesce(F.date_format(parse_time(text), "yyMMddHHmmss"), F.lit("")))


def birth_slashed(value: Column) -> Column:
    b = birth_text(value)
    return F.when(b != "", F.concat_ws("/", b.substr(1, 2), b.substr(3, 2), b.substr(5, 2))).otherwise(F.lit(""))


def test_slashed(value: Column) -> Column:
    t = test_text(value)
    day = F.concat_ws("/", t.substr(1, 2), t.substr(3, 2), t.substr(5, 2))
    time = F.concat_ws(":", t.substr(7, 2), t.substr(9, 2), t.substr(11, 2))
    return F.when(t != "", F.concat_ws(" ", day, time)).otherwise(F.lit(""))


def dob_parts(value: Column) -> Column:
    """struct(day, month, year) of D/M/Y or Y/M/D with / - or . between. Only ranges
    are checked (31/02 passes); all null for anything else."""
    parts = F.split(F.trim(value), r"[/\-.]")
    text = [F.trim(F.get(parts, F.lit(k))) for k in range(3)]
    number = [F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")) for t in text]
    year_first = F.length(text[0]) == 4
    year = F.when(year_first, number[0]).otherwise(F.when(number[2] < 100, century(number[2])).otherwise(number[2]))
    month, day = number[1], F.when(year_first, number[2]).otherwise(number[0])
    ok = (F.size(parts) == 3) & year.isNotNull() & month.between(1, 12) & day.between(1, 31)
    return F.struct(*[F.when(ok, c).alias(n) for c, n in ((day, "day"), (month, "month"), (year, "year"))])


def birth_year(value: Column) -> Column:
    return dob_parts(value)["year"]


def birth_year_range(age: Column, tested: Column) -> tuple[Column, Column]:
    """The two birth years possible for an age of 1 to 120 at a date."""
    ok = age.between(1, 120)
    return F.when(ok, F.year(tested) - age - 1), F.when(ok, F.year(tested) - age)


def slashed_parts(value: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of YY/MM/DD."""
    part = lambda p: F.regexp_extract(value, p, 1).try_cast("int")
    return century(part(r"^(\d+)/")), part(r"^\d+/(\d+)/"), part(r"^\d+/\d+/(\d+)$")


def year_of_prefix(value: Column) -> Column:
    return century(F.substring(value, 1, 2).try_cast("int"))


def year_of_answer(value: Column) -> Column:
    """Year of d/m/Y, else of a number."""
    parts = F.split(F.trim(value), "/")
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(2)).try_cast("int")).otherwise(F.trim(value).try_cast("double").try_cast("int"))


def parse_number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_bool(value: Column) -> Column:
    """True, false, or null where the text is neither."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def label_from_values(value: Column, false_values: Sequence[str], case_sensitive: bool = False) -> Column:
    """Null for blank text, false for the given values, true for any other."""
    text = F.trim(value.cast("string"))
    compared = text if case_sensitive else F.lower(text)
    no = [v if case_sensitive else v.lower() for v in false_values]
    return F.when(text.isNull() | (text == ""), None).when(compared.isin(*no), False).otherwise(True)


def norm_sex(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("masculino", "m", "male"), "m").when(text.isin("feminino", "f", "female"), "f").otherwise("")


def same_sex(a: Column, b: Column) -> Column:
    return F.coalesce((norm_sex(a) != "") & (norm_sex(a) == norm_sex(b)), F.lit(False))
