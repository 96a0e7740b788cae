"""Filters, guards and encodings (DataFrame -> DataFrame)."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import blank_to_null
from ..functions.values import year_of_answer

#: Words for the three comparisons, as users type them.
OPERATORS = {"eq": "eq", "igual": "eq", "=": "eq", "gt": "gt", "maior": "gt", ">": "gt", "lt": "lt", "menor": "lt", "<": "lt"}


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in the order wanted."""
    return [c for c in wanted if c in df.columns]


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Column-selective read; an error where none of the wanted columns exists."""
    found = available(df, wanted)
    if not found:
        raise ValueError(f"none of the columns exists: {', '.join(wanted)}")
    return df.select(*found)


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def duplicate_columns(names: Sequence[str]) -> list[str]:
    """Names that occur more than once, without regard to case."""
    lower = [n.lower() for n in names]
    return sorted({n for n in lower if lower.count(n) > 1})


def drop_identity(df: DataFrame, exact: Collection[str]) -> DataFrame:
    """Drops personal columns by exact name, never by prefix."""
    return df.drop(*[c for c in df.columns if c in set(exact)])


def encode_codes(df: DataFrame, column: str, codes: dict[str, int], to: str) -> DataFrame:
    """Replaces text by its code; an unknown text ends the job with its name."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    text = F.lower(F.trim(df[column]))
    unknown = F.raise_error(F.concat(F.lit(f"{column}: no code for "), F.coalesce(text, F.lit("null"))))
    return df.withColumn(to, F.coalesce(F.try_element_at(table, text), unknown.cast("int")))


def cast_or_drop(df: DataFrame, column: str, kind: str = "int") -> DataFrame:
    """Casts and keeps the rows where that worked."""
    return df.withColumn(column, df[column].try_cast(kind)).where(F.col(column).isNotNull())


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(frame with the columns as double, one row with the invalid values of each)."""
    bad = [F.count_if(blank_to_null(df[c]).isNotNull() & df[c].cast("string").try_cast("double").isNull()).alias(c) for c in columns]
    return df.withColumns({c: df[c].cast("string").try_cast("double") for c in columns}), df.agg(*bad)


def keep_annotated(df: DataFrame, column: str, rule: Column | Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows that the rule accepts; without a rule, those where the column isn't blank."""
    if rule is None:
        return df.where(blank_to_null(df[column]).isNotNull())
    return df.where(rule(df[column]) if callable(rule) else rule)


def binarize(df: DataFrame, column: str, to: str, parser: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(to, parser(df[column]))


def multilabel(df: DataFrame, column: str, labels: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Splits text at , ; / + into one boolean column per label; null text gives nulls.

    Labels not given are the distinct ones, which come to the driver as column names.
    """
    parts = F.filter(F.transform(F.split(F.upper(df[column]), r"[,;/+]"), F.trim), lambda x: x != "")
    if labels is None:
        labels = [r[0] for r in df.select(F.explode(parts).alias("label")).distinct().orderBy("label").collect()]
    return df.withColumns({f"{prefix}{x}": F.array_contains(parts, x.upper()) for x in labels})


def compare_filter(df: DataFrame, column: str, operator: str, value: str) -> DataFrame:
    """Keeps rows whose column is equal to, above or below a value given as text."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    op = OPERATORS.get(operator.lower().strip())
    if op is None:
        raise ValueError(f"no operator {operator}: use one of {', '.join(OPERATORS)}")
    if is_numeric(df, column):
        try:
            number = float(value)
        except ValueError as e:
            raise ValueError(f"{column} is a number, {value!r} is none") from e
        test = {"eq": df[column] == number, "gt": df[column] > number, "lt": df[column] < number}[op]
    elif op == "eq":
        test = df[column].cast("string") == str(value)
    else:
        raise ValueError(f"{operator} needs a numeric column, {column} isn't")
    return df.where(test)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; an error where it has no row (one short job)."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def validate_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    text = [c for c in columns if c in df.columns and not is_numeric(df, c)]
    if missing or text:
        raise ValueError(f"missing columns: {missing}; not numeric: {text}")


def within_days(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of whole days first..last, both included; an open end where None."""
    day = F.to_date(df[column])
    out = df if first is None else df.where(day >= F.lit(first).cast("date"))
    return out if last is None else out.where(day <= F.lit(last).cast("date"))


def plausible_year(year: Column, low: int = 1900, high: int = 2015) -> Column:
    return year.between(low, high)


def caption_group(caption: Column) -> Column:
    """Group of a question by the first letters of its caption."""
    text = F.upper(F.trim(caption))
    return (
        F.when(text.startswith("QS"), "sociodemographic")
        .when(text.startswith("TR"), "attention")
        .when(text.startswith("Q"), "scale")
        .when(text.startswith("F"), "feedback")
        .otherwise("other")
    )


def passes_year(answer: Column, low: int | None, high: int | None) -> Column:
    """Permissive: a missing or unreadable year passes."""
    year = year_of_answer(answer)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    return F.coalesce(ok, F.lit(True))


def passes_any(values: Column, allowed: Sequence[str]) -> Column:
    """Permissive: an empty or missing list passes, else one value must be allowed."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, True).otherwise(F.arrays_overlap(values, F.array(*map(F.lit, allowed))))


def filter_submissions(answers: DataFrame, years: dict[str, tuple[int | None, int | None]] | None = None, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """submission_id of the submissions that pass every filter on its caption.

    ``answers`` has submission_id, position, caption, text_response, option_texts.
    For a caption the first answer of a submission counts; where there is none the
    submission passes. One aggregation, then joins by semi join in the caller.
    """
    checks = []
    for caption, (low, high) in (years or {}).items():
        first = F.min_by("text_response", F.when(F.col("caption") == caption, F.col("position")))
        checks.append(passes_year(first, low, high))
    for caption, allowed in (categories or {}).items():
        texts = F.when(F.coalesce(F.size("option_texts"), F.lit(0)) > 0, F.col("option_texts")).when(F.col("text_response").isNotNull(), F.array("text_response"))
        first = F.min_by(texts, F.when(F.col("caption") == caption, F.col("position")))
        checks.append(passes_any(first, allowed))
    ok = F.lit(True)
    for c in checks:
        ok = ok & c
    return answers.groupBy("submission_id").agg(ok.alias("passes")).where("passes").select("submission_id")


def shown_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(submission_id, question_id): dependent questions whose trigger option was
    selected, and all that depend on nothing."""
    people = answers.select("submission_id").distinct()
    free = people.join(questions.where("depends_on_question_id is null").select("question_id"))
    chosen = answers.select("submission_id", F.col("question_id").alias("depends_on_question_id"), F.explode("selected_options").alias("depends_on_option_id"))
    bound = questions.where("depends_on_question_id is not null").select("question_id", "depends_on_question_id", "depends_on_option_id")
    return free.unionByName(bound.join(chosen, ["depends_on_question_id", "depends_on_option_id"]).select("submission_id", "question_id").distinct())


def submission_errors(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(submission_id, question_id, error): unknown and missing questions, and answers
    that break the rule of their type."""
    known = answers.join(questions.select("question_id", "question_type", "is_required"), "question_id", "left")
    n = F.coalesce(F.size("selected_options"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    blank = blank_to_null(F.col("text_response")).isNull()
    error = (
        F.when(F.col("question_type").isNull(), "unknown question")
        .when((F.col("question_type") == "single") & (n > 1), "more than one option")
        .when(F.col("question_type").isin("single", "multiple") & F.col("is_required") & (n == 0), "no option")
        .when((F.col("question_type") == "free_text") & F.col("is_required") & blank, "no text")
        .when((F.col("question_type") == "free_text") & (n > 0), "options on a free text")
    )
    broken = known.select("submission_id", "question_id", error.alias("error")).where("error is not null")
    required = shown_questions(questions, answers).join(questions.where("is_required").select("question_id"), "question_id", "left_semi")
    missing = required.join(answers.select("submission_id", "question_id"), ["submission_id", "question_id"], "left_anti")
    return broken.unionByName(missing.select("submission_id", "question_id", F.lit("missing answer").alias("error")))


def positive_ids(column: Column) -> Column:
    """The distinct ids above 0 of a list, in rising order; null for null."""
    return F.array_sort(F.array_distinct(F.filter(column, lambda x: x > 0)))


def created_by(df: DataFrame, creator: str, who, order: str) -> DataFrame:
    """Rows of one creator, in the order they were made."""
    return df.where(F.col(creator) == F.lit(who)).orderBy(order)
