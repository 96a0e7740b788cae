"""Questionnaire exports: nested documents and legacy flat lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NESTED = (
    "success boolean, data struct<questionnaire:struct<id:bigint,title:string>, submissions:array<struct<submission_id:bigint,total_score:double,chyps_score:double,submitted_at:string,"
    "answers:array<struct<caption:string,text_response:string,selected_option_texts:array<string>,selected_option_ids:array<bigint>,score:double>>>>>"
)
FIXED = ("submission_id", "questionnaire_id", "questionnaire_title", "total_score", "chyps_score", "submitted_at")
#: Labels of the legacy list and the columns they become.
LEGACY = {
    "ID da Submissão": "submission_id",
    "Pontuação Total": "total_score",
    "Data de Envio": "submitted_at",
    "QS1: Nome": "QS1",
    "QS2: Data de nascimento: __ / __ / ____": "QS2",
    "QS3: Email": "QS3",
    "QS4: Sexo": "QS4",
    "QS5: Raça/Etnia": "QS5",
    "QS6: Grau de escolaridade": "QS6",
}
IDENTITY = {"identity_name": "QS1", "identity_dob": "QS2", "identity_sex": "QS4"}


def answer_value(answer: Column) -> Column:
    """The text response, else the option texts joined, else ''."""
    text = F.trim(F.coalesce(answer["text_response"], F.lit("")))
    options = F.filter(F.transform(F.coalesce(answer["selected_option_texts"], F.array().cast("array<string>")), lambda o: F.trim(o)), lambda o: o != "")
    return F.when(text != "", text).otherwise(F.array_join(options, "; "))


def long_answers(docs: DataFrame) -> DataFrame:
    """One row per submission and answer of nested documents (schema NESTED)."""
    subs = docs.select(F.col("data.questionnaire.id").alias("questionnaire_id"), F.coalesce("data.questionnaire.title", F.lit("")).alias("questionnaire_title"), F.explode("data.submissions").alias("s"))
    each = subs.select("questionnaire_id", "questionnaire_title", "s.submission_id", "s.total_score", "s.chyps_score", F.coalesce("s.submitted_at", F.lit("")).alias("submitted_at"), F.posexplode_outer("s.answers").alias("place", "a"))
    return each.select(*FIXED, "place", F.trim("a.caption").alias("caption"), answer_value(F.col("a")).alias("value"), "a.score")


def flatten(docs: DataFrame, captions: Sequence[str] | None = None) -> DataFrame:
    """One row per submission, one column per caption ('' where it has none), and the
    identity columns. Captions that aren't given become columns in sorted order."""
    long = long_answers(docs)
    if captions is None:
        captions = [r[0] for r in long.select("caption").where("caption <> ''").distinct().orderBy("caption").collect()]
    # a caption that occurs twice keeps its last answer
    last = [F.coalesce(F.max_by("value", F.when(F.col("caption") == c, F.col("place"))), F.lit("")).alias(c) for c in captions]
    rows = long.groupBy(*FIXED)
    return with_identity(rows.agg(*last) if last else long.select(*FIXED).distinct())


def with_identity(df: DataFrame, prefixes: dict[str, str] = IDENTITY) -> DataFrame:
    """identity_* columns from the first column that starts with a caption; '' where
    there is none."""
    find = lambda p: next((c for c in df.columns if c.lower().startswith(p.lower())), None)
    return df.withColumns({n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if (c := find(p)) else F.lit("") for n, p in prefixes.items()})


def legacy(df: DataFrame, names: dict[str, str] = LEGACY) -> DataFrame:
    return with_identity(df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns}))


def is_nested(df: DataFrame) -> bool:
    return "data" in df.columns


def read_questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """Either format, told apart by the inferred schema."""
    found = spark.read.option("multiLine", "true").json(path)
    return flatten(spark.read.option("multiLine", "true").schema(NESTED).json(path)) if is_nested(found) else legacy(found)
