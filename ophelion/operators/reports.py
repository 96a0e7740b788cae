"""Questionnaire reports: question statistics, distributions, summaries, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case, preview
from .quantiles import values_at
from .ranking import places


def is_correct(kind: Column, chosen: Column, key: Column) -> Column:
    """Single choice: exactly one option, and it is in the key. Multiple choice: the
    same set. Null for free text."""
    chosen = F.array_distinct(F.coalesce(chosen, F.array().cast("array<bigint>")))
    key = F.coalesce(key, F.array().cast("array<bigint>"))
    one = (F.size(chosen) == 1) & F.arrays_overlap(chosen, key)
    return F.when(kind == "single", F.coalesce(one, F.lit(False))).when(kind == "multiple", F.array_sort(chosen) == F.array_sort(F.array_distinct(key)))


def answer_keys(options: DataFrame) -> DataFrame:
    return options.where("is_correct").groupBy("question_id").agg(F.collect_set("option_id").alias("key"))


def question_stats(questions: DataFrame, answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Per question: answers, correct answers, accuracy and error rate in percent, and
    the scores' average, least and greatest; zeros without answers."""
    marked = answers.join(questions.select("question_id", "question_type"), "question_id").join(keys, "question_id", "left")
    marked = marked.withColumn("ok", is_correct(F.col("question_type"), F.col("selected_options"), F.col("key")))
    per = marked.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("total_answers"),
        F.count_if("ok").alias("correct_answers"),
        F.avg("score").alias("a"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    )
    out = questions.select("question_id", "question_type").join(per, "question_id", "left")
    n, c = F.coalesce("total_answers", F.lit(0)), F.coalesce("correct_answers", F.lit(0))
    share = lambda x: F.when((F.col("question_type") != "free_text") & (n > 0), F.round(100.0 * F.try_divide(x, n), 2)).otherwise(F.lit(0.0))
    number = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 2)
    return out.select("question_id", "question_type", n.alias("total_answers"), c.alias("correct_answers"), share(c).alias("accuracy_percentage"), share(n - c).alias("error_rate"), number(F.col("a")).alias("avg_score"), number(F.col("low")).alias("min_score"), number(F.col("high")).alias("max_score"))


def option_counts(answers: DataFrame) -> DataFrame:
    """(question_id, option_id, count, selections, answers): both denominators."""
    chosen = answers.select("question_id", F.explode("selected_options").alias("option_id"))
    n = chosen.groupBy("question_id", "option_id").agg(F.count(F.lit(1)).alias("count"))
    given = answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("answers"))
    per = Window.partitionBy("question_id")
    return n.join(given, "question_id").withColumn("selections", F.sum("count").over(per))


def option_distribution(answers: DataFrame, of: str = "answers") -> DataFrame:
    """Percentages of options. The report divides by answers, the chart (of =
    'selections') by selections; a chart of two options is a pie, else bars."""
    n = option_counts(answers)
    kinds = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    pct = F.round(100.0 * F.try_divide(F.col("count"), F.col(of)), 1)
    return n.select("question_id", "option_id", "count", pct.alias("percentage"), F.when(kinds == 2, "pie").otherwise("bar").alias("chart_type"))


def upper_median_of(df: DataFrame, value: str) -> DataFrame:
    """One row with sorted[n // 2] of a numeric column; null without a value."""
    return values_at(df, value, {"median": (0.5, F.floor(F.col("_n") / 2))})


def score_analytics(submissions: DataFrame, score: str = "total_score") -> DataFrame:
    """min, max, mean, upper median, population sd, and how many scores lie in the
    bands of 80, 60 and 40 percent of the greatest."""
    v = F.col(score).cast("double")
    base = submissions.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.round(F.stddev_pop(v), 2).alias("std_deviation"))
    top = F.col("max")
    cut = lambda s: top * F.lit(s)
    bands = submissions.select(v.alias("v")).join(F.broadcast(base.select("max"))).agg(
        F.count_if(F.col("v") >= cut(0.8)).alias("excellent"),
        F.count_if((F.col("v") >= cut(0.6)) & (F.col("v") < cut(0.8))).alias("good"),
        F.count_if((F.col("v") >= cut(0.4)) & (F.col("v") < cut(0.6))).alias("average"),
        F.count_if(F.col("v") < cut(0.4)).alias("poor"),
    )
    return base.join(upper_median_of(submissions, score)).join(bands)


def submission_stats(submissions: DataFrame, score: str = "total_score", at: str = "submitted_at") -> DataFrame:
    v = F.col(score).cast("double")
    row = submissions.agg(F.count(F.lit(1)).alias("total"), F.avg(v).alias("average"), F.min(v).alias("min"), F.max(v).alias("max"), F.max(at).alias("latest"))
    return row.join(upper_median_of(submissions, score))


def text_answer_stats(answers: DataFrame, by: Sequence[str], text: str = "text_response") -> DataFrame:
    n = F.length(F.trim(F.col(text)))
    return answers.where(n > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("responses"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def filter_options(answers: DataFrame, pattern: str) -> DataFrame:
    """Sorted distinct answers to the questions whose text holds the pattern."""
    hit = answers.where(contains_ignoring_case(F.col("question_text"), pattern))
    return hit.select(F.trim("text_response").alias("value")).where("value <> ''").distinct().orderBy("value")


def search_page(texts: DataFrame, text: str, needle: str, order: Sequence[str], number: int, size: int, shown: int = 150) -> DataFrame:
    """One page of the texts that hold the needle, with previews and the total."""
    hits = texts.where(contains_ignoring_case(F.col(text), needle))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    part = hits.orderBy(*order).offset((number - 1) * size).limit(size)
    return part.withColumn("preview", preview(F.col(text), shown)).join(F.broadcast(total))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, low, high, n): bins of equal width, the last one closed; a constant
    column has the unit range around it. Empty bins are absent."""
    v = F.col(value).cast("double")
    ends = df.where(v.isNotNull()).groupBy(*by).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    ends = ends.select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"), F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"))
    joined = df.where(v.isNotNull()).select(*by, v.alias("_v")).join(F.broadcast(ends) if not by else ends, list(by) if by else None)
    width = (F.col("_b") - F.col("_a")) / bins
    place = F.least(F.floor((F.col("_v") - F.col("_a")) / width), F.lit(bins - 1)).cast("int")
    n = joined.withColumn("bin", place).groupBy(*by, "bin", "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*by, "bin", (F.col("_a") + F.col("bin") * width).alias("low"), (F.col("_a") + (F.col("bin") + 1) * width).alias("high"), "n")


def long_export(submissions: DataFrame, answers: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """One row per answer with the texts of its options in the order selected."""
    texts = options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("option_id", F.col("text").alias("option_text")))).alias("offered"))  # options of one question
    given = answers.select("submission_id", "question_id", "text_response", "score", "selected_options").join(texts, "question_id", "left")
    out = given.join(questions.select("question_id", "caption"), "question_id").join(submissions.select("submission_id", "submitted_at", "total_score"), "submission_id")
    names = F.flatten(F.transform("selected_options", lambda o: F.transform(F.filter("offered", lambda x: x["option_id"] == o), lambda x: x["option_text"])))
    return out.select("submission_id", "submitted_at", "total_score", "question_id", "caption", F.coalesce(F.array_join(names, "; "), F.lit("")).alias("options"), "text_response", "score")


def wide_export(long: DataFrame, captions: Sequence[str], key: Sequence[str], value: Column, labels: dict[str, str] | None = None) -> DataFrame:
    """A column per caption in the given order, renamed by ``labels``."""
    wide = long.groupBy(*key).pivot("caption", list(captions)).agg(F.first(value))
    return wide.withColumnsRenamed(labels or {})


def nested_export(long: DataFrame, key: str, header: Sequence[str]) -> DataFrame:
    """(key, json): a submission and its answers as one JSON document."""
    answer = F.struct("question_id", "caption", "options", "text_response", "score")
    docs = long.groupBy(key, *header).agg(F.array_sort(F.collect_list(answer)).alias("answers"))
    return docs.select(key, F.to_json(F.struct(key, *header, "answers")).alias("json"))


def summary_report(submissions: DataFrame, answers: DataFrame) -> DataFrame:
    a = answers.agg(F.count(F.lit(1)).alias("answers"), F.countDistinct("question_id").alias("questions_answered"))
    return submissions.agg(F.count(F.lit(1)).alias("submissions"), F.round(F.avg("total_score"), 2).alias("avg_score"), F.min("submitted_at").alias("first"), F.max("submitted_at").alias("last")).join(a)


def order_items(items: DataFrame, order: str = "custom", seed: int = 0) -> DataFrame:
    """Items of a questionnaire: by sort order, by text up or down, or by chance."""
    if order == "random":
        return items.orderBy(F.xxhash64("item_type", "item_id", F.lit(seed)))
    return {"custom": lambda: items.orderBy("step", "sort_order"), "ascending": lambda: items.orderBy(F.asc("text")), "descending": lambda: items.orderBy(F.desc("text"))}[order]()


def submitted_answers(answers: DataFrame, questions: DataFrame, scored: DataFrame) -> DataFrame:
    """Answers as stored: scored, free text trimmed, N/A where an optional free text is
    blank or wasn't answered."""
    blank = F.trim(F.coalesce("text_response", F.lit(""))) == ""
    given = answers.select("submission_id", "question_id", "selected_options", "text_response")
    known = given.join(questions.select("question_id", "question_type", "is_required"), "question_id").join(scored, ["submission_id", "question_id"], "left")
    text = F.when(F.col("question_type") != "free_text", F.col("text_response")).when(~blank, F.trim("text_response")).when(~F.col("is_required"), "N/A")
    stored = known.select("submission_id", "question_id", "selected_options", text.alias("text_response"), F.coalesce("score", F.lit(0.0)).alias("score"))
    optional = questions.where("question_type = 'free_text' and not is_required").select("question_id")
    absent = answers.select("submission_id").distinct().crossJoin(F.broadcast(optional)).join(answers.select("submission_id", "question_id"), ["submission_id", "question_id"], "left_anti")
    return stored.unionByName(absent.select("submission_id", "question_id", F.array().cast("array<bigint>").alias("selected_options"), F.lit("N/A").alias("text_response"), F.lit(0.0).alias("score")))


def questionnaire_list(questionnaires: DataFrame, creator, fields: Sequence[str], first: str | None = None, last: str | None = None, by: str = "creator_id", at: str = "created_at") -> DataFrame:
    """The chosen fields of one creator's questionnaires made on days first..last. Days
    are compared as text, so a missing date is before any day; unknown fields are left out."""
    day = F.substring(F.coalesce(F.col(at).cast("string"), F.lit("")), 1, 10)
    out = questionnaires.where(F.col(by).cast("string") == F.lit(str(creator)))
    out = out if first is None else out.where(day >= F.lit(first))
    out = out if last is None else out.where(day <= F.lit(last))
    return out.select(*(f for f in fields if f in questionnaires.columns))


def delete_cascade(parent: DataFrame, children: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Parent and children without the rows of the deleted keys."""
    keys = gone.select(key)
    return {"parent": parent.join(keys, key, "left_anti"), **{n: c.join(keys, key, "left_anti") for n, c in children.items()}}


def assign_steps(items: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """step = how many bounds lie at or under the sort order, from 1."""
    step = F.lit(1)
    for b in bounds:
        step = step + (F.col("sort_order") >= b).cast("int")
    return items.withColumn("step", step)


def read_model(questionnaires: DataFrame, items: DataFrame, questions: DataFrame, options: DataFrame, instructions: DataFrame, seed: int = 0) -> DataFrame:
    """What a respondent is shown: the items of each questionnaire in its order, with a
    place from 1, a step (1 where none is given) and their content, a question with its
    options or an instruction; the other one is null.

    questionnaires has questionnaire_id and question_order; items item_key (unique),
    questionnaire_id, item_type (question, term, instruction), item_id, sort_order, step;
    questions question_id, options option_id, question_id and sort_order, instructions
    instruction_id; further columns go into the content. ``ascending`` and ``custom`` go by
    sort_order, ``descending`` against it, ``random`` by a draw that ``seed`` fixes, for
    options too, any other order by item_key; ties go by item_key, nulls come first.
    Items without content, or of another type, aren't shown. An empty table gives no rows."""
    drawn = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))
    kind = F.when(F.col("item_type").isin("question", "term"), "question").when(F.col("item_type") == "instruction", "instruction")
    there = questions.select(F.lit("question").alias("_kind"), F.col("question_id").alias("item_id")).unionByName(instructions.select(F.lit("instruction").alias("_kind"), F.col("instruction_id").alias("item_id")))
    by = F.col("question_order")
    number = F.when(by == "descending", -F.col("sort_order")).when(by.isin("ascending", "custom"), F.col("sort_order")).otherwise(0)
    order = {"_number": number, "_draw": F.when(by == "random", drawn(F.col("item_key"))).otherwise("")}
    slim = items.select("questionnaire_id", "item_key", "item_type", "item_id", "sort_order", F.coalesce(F.nullif("step", F.lit(0)), F.lit(1)).alias("step"), kind.alias("_kind"))
    slim = slim.join(there, ["_kind", "item_id"], "left_semi").join(questionnaires.select("questionnaire_id", "question_order"), "questionnaire_id")
    placed = places(slim.withColumns(order), ["questionnaire_id"], [*order, "item_key"])

    fixed = F.struct("sort_order", "option_id", *(c for c in options.columns if c not in ("sort_order", "option_id", "question_id")))
    offered = options.groupBy("question_id").agg(F.array_sort(F.collect_list(fixed)).alias("options"))
    asked = questions.join(offered, "question_id", "left").select(F.lit("question").alias("_kind"), F.col("question_id").alias("item_id"), F.struct(*questions.columns, "options").alias("question"))
    told = instructions.select(F.lit("instruction").alias("_kind"), F.col("instruction_id").alias("item_id"), F.struct(*instructions.columns).alias("instruction"))
    whole = placed.join(asked.unionByName(told, allowMissingColumns=True), ["_kind", "item_id"])
    mixed = F.transform(F.array_sort(F.transform("question.options", lambda o: F.struct(drawn(o["option_id"]).alias("at"), o.alias("o")))), lambda x: x["o"])
    question = F.when(by == "random", F.col("question").withField("options", mixed)).otherwise(F.col("question"))
    return whole.select("questionnaire_id", "place", "item_type", "item_id", "sort_order", "step", F.when(F.col("question").isNotNull(), question).alias("question"), "instruction")
