"""Record linkage: blocking, fuzzy scores, additive points, labels and decisions.

All queries are linked at once. ``scored_candidates`` lists every person of a query's
birth year. ``link`` reaches the same decisions without comparing them all: a pair with
nothing in common but year and sex stays under the review threshold, and one that only
shares a first or last word stays under the acceptance threshold, so that of these the
first few by (points, source, person) are enough (``word_pairs``). Close names are found
by blocks of distinct forms (``near``), behind which equal people and equal queries stand.
``evidence`` is the index of name parts, for names that share few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.fuzzy import fuzzy_scores, near_pairs
from ..functions.values import birth_year, norm_sex
from ..sources.staging import staged
from .joins import soft_filter

#: Points of each kind of evidence and the two thresholds.
POINTS = {"record": 100, "exact": 50, "fuzzy95": 45, "fuzzy90": 35, "fuzzy85": 25, "year": 20, "sex": 10, "first": 15, "last": 15, "shared": 5}
ACCEPT, REVIEW, SHOWN = 70, 35, 5
#: A fuzzy ratio under this adds no points.
FUZZY = 85


def query_fields(df: DataFrame, key: str, name: str, dob: str, sex: str, unicode: bool = True) -> DataFrame:
    """(query_id, raw_name, query_norm, tokens, signatures, first_token, last_token,
    birth_year, query_sex) of each respondent. Of the signatures only those that all
    others start with are kept: what starts with any of them starts with one of these."""
    raw = ids.text_or_empty(F.col(name))
    out = df.select(F.col(key).alias("query_id"), raw.alias("raw_name"), ids.normalize_name(F.col(name), unicode).alias("query_norm"), ids.name_tokens(F.col(name), unicode).alias("tokens"), ids.name_heads(raw).alias("signatures"), birth_year(F.col(dob)).alias("birth_year"), norm_sex(F.coalesce(F.col(sex), F.lit(""))).alias("query_sex"))
    return out.withColumns({"first_token": F.coalesce(F.get("tokens", F.lit(0)), F.lit("")), "last_token": F.when(F.size("tokens") > 1, F.element_at("tokens", -1)).otherwise(F.lit(""))})


def by_year(queries: DataFrame, people: DataFrame) -> DataFrame:
    """(query_id, person_id) with the birth year equal to dob_year or between
    birth_year_min and birth_year_max; a range becomes one row per year."""
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    years = people.where(low.isNotNull()).select("person_id", "source", F.explode(F.sequence(low, high)).alias("birth_year"))
    return queries.where("birth_year is not null").select("query_id", "birth_year").join(years, "birth_year").select("query_id", "person_id", "source")


def _heads(name: Column, longest: int = 3) -> Column:
    """The first one, two and three characters, as far as there are so many."""
    return F.array_distinct(F.transform(F.array(*(F.lit(k) for k in range(1, longest + 1))), lambda k: F.substring(name, F.lit(1), k)))


def by_name(wanted: DataFrame, people: DataFrame, key: str = "query_id", person: str = "person_id") -> DataFrame:
    """(query, person, source) where the person's name is a signature of the query or
    starts with one of two letters or more, for queries (key, signatures). The first
    three letters of a form find the people whose name starts with them."""
    forms = wanted.select(key, F.explode("signatures").alias("form")).withColumn("head", F.substring("form", 1, 3))
    named = people.where("norm_name <> ''").select(person, "source", "norm_name", F.explode(_heads(F.col("norm_name"))).alias("head"))
    hit = (F.col("norm_name") == F.col("form")) | ((F.length("form") >= 2) & F.startswith(F.col("norm_name"), F.col("form")))
    return forms.join(named, "head").where(hit).select(key, person, "source").distinct()


def _not_pooled(queries: DataFrame, people: DataFrame, pooled: DataFrame, key: str) -> DataFrame:
    """The queries that lack candidates in some source. ``pooled`` has a row for each
    query and source with any."""
    sources = people.select("source").where("source is not null").distinct().count()
    complete = pooled.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == sources)
    return queries.join(complete, key, "left_anti")


def candidates(queries: DataFrame, people: DataFrame) -> DataFrame:
    """Candidates by birth year; for a query and source without any, by name; of those
    only the ones with the query's sex where there are some."""
    first = by_year(queries, people)
    pooled = first.select("query_id", "source").distinct()
    named = by_name(_not_pooled(queries, people, pooled, "query_id"), people).join(pooled, ["query_id", "source"], "left_anti")
    pairs = first.unionByName(named).join(people.drop("source"), "person_id").join(queries.select("query_id", "query_sex"), "query_id")
    return soft_filter(pairs, ["query_id", "source"], _fits()).drop("query_sex")


def candidate_counts(queries: DataFrame, people: DataFrame) -> DataFrame:
    """(query_id, candidates): the row counts of ``candidates``, whose pairs by birth year
    are counted by (source, year, sex) and not listed. person_id is unique."""
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    years = people.where(low.isNotNull() & F.col("person_id").isNotNull()).select("source", "sex", F.explode(F.sequence(low, high)).alias("birth_year"))
    kinds = years.groupBy("source", "sex", "birth_year").agg(F.count(F.lit(1)).alias("n"))
    summed = lambda n: [F.sum(n).alias("every"), F.sum(F.when(F.coalesce(_fits(), F.lit(False)), n).otherwise(0)).alias("fit")]
    asked = queries.where("birth_year is not null").select("birth_year", "query_sex").distinct()
    held = asked.join(kinds, "birth_year").groupBy("birth_year", "query_sex", "source").agg(*summed(F.col("n")))
    first = queries.join(held, (queries["birth_year"] == held["birth_year"]) & queries["query_sex"].eqNullSafe(held["query_sex"])).select("query_id", "source", "every", "fit")
    pooled = first.select("query_id", "source")
    named = by_name(_not_pooled(queries, people, pooled, "query_id"), people).join(pooled, ["query_id", "source"], "left_anti")
    sexed = named.join(people.select("person_id", "sex"), "person_id").join(queries.select("query_id", "query_sex"), "query_id")
    both = first.unionByName(sexed.groupBy("query_id", "source").agg(*summed(F.lit(1)))).groupBy("query_id", "source").agg(F.sum("every").alias("every"), F.sum("fit").alias("fit"))
    return both.groupBy("query_id").agg(F.sum(F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("every"))).alias("candidates"))


def _fits() -> Column:
    return (F.col("query_sex") == "") | F.startswith(F.lower("sex"), F.col("query_sex"))


def classify(c: dict[str, Column]) -> Column:
    """The label of a scored pair; the first rule that holds."""
    several = F.size(c["tokens"]) >= 2
    inside = (F.size(c["tokens"]) > 0) & (F.size(F.array_except(c["tokens"], c["cand_tokens"])) == 0)
    return (
        F.when(c["norm_name"] == "", "NO_CANDIDATE")
        .when(c["query_norm"] == c["norm_name"], "EXACT_NAME")
        .when(inside, "PARTIAL_NAME")
        .when((c["partial_ratio"] >= 85) & (c["ratio"] < 70), "NAME_ABBREVIATION")
        .when(c["first"] & ~c["last"] & several, "FIRST_NAME_ONLY")
        .when(c["last"] & ~c["first"] & several, "LAST_NAME_ONLY")
        .when(c["year"] & c["sex"] & (c["token_set_ratio"] < 70), "YEAR_AND_GENDER_MATCH")
        .when((c["token_set_ratio"] >= 85) & (c["year"] | c["sex"]), "POSSIBLE_HOMONYM")
        .when(c["ratio"] >= 80, "POSSIBLE_TYPO")
        .when((c["token_set_ratio"] >= 70) | (c["partial_ratio"] >= 75), "PARTIAL_NAME")
        .otherwise("LOW_CONFIDENCE")
    )


#: People, or queries, that are alike in one row, and people or queries of a group.
ALIKE, GROUP = 500, 1_000


def _alike(rows: DataFrame, form: str, columns: Sequence[str], key: str, member: Column, name: str, alike: int) -> DataFrame:
    """(form, columns, block, name): the rows of a form as arrays of about ``alike``."""
    many = rows.groupBy(form).agg(F.ceil(F.count(F.lit(1)) / alike).alias("_n")).where("_n > 1")
    block = F.pmod(F.xxhash64(key), F.coalesce("_n", F.lit(1)))
    return rows.join(many, form, "left").groupBy(form, *columns, block.alias("block")).agg(F.collect_list(member).alias(name))


def _groups(rows: DataFrame, side: str, form: str, members: str, columns: Sequence[str], group: int) -> DataFrame:
    """(birth_year, side_group, side_rows): the rows of a year dealt to groups that have
    about ``group`` members."""
    n = rows.groupBy("birth_year").agg(F.ceil(F.sum(F.size(members)) / group).alias("_n"))
    dealt = rows.join(n, "birth_year").withColumn(f"{side}_group", F.pmod(F.xxhash64(form, "block"), F.col("_n")))
    return dealt.groupBy("birth_year", f"{side}_group").agg(F.collect_list(F.struct(*columns)).alias(f"{side}_rows"))


def scored_candidates(queries: DataFrame, people: DataFrame, alike: int = ALIKE, group: int = GROUP) -> DataFrame:
    """Every candidate pair with its ratios, points, label and reasons. ``people`` has
    person_id, source, record, norm_name, dob_year, birth_year_min, birth_year_max, sex.

    Queries that are alike in all that is scored are one row with their ids, and so are
    people; they are scored once, and told apart in the result only. The pairs of a year
    are made from pairs of groups, each a row of work, so that no pair is shuffled.
    query_id and person_id are unique."""
    named = people.where("person_id is not null").withColumn("source", F.coalesce("source", F.lit("\x00")))
    rows = staged(queries.where("query_id is not null").select("query_id", *QUERY_FORM, _form(QUERY_FORM).alias("q_form")), "rows")  # counted and gathered
    asked = _alike(rows, "q_form", QUERY_FORM, "query_id", F.col("query_id"), "q_ids", alike)
    held = _alike(named.withColumn("p_form", _form(PERSON_FORM)), "p_form", PERSON_FORM, "person_id", F.struct("person_id", F.coalesce("record", F.lit("")).alias("record")), "members", alike)
    asked, held = staged(asked, "asked"), staged(held, "held")
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    years = held.where(low.isNotNull()).withColumn("birth_year", F.explode(F.sequence(low, high)))
    fits = lambda sex: F.max(F.coalesce(F.startswith(F.lower("sex"), F.lit(sex)), F.lit(False)))
    years = years.join(years.groupBy("source", "birth_year").agg(fits("m").alias("any_m"), fits("f").alias("any_f")), ["source", "birth_year"])
    ours, theirs = (*QUERY_FORM, "q_ids"), (*PERSON_FORM, "members")
    met = _groups(asked.where("birth_year is not null"), "q", "q_form", "q_ids", ours, group).join(_groups(years, "p", "p_form", "members", (*theirs, "any_m", "any_f"), group), "birth_year")
    # a number, as the few bytes of groups would else be put into few tasks
    tasks = 4 * int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "birth_year", "q_group", "p_group").select(F.explode("q_rows").alias("q"), "p_rows").select("q", F.explode("p_rows").alias("p")).select("q.*", "p.*")
    any_fit = F.when(F.col("query_sex") == "m", F.col("any_m")).when(F.col("query_sex") == "f", F.col("any_f")).otherwise(True)
    first = met.where(~any_fit | F.coalesce(_fits(), F.lit(False))).select(*ours, *theirs)
    # a query without people of its year in a source
    forms, persons = asked.dropDuplicates(["q_form"]).drop("q_ids", "block"), held.dropDuplicates(["p_form"]).drop("members", "block")
    pooled = staged(pools(forms, persons), "pools")
    found = by_name(_not_pooled(forms, persons, pooled, "q_form"), persons, "q_form", "p_form").join(pooled, ["q_form", "source"], "left_anti").drop("source")
    found = soft_filter(found.join(persons, "p_form").join(forms, "q_form"), ["q_form", "source"], _fits()).select("q_form", "p_form")
    pairs = first.unionByName(found.join(asked, "q_form").join(held, "p_form").select(*ours, *theirs))
    scored = score_pairs(pairs, "q_ids", "members", F.nullif("source", F.lit("\x00")).alias("source"))
    each = scored.select(F.explode("q_ids").alias("query_id"), *scored.columns[1:])
    each = each.select("query_id", F.explode("members").alias("who"), *scored.columns[2:])
    return each.select("query_id", "who.person_id", "source", "who.record", *scored.columns[3:])


def _year_and_sex() -> tuple[Column, Column]:
    year = F.coalesce((F.col("dob_year") == F.col("birth_year")), F.when(F.col("dob_year").isNull(), F.col("birth_year").between(F.col("birth_year_min"), F.col("birth_year_max"))), F.lit(False))
    return year, F.coalesce((F.col("query_sex") != "") & (norm_sex(F.col("sex")) == F.col("query_sex")), F.lit(False))


def score_pairs(pairs: DataFrame, *keep: str | Column) -> DataFrame:
    """The ``keep`` columns of each pair with its ratios, points, label and reasons."""
    pairs = pairs.withColumn("norm_name", F.coalesce("norm_name", F.lit("")))
    rated = pairs.withColumn("f", fuzzy_scores("query_norm", "norm_name")).select("*", "f.*").drop("f")
    named = F.col("norm_name") != ""
    exact = named & (F.col("query_norm") == F.col("norm_name"))
    first = named & (F.col("first_token") != "") & F.startswith("norm_name", "first_token")
    last = named & (F.col("last_token") != "") & F.endswith("norm_name", "last_token")
    # a collapsed name is one word of its own
    cand_tokens = F.when(F.length("norm_name") >= 2, F.array("norm_name")).otherwise(F.array().cast("array<string>"))
    shared = F.size(F.array_intersect("tokens", cand_tokens))
    year, sex = _year_and_sex()
    best = F.col("fuzzy_best")
    fuzzy = F.when(best >= 95, POINTS["fuzzy95"]).when(best >= 90, POINTS["fuzzy90"]).when(best >= 85, POINTS["fuzzy85"]).otherwise(0)
    other = named & ~exact
    worth = lambda test, points: F.when(test, points).otherwise(0)
    score = worth(exact, POINTS["exact"]) + worth(other, fuzzy) + worth(other & first, POINTS["first"]) + worth(other & last, POINTS["last"]) + worth(other, F.least(shared, F.lit(3)) * POINTS["shared"]) + worth(year, POINTS["year"]) + worth(sex, POINTS["sex"])
    reason = lambda test, text: F.when(test, text)
    reasons = F.array_join(
        F.array_compact(
            F.array(
                reason(exact, F.lit("exact_name")),
                reason(other & (fuzzy > 0), F.concat(F.lit("fuzzy="), best.cast("string"))),
                reason(other & first, F.lit("first_name")),
                reason(other & last, F.lit("last_name")),
                reason(other & (shared > 0), F.concat(F.lit("shared_tokens="), shared.cast("string"))),
                reason(year, F.lit("birth_year")),
                reason(sex, F.lit("sex")),
            )
        ),
        "|",
    )
    c = {k: F.col(k) for k in ("tokens", "norm_name", "query_norm", "ratio", "partial_ratio", "token_set_ratio")}
    c |= {"cand_tokens": cand_tokens, "first": first, "last": last, "year": year, "sex": sex}
    return rated.select(*keep, "norm_name", "ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "fuzzy_best", score.alias("score"), year.alias("birth_year_match"), sex.alias("sex_match"), first.alias("first_name_match"), last.alias("last_name_match"), classify(c).alias("classification"), reasons.alias("reasons"))


def phase(reasons: Column) -> Column:
    has = lambda t: F.contains(reasons, F.lit(t))
    return F.when(has("exact_name"), "phase3_exact_name").when(has("fuzzy"), "phase4_fuzzy").when(has("first_name") | has("shared_tokens"), "phase3_token_name").when(has("birth_year"), "phase1_birth_year").otherwise("phase3_name")


def _best_per_record(scored: DataFrame) -> DataFrame:
    own = F.coalesce(F.nullif("record", F.lit("")), F.concat(F.lit("\x00"), F.col("source"), F.col("person_id").cast("string")))
    order = [F.desc("score"), F.asc("source"), F.asc("person_id")]
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", own).orderBy(*order))).where("_n = 1").drop("_n")


def decide(queries: DataFrame, scored: DataFrame, record_links: DataFrame | None = None) -> DataFrame:
    """(query_id, decision, record, score, phase, candidates) for every query.

    A name of digits that links one record decides at once. Else the pairs at or over
    the accept threshold decide if they agree on one non-blank record; the best pair
    that has it gives score and phase. Else up to five pairs go to review.
    """
    one = _best_per_record(scored)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "person_id"))
    ranked = one.withColumn("_rank", rank)
    high, named = F.col("score") >= ACCEPT, F.col("record") != ""
    top = F.struct("score", (-F.col("_rank")).alias("r"), "record", "reasons")
    listed = lambda test: F.slice(F.transform(F.array_sort(F.collect_list(F.when(test & (F.col("_rank") <= SHOWN), F.struct("_rank", "person_id", "record", "score", "classification")))), lambda x: x.dropFields("_rank")), 1, SHOWN)
    per = ranked.groupBy("query_id").agg(
        F.count_if(high).alias("n_high"),
        F.countDistinct(F.when(high & named, F.col("record"))).alias("records"),
        F.max(F.when(high & named, top)).alias("unique"),
        F.max(top).alias("best"),
        listed(high).alias("accepted"),
        listed(F.col("score") >= REVIEW).alias("review"),
    )
    out = queries.select("query_id", "raw_name").join(per, "query_id", "left")
    digits = F.lit(None).cast("string")
    if record_links is not None:
        single = record_links.groupBy(F.col("record").alias("_record")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
        out = out.join(single, (F.col("raw_name") == F.col("_record")) & F.col("raw_name").rlike(r"^\d+$"), "left")
        digits = F.col("_record")
    unique = F.coalesce((F.col("n_high") > 0) & (F.col("records") == 1), F.lit(False))
    shown = F.when(F.col("n_high") > 0, F.col("accepted")).otherwise(F.col("review"))
    several = F.coalesce(F.size(shown) > 0, F.lit(False))
    decision = F.when(digits.isNotNull() | unique, "MATCH_UNIQUE").when(several, "MATCH_MULTIPLE").otherwise("NO_MATCH")
    how = F.when(digits.isNotNull(), "phase0_record").when(unique, phase(F.col("unique.reasons"))).when(several, "review").when(F.col("best").isNull(), "phase1_blocking").otherwise("phase4_fuzzy")
    return out.select("query_id", decision.alias("decision"), F.when(digits.isNotNull(), digits).when(unique, F.col("unique.record")).alias("record"), F.when(digits.isNotNull(), POINTS["record"]).when(unique, F.col("unique.score")).otherwise(F.coalesce("best.score", F.lit(0))).alias("score"), how.alias("phase"), F.when(~unique & digits.isNull() & several, shown).alias("candidates"))


# ------------------------------------------------- linkage by an index of names


def name_pieces(name: Column, threshold: int = FUZZY) -> Column:
    """A name cut into so many pieces that one of them is whole in every other name that
    is as long or longer and as similar as the threshold.

    With n characters here, m in the stretch of the other name that is compared and l in
    common, 2 l / (n + m) >= t leaves n + m - 2 l <= (1 - t)(n + m) insertions and
    deletions, each of which spoils one piece at most; l <= n bounds m by n (2 / t - 1),
    and so the edits by 2 n (1 - t) / t."""
    n = F.length(name)
    count = F.floor(n * (200.0 / threshold - 2) + 1e-9).cast("int") + 1
    start = lambda i: F.floor(i * n / count).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(name, start(i) + 1, start(i + 1) - start(i)))
    return F.array_distinct(F.filter(cut, lambda x: x != ""))


def name_grams(name: Column, threshold: int = FUZZY) -> Column:
    """All stretches of a name that are as long as a piece can be."""
    longest = math.ceil(threshold / (200.0 - 2 * threshold) - 1e-9)
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - k + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(k)))
    each = [of(k) for k in range(1, longest + 1)]
    return F.array_distinct(F.filter(F.concat(*each), lambda x: x != ""))


def shares_pairs(short: Column, long: Column, threshold: int = FUZZY) -> Column:
    """Whether the longer name holds as many pairs of letters of the shorter one as two
    names have at the threshold at least: by the bounds of ``name_pieces`` a character
    that is missing spoils two pairs and one that is added one, so that
    2 (n - l) + (m - l) of n - 1 may be spoilt; the bound is linear in m, which lies
    between n t / (2 - t) and n (2 / t - 1)."""
    t = threshold / 100
    spoilt = max(2 - 1.5 * t + m * (1 - 1.5 * t) for m in (t / (2 - t), 2 / t - 1))
    n = F.length(short)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(short, i, F.lit(2)))
    return F.size(F.filter(pairs, lambda x: F.contains(long, x))) >= n * (1 - spoilt) - 1 - 1e-9


def _kind(kind: str, parts: Column) -> Column:
    return F.transform(parts, lambda x: F.concat(F.lit(kind), x))


def evidence(queries: DataFrame, people: DataFrame, key: str = "query_id", person: str = "person_id", threshold: int = FUZZY) -> DataFrame:
    """(query, person): the pairs of one birth year whose names share evidence: a fuzzy
    ratio at or over the threshold, the query's first word at the start of the person's
    name, or its last word at the end. None is missed, and each comes once; some pairs a
    little under the threshold come too.

    Both sides are exploded into parts of their names and meet in (year, part), so that a
    year with many people is spread over its parts: a piece of the shorter name is a
    stretch of the longer one (kind a: the query is shorter or as long, b: the person),
    and words meet by three letters (p: at the start, s: at the end, reversed)."""
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    name, asked = F.col("norm_name"), F.col("query_norm")
    theirs = F.concat(_kind("a", name_grams(name, threshold)), _kind("b", name_pieces(name, threshold)), _kind("p", _heads(name)), _kind("s", _heads(F.reverse(name))))
    word = lambda w: F.when(F.col(w) != "", F.array(F.col(w))).otherwise(F.array().cast("array<string>"))
    ours = F.concat(
        _kind("a", name_pieces(asked, threshold)),
        _kind("b", name_grams(asked, threshold)),
        _kind("p", F.transform(word("first_token"), lambda w: F.substring(w, 1, 3))),
        _kind("s", F.transform(word("last_token"), lambda w: F.substring(F.reverse(w), 1, 3))),
    )
    held = people.where("norm_name <> ''").where(low.isNotNull()).select(person, "norm_name", F.explode(F.sequence(low, high)).alias("birth_year"), theirs.alias("parts"))
    wanted = queries.where("birth_year is not null and query_norm <> ''").select(key, "query_norm", "first_token", "last_token", "birth_year", F.explode(ours).alias("part"))
    met = wanted.join(held.select(person, "norm_name", "birth_year", F.explode("parts").alias("part")), ["birth_year", "part"])
    kind, part = F.substring("part", 1, 1), F.substring(F.col("part"), F.lit(2), F.length("part"))
    starts = (F.col("first_token") != "") & F.startswith(name, F.col("first_token"))
    ends = (F.col("last_token") != "") & F.endswith(name, F.col("last_token"))
    # of all pieces that the longer name holds the first one finds the pair
    first = lambda short, long: F.get(F.filter(name_pieces(short, threshold), lambda x: F.contains(long, x)), F.lit(0)) == part
    fits = (
        F.when(kind == "p", starts)
        .when(kind == "s", ends & ~starts)
        .when(starts | ends, False)
        .when(kind == "a", (F.length(asked) <= F.length(name)) & first(asked, name) & shares_pairs(asked, name, threshold))
        .otherwise((F.length(name) < F.length(asked)) & first(name, asked) & shares_pairs(name, asked, threshold))
    )
    return met.where(fits).select(key, person)


#: Names of a block; every pair of blocks of a year is one row of work.
BLOCK = 500


def near(queries: DataFrame, people: DataFrame, key: str = "query_id", person: str = "person_id", threshold: int = FUZZY, block: int = BLOCK) -> DataFrame:
    """(query, person): the pairs of one birth year with a ratio or partial ratio at or
    over the threshold, each once. The names of a year are dealt to blocks, and pairs of
    blocks to tasks, so that no year is one task's work."""
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    held = people.where("norm_name <> ''").where(low.isNotNull()).select(F.col(person).alias("id"), F.col("norm_name").alias("name"), F.explode(F.sequence(low, high)).alias("birth_year"))
    asked = queries.where("birth_year is not null and query_norm <> ''").select(F.col(key).alias("id"), F.col("query_norm").alias("name"), "birth_year")

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        n = rows.groupBy("birth_year").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
        dealt = rows.join(n, "birth_year").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
        return dealt.groupBy("birth_year", F.col("b").alias(f"{side}_block")).agg(F.collect_list("id").alias(f"{side}_ids"), F.collect_list("name").alias(f"{side}_names"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, x, b, y in zip(pdf["q_ids"], pdf["q_names"], pdf["p_ids"], pdf["p_names"], strict=True):
                i, j = near_pairs(x, y, threshold)
                yield pd.DataFrame({key: np.asarray(a, object)[i], person: np.asarray(b, object)[j]})

    met = blocks(asked, "q").join(blocks(held, "p"), "birth_year").repartition("birth_year", "q_block", "p_block").select("q_ids", "q_names", "p_ids", "p_names")
    types = {c: df.schema[c].dataType.simpleString() for c, df in ((key, queries), (person, people))}
    return met.mapInPandas(compare, f"`{key}` {types[key]}, `{person}` {types[person]}")


WORDS = ("birth_year", "query_sex", "first_token", "last_token")


def word_pairs(queries: DataFrame, people: DataFrame, pooled: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(q_form, p_form): of the pairs of a birth year that share a first or last word, those
    with the first ``shown`` records by points of year, sex and words, then source and
    person. A pair that is not close has just these points and a close one has more, so the
    others are in no list and are no best pair. Queries that ask for the same year, sex and
    words share them; ``people`` are forms."""
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    name = F.col("norm_name")
    years = people.where("norm_name <> ''").where(low.isNotNull()).select("p_form", "norm_name", F.explode(F.sequence(low, high)).alias("birth_year"))
    asked = queries.where("birth_year is not null and query_norm <> ''")
    groups = asked.select(*WORDS).distinct()

    def meet(word: str, turned: Column) -> DataFrame:
        part = lambda c: F.reverse(c) if word == "last_token" else c
        named = years.select("p_form", "norm_name", "birth_year", F.explode(_heads(turned)).alias("head"))
        words = groups.where(F.col(word) != "").select("birth_year", word).distinct().withColumn("head", F.substring(part(F.col(word)), 1, 3))
        hit = words.join(named, ["birth_year", "head"]).where(F.startswith(turned, part(F.col(word))))
        return groups.join(hit.select("birth_year", word, "p_form"), ["birth_year", word]).select(*WORDS, "p_form")

    both = meet("first_token", name).unionByName(meet("last_token", F.reverse(name))).distinct().join(people, "p_form")
    # the pool of a query is that of its year and sex
    fitting = asked.select("q_form", "birth_year", "query_sex").join(pooled, "q_form").select("birth_year", "query_sex", "source", "any_fit").distinct()
    both = both.join(fitting, ["birth_year", "query_sex", "source"]).where(~F.col("any_fit") | F.coalesce(_fits(), F.lit(False)))
    year, sex = _year_and_sex()
    worth = lambda test, points: F.when(test, POINTS[points]).otherwise(0)
    starts, ends = (F.col("first_token") != "") & F.startswith(name, F.col("first_token")), (F.col("last_token") != "") & F.endswith(name, F.col("last_token"))
    points = worth(year, "year") + worth(sex, "sex") + worth(starts, "first") + worth(ends, "last")
    each = both.select(*WORDS, "source", "p_form", (-points).alias("less"), F.explode("shown").alias("who"))
    own = F.coalesce(F.nullif("who.record", F.lit("")), F.concat(F.lit("\x00"), F.col("source"), F.col("who.person_id").cast("string")))
    one = each.groupBy(*WORDS, own.alias("own")).agg(F.min(F.struct("less", "source", "who.person_id", "p_form")).alias("best"))
    few = one.withColumn("_n", F.row_number().over(Window.partitionBy(*WORDS).orderBy("best"))).where(F.col("_n") <= shown).select(*WORDS, "best.p_form")
    return asked.select("q_form", *WORDS).join(few, list(WORDS)).select("q_form", "p_form").distinct()


PERSON_FORM = ("source", "norm_name", "dob_year", "birth_year_min", "birth_year_max", "sex")
QUERY_FORM = ("query_norm", "tokens", "signatures", "first_token", "last_token", "birth_year", "query_sex")


def _form(columns: Sequence[str]) -> Column:
    return F.md5(F.to_json(F.struct(*columns)).cast("binary"))


def person_forms(people: DataFrame, parts: int = 64) -> DataFrame:
    """People who are alike in all that is scored, as one row: p_form, their columns, the
    least and greatest record, the first person with a record, and the first SHOWN
    persons of different records. A form that many share is summed up in parts."""
    record = F.nullif("record", F.lit(""))
    own = F.coalesce(F.concat(F.lit("r"), record), F.concat(F.lit("p"), F.col("person_id").cast("string")))
    rows = people.select("person_id", record.alias("record"), own.alias("_own"), *PERSON_FORM, _form(PERSON_FORM).alias("p_form"))
    summed = rows.groupBy("p_form", *PERSON_FORM).agg(F.min("record").alias("low_record"), F.max("record").alias("high_record"), F.min(F.when(F.col("record").isNotNull(), F.col("person_id"))).alias("named"))
    one = rows.groupBy("p_form", "_own").agg(F.min("person_id").alias("person_id"), F.min("record").alias("record"))
    dealt = one.withColumn("_part", F.pmod(F.xxhash64("_own"), F.lit(parts)))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("person_id"))
    some = dealt.withColumn("_n", order("p_form", "_part")).where(F.col("_n") <= SHOWN)
    few = some.withColumn("_n", order("p_form")).where(F.col("_n") <= SHOWN)
    shown = few.groupBy("p_form").agg(F.array_sort(F.collect_list(F.struct("person_id", F.coalesce("record", F.lit("")).alias("record")))).alias("shown"))
    return summed.join(shown, "p_form")


def pools(queries: DataFrame, people: DataFrame, key: str = "q_form") -> DataFrame:
    """(query, source, any_fit, floor) of queries that have people of their birth year:
    whether some of them fit the query's sex, and the points of the best by year and sex
    alone. Only what people have in this (source, year, sex) is joined."""
    low, high = F.coalesce("birth_year_min", "dob_year"), F.coalesce("birth_year_max", "dob_year")
    kinds = people.where(low.isNotNull()).select("source", "sex", F.col("dob_year").alias("dob_year"), F.explode(F.sequence(low, high)).alias("birth_year"))
    kinds = kinds.select("source", "sex", "birth_year", F.coalesce(F.col("dob_year") == F.col("birth_year"), F.lit(True)).alias("exact")).distinct()
    met = queries.where("birth_year is not null").select(key, "birth_year", "query_sex").join(kinds, "birth_year")
    fits = F.coalesce(_fits(), F.lit(False))
    same = (F.col("query_sex") != "") & (F.coalesce(norm_sex(F.col("sex")), F.lit("")) == F.col("query_sex"))
    points = F.when(F.col("exact"), POINTS["year"]).otherwise(0) + F.when(same, POINTS["sex"]).otherwise(0)
    per = met.groupBy(key, "source").agg(F.max(fits).alias("any_fit"), F.max(F.when(fits, points)).alias("_fit"), F.max(points).alias("_all"))
    return per.select(key, "source", "any_fit", F.when(F.col("any_fit"), F.col("_fit")).otherwise(F.col("_all")).alias("floor"))


def link(queries: DataFrame, people: DataFrame, record_links: DataFrame | None = None) -> DataFrame:
    """(query_id, decision, record, score, phase, candidates) for every query: what
    ``decide`` makes of ``scored_candidates``, from close names and the first few pairs
    that share a word."""
    asked = staged(queries.withColumn("q_form", _form(QUERY_FORM)), "asked")
    forms = asked.select("q_form", *QUERY_FORM).dropDuplicates(["q_form"])
    held = staged(person_forms(people), "held")
    pooled = staged(pools(forms, held), "pools")
    year = near(forms, held, "q_form", "p_form").unionByName(word_pairs(forms, held, pooled)).distinct()
    lacking = _not_pooled(forms, held, pooled, "q_form")
    name = by_name(lacking, held, "q_form", "p_form").join(pooled, ["q_form", "source"], "left_anti").select("q_form", "p_form")
    by_birth = year.join(held, "p_form").join(forms, "q_form").join(pooled.select("q_form", "source", "any_fit"), ["q_form", "source"])
    # without a pool by year the people found by name are the pool
    pairs = by_birth.where(~F.col("any_fit") | F.coalesce(_fits(), F.lit(False))).drop("any_fit").unionByName(soft_filter(name.join(held, "p_form").join(forms, "q_form"), ["q_form", "source"], _fits()))
    scored = staged(score_pairs(pairs, "q_form", "p_form", "source", "low_record", "high_record", "named", "shown"), "scored")
    high = F.col("score") >= ACCEPT
    told = high & F.col("named").isNotNull()
    best = F.min(F.when(told, F.struct((-F.col("score")).alias("score"), "source", "named", "reasons")))
    per = scored.groupBy("q_form").agg(F.max("score").alias("top"), F.max(high).alias("any_high"), F.min(F.when(told, F.col("low_record"))).alias("low"), F.max(F.when(told, F.col("high_record"))).alias("high"), best.alias("best"))
    per = per.join(pooled.groupBy("q_form").agg(F.max("floor").alias("floor")), "q_form", "full")
    rows = scored.where(F.col("score") >= REVIEW).select("q_form", "source", "score", "classification", F.explode("shown").alias("who")).select("q_form", "source", "score", "classification", "who.*")
    own = F.coalesce(F.nullif("record", F.lit("")), F.concat(F.lit("\x00"), F.col("source"), F.col("person_id").cast("string")))
    order = [F.desc("score"), F.asc("source"), F.asc("person_id")]
    once = rows.withColumn("_own", own).withColumn("_n", F.row_number().over(Window.partitionBy("q_form", "_own").orderBy(*order))).where("_n = 1")
    first = once.withColumn("_rank", F.row_number().over(Window.partitionBy("q_form").orderBy(*order))).where(F.col("_rank") <= SHOWN)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "person_id", "record", "score", "classification"))), lambda x: x.dropFields("_rank"))
    lists = first.groupBy("q_form").agg(listed.alias("listed"))
    out = asked.select("query_id", "raw_name", "q_form").join(per, "q_form", "left").join(lists, "q_form", "left")
    digits = F.lit(None).cast("string")
    if record_links is not None:
        single = record_links.groupBy(F.col("record").alias("_record")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
        out = out.join(single, (F.col("raw_name") == F.col("_record")) & F.col("raw_name").rlike(r"^\d+$"), "left")
        digits = F.col("_record")
    unique = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    shown = F.when(F.coalesce("any_high", F.lit(False)), F.filter("listed", lambda x: x["score"] >= ACCEPT)).otherwise(F.col("listed"))
    several = F.coalesce(F.size(shown) > 0, F.lit(False))
    score = F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("floor", F.lit(0)))
    decision = F.when(digits.isNotNull() | unique, "MATCH_UNIQUE").when(several, "MATCH_MULTIPLE").otherwise("NO_MATCH")
    how = F.when(digits.isNotNull(), "phase0_record").when(unique, phase(F.col("best.reasons"))).when(several, "review").when(F.coalesce("top", "floor").isNull(), "phase1_blocking").otherwise("phase4_fuzzy")
    return out.select("query_id", decision.alias("decision"), F.when(digits.isNotNull(), digits).when(unique, F.col("low")).alias("record"), F.when(digits.isNotNull(), POINTS["record"]).when(unique, -F.col("best.score")).otherwise(score).alias("score"), how.alias("phase"), F.when(~unique & digits.isNull() & several, shown).alias("candidates"))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision", "phase").agg(F.count(F.lit(1)).alias("n"))


def confirmed(answers: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Answers of uniquely linked respondents with their record."""
    links = decided.where("decision = 'MATCH_UNIQUE'").select(F.col("query_id").alias(key), F.col("record"))
    return answers.drop("record").join(links, key)


def fuzzy_find(pool: DataFrame, name: str, query: str, threshold: int = 80) -> DataFrame:
    """Rows whose name is close to one query: the better of token sort and partial."""
    rated = pool.withColumn("_f", fuzzy_scores(F.lit(query), F.col(name)))
    return rated.withColumn("similarity", F.greatest("_f.token_sort_ratio", "_f.partial_ratio")).drop("_f").where(F.col("similarity") >= threshold)


def latest_tests(tests: DataFrame) -> DataFrame:
    """Per person the latest test with the birth-year range of its age."""
    from ..functions.values import birth_year_range

    low, high = birth_year_range(F.col("age"), F.col("test_date"))
    last = tests.groupBy("person_id").agg(F.max_by(F.struct("name", "age", "sex", "test_date"), F.struct("test_date", "name")).alias("t")).select("person_id", "t.*")
    return last.select("person_id", F.lit("test").alias("source"), ids.normalize_name(F.col("name")).alias("norm_name"), "sex", low.alias("birth_year_min"), high.alias("birth_year_max"))
