"""Linkage by the index of names against the comparison of all people of a year."""

from __future__ import annotations

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ophelion.functions import fuzzy, ids
from ophelion.operators import linkage
from ophelion.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
PEOPLE = "person_id string, source string, record string, norm_name string, dob_year int, birth_year_min int, birth_year_max int, sex string"


def edited(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(out) + 1)
        roll = rng.random()
        if roll < 0.4 and out:
            out.pop(min(at, len(out) - 1))
        elif roll < 0.8:
            out.insert(at, rng.choice("abcdefgh "))
        else:
            rng.shuffle(out)
    return "".join(out)


@pytest.fixture(scope="module")
def both(spark):
    """Names that are near, short, cut off, empty and repeated; years known, in ranges,
    missing and in one source only."""
    rng = random.Random(4)
    word = lambda low=1: "".join(rng.choices("abcdefgh", k=rng.randint(low, 8)))
    names = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["", " ", "a", "ab", "abc", "aba", "123", "Éa Bç", "abcabc abcabc"]
    asked = [(i, rng.choice(names) if i % 9 else None, f"01/02/{rng.choice([1990, 1991, 1995, 2001])}" if i % 7 else rng.choice([None, "x"]), rng.choice(["M", "f", "", None, "feminino"])) for i in range(160)]
    people = []
    for i in range(220):
        dob = rng.choice([1990, 1991, 1990, None])
        low = rng.choice([None, 1989, 1990, 1994]) if dob is None or i % 11 == 0 else None
        source = "mapping" if dob else "test"
        name = ids._normalise(edited(rng, rng.choice(names)))
        people.append((f"p{i}", source, rng.choice([None, "", f"r{i % 40}", f"r{i % 40}"]), name if i % 17 else None, dob, low, None if low is None else low + rng.randint(0, 2), rng.choice(["M", "F", "Masculino", "x", None])))
    people += [(f"q{i}", *people[5][1:]) for i in range(30)]  # alike
    queries = linkage.query_fields(spark.createDataFrame(asked, "id long, name string, dob string, sex string"), "id", "name", "dob", "sex").cache()
    return queries, spark.createDataFrame(people, PEOPLE).repartition(5).cache()


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_same_decisions_as_all_pairs(both):
    queries, people = both
    all_pairs = linkage.scored_candidates(queries, people).cache()
    want, found = linkage.decide(queries, all_pairs), linkage.link(queries, people)
    assert found.columns == want.columns
    assert rows(found) == rows(want)
    assert {r["decision"] for r in found.collect()} == {"MATCH_UNIQUE", "MATCH_MULTIPLE", "NO_MATCH"}
    assert len({r["phase"] for r in found.collect()}) >= 4
    links = people.sparkSession.createDataFrame([("123",), ("7",), ("7",)], "record string")
    assert rows(linkage.link(queries, people, links)) == rows(linkage.decide(queries, all_pairs, links))


def test_evidence_misses_none(both):
    """All pairs of a year over the thresholds are found, once, and not all pairs are."""
    queries, people = both
    pairs = linkage.by_year(queries, people).join(people.drop("source"), "person_id").join(queries, "query_id").where("norm_name <> '' and query_norm <> ''").collect()
    told = lambda r: bool(r["first_token"]) and r["norm_name"].startswith(r["first_token"]) or bool(r["last_token"]) and r["norm_name"].endswith(r["last_token"])
    close = lambda a, b: max(f(a, b) for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio)) >= 85
    want = {(r["query_id"], r["person_id"]) for r in pairs if told(r) or close(r["query_norm"], r["norm_name"])}
    found = [(r["query_id"], r["person_id"]) for r in linkage.evidence(queries, people).collect()]
    assert len(found) == len(set(found))
    assert want and want <= set(found)
    assert len(found) < len(pairs)


@pytest.mark.parametrize("threshold", [70, 80, 85, 90, 95])
def test_pieces_of_similar_names(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(4000):
        a = "".join(rng.choices("abcd", k=rng.randint(1, 24)))
        b = edited(rng, a if rng.random() < 0.7 else a + a)
        if a and b and max(fuzzy.ratio(a, b), fuzzy.partial_ratio(a, b)) >= threshold:
            pairs.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "short string, long string")
    lost = df.where(F.size(F.array_intersect(linkage.name_pieces(F.col("short"), threshold), linkage.name_grams(F.col("long"), threshold))) == 0)
    assert len(pairs) > 500 and lost.collect() == []
    assert df.where(~linkage.shares_pairs(F.col("short"), F.col("long"), threshold)).collect() == []


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("given", ["respondents", "clients_sought"])
def test_same_decisions_on_the_tables(spark, given):
    queries, people = getattr(catalogue, given)(catalogue.Tables(spark, FOLDER))
    queries, people = queries.cache(), people.cache()
    want = linkage.decide(queries, linkage.scored_candidates(queries, people))
    assert rows(linkage.link(queries, people)) == rows(want)


def test_no_group_for_each_year(both):
    plan = linkage.evidence(*both)._jdf.queryExecution().executedPlan().toString()
    assert "birth_year" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert all("part" in line for line in plan.splitlines() if "Join" in line)


def test_names_without_people(spark, both):
    queries, people = both
    out = linkage.link(queries, people.where("false")).collect()
    assert len(out) == 160 and {(r["decision"], r["phase"]) for r in out} == {("NO_MATCH", "phase1_blocking")}
    assert linkage.link(queries.where("false"), people).count() == 0


def test_candidate_counts_without_pairs(both):
    """As many as ``candidates`` lists, of which no pair by year is joined."""
    queries, people = both
    want = linkage.candidates(queries, people).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    found = linkage.candidate_counts(queries, people)
    assert rows(found.select("query_id", "candidates")) == rows(want) != []


def test_candidates_of_the_tables_are_counted(spark, monkeypatch):
    monkeypatch.setattr(linkage, "by_year", lambda *a: pytest.fail("pairs are listed"))
    assert catalogue.QUERIES["linkage_candidates"](spark, FOLDER).count() > 0


def test_near_is_all_close_pairs_of_a_year(both):
    """By blocks of any size, each pair once; short, long and equal names."""
    queries, people = both
    pairs = linkage.by_year(queries, people).join(people.drop("source"), "person_id").join(queries, "query_id").where("norm_name <> '' and query_norm <> ''").collect()
    want = sorted((r["query_id"], r["person_id"]) for r in pairs if max(fuzzy.ratio(r["query_norm"], r["norm_name"]), fuzzy.partial_ratio(r["query_norm"], r["norm_name"])) >= 85)
    for block in (500, 7):
        assert sorted((r["query_id"], r["person_id"]) for r in linkage.near(queries, people, block=block).collect()) == want != []


def test_a_common_word_makes_no_pairs(spark, monkeypatch):
    """All have one first and one last word; those that are not close are not scored, but
    for the few that a list for review shows."""
    rng = random.Random(9)
    word = lambda alphabet: "".join(rng.choices(alphabet, k=14))
    asked = [(i, f"ana {word('bcdefgh')} sil", "01/02/1990", "F") for i in range(60)]
    people = [(f"p{i:03}", "mapping", f"r{i % 150}", f"ana{word('mnopqrst')}sil", 1990, None, None, "F") for i in range(200)]
    queries = linkage.query_fields(spark.createDataFrame(asked, "id long, name string, dob string, sex string"), "id", "name", "dob", "sex").cache()
    people = spark.createDataFrame(people, PEOPLE).cache()
    want = linkage.decide(queries, linkage.scored_candidates(queries, people))
    real, pairs = linkage.score_pairs, []
    monkeypatch.setattr(linkage, "score_pairs", lambda df, *keep: pairs.append(df.count()) or real(df, *keep))
    assert rows(linkage.link(queries, people)) == rows(want)
    assert pairs == [60 * 5]


def test_ratios_of_many_pairs_at_once():
    rng = random.Random(2)
    text = lambda of, k: "".join(rng.choices(of, k=rng.randint(0, k)))
    a = [text("abcd ", 14) for _ in range(1500)] + [text("aé", 90) for _ in range(60)] + ["x" * 64] * 9
    b = [text("abcd ", 18) if k % 3 else a[k][::-1] for k in range(1500)] + [text("aé", 70) for _ in range(60)] + ["x" * 30 + "y" * 40] * 9
    four = [[int(f(x, y)) for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio)] if x else [0] * 4 for x, y in zip(a, b, strict=True)]
    assert fuzzy.fuzzy_scores.func(pd.Series(a), pd.Series(b)).to_numpy().tolist() == [[*r, max(r)] for r in four]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_scores_are_of_a_search(spark):
    """Every twentieth customer, with all its candidates."""
    found = {r["query_id"]: r["count"] for r in catalogue.QUERIES["linkage_scores"](spark, FOLDER).groupBy("query_id").count().collect()}
    every = {r["query_id"]: r["candidates"] for r in catalogue.QUERIES["linkage_candidates"](spark, FOLDER).collect()}
    assert found == {k: n for k, n in every.items() if k % 20 == 0} != {}


def test_scores_of_alike_people_are_made_once(spark, both, monkeypatch):
    """The same rows as of single pairs, with blocks and groups of any size; a pair of
    forms is scored once, and people without a source are a source of their own."""
    queries, people = both
    single = linkage.candidates(queries, people).join(queries, "query_id")
    want = linkage.score_pairs(single, "query_id", "person_id", "source", F.coalesce("record", F.lit("")).alias("record"))
    found = linkage.scored_candidates(queries, people)
    assert found.columns == want.columns and rows(found) == rows(want) != []
    assert rows(linkage.scored_candidates(queries, people, alike=3, group=7)) == rows(want)
    real, pairs = linkage.score_pairs, []
    monkeypatch.setattr(linkage, "score_pairs", lambda df, *keep: pairs.append(df.count()) or real(df, *keep))
    asked = [(i, "Ana Luz", "01/02/1990", "F") for i in range(40)]
    alike = spark.createDataFrame([(f"p{i}", None if i % 2 else "a", f"r{i}", "analuz", 1990, None, None, "F") for i in range(50)], PEOPLE)
    same = linkage.query_fields(spark.createDataFrame(asked, "id long, name string, dob string, sex string"), "id", "name", "dob", "sex")
    assert linkage.scored_candidates(same, alike).where("score = 80").count() == 40 * 50 and pairs == [2]
