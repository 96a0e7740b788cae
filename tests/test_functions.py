"""Functions by hand-computed cases, and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ophelion.functions import fuzzy, ids, similarity, special, text, values
from ophelion.operators import classify, clean, cluster, dedupe, joins, linkage, ranking, reports, scores, signal


def one(spark, column, **row):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint' if isinstance(v, int) else 'double'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], kinds).select(column.alias("x")).first()["x"]


def test_names(spark):
    cases = {"João da Silva": "joaodasilva", "Cópia de  Çelia-Øst": "celiaost", "GON�ALVES": "goncalves", "Straße Łódź Ætna": "strasselodzaetna", "": "", None: ""}
    for name, want in cases.items():
        assert one(spark, ids.normalize_name(F.col("n")), n=name) == want
    assert ids.tokens_of("Marina Teresa e Lopes") == ["marina", "teresa", "lopes"]
    assert ids.variations_of("Ana Bela Costa") == {"ana", "anabelacosta", "anabela", "anacosta", "anab", "anac", "anabc", "abc", "anabcosta"}
    assert ids.variations_of("Ana Bela Costa", True) - ids.variations_of("Ana Bela Costa") == {"ana bela costa", "ana bela", "ana costa"}
    assert ids.variations_of(" ") == set()
    long = [f"{a}{b}" for a in "bcdefghi" for b in "xyz"]
    found = ids.variations_of(" ".join(["ana", *long]))
    assert {"ana" + "".join(long), "ana" + long[-1], "ana" + long[0] + long[-1], "a" + "".join(w[0] for w in long), "ana" + long[0][0] + long[-1]} <= found
    full = [f"{chr(98 + k)}q" for k in range(ids.INITIALS)]  # every subset of initials as far as INITIALS goes
    assert len({x for x in ids.variations_of(" ".join(["ana", *full])) if x.startswith("ana") and "q" not in x}) == 2**ids.INITIALS


@given(st.text(max_size=30))
def test_normalised_names_are_plain(name):
    out = ids._normalise(name)
    assert out == out.lower() and all(c.isascii() and c.isalnum() for c in out) and ids._normalise(out) == out


@given(st.text(alphabet="abc d", max_size=12), st.text(alphabet="abc d", max_size=12))
def test_ratios_are_symmetric_and_bounded(a, b):
    for f in (fuzzy.ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 100
    n, m = len(a), len(b)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.lcs(a, b) == table[n][m]
    short, long = sorted((a, b), key=len)
    if short:
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max(fuzzy.ratio(short, long[max(0, s) : s + len(short)]) for s in range(1 - len(short), len(long))))


def test_ratios():
    assert fuzzy.ratio("abcd", "abed") == 75 and fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("ana bela", "ana bela costa") == 100


def test_ids(spark):
    parse = lambda x: tuple(one(spark, ids.parse_id(F.col("n")), n=x) or ())
    assert parse("123-Ana Luz_900102_200304050607") == ("123", "analuz", "900102", "200304050607")
    assert parse("123_Ana_900102_200304050607") == ("123", "ana", "900102", "200304050607")
    assert parse("123_900102_200304050607") == ("123", None, "900102", "200304050607")
    assert parse("ana_bela_900102") == ("ana", "bela", "900102", None)
    assert parse("") == (None, None, None, None)
    assert one(spark, ids.canonical_id(F.col("n")), n="123-Ana__900102_200304050607") == "123_ana_900102_200304050607"
    build = lambda **k: one(spark, ids.build_id(F.col("r"), F.col("n"), F.col("b"), F.col("t")), **k)
    assert build(r="n 77/2", n="Ana Luz", b="900102", t="") == "77-analuz_900102"
    assert build(r="", n=None, b="", t="200304050607") == "unknown_200304050607"
    for n in (0, 7, 123456789, 10**12):
        code = one(spark, ids.encode_id(F.col("n")), n=n)
        assert "=" not in code and one(spark, ids.decode_id(F.col("c")), c=code) == n
    record, name = ids.record_and_name(F.col("n"))
    for raw, want in {"12345 - Ana": ("12345", "Ana"), "12, Ana Luz": ("12", "Ana Luz"), "Ana": (None, "Ana"), "": (None, None)}.items():
        assert (one(spark, record, n=raw), one(spark, name, n=raw)) == want
    f = one(spark, ids.identity_from_file_name(F.col("n")), n="/x/Cópia de 12-Ana Luz_900102_200304050607.csv")
    assert tuple(f) == ("12", "Ana Luz", "900102", "200304050607", True)
    assert one(spark, ids.identity_from_file_name(F.col("n")), n="other.csv")["confident"] is False


def test_dates_and_values(spark):
    d = lambda x: tuple(one(spark, values.dob_parts(F.col("d")), d=x) or ())
    assert d("11/07/1985") == (11, 7, 1985) and d("2001-2-3") == (3, 2, 2001) and d("31.02.29") == (31, 2, 2029)
    assert d("1/13/2000") == (None, None, None) and d("1/1") == (None, None, None) and d(None) == (None, None, None)
    assert one(spark, values.birth_text(F.col("d")), d="1990-01-02") == "900102" and one(spark, values.birth_text(F.col("d")), d="none") == ""
    assert one(spark, values.birth_slashed(F.col("d")), d="25/12/1990") == "90/12/25"
    assert one(spark, values.test_slashed(F.col("d")), d="200304050607") == "20/03/04 05:06:07"
    assert [one(spark, values.parse_bool(F.col("d")), d=x) for x in ("Sim", " NÃO ", "", "talvez", None)] == [True, False, None, None, None]
    assert [one(spark, values.year_of_answer(F.col("d")), d=x) for x in ("1/2/1990", "1987.0", "x")] == [1990, 1987, None]
    assert [one(spark, values.norm_sex(F.col("d")), d=x) for x in (" Feminino", "M", "x")] == ["f", "m", ""]
    assert one(spark, values.finite_or_null(F.col("d")), d=math.inf) is None


def test_readability_by_hand(spark):
    # 5 words, 2 sentences, 7 vowel runs, 18 letters
    t = "Bom dia. Eu sou ação1!"
    c = {k: one(spark, v, t=t) for k, v in text.text_counts(F.col("t")).items()}
    assert c == {"words": 5, "sentences": 2, "syllables": 6, "letters": 16}
    r = {k: one(spark, v, t=t) for k, v in text.readability(*text.text_counts(F.col("t")).values()).items()}
    assert r["flesch_reading_ease"] == pytest.approx(226 - 1.04 * 2.5 - 72 * 6 / 5)
    assert r["gulpease_index"] == pytest.approx(89 + (600 - 160) / 5)
    assert r["coleman_liau_index"] == pytest.approx(5.4 * 16 / 5 - 21 * 2 / 5 - 14)
    empty = {k: one(spark, v, t="") for k, v in text.readability(*text.text_counts(F.col("t")).values()).items()}
    assert set(empty.values()) == {0.0}


def test_tails():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_tail(30.0, 10) == pytest.approx(0.000856641, abs=1e-8)
    assert special.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_tail(0, 5) == pytest.approx(1)
    assert special.studentised_range_tail(3.314, 3) == pytest.approx(0.05, abs=2e-4)


#: Four rows of a published results table; the order and values below are published too.
MODELS = [("a", 66.5, 88.6, 8, 0.7120550274848938, 0.7523332834243774), ("b", 69.0, 80.5, 7, 0.7131612300872803, 0.7636045813560486), ("c", 72.0, 79.8, 7, 0.7184709310531616, 0.7331866025924683), ("d", 64.7, 74.3, 8, 0.714280903339386, 0.7760249972343445)]


def test_ranking(spark):
    df = spark.createDataFrame(MODELS, "model_id string, flesch_reading_ease double, gulpease_index double, final_readability_score int, bertscore double, comet double")
    assert [r["model_id"] for r in ranking.rank_by_selected(df, ["bertscore", "comet"]).collect()][:2] == ["d", "b"]
    assert ranking.rank_by_selected(df, ["bertscore", "comet"]).first()["final_score"] == pytest.approx(0.7451529502868652)
    norm = {r["model_id"]: r for r in ranking.rank_by_average(df).collect()}
    assert norm["a"]["final_readability_score_norm"] == 1.0 and norm["b"]["final_readability_score_norm"] == 0.0
    assert ranking.direction("final_readability_score") == "higher" and ranking.direction("final_readability_score", strict=True) == "lower"
    top = ranking.rank_each(df, ["gunning_fog_index", "comet"], top=2).collect()
    assert [(r["metric"], r["rank"], r["model_id"]) for r in top] == [("comet", 1, "d"), ("comet", 2, "b")]
    with pytest.raises(ValueError):
        ranking.rank_by_selected(df, ["missing"])
    with pytest.raises(ValueError):
        clean.compare_filter(df, "model_id", "gt", "1")
    with pytest.raises(ValueError):
        clean.require_rows(clean.compare_filter(df, "comet", "maior", "2"), "filter")
    assert clean.compare_filter(df, "model_id", "igual", "a").count() == 1


def test_signal():
    t = np.arange(300) * 2.0
    x = np.sin(2 * np.pi * 25 * t / 1000)
    row = signal.series_features(t, x)
    assert row[0] == 300 and row[1] == 500 and row[5] == pytest.approx(25)
    assert row[6] == pytest.approx(25, abs=2) and row[8] == pytest.approx(25, abs=2)
    assert signal.series_features(t[:31], x[:31]) is None and signal.series_features(t, np.full(300, np.nan)) is None
    shuffled = np.random.default_rng(0).permutation(300)
    assert signal.series_features(t[shuffled], x[shuffled]) == row
    assert signal.fill_line(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]
    a, d = signal.dwt(np.ones(40))
    assert len(a) == 23 and np.allclose(d, 0, atol=1e-9) and np.allclose(a, math.sqrt(2))
    assert sum(c * c for c in signal.DB4_LOW) == pytest.approx(1)


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (20, 6)), rng.normal(5, 0.1, (20, 6)), [[50.0] * 6]])
    labels = cluster.dbscan(x, 1.0, 4, block=7)
    assert labels.tolist() == [0] * 20 + [1] * 20 + [-1]
    x[0, 0] = np.nan
    assert cluster.distance_block(x[:1], x[1:2])[0, 0] == pytest.approx(np.sqrt(((x[0, 1:] - x[1, 1:]) ** 2).mean()))
    assert np.isinf(cluster.distance_block(np.full((1, 6), np.nan), x[:1])[0, 0])


def test_similarity():
    a = np.eye(3)
    assert similarity.greedy_match(a, a) == pytest.approx((1, 1, 1))
    assert similarity.greedy_match(a[:1], a)[:2] == pytest.approx((1, 1 / 3))
    assert similarity.greedy_match(np.zeros((0, 3)), a) == (0, 0, 0)


def test_scores(spark):
    options = spark.createDataFrame([(1, 10, 2, 0.0), (1, 11, 1, 0.0), (1, 12, None, 2.5)], "question_id long, option_id long, sort_order int, weight double")
    assert {r["option_id"]: r["points"] for r in scores.option_points(options).collect()} == {12: 2.5, 11: 1.0, 10: 2.0}
    answers = spark.createDataFrame([(1, 1, [10, 12, 99]), (2, 1, []), (3, 1, None)], "submission_id long, question_id long, selected_options array<long>")
    assert {r["submission_id"]: r["points"] for r in scores.score_by_sum(answers, options).collect()} == {1: 4.5, 2: 0.0, 3: 0.0}
    single = spark.createDataFrame([(1, "single")], "question_id long, question_type string")
    assert {r["submission_id"]: r["score"] for r in scores.score_by_type(answers, options, single).collect()}[1] == 2.0
    two = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 7 + [(None, "x")], "r string, c string")
    out = scores.chi_square(scores.crosstab(two, "r", "c")).first()
    assert out["chi_square"] == pytest.approx(3.2323, abs=1e-4) and out["p_value"] == pytest.approx(0.072200, abs=1e-5)
    stats = scores.descriptive_stats(spark.createDataFrame([(x,) for x in (3.0, 1.0, 1.0, 3.0, 8.0)], "v double"), "v").first()
    assert (stats["mode"], stats["median"], stats["iqr"], stats["n"]) == (1.0, 3.0, 2.0, 5)
    assert scores.descriptive_stats(spark.createDataFrame([], "v double"), "v").first()["sd"] == 0
    middle = lambda v: reports.upper_median_of(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()["median"]
    assert middle([1, 2, 3, 4]) == 3 and middle([5]) == 5 and middle([2, 2, 2]) == 2 and middle(range(1001)) == 500


def test_correct_answers(spark):
    row = lambda kind, chosen, key: one(spark, reports.is_correct(F.lit(kind), F.array(*map(F.lit, chosen)).cast("array<bigint>"), F.array(*map(F.lit, key)).cast("array<bigint>")), x=1)
    assert row("single", [1], [1, 2]) is True and row("single", [1, 2], [1, 2]) is False
    assert row("multiple", [2, 1], [1, 2]) is True and row("multiple", [1], [1, 2]) is False and row("free_text", [], []) is None


def test_purge_keeps_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "id long, v string")
    allowed = spark.createDataFrame([(1,)], "id long")
    assert {r["v"] for r in dedupe.purge_orphans(df, allowed, "id").collect()} == {"a", "c"}
    assert [tuple(r) for r in dedupe.purge_log(df, allowed, "id", ["v"], "v").collect()] == [(2, 2, "b")]


def test_pseudonyms_hide_unmapped_ids(spark):
    df = spark.createDataFrame([("1",), ("2",), (" ",), (None,)], "id string")
    mapping = joins.hash_mapping(df.limit(1), "id", "salt")
    assert {r["id"] for r in joins.map_ids(df, mapping, "id", "id_hashed").collect()} == {mapping.first()["id_hashed"], None}
    assert joins.hash_mapping(df, "id", "salt").count() == 2


def test_prefix_join(spark):
    queries = spark.createDataFrame([("marinatlb",), ("ana",), ("zed",), ("b",)], "q string")
    names = spark.createDataFrame([(1, "marina"), (2, "anabela"), (3, "ana"), (4, "bo"), (5, "i")], "k int, n string")
    found = {r["q"]: (r["matched"], r["method"]) for r in joins.prefix_join(queries, names, "q", "n", "k").collect()}
    assert found == {"marinatlb": ("marina", "name_prefix"), "ana": ("ana", "name_exact"), "zed": (None, "not_found"), "b": ("bo", "name_prefix")}


def test_linkage_decisions(spark):
    asked = spark.createDataFrame([(1, "Ana Luz Costa", "1/2/1990", "F"), (2, "77", "x", ""), (3, "Zed Qux", "1/1/1950", "M")], "k long, name string, dob string, sex string")
    people = spark.createDataFrame([("p1", "mapping", "10", "analuzcosta", 1990, None, None, "F"), ("p2", "test", "10", "analuz", None, 1989, 1990, "female"), ("p3", "mapping", "11", "rui", 1990, None, None, "M")], "person_id string, source string, record string, norm_name string, dob_year int, birth_year_min int, birth_year_max int, sex string")
    links = spark.createDataFrame([("77",)], "record string")
    queries = linkage.query_fields(asked, "k", "name", "dob", "sex")
    scored = linkage.scored_candidates(queries, people)
    got = {(r["query_id"], r["person_id"]): r for r in scored.collect()}
    assert set(got) == {(1, "p1"), (1, "p2")} and got[1, "p1"]["score"] == 80 and got[1, "p1"]["classification"] == "EXACT_NAME"
    decided = {r["query_id"]: (r["decision"], r["record"], r["phase"]) for r in linkage.decide(queries, scored, links).collect()}
    assert decided == {1: ("MATCH_UNIQUE", "10", "phase4_fuzzy"), 2: ("MATCH_UNIQUE", "77", "phase0_record"), 3: ("NO_MATCH", None, "phase1_blocking")}


def test_metrics(spark):
    rng = np.random.default_rng(0)
    rows = [(int(t), float(round(s, 1))) for t, s in zip(rng.integers(0, 2, 80), rng.random(80), strict=True)]
    df = spark.createDataFrame(rows, "t int, s double")
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert classify.roc_auc(df, "t", "s").first()["roc_auc"] == pytest.approx(auc)
    ap = sum(sum(s == c and t for t, s in rows) * sum(s >= c and t for t, s in rows) / sum(s >= c for _, s in rows) for c in {s for _, s in rows}) / len(pos)
    assert classify.average_precision(df, "t", "s").first()["average_precision"] == pytest.approx(ap)
    split = classify.stratified_split(df.withColumn("k", F.monotonically_increasing_id()), "t", "k")
    assert split.where("is_test").count() == round(0.2 * len(pos)) + round(0.2 * len(neg))


def test_name_forms_are_made_in_many_tasks(spark):
    """A table in one file is dealt out before its forms are made."""
    from ophelion.plans import catalogue

    for name in ("name_variations", "name_signatures"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan


def test_all_words_of_a_long_name_have_forms(spark):
    """Every choice of initials of more words than INITIALS, each once, in any pieces."""
    words = [f"{'bcd'[k * k % 3]}{'xyz'[k % 3]}" for k in range(ids.INITIALS + 3)]
    choices = [""]
    for w in words[:-1]:
        choices += [c + w[0] for c in choices]
    want = {"ana" + c + x for c in choices for x in ("", words[-1][0])} | {"ana" + c + words[-1] for c in choices}
    some = [(), *((w,) for w in words), *((a, b) for k, a in enumerate(words) for b in words[k + 1 :])]
    want |= {"ana" + "".join(c) for c in [*some, words]} | {"a" + "".join(w[0] for w in words)}
    spaced = want | {" ".join(("ana", *c)) for c in [*some, words]}
    name = " ".join(("Ana", *words))
    assert ids.variations_of(name) == want and ids.variations_of(name, True) == spaced
    for bits in (1, 5):
        found = [f for p in range(2**bits) for f in ids.forms_of(name, True, p, bits)]
        assert len(found) == len(set(found)) and set(found) == spaced
    df = spark.createDataFrame([(1, name), (2, None), (3, "Ana Bela"), (4, " ")], "k long, name string")
    found = [tuple(r) for r in ids.name_forms(df, "k", F.col("name"), spaced=True).collect()]
    assert sorted(found) == sorted([*((1, f) for f in spaced), *((3, f) for f in ids.variations_of("Ana Bela", True))])


def test_forms_start_with_the_heads_of_a_name(spark):
    names = ["Ana Bela Costa", "Rui", "Zé e Ana", "", None, " ".join(f"{a}{b}" for a in "bcdefghi" for b in "xyz")]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", ids.name_heads(F.col("name")).alias("heads"))
    for r in df.collect():
        forms = ids.variations_of(r["name"] or "", True)
        assert set(r["heads"]) <= forms and all(f.startswith(tuple(r["heads"])) for f in forms)
