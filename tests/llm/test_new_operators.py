"""Fill-in-middle, quality votes and the clustered layout against brute force, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ophelion.llm import _base, cluster_layout, fill_in_middle, quality_vote

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "n", "form", "low", "high", "first", "second", "z", "position", "file", "length", "date", "salt", "part", "at", "draw", "quality", "held_out", "score"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(60)]
    texts += [None, None, "", "a", "?", "\n", "aB\r\n\tü𝔘x١é", "<P>", "x <S> y", "<M", "a<<P", "<P<S<M", "P>S>M>", "<<<<>>>>" * 5, "ab" * 3000, "1" * 3000, "x" * 1023 + "y 1", "𝔘" * 1024 + "word", " ".join(rng.choices(vocabulary, k=20_000))]
    texts += texts[:4]
    sources = ["s1"] * 12 + ["s2", "é", "z", "", None]
    out = [(k * 7, t, rng.choice(["en", "fr", "de", None]), rng.choice(sources), 0) for k, t in enumerate(texts)]
    out += [out[0], out[0], out[1]]  # repeated rows
    out += [(None, t, "en", "s1", 0) for t in ("no id", "no id", "another", None)] + [(7, "one id, another text", "en", None, 1)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# ------------------------------------------------------------- fill in middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if four % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1024, 7, 1])
def test_fill_in_middle(docs, rows, empty, block):
    out = fill_in_middle.fill_in_middle(docs, block)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(brute_middle(i, t)) for i, t, *_ in rows)
    back = out.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t, *_ in rows)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(empty, block).count() == 0


def test_fill_in_middle_moves_texts_once(spark, docs):
    df = fill_in_middle.fill_in_middle(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = set(re.findall(r"Exchange hashpartitioning\(row.*REPARTITION_BY_COL, \[plan_id=(\d+)\]", plan))
    assert len(dealt) == 1 and plan.count("ReusedExchange") == 2


def test_cuts_at_every_place(spark):
    """Ids enough for all pairs of cuts of a text of few units."""
    data = [(i, "ab, ü") for i in range(400)]
    out = {r["doc_id"]: tuple(r) for r in fill_in_middle.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string"), 2).collect()}
    assert out == {i: brute_middle(i, t) for i, t in data}
    assert len({r[3:5] for r in out.values() if r[2] != "plain"}) == 15


# --------------------------------------------------------------- quality votes


@functools.cache
def one_hash(word):
    return int(_base.chunk_words([word])[0][0])


def brute_rates(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    forms = [re.sub(rb"[0-9]+", b"0", re.sub(rb"(?:[a-z]|[\x80-\xff])+", b"a", re.sub(rb"[A-Z]+", b"A", w))) for w in words]
    out = Counter(one_hash(w) % 1024 for w in words)
    out.update(1024 + one_hash(f) % 1024 for f in forms)
    for a, b in zip(forms, forms[1:]):
        mixed = _base.mix(np.array([(one_hash(b) * 3 + one_hash(a)) % 2**64], np.uint64))
        out[1024 + int(mixed[0]) % 1024] += 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[2048] = len(words) - len(set(words))
    out[2049] = sum(a == b for a, b in zip(words, words[1:]))
    out[2050] = len(words) * (len(lines) - len(set(lines))) / max(1, len(lines))
    x = np.zeros(2051)
    for k, v in out.items():
        x[k] = (v / max(1, len(words))) ** 0.5
    return x


TEXTS = [b"", b" \n\t", b"one", b"One TWO two 22 2!! | a|b\nthe line\nthe line\n\xc3\xa9t\xc3\xa9 e", b"a a a a", b"x" * 70_000 + b" Y"]


def test_term_rates():
    found = quality_vote.term_rates(TEXTS)
    assert np.allclose(found, [brute_rates(t) for t in TEXTS])
    assert not found[0].any() and not found[1].any()


def test_singular_vectors():
    x = np.random.default_rng(1).standard_normal((60, 40)) * np.arange(40, 0, -1) ** 2
    want = np.linalg.svd(x)[2][:4]
    assert np.allclose(np.abs(want @ quality_vote.singular_vectors(x, 4)), np.eye(4), atol=1e-6)


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(9)
    data = []
    for i in range(500):
        words = ["".join(rng.choices("abcdef", k=rng.randint(2, 6))) for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            words = [f"{w.upper()}!!" for w in words] if i % 4 else [words[0]] * len(words)
        data.append((i, " ".join(words), int(not bad)))
    return data


def test_quality_votes(spark, judged, docs, empty):
    df = spark.createDataFrame([(i, t) for i, t, _ in judged] + [(9000, None), (9001, ""), (None, "One TWO!!"), (3, judged[3][1])], "doc_id long, text string")
    told = spark.createDataFrame([(i, q) for i, _, q in judged] + [(3, judged[3][2]), (4, None), (None, 0), (77_777, 1)], "doc_id long, quality int")
    out = [tuple(r) for r in quality_vote.score_quality(df, told).collect()]
    assert len(out) == 504
    by = {i: (held, score, predicted) for i, held, score, predicted in out}
    truth = {i: q for i, _, q in judged}
    assert all(held == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, (held, *_) in by.items())
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in by.values())
    assert [by[i][2] for i in truth if by[i][0]] == [truth[i] for i in truth if by[i][0]]
    # by hand: the labelled training texts, their vectors, and a vote of the nearest
    train = [(t, q) for i, t, q in judged if zlib.crc32(str(i).encode()) % 5]
    own = np.array([brute_rates(t.encode()) for t, _ in train])
    model = quality_vote.fit(own, np.array([q for _, q in train]))
    own = own @ model.project
    mean = sum(q for _, q in train) / len(train)
    for i, text in [(i, t) for i, t, _ in judged[:40]] + [(9000, ""), (9001, ""), (None, "One TWO!!")]:
        x = brute_rates(text.encode()) @ model.project
        near = sorted(((round(float(x @ v) / max(1e-12, np.linalg.norm(x) * np.linalg.norm(v)), 5), q) for v, (_, q) in zip(own, train)), reverse=True)
        voters = [(c, q) for c, q in near if c >= near[quality_vote.NEIGHBOURS - 1][0] and c > 0]
        want = (sum(c * q for c, q in voters) + 1e-3 * mean) / (sum(c for c, _ in voters) + 1e-3)
        assert by[i][1] == pytest.approx(want, abs=2e-2)
    assert by[9000][1] == by[9001][1] == pytest.approx(mean)
    assert {r["score"] for r in quality_vote.score_quality(docs.drop("quality"), told.where("false")).collect()} == {0.0}
    assert quality_vote.score_quality(empty, told).count() == 0
    assert {r["score"] for r in quality_vote.score_quality(df, told.where("doc_id = 77777")).collect()} == {0.0}


def test_quality_sample_is_bounded_and_repeatable(spark, judged):
    df = spark.createDataFrame([(i, t) for i, t, _ in judged] + [(11, f"{t} {i}") for i, t, _ in judged], "doc_id long, text string")
    told = spark.createDataFrame([(i, q) for i, _, q in judged], "doc_id long, quality int")
    one = quality_vote.train(df, told, 50)
    two = quality_vote.train(df.repartition(7).union(df), told.union(told).repartition(3), 50)
    assert 0 < len(one.vectors) <= 50
    assert np.allclose(one.vectors, two.vectors, atol=1e-4) and (one.labels == two.labels).all()
    only = quality_vote.train(df.where("doc_id = 11"), told.where("doc_id = 11"), 50)  # one id for all rows
    assert len(only.vectors) == 50


# -------------------------------------------------------------------- layout


def brute_layout(rows, per_file):
    n = len(rows)
    text = lambda x: b"" if x is None else b"=" + x.encode()
    values = [(text(s), text(g), -1 if t is None else len(t.encode()), zlib.crc32(("" if i is None else str(i)).encode()) % 365) for i, t, g, s, _ in rows]
    columns = [sorted(v[k] for v in values) for k in range(4)]
    at = [tuple(16 * sum(x < v[k] for x in columns[k]) // n for k in range(4)) for v in values]
    z = []
    for s, g, length, date in at:
        bits = "".join(f"{c:04b}"[b] for b in range(4) for c in (length, s, date, g))
        z.append(int(bits, 2))
    order = sorted(range(n), key=lambda k: (z[k], -1 if rows[k][0] is None else rows[k][0]))
    file = {k: p // per_file for p, k in enumerate(order)}
    held = defaultdict(set)
    for k, f in file.items():
        held[f].add(at[k])
    box = {f: [(min(c[d] for c in cells), max(c[d] for c in cells)) for d in range(4)] for f, cells in held.items()}
    out = []
    for p, k in enumerate(order):
        s, g, length, date = at[k]
        query = [(s, s), (g, g), (length - 2, length + 2), (date - 2, date + 2)]
        touched = sum(all(lo <= b and hi >= a for (a, b), (lo, hi) in zip(query, q)) for q in box.values())
        matching = sum(any(all(a <= x <= b for (a, b), x in zip(query, c)) for c in cells) for cells in held.values())
        out.append((rows[k][0], z[k], p, file[k], touched, matching, ",".join(f"{a},{b}" for a, b in box[file[k]])))
    return sorted(map(repr, out))


@pytest.mark.parametrize("per_file", [1, 4, 500])
def test_layout(docs, rows, empty, per_file):
    out = cluster_layout.lay_out(docs, per_file).collect()
    assert sorted(repr(tuple(r)[:7]) for r in out) == brute_layout(rows, per_file)
    assert cluster_layout.lay_out(empty, per_file).count() == 0


def test_layout_of_one_hot_value(spark):
    """A third of the rows shares every value, ids included."""
    data = [(None if i % 3 == 0 else i, "same" if i % 3 == 0 else "x" * (i % 50), "en", "hot" if i % 3 == 0 else f"s{i % 9}", 0) for i in range(900)]
    out = cluster_layout.lay_out(spark.createDataFrame(data, DOCS).repartition(6), 20).collect()
    assert sorted(repr(tuple(r)[:7]) for r in out) == brute_layout(data, 20)


def test_written_layout(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/layout"
    boxes = {r["file"]: r for r in cluster_layout.write_layout(docs, path, 10).collect()}
    back = spark.read.parquet(path).collect()
    assert len(back) == len(rows) and len(boxes) == -(-len(rows) // 10)
    assert sorted((r["kept"]["doc_id"] or -1, r["kept"]["text"] or "") for r in back) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert Counter(r["file"] for r in back) == {f: r["rows"] for f, r in boxes.items()}
    assert sorted(r["position"] for r in back) == list(range(len(rows)))
