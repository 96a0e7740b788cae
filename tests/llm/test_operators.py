"""Each operator against brute force on small tables, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ophelion.llm import exact_dedup, html_extract, jaccard_join, language_id, lm_score, media, mixing, packing, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators use inside themselves
CLASH = ["key", "marks", "size", "rep", "digest", "shard", "piece", "row", "word", "range", "score", "held_out", "length", "root"]


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared, line = prose(80), "the same line again\n"
    texts = [prose(rng.randint(1, 220)) for _ in range(40)]
    texts += [f"{prose(30)} {shared} {prose(rng.randint(0, 60))}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[5], None, None, "", " \n\t", "one", "one two three", line * 60, "*** 123 ???"]
    near = prose(150).split()
    for k in range(7):
        changed = list(near)
        changed[10 * k + 3] = f"changed{k}"
        texts.append(" ".join(changed))
    texts.append(" ".join(prose(60) for _ in range(400)))  # very long
    texts.append("ünï cödé　wide space word \x1c sep")
    langs, sources = ["en", "fr", None], ["a", "b", "c", "d", None]
    out = [(k * 3, t, langs[k % 3], sources[0] if k % 3 == 0 else sources[k % 5], None if t is None else len(t)) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [out[0], out[1]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def null_id(spark, docs):
    return docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def covered(rows, size=50):
    first = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc_id:
                gone[i : i + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, rows, null_id, empty):
    out = substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    found = sorted(map(tuple, out.collect()))
    assert found == covered(rows)
    assert sum(r[2] for r in found) > 300
    assert substring_dedup.dedup_substrings(null_id).count() == len(rows) + 3
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_of_many_rows_without_an_id(spark):
    """None of them is smaller than another; all are larger than any id."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(70)) for x in "abc")
    rows = [(5, one), (9, "x " + two), (7, two)]
    rows += [(None, f"lead{i} {one} tail{i}") for i in range(12)] + [(None, f"{two} {three} n{i % 4}") for i in range(12)] + [(None, three), (None, three), (None, None), (None, "short")]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    top = 2**62
    want = [(None if d == top else d, *rest) for d, *rest in covered([(top if d is None else d, t) for d, t in rows])]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert sum(r[2] for r in want) >= 12 * 70 * 2


def test_repeat_lengths(spark, empty):
    text = " ".join(f"w{i}" for i in range(130))
    short = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "x " + text), (3, short), (4, "other")], "doc_id long, text string")
    found = {r["doc_id"]: r["longest"] for r in substring_dedup.repeat_lengths(df).collect()}
    assert found == {1: 100, 2: 100, 3: 50}
    assert substring_dedup.repeat_lengths(empty).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 60).astype(np.uint64)
    for width in (1, 2, 3, 26, 59, 60):
        assert substring_dedup.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(61 - width)]


def test_exact_dedup(docs, rows, null_id, empty, spark):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    want = sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert sorted(map(tuple, exact_dedup.dedup_exact(docs).collect())) == want
    assert exact_dedup.dedup_exact(empty).count() == 0
    assert exact_dedup.dedup_exact(null_id).count() == len(rows) + 3
    odd = [(7, "a"), (7, "b"), (None, "a"), (None, "c"), (None, "c"), (8, "b"), (9, None), (None, "")]
    found = sorted(map(repr, (tuple(r)[:4] for r in exact_dedup.dedup_exact(spark.createDataFrame(odd, "doc_id long, text string")).collect())))
    want = [(7, 7, 2, True), (7, 8, 2, False), (None, 7, 2, False), (None, None, 2, True), (None, None, 2, True), (8, 8, 2, True), (9, 9, 2, True), (None, 9, 2, False)]
    assert found == sorted(map(repr, want))
    # against history: members take its winner, the rest group among themselves
    history = spark.createDataFrame([(900, "stored"), (901, "stored")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "stored"), (2, "fresh"), (3, "fresh"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_exact(new, history).collect()}
    assert found == {1: (901, 2, False), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


def test_exact_dedup_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOOKUP_ROWS", 10)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 8)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.dedup_exact(df)
    assert out.where("text_sha256 = sha2('hot', 256)").agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.count("*")).first()[:] == (99, 99, 100, 100)
    assert out.where("kept").count() == 201


def test_minimal_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), "V32")
    seeds = exact_dedup.build_mph(digests)
    assert sorted(exact_dedup.mph_slots(digests, seeds, 3000)) == list(range(3000))


def test_mixing(docs, rows, null_id, empty, spark):
    connection = duckdb.connect()
    import pandas as pd

    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"])  # noqa: F841
    want = connection.sql(mixing.mix_sql()).fetchall()
    out = mixing.mix_sources(docs).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    total = sum(r["size"] for r in out)
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - total) < 1e-6 * total
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(null_id).count() == len(rows) + 3
    odd = [(7, "one " * 10, "a"), (7, "x y z w", "b"), (None, "q " * 30, "b"), (None, "r " * 7, "b"), (None, None, None), (7, "x y z w", "b")]
    documents = pd.DataFrame(odd, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    out = mixing.mix_sources(spark.createDataFrame(odd, "doc_id long, text string, source string")).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, connection.sql(mixing.mix_sql()).fetchall()))


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 0, "e": 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    names, w = ["a", "b", "c", "e", None], [5, 2, 1, 5, 2]
    target = {n: 0.0 for n in names}
    left, open_ = sum(sizes.values()), set(names)
    while True:  # shares by weight, capped, the excess reshared until none is above
        level = left / sum(w[names.index(n)] for n in open_)
        above = {n for n in open_ if w[names.index(n)] * level > 3 * sizes[n] + 1e-9}
        if not above:
            target |= {n: w[names.index(n)] * level for n in open_}
            break
        for n in above:
            target[n] = 3.0 * sizes[n]
            left -= target[n]
        open_ -= above
    assert found == pytest.approx(target)


def test_packing(docs, rows, null_id, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    out = packing.pack_documents(docs).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    check_bins(out)
    used, least = len({r["sequence_id"] for r in out}), -(-sum(r["length"] for r in out) // 4096)
    assert used <= least + 1
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(null_id).count() >= len(rows) + 3


def check_bins(out, capacity=4096):
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_word_tokenizer_equals_the_whole_tokenizer():
    from tokenizers import Tokenizer

    t = packing.WordTokenizer(packing.default_tokenizer())
    whole = Tokenizer.from_file(packing.default_tokenizer())
    for text in ["Don't we'll 12½ É́cole ÇA Straße İx naïve", "é é Σίσυφος ΣΑΣ 中文字 かな a b", "<|endoftext|> x<|startoftext|>y", "a\x1cb ​ z﻿", "'S 'T I'M…—«»", "  \n\t ", "ﬁ ²³ ª º"]:
        assert np.frombuffer(t.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_word_tokenizer_on_every_common_character():
    from tokenizers import Tokenizer

    t = packing.WordTokenizer(packing.default_tokenizer())
    whole = Tokenizer.from_file(packing.default_tokenizer())
    for c in map(chr, range(33, 0x250)):
        text = f"{c} {c}bC A{c} x{c}y {c}{c}"
        assert np.frombuffer(t.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_fullest_combination_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 12)))
        room = rng.randint(1, 90)
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        reach = {0}
        for x in counts.elements():
            reach |= {r + x for r in reach if r + x <= room}
        assert sum(k * n for k, n in got) == max(reach)
        assert all(n <= counts[k] for k, n in got)
    histogram = Counter(rng.randint(1, 60) for _ in range(500))
    placed = Counter()
    for combination, times in packing.plan_bins(histogram, 64):
        assert sum(k * n for k, n in combination) <= 64
        placed.update({k: n * times for k, n in combination})
    assert placed == histogram


def brute_links(rows, threshold=0.8):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [[False] * len(rows) for _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            links[i][j] = i != j and (a == b or bool(a | b) and len(a & b) / len(a | b) >= threshold)
    return sets, links


def test_jaccard_join(docs, rows, null_id, empty):
    sets, links = brute_links(rows)
    parent = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if links[i][j]:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    smallest = {}
    for i, p in enumerate(parent):
        smallest[p] = min(smallest.get(p, rows[i][0]), rows[i][0])
    want = sorted((rows[i][0], smallest[parent[i]], sum(links[i]), len({frozenset(sets[j]) for j in range(len(rows)) if links[i][j]} - {frozenset(sets[i])})) for i in range(len(rows)))
    out = jaccard_join.near_duplicates(docs)
    assert sorted(tuple(r)[:4] for r in out.collect()) == want
    assert max(r[3] for r in want) >= 6
    assert jaccard_join.near_duplicates(null_id).count() == len(rows) + 3
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_without_ids(spark):
    """Texts without an id, or with the same one, keep their own links and classes."""
    rng = random.Random(11)
    text = lambda: [f"w{rng.randint(0, 9999)}" for _ in range(100)]
    near = lambda x, k: " ".join([*x[:40], f"near{k}", *x[41:]])
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, " ".join(a)), (None, near(a, 0)), (None, " ".join(b)), (None, near(b, 1)), (None, " ".join(c))]
    rows += [(9, " ".join(d)), (9, " ".join(e)), (4, near(e, 2)), (None, " ".join(c))]
    links, classes = [1, 1, 1, 1, 1, 0, 1, 1, 1], [7, 7, None, None, None, 9, 4, 4, None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    big = 2**63 - 1
    order = lambda found: sorted(found, key=lambda r: [big if x is None else x for x in r])
    out = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()]
    assert order(out) == order((i, k, n) for (i, _), k, n in zip(rows, classes, links, strict=True))

    import corpus_pipeline

    full = docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, full, "").collect()]
    assert {rows[0], rows[4], rows[5], rows[7]} < set(kept) and len({rows[2], rows[3]} & set(kept)) == 1
    assert not {rows[1], rows[6]} & set(kept)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Pools of many blocks lose no link, within a size and across sizes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    rows = []
    for k in range(60):
        changed = base[: 80 - k // 4]
        changed[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(changed)))
    sets, links = brute_links(rows)
    found = {r["doc_id"]: r["n_texts"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    different = [len({frozenset(sets[j]) for j in range(60) if links[i][j]} - {frozenset(sets[i])}) for i in range(60)]
    assert [found[k] for k in range(60)] == different


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (203, 201), (5, 5)]
    found = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 203: 200}


def test_media(docs, rows, null_id, empty):
    found = {r["doc_id"]: r for r in media.document_media(docs).collect()}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192) or b" " * 192
        r = found[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.decode_png(stored) == payload and r["feature"] == media.sample_feature(payload)
        assert (r["position"], r["caption"]) == (0, str(doc_id))
    assert media.document_media(empty).count() == 0
    assert media.document_media(null_id).count() == len(rows) + 3


def test_interleaved_sequence_keeps_positions_and_captions(spark):
    html = '<p>One <b>two</b></p><figure><img src="sha256:ab" alt="alt"><figcaption>Cap &amp; tion</figcaption></figure><p>Three<img src="x.png" alt="y">four</p><script>no</script>'
    items = media.parse_sequence(html)
    assert [(i["kind"], i["text"], i["caption"]) for i in items] == [("text", "One two", None), ("media", None, "Cap & tion"), ("text", "Three", None), ("media", None, "y"), ("text", "four", None)]
    assert [i["position"] for i in items] == list(range(5)) and items[1]["digest"] == "ab"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("ab", 5)], "digest string, width int")
    got = media.resolve(media.interleave(pages, "page_id"), store, "page_id").orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["caption"], r["width"]) for r in got] == [(1, 1, "Cap & tion", 5), (1, 3, "y", None)]
    with pytest.raises(ValueError):
        media.decode_png(b"nothing")


def test_language_id(spark, docs, rows, null_id, empty):
    rng = random.Random(2)
    alphabets = {"en": "the and of ing tion".split(), "de": "der und sch ung ß ü".split(), "fr": "les eau é que ou".split()}
    data = [(i, " ".join("".join(rng.choices(alphabets[k], k=2)) for _ in range(rng.randint(3, 80))), k) for i, k in enumerate(list(alphabets) * 80)]
    df = spark.createDataFrame(data + [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i]["lang_pred"], k) for i, _, k in data if out[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert language_id.identify(docs).count() == len(rows)
    assert language_id.identify(null_id).count() == len(rows) + 3
    assert language_id.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert language_id.identify(nothing).first()["lang_pred"] == "und"


def test_codewords_differ():
    for n in (2, 4, 6, 9, 20):
        code = language_id.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= 1 and (n < 3 or min(apart) >= 2)


def test_toxicity(spark, docs, rows, null_id, empty):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "Trash!", "clown,"]))
        data.append((i, " ".join(text)))
        if i % 3 == 0:
            labels.append((i, int(toxic)))
    df = spark.createDataFrame(data + [(9000, None), (9001, "")], "doc_id long, text string")
    told = spark.createDataFrame(labels + [(3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(df, told).collect()}
    held = [(out[i]["predicted"], int(i % 8 == 0)) for i, _ in data if out[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in out.items())
    assert out[9000]["score"] == out[9001]["score"] and out[9000]["predicted"] == 0
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, told.unionByName(told.where("toxic = 1"))).collect()}
    assert again == {i: r["score"] for i, r in out.items()}
    none = told.where("false")
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(null_id, told).count() == len(rows) + 3
    assert toxicity.score_toxicity(empty, told).count() == 0


def brute_base(rows):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [w.decode() for w in (t or "").encode().translate(lm_score._UPPER).split()] + [None]
    counts = Counter(w for i, t, *_ in rows if not fold(i) for w in tokens(t))
    n, v = counts.total(), len(counts)
    out = []
    for i, t, *_ in rows:
        own = tokens(t)
        out.append((i, fold(i), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return sorted(out)


def test_lm_score(docs, rows, null_id, empty, spark, monkeypatch):
    for size in (1 << 23, 3000):  # one chunk a task, and many
        monkeypatch.setattr(lm_score, "CHUNK", size)
        out = lm_score.score_corpus(docs).collect()
        found = sorted(tuple(r)[:6] for r in out)
        want = brute_base(rows)
        assert [f[:5] for f in found] == [w[:5] for w in want]
        assert [f[5] for f in found] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(r["score"] < 0 for r in out)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm_score.score_corpus(empty).count() == 0
    assert lm_score.score_corpus(null_id).count() == len(rows) + 3


def test_lm_score_without_ids(spark):
    """Rows without an id, or with the same one, are scored by their own text."""
    rows = [(None, "a b a"), (None, "zz"), (7, "a b"), (7, "a b a b zz"), (None, None), (8, "")]
    out = lm_score.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in out) == sorted((i or -1, len((t or "").split()) + 1) for i, t in rows)
    want = sorted((i or -1, s) for i, s in brute_score(rows))
    assert sorted((r["doc_id"] or -1, r["score"]) for r in out) == [(i, pytest.approx(s, rel=1e-6)) for i, s in want]


def brute_score(rows, prior=1000.0):
    """Scores from the exact levels of all words and pairs, those seen once included."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().translate(lm_score._UPPER).split(), b""]
    one, two, docs = Counter(), Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            own = tokens(t)
            docs += 1
            one.update(own)
            two.update(zip([None, *own], own))
    mass = one.total() + 0.5 * (len(one) + 1)
    middle = lambda n: float(lm_score.count_of(lm_score.levels_of(np.array([n]), 1), 1)[0])
    for i, t, *_ in rows:
        score, before = 0.0, None
        for w in tokens(t):
            context = docs if before is None else middle(one[before])
            p = (min(middle(two[before, w]), context) + prior * (middle(one[w]) + 0.5) / mass) / (context + prior)
            score, before = score + math.log10(min(p, 1.0)), w
        yield i, score


@pytest.mark.parametrize("tokens", [1 << 21, 16])  # 16: more parts and segments than the least
def test_lm_score_counts_every_pair(docs, rows, monkeypatch, tokens):
    monkeypatch.setattr(lm_score, "PART_TOKENS", tokens)
    monkeypatch.setattr(lm_score, "SEGMENT_TOKENS", tokens * 4)
    monkeypatch.setattr(lm_score, "COARSE_BITS", 8)
    monkeypatch.setattr(lm_score, "PIECE_TOKENS", tokens)
    found = sorted((r["doc_id"], r["score"]) for r in lm_score.score_corpus(docs).collect())
    want = sorted(brute_score(rows))
    assert [f[0] for f in found] == [w[0] for w in want]
    # the filter errs upwards for some of the n-grams; without pairs seen once the sums are off by more
    assert [f[1] for f in found] == pytest.approx([w[1] for w in want], rel=0.01)


def test_count_filter_keeps_levels():
    rng = np.random.default_rng(0)
    prints = np.unique(rng.integers(0, 1 << 48, 4000).astype(np.uint64))
    counts = rng.zipf(1.6, len(prints)).clip(1, 10**6).astype(np.uint32)
    assert (lm_score._unpack_sorted(lm_score._pack_sorted(prints)) == prints).all()
    assert (lm_score._unpack(lm_score._pack(counts)) == counts).all()
    assert not len(lm_score._unpack(lm_score._pack(prints[:0])))
    size = 4096
    bits = np.zeros((256, size * 8), np.bool_)
    levels = np.where(prints & np.uint64(1) == 1, lm_score.levels_of(counts, 2), lm_score.levels_of(counts, 1))
    for q in range(1, levels.max() + 1):
        mine = prints[levels >= q]
        for row in lm_score.CountFilter.places(mine, q, size * 8):
            bits[(mine >> np.uint64(40)).astype(int), row.astype(int)] = True
    model = lm_score.CountFilter(np.packbits(bits, axis=1, bitorder="little"), 1, 2)
    found = model.levels(prints)
    assert (found >= levels).all() and (found == levels).mean() > 0.95  # errs upwards only
    assert (lm_score.count_of(np.array([0, 1, 2, 3, 4]), 1) == [0, 1, 2, 3, 4.5]).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/x">Menu {k}</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy {k}</div>
<article><header><h1>Title&nbsp;{k} &amp; more</h1></header><p>First  para\n{k}<br>line</p><p><b>open<p>second &lt;p&gt; {k}</p>
<div class="note-box">Always the same box</div><form>Search <button>Go</button></form><aside>Related {k}</aside>
<ul><li>item {k}<li>other {k}</ul></article><section id="comments"><p>Reader {k}</p></section><footer>&copy; {k}</footer></body></html>"""


def test_html_extract(spark):
    pages = [(k, f"https://h{k % 2}.example/{k}", PAGE.format(k=k)) for k in range(40)]
    pages += [(100, None, None), (101, "odd", ""), (102, "http://x/", "plain <b>text</b> &#233;<"), (103, "http://x/", "<div>only<script>never closed"), (104, "http://x/", "<nav>only menu</nav>"), (1, pages[1][1], pages[1][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1)).withColumn("weak", F.lit(2))
    out = defaultdict(list)
    for r in html_extract.extract_main_text(df).collect():
        out[r["page_id"]].append(r)
        assert r["n_chars"] == len(r["text"])
    for k in range(40):
        assert out[k][0]["text"] == f"Title {k} & more\nFirst para {k} line\nopen\nsecond <p> {k}\nitem {k}\nother {k}", k
        assert out[k][0]["n_removed"] == 1  # the box that every page shows
    assert [out[k][0]["text"] for k in (100, 101, 102, 103, 104)] == ["", "", "plain text é<", "only", ""]
    assert len(out[1]) == 2
    assert html_extract.extract_main_text(df.where("false")).count() == 0


def test_one_page_host_keeps_everything(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p><p>y</p>")] * 20, "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_main_text(df).collect()} == {"x\ny"}
    assert html_extract.importance([20]) == 0 and html_extract.importance([1] * 20) == pytest.approx(1)


def test_html_extract_by_join(spark, monkeypatch):
    """The same where the low branches are too many to broadcast."""
    pages = [(k, f"https://h{k % 2}.example/{k}", PAGE.format(k=k)) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted(map(tuple, html_extract.extract_main_text(df).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_extract.extract_main_text(df).collect())) == want
