"""Places in groups of any share, and the ordered read model."""

from __future__ import annotations

import hashlib

from ophelion.operators import ranking, reports


def test_places_are_row_numbers(spark):
    rows = [("hot", k * 37 % 5_003) for k in range(5_000)] + [("cold", k) for k in range(40)] + [(None, 3), (None, None), (None, 1)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = ranking.places(df, ["g"], ["x"]).collect()
    want = []
    for g in ("hot", "cold", None):
        own = sorted((x for h, x in rows if h == g), key=lambda x: (x is not None, x))
        want += [(g, x, k + 1) for k, x in enumerate(own)]
    assert sorted(map(repr, ((r["g"], r["x"], r["place"]) for r in got))) == sorted(map(repr, want))
    assert ranking.places(df.where("x < 0"), ["g"], ["x"]).count() == 0


def test_read_model(spark):
    orders = {1: "ascending", 2: "descending", 3: "custom", 4: "random", 5: None}
    questionnaires = spark.createDataFrame(list(orders.items()), "questionnaire_id int, question_order string")
    mould = [(10, "question", 1, 2, None), (11, "instruction", 1, 1, 0), (12, "term", 2, 3, 4), (13, "question", 9, 0, 1), (14, "page", 1, 0, 1), (15, None, 1, 0, 1), (16, "question", 1, 2, 2), (17, "question", None, 5, 1)]
    items = spark.createDataFrame([(k * 100 + key, k, *rest) for k in orders for key, *rest in mould] + [(999, 77, "question", 1, 1, 1)], "item_key int, questionnaire_id int, item_type string, item_id int, sort_order int, step int")
    questions = spark.createDataFrame([(1, "one"), (2, "two")], "question_id int, text string")
    options = spark.createDataFrame([(k, 1, f"o{k}", 9 - k) for k in range(6)], "option_id int, question_id int, text string, sort_order int")
    told = spark.createDataFrame([(1, "read", "x")], "instruction_id int, text string, more string")
    got = sorted(reports.read_model(questionnaires, items, questions, options, told, seed=3).collect(), key=lambda r: (r["questionnaire_id"], r["place"]))
    shown = {k: [r["item_type"] + str(r["item_id"]) for r in got if r["questionnaire_id"] == k] for k in orders}
    assert shown[1] == shown[3] == ["instruction1", "question1", "question1", "term2"]
    assert shown[2] == ["term2", "question1", "question1", "instruction1"]
    assert shown[5] == ["question1", "instruction1", "term2", "question1"]
    drawn = sorted(((hashlib.md5(f"3:{400 + key}".encode()).hexdigest(), kind + str(i)) for key, kind, i, *_ in mould if key in (10, 11, 12, 16)))
    assert shown[4] == [name for _, name in drawn]
    assert all([r["place"] for r in got if r["questionnaire_id"] == k] == [1, 2, 3, 4] for k in orders) and len(got) == 20
    first = [r for r in got if r["questionnaire_id"] == 1]
    assert [r["step"] for r in first] == [1, 1, 2, 4]
    assert first[0]["instruction"]["more"] == "x" and first[0]["question"] is None
    assert [o["text"] for o in first[1]["question"]["options"]] == ["o5", "o4", "o3", "o2", "o1", "o0"]
    assert first[3]["question"]["text"] == "two" and first[3]["question"]["options"] is None
    mixed = next(r for r in got if r["questionnaire_id"] == 4 and r["item_id"] == 1 and r["question"])
    assert [o["option_id"] for o in mixed["question"]["options"]] == sorted(range(6), key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())
