"""Change sets against a replay of the log, change by change."""

from __future__ import annotations

import random

import pytest

from ophelion.operators import changes


def replay(base, log):
    table, errors = {k: [a, b] for k, a, b in base}, []
    for n, k, op, a, b in sorted(set(log), key=lambda c: c[0]):
        if k is None or op not in ("I", "U", "D"):
            errors.append((n, "invalid"))
        elif k not in table and op != "I" and not any(c[1] == k and c[2] == "I" and c[0] < n for c in log) and k not in {x[0] for x in base}:
            errors.append((n, "not_found"))
        elif op == "D":
            table[k] = None
        else:
            old = table.get(k) or [None, None]
            table[k] = [a if a is not None else old[0], b if b is not None else old[1]]
    return {k: tuple(v) for k, v in table.items() if v}, sorted(errors)


@pytest.mark.parametrize("seed", range(4))
def test_changes_in_any_order(spark, seed):
    rng = random.Random(seed)
    base = [(k, f"a{k}", float(k)) for k in range(12)]
    log = [(n, rng.choice([*range(20), 3, 3, 3, None]), rng.choice(["I", "U", "U", "D", "U", "x" if n % 37 == 0 else "U"]), rng.choice([None, f"v{n}"]), rng.choice([None, float(n)])) for n in range(150)]
    sent = [*log, *rng.sample(log, 30)]
    rng.shuffle(sent)
    have = spark.createDataFrame(base, "k long, a string, b double")
    df = spark.createDataFrame(sent, "seq long, k long, op string, a string, b double").repartition(3)
    table, errors = replay(base, log)
    found = changes.apply_changes(have, df, "k", ["a", "b"])
    assert {r["k"]: (r["a"], r["b"]) for r in found.collect()} == table
    assert sorted({(r["seq"], r["error"]) for r in changes.rejected_changes(have, df, "k").collect()}) == errors
    again = changes.apply_changes(found, df.where("false"), "k", ["a", "b"])
    assert {r["k"]: (r["a"], r["b"]) for r in again.collect()} == table
    gone = {r["k"] for r in changes.orphans(have.select("k"), have, found, "k").collect()}
    assert gone == {k for k, *_ in base} - set(table)
