"""Change sets: a log of inserts, updates and deletes applied to a table by key.

The last change wins, whatever order the log arrives in and however often a change is
repeated. All that a key needs is summed up in one aggregation (the last value of each
field, the last delete, the first insert), which combines before the shuffle, so a key
with a third of the log is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "I", "U", "D"


def _valid(key: str, op: str, order: Sequence[str]) -> Column:
    known = F.col(op).isin(INSERT, UPDATE, DELETE)
    return F.coalesce(known & F.col(key).isNotNull(), F.lit(False)) & ~F.coalesce(*(F.when(F.col(c).isNull(), True) for c in order), F.lit(False))


def summed_changes(changes: DataFrame, key: str, fields: Sequence[str], op: str, order: Sequence[str]) -> DataFrame:
    """(key, last_op, deleted, inserted, <field>): places in the order of the last delete
    and the first insert, and of each field the last value given with its place."""
    at = F.struct(*order)
    rows = changes.where(_valid(key, op, order))
    given = [F.max(F.when((F.col(op) != DELETE) & F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c) for c in fields]
    return rows.groupBy(key).agg(
        F.max(F.struct(at.alias("at"), F.col(op).alias("op")))["op"].alias("last_op"),
        F.max(F.when(F.col(op) == DELETE, at)).alias("deleted"),
        F.min(F.when(F.col(op) == INSERT, at)).alias("inserted"),
        *given,
    )


def apply_changes(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], op: str = "op", order: Sequence[str] = ("seq",)) -> DataFrame:
    """(key, fields) after the changes, ordered by ``order`` (a later place in the log).

    A field that a change leaves null keeps its value. A delete ends a row; what comes
    after it starts from nothing. A key that isn't in the base exists from its first
    insert on, and changes before that count for nothing (``rejected_changes``). An
    insert of a key that exists updates it. Equal places with different values are
    settled by the greater value. Keys of the base are unique, and null ones stay as they
    are."""
    log = summed_changes(changes, key, fields, op, order)
    old = base.select(key, F.struct(*fields).alias("_old"), F.lit(True).alias("_in"))
    both = old.join(log, key, "full")
    held = F.coalesce("_in", F.lit(False))
    started = held | F.col("inserted").isNotNull()
    counts = lambda at: (F.col("deleted").isNull() | (at > F.col("deleted"))) & (held | (at >= F.col("inserted")))
    value = lambda c: F.coalesce(F.when(counts(F.col(f"{c}.at")), F.col(f"{c}.value")), F.when(F.col("deleted").isNull(), F.col(f"_old.{c}")))
    alive = both.where(started & (F.coalesce("last_op", F.lit(UPDATE)) != DELETE))
    return alive.select(key, *(value(c).alias(c) for c in fields))


def rejected_changes(base: DataFrame, changes: DataFrame, key: str, op: str = "op", order: Sequence[str] = ("seq",)) -> DataFrame:
    """(all columns of the log, error): changes without a key, a place or a known
    operation, and updates and deletes of keys that don't exist by then."""
    at = F.struct(*order)
    first = changes.where(_valid(key, op, order)).where(F.col(op) == INSERT).groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_first"))
    known = base.select(F.col(key).alias("_held")).where("_held is not null").distinct()
    rows = changes.join(known, F.col(key) == F.col("_held"), "left").join(first, F.col(key) == F.col("_key"), "left")
    missing = F.col("_held").isNull() & (F.col("_first").isNull() | (at < F.col("_first")))
    error = F.when(~_valid(key, op, order), "invalid").when(missing, "not_found")
    return rows.select(*changes.columns, error.alias("error")).where("error is not null")


def orphans(children: DataFrame, base: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The rows of a child table that go with the deleted rows of the base."""
    gone = base.select(key).join(after.select(key), key, "left_anti")
    return children.join(gone, key, "left_semi")
