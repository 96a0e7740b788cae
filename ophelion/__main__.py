"""Commands: ``python -m ophelion COMMAND ...`` runs one job over files.

Inputs are Parquet folders, or CSV where the name ends in ``.csv``; each result is a
Parquet table of its own name below ``--out``. What a command needs is checked before
Spark starts.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions.ids import split_list
from .operators import cluster, density, joins, ranking, reports, signal
from .plans import jobs
from .sources import files, sinks

Results = dict[str, DataFrame]


def read(spark: SparkSession, path: str) -> DataFrame:
    return files.analysis_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def named(items: Sequence[str]) -> dict[str, str]:
    """name=path arguments."""
    pairs = dict(x.split("=", 1) for x in items if "=" in x)
    if len(pairs) != len(items):
        raise SystemExit("tables are given as name=path, each name once")
    return pairs


def salt(a) -> str:
    """The salt comes from the environment, as arguments show in process lists."""
    found = os.environ.get(a.salt_env, "")
    if not found:
        raise SystemExit(f"the environment has no {a.salt_env}")
    return found


def numbers(text: str, kind: Callable = float) -> list:
    return [kind(x) for x in split_list(text)]


def consolidate(spark, a) -> Results:
    tables = jobs.consolidate(spark, a.device, a.exam, f"{a.out}/consolidated")
    found = jobs.audit_cross(tables["patients"], tables["metadata"]) if a.audit else {}
    return {f"audit_{n}": df for n, df in found.items()}


def audit_cross(spark, a) -> Results:
    return jobs.audit_cross(read(spark, a.patients), read(spark, a.metadata), a.key)


def audit_before_after(spark, a) -> Results:
    return jobs.audit_before_after(read(spark, a.before), read(spark, a.after), a.key)


def annotate(spark, a) -> Results:
    people, missing = jobs.annotate(read(spark, a.people), read(spark, a.records), a.row_id)
    return {"people": people, "not_found": missing}


def purge(spark, a) -> Results:
    done = jobs.purge(spark, {n: read(spark, p) for n, p in named(a.table).items()}, read(spark, a.allowed), a.key)
    return {x: df for n, (kept, log) in done.items() for x, df in ((n, kept), (f"{n}_log", log))}


def hash_ids(spark, a) -> Results:
    return {"mapping": joins.hash_mapping(read(spark, a.ids), a.key, salt(a))}


def anonymise(spark, a) -> Results:
    done = jobs.anonymise({n: read(spark, p) for n, p in named(a.table).items()}, read(spark, a.ids), a.key, salt(a))
    return {x: df for n, (kept, log) in done.items() for x, df in ((n, kept), (f"{n}_audit", log))}


def parquet(spark, a) -> Results:
    sinks.final_dataset(read(spark, a.input), split_list(a.drop), a.type_column, jobs.WAVEFORM_CODES, f"{a.out}/final")
    return {}


def metrics(spark, a) -> Results:
    return {"metrics": jobs.translation_metrics(files.text_corpus(spark, a.corpus, a.prefix))}


def rank(spark, a) -> Results:
    return {"ranking": jobs.rank_models(read(spark, a.input), a.method, split_list(a.columns), tuple(a.where) if a.where else None, a.top, a.model)}


def histogram(spark, a) -> Results:
    return {"histogram": reports.histogram(read(spark, a.input), a.column, a.bins, split_list(a.by))}


def preview(spark, a) -> Results:
    df = read(spark, a.input)
    return {"preview": sinks.preview_whole(df, a.key, a.rows) if a.key else sinks.preview(df, a.rows)}


def curves(spark, a) -> Results:
    return {"curves": signal.curves(read(spark, a.input), a.patient, split_list(a.keys), a.order, a.patients, a.rows, a.points)}


def sweep(spark, a) -> Results:
    grid = [(e, m) for e in numbers(a.eps) for m in numbers(a.min_samples, int)]
    found = density.sweep(read(spark, a.input), split_list(a.partition), a.row_id, a.vector, grid)
    return {"sweep": found, "totals": cluster.sweep_totals(found)}


def questionnaires(spark, a) -> Results:
    return {"questionnaires": reports.questionnaire_list(read(spark, a.input), a.creator, split_list(a.fields), a.first, a.last)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ophelion", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def add(where, name: str, run, *needed: str, **given):
        """A command with its required options, and others with their defaults."""
        p = where.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        for x in needed:
            p.add_argument(f"--{x}", required=True, **({"nargs": "+"} if x == "table" else {}))
        for x, default in given.items():
            kind = {"action": "store_true"} if default is False else {"type": type(default), "default": default} if default is not None else {}
            p.add_argument(f"--{x.replace('_', '-')}", **kind)
        p.add_argument("--out", required=True)
        p.set_defaults(run=run)
        return p

    add(commands, "consolidate", consolidate, "device", "exam", audit=False)
    audits = commands.add_parser("audit").add_subparsers(dest="mode", required=True)
    add(audits, "cross", audit_cross, "patients", "metadata", key="patient_unique_id")
    add(audits, "before-after", audit_before_after, "before", "after", key="patient_unique_id")
    add(commands, "annotate", annotate, "people", "records", "row-id")
    add(commands, "purge", purge, "table", "allowed", key="patient_unique_id")
    add(commands, "hash", hash_ids, "ids", key="patient_unique_id", salt_env="OPHELION_SALT")
    add(commands, "anonymise", anonymise, "table", "ids", key="patient_unique_id", salt_env="OPHELION_SALT")
    add(commands, "parquet", parquet, "input", drop="", type_column="waveform_type")
    add(commands, "metrics", metrics, "corpus", "prefix")
    ranks = add(commands, "rank", rank, "input", columns="", top=5, model="model_id")
    ranks.add_argument("--method", type=int, choices=(1, 2, 3), required=True)
    ranks.add_argument("--where", nargs=3, metavar=("COLUMN", "OPERATOR", "VALUE"))
    add(commands, "histogram", histogram, "input", "column", bins=20, by="")
    add(commands, "preview", preview, "input", rows=20, key="")
    add(commands, "curves", curves, "input", patient="patient_unique_id", keys="waveform_type,test_id", order="time_ms", patients=3, rows=20000, points=2000)
    add(commands, "sweep", sweep, "input", "row-id", "vector", "eps", "min-samples", partition="")
    add(commands, "questionnaires", questionnaires, "input", "creator", "fields", first=None, last=None)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command; the names of the tables written."""
    a = parser().parse_args(argv)
    if a.command == "rank" and a.method > 1 and not split_list(a.columns):
        raise SystemExit("methods 2 and 3 need --columns")
    spark = spark or SparkSession.builder.appName("ophelion").getOrCreate()
    found = a.run(spark, a)
    for name, df in found.items():
        sinks.write_parquet(df, f"{a.out}/{name}")
    return list(found)


if __name__ == "__main__":
    main()
