"""Whole jobs composed of the operators: what a user ran as a command."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, values
from ..operators import clean, dedupe, joins, linkage, ranking, scores, signal
from ..sources import files, sinks

WAVEFORM_CODES = {"pupil waveform": 1, "raw waveform": 2, "reported waveform": 3}
PERSONAL = ("name", "record", "PatientID", "PatientBirthdate", "birth_date", "field", "source_file")


def consolidate(spark: SparkSession, device_path: str, exam_path: str, out: str) -> dict[str, DataFrame]:
    """Device and exam files to tables: metadata, waveforms, patients, id mapping."""
    device = files.binary_files(spark, device_path)
    metadata = files.with_identity(files.device_metadata(device))
    who = metadata.select("source_file", "test_id", "patient_unique_id")
    waveforms = files.device_waveforms(device).join(who, ["source_file", "test_id"])
    people = files.patients(files.exam_records(files.binary_files(spark, exam_path)))
    tables = {"metadata": metadata, "waveforms": waveforms, "patients": people, "mapping": files.id_mapping(people)}
    for name, df in tables.items():
        sinks.write_parquet(df, f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def audit_cross(patients: DataFrame, metadata: DataFrame, key: str = "patient_unique_id") -> dict[str, DataFrame]:
    found = dedupe.presence(patients, metadata, key, ("patients", "metadata"))
    both = found.where("presence = 'both'").select(key)
    counted = dedupe.with_occurrences(dedupe.with_occurrences(both, patients, key, "in_patients"), metadata, key, "in_metadata")
    return {"presence": found, "summary": dedupe.presence_summary(found), "both": counted, "only_one": found.where("presence <> 'both'")}


def audit_before_after(before: DataFrame, after: DataFrame, key: str) -> dict[str, DataFrame]:
    return {"counts": dedupe.before_after(before, after, key), "changes": dedupe.changed_ids(before, after, key)}


def purge(spark: SparkSession, tables: dict[str, DataFrame], allowed: DataFrame, key: str, out: str | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept rows, log) of each table; written only where ``out`` is given."""
    done = {n: (dedupe.purge_orphans(df, allowed, key), dedupe.purge_log(df, allowed, key, [], key)) for n, df in tables.items()}
    if out:
        for n, (kept, log) in done.items():
            sinks.write_parquet(kept, f"{out}/{n}")
            sinks.write_csv(log, f"{out}/{n}_log")
    return done


def anonymise(tables: dict[str, DataFrame], ids_from: DataFrame, key: str, salt: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Pseudonymised tables with their audit; one mapping for all of them."""
    mapping = joins.hash_mapping(ids_from, key, salt)
    return {n: joins.anonymise(df, mapping, key, PERSONAL) for n, df in tables.items()}


def annotate(people: DataFrame, records: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(people with their record's annotations, unmatched): by record number, exact
    name, then a name of which one is a prefix of the other; the record's sex wins."""
    named = records.withColumn("norm_name", ids.normalize_name(F.col("name")))
    by_number = named.where(ids.blank_to_null(F.col("record")).isNotNull())
    steps = [("record", by_number, ids.blank_to_null(F.col("record")), "record", "record_id"), ("name_exact", named, F.nullif(ids.normalize_name(F.col("name")), F.lit("")), "norm_name", "record_id")]
    matched = joins.cascade_match(people, steps, row_id)
    open_ = matched.where("matched is null").withColumn("norm_name", ids.normalize_name(F.col("name")))
    prefix = joins.prefix_join(open_.select("norm_name").distinct(), named.withColumnRenamed("norm_name", "other"), "norm_name", "other", "record_id")
    found = open_.join(prefix.select("norm_name", "matched", "method").withColumnsRenamed({"matched": "hit"}), "norm_name", "left")
    ident = named.groupBy(F.col("norm_name").alias("hit")).agg(F.min("record_id").cast("string").alias("hit_id"))
    later = found.join(ident, "hit", "left").select(*people.columns, F.col("hit_id").alias("matched"), F.when(F.col("hit_id").isNotNull(), "name_prefix").otherwise("not_found").alias("match_method"))
    every = matched.where("matched is not null").unionByName(later)
    info = records.select(F.col("record_id").cast("string").alias("matched"), F.col("sex").alias("_sex"), *[values.parse_bool(F.col(c)).alias(c) for c in records.columns if c.startswith("has_")])
    out = every.join(info, "matched", "left")
    if "sex" in people.columns:
        own, theirs = ids.blank_to_null(F.col("sex")), ids.blank_to_null(F.col("_sex"))
        out = out.withColumns({"sex_differs": F.coalesce((values.norm_sex(own) != values.norm_sex(theirs)) & (values.norm_sex(own) != "") & (values.norm_sex(theirs) != ""), F.lit(False)), "sex": F.coalesce(theirs, own)}).drop("_sex")
    else:
        out = out.withColumnRenamed("_sex", "sex")
    return out, out.where("match_method = 'not_found'")


def spectral_job(waveforms: DataFrame, dims: DataFrame, keys: Sequence[str], dim_columns: Sequence[str]) -> DataFrame:
    """Features of every voltage series with its dimensions, unknown ones filled."""
    once = joins.dims_once(dims, keys, dim_columns, dim_columns[0])
    voltage = waveforms.where("voltage_uV is not null").dropna(subset=list(keys)).withColumns({k: F.col(k).cast("string") for k in keys})
    joined = signal.fill_dims(voltage.join(once, list(keys), "left"), keys, dim_columns)
    series = joined.withColumnsRenamed({"voltage_uV": "value"}).withColumn("signal_type", F.lit("voltage"))
    return signal.spectral_features(series, [*keys, "waveform_type", *dim_columns, "signal_type"])


def translation_metrics(corpus: DataFrame, key: str = "content") -> DataFrame:
    """The corpus with counts and readability indices of each text."""
    counted = corpus.withColumns(text.text_counts(F.col(key)))
    return counted.withColumns(text.readability(*[F.col(c) for c in ("words", "sentences", "syllables", "letters")]))


def rank_models(df: DataFrame, method: int, columns: Sequence[str] = (), where: tuple[str, str, str] | None = None, top: int = 5, model: str = "model_id") -> DataFrame:
    """Ranking command: an optional filter first, then one of the three methods."""
    if where:
        df = clean.require_rows(clean.compare_filter(df, *where), "filter")
    if method == 1:
        return ranking.rank_by_average(df)
    if method == 2:
        return ranking.rank_each(df, columns, model, top)
    if method == 3:
        return ranking.rank_by_selected(df, columns)
    raise ValueError("method must be 1, 2 or 3")


def link_questionnaires(people_answers: DataFrame, people: DataFrame, key: str, name: str, dob: str, sex: str, record_links: DataFrame | None = None) -> dict[str, DataFrame]:
    """Results, confirmed, ambiguous, unmatched, explanation and counts of a linkage."""
    queries = linkage.query_fields(people_answers, key, name, dob, sex)
    scored = linkage.scored_candidates(queries, people)
    decided = linkage.decide(queries, scored, record_links)
    return {
        "results": decided.drop("candidates"),
        "confirmed": decided.where("decision = 'MATCH_UNIQUE'").select("query_id", "record", "score"),
        "ambiguous": decided.where("decision = 'MATCH_MULTIPLE'").select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.*"),
        "unmatched": decided.where("decision = 'NO_MATCH'").select("query_id", "score", "phase"),
        "explain": scored,
        "counts": linkage.decision_counts(decided),
    }


def analyse_questionnaire(answers: DataFrame, options: DataFrame, items: Sequence[str] = scores.ITEMS, subscales: dict[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Scores per respondent with group statistics, reliability and correlations.
    ``answers`` has submission_id, question_id, caption, selected_options."""
    points = scores.score_by_sum(answers, options).join(answers.select("submission_id", "question_id", "caption").distinct(), ["submission_id", "question_id"])
    subscales = dict(scores.SUBSCALES) if subscales is None else subscales
    wide = scores.scale_scores(points, items, subscales)
    names = [*subscales, "global_score"]
    stats = wide.unpivot([], [F.col(f"`{n}`") for n in names], "scale", "value")
    return {"scores": wide, "stats": scores.descriptive_stats(stats, "value", ["scale"]), "alpha": scores.cronbach_alpha(wide, items), "spearman": scores.spearman(wide, items)}
