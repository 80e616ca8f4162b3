"""Run tables: pending work, failures, forks, merges and rekeying."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.functions.keys import stable_key
from gridscore.operators.windows import latest_rows


def pending(cells: DataFrame, *done: DataFrame, key: Sequence[str] = ("stable_key",)) -> DataFrame:
    """Cells that no ``done`` table names. Done keys are made distinct first, so a key that
    was recorded many times arrives once."""
    for table in done:
        cells = cells.join(table.select(*key).distinct(), list(key), "left_anti")
    return cells


def with_items(pending_cells: DataFrame, items: DataFrame, context_rows: Column) -> DataFrame:
    """Attach the item of each cell; a context row without item stops the job."""
    looked_up = pending_cells.join(items, "source_id", "left")
    missing = context_rows & F.col("item").isNull()
    message = F.concat(F.lit("no context item for "), F.col("source_id"))
    return looked_up.withColumn("item", F.when(missing, F.raise_error(message).cast(items.schema["item"].dataType)).otherwise(F.col("item")))


def latest_failures(failures: DataFrame) -> DataFrame:
    """The newest failure per key; of equal times the one recorded later (``seq``)."""
    return latest_rows(failures, ["stable_key"], ["recorded_at", "seq"])


def unresolved_failures(translations: DataFrame, failures: DataFrame) -> DataFrame:
    """Newest failures of keys that never succeeded."""
    return pending(latest_failures(failures), translations)


def fork_rows(
    translations: DataFrame, unresolved: DataFrame, overlap: DataFrame, allowed: DataFrame, source_run: str, new_run: str
) -> DataFrame:
    """Translations a fork may copy, rekeyed for the new run with their origin kept."""
    kept = translations.join(overlap.select("participant_id").distinct(), "participant_id", "left_semi")
    kept = kept.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
    return rekey(pending(kept, unresolved), source_run, new_run)


def rekey(rows: DataFrame, source_run: str, new_run: str) -> DataFrame:
    """Rows of one run under the keys of another, with ``source_run_id`` and ``source_stable_key``."""
    return (
        rows.withColumn("source_run_id", F.lit(source_run))
        .withColumn("source_stable_key", F.col("stable_key"))
        .withColumn("stable_key", stable_key(F.lit(new_run), "source_id", "target_language", "participant_id"))
    )


def carried_failures(failures: DataFrame, unresolved: DataFrame, overlap: DataFrame, allowed: DataFrame, new_run: str) -> DataFrame:
    """Every recorded failure of a key that stays unresolved, rekeyed."""
    kept = failures.join(overlap.select("participant_id").distinct(), "participant_id", "left_semi")
    kept = kept.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
    kept = kept.join(unresolved.select("stable_key").distinct(), "stable_key", "left_semi")
    return kept.withColumn("stable_key", stable_key(F.lit(new_run), "source_id", "target_language", "participant_id"))


def may_reuse_judgments(prompt_mismatch_allowed: bool, source: tuple[str | None, str], wanted: tuple[str | None, str]) -> bool:
    """Judge rows are reused only under the same prompt, judge model and judge backend."""
    return not prompt_mismatch_allowed and source[0] is not None and source == wanted


def reused_keys(judgments: DataFrame, copied: DataFrame, judge_model: str) -> DataFrame:
    """Old and new key (``source_stable_key``, ``stable_key``) of copied translations with an ok judgment by the same judge."""
    good = judgments.where((F.col("status") == "ok") & (F.col("judge_model_id") == judge_model))
    keys = copied.select("source_stable_key", "stable_key").distinct()
    return keys.join(good.select(F.col("stable_key").alias("source_stable_key")).distinct(), "source_stable_key", "left_semi")


def reused_judgments(judgments: DataFrame, copied: DataFrame, judge_model: str, new_run: str) -> DataFrame:
    """Judgments of the reused keys, moved to the new run."""
    return rekey_metrics(judgments, reused_keys(judgments, copied, judge_model)).withColumn("run_id", F.lit(new_run))


def rekey_metrics(metrics: DataFrame, copied: DataFrame) -> DataFrame:
    """Rows of copied keys under their new keys; others are dropped. With :func:`reused_keys` as ``copied`` the same serves
    the raw rows and the usage rows of a judge."""
    keys = copied.select(F.col("source_stable_key").alias("stable_key"), F.col("stable_key").alias("_new")).distinct()
    return metrics.join(keys, "stable_key").withColumn("stable_key", F.col("_new")).drop("_new")


def import_participants(target: DataFrame, source: DataFrame, participants: Sequence[str], expected: int) -> DataFrame:
    """Append the rows of named participants of another run; each must have exactly ``expected``.

    Counting is a small aggregate; its result rides along as a per-participant check so that
    one job both checks and copies. Its size decides how it is joined.
    """
    wanted = source.where(F.col("participant_id").isin(*participants))
    counts = wanted.groupBy("participant_id").agg(F.count(F.lit(1)).alias("_n"))
    message = F.format_string("%s has %d rows, expected %d", F.col("participant_id"), F.col("_n"), F.lit(expected))
    checked = wanted.join(counts, "participant_id").withColumn(
        "_ok", F.when(F.col("_n") == expected, True).otherwise(F.raise_error(message).cast("boolean"))
    )
    return target.unionByName(checked.where("_ok").drop("_n", "_ok"), allowMissingColumns=True)


def rejudge_admission(translations: DataFrame, unresolved: DataFrame, expected: int) -> DataFrame:
    """One row: may this run be judged again? Counts distinct keys, not rows."""
    keys = translations.agg(F.count_distinct("stable_key").alias("n")).select(F.lit("keys").alias("what"), "n")
    open_ = unresolved.agg(F.count(F.lit(1)).alias("n")).select(F.lit("open").alias("what"), "n")

    def pick(what: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col("n")))

    counts = keys.unionByName(open_).agg(pick("keys").alias("distinct_keys"), pick("open").alias("unresolved"))
    return counts.withColumn("expected", F.lit(expected).cast("bigint")).withColumn(
        "admitted", (F.col("unresolved") == 0) & (F.col("distinct_keys") == F.col("expected"))
    )


def with_latency(rows: DataFrame, metrics: DataFrame, seq: str = "seq") -> DataFrame:
    """Latency per key: the last metric row wins, a missing one counts as zero."""
    last = metrics.groupBy("stable_key").agg(F.max_by("latency_ms", seq).alias("latency_ms"))
    return rows.join(last, "stable_key", "left").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0)))


def with_condition(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """Condition by participant id, else by model id; of equal model ids the last one listed."""
    by_id = conditions.groupBy("participant_id").agg(F.max_by("label", "ord").alias("_by_id"))
    by_model = conditions.groupBy("participant_model_id").agg(F.max_by("label", "ord").alias("_by_model"))
    return (
        rows.join(by_id, "participant_id", "left")
        .join(by_model, "participant_model_id", "left")
        .withColumn("label", F.coalesce("_by_id", "_by_model"))
        .drop("_by_id", "_by_model")
    )


def nested_results(outputs: DataFrame) -> DataFrame:
    """Item documents: languages with their outputs, sorted by label.

    Input columns: ``item_ord, source_id, target_language, label, output, latency_ms`` for
    known items and conditions. The outputs of an item are bounded by languages and conditions,
    and each item is one document.
    """
    entry = F.struct("label", "output", "latency_ms")
    by_language = outputs.groupBy("item_ord", "source_id", "target_language").agg(F.sort_array(F.collect_list(entry)).alias("outputs"))
    return by_language.groupBy("item_ord", "source_id").agg(
        F.sort_array(F.collect_list(F.struct("target_language", "outputs"))).alias("translations")
    )
