"""Where a run stands: progress per participant, sample counts, recent events, focus list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.keys import is_partial_service, split_participant_language


def participant_progress(attempts: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress per phase and participant. ``totals`` has ``phase, participant_id, total``."""
    done = F.col("outcome").isin("success", "failure")
    counts = attempts.groupBy("phase", "participant_id").agg(
        F.count_if(done).alias("completed"),
        F.count_if(F.col("outcome") == "success").alias("succeeded"),
        F.count_if(F.col("outcome") == "failure").alias("failed"),
        F.count_if(F.col("outcome") == "retry").alias("retries"),
        F.max(F.when(F.col("outcome") == "failure", F.col("ts"))).alias("last_failure_at"),
    )
    joined = totals.join(counts, ["phase", "participant_id"], "left")
    for name in ("completed", "succeeded", "failed", "retries"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
    return joined.withColumn("remaining", F.greatest(F.col("total") - F.col("completed"), F.lit(0)))


def final_progress(progress: DataFrame) -> DataFrame:
    """Both phases added up per participant."""
    sums = [F.sum(name).alias(name) for name in ("completed", "succeeded", "failed", "retries", "remaining")]
    return progress.groupBy("participant_id").agg(*sums, F.max("last_failure_at").alias("last_failure_at"))


def rate_and_eta(completed: Column, total: Column, elapsed_ms: Column, initial: Column) -> tuple[Column, Column]:
    """Items per minute in this session, and whole minutes to the end (0 when idle)."""
    minutes = F.greatest(elapsed_ms / 60000, F.lit(1 / 60000))
    done = F.greatest(completed - F.coalesce(initial, F.lit(0)), F.lit(0))
    rate = done / minutes
    eta = F.when(rate == 0, 0).otherwise(F.ceil(F.greatest(total - completed, F.lit(0)) / rate))
    return rate, eta.cast("bigint")


def sample_counts(groups: DataFrame, people: DataFrame, runs: DataFrame) -> DataFrame:
    """Valid, failed, expected and unresolved samples per run and participant.

    ``groups``: ``run_id, key`` (participant::language), ``ok, failed``. ``people``: ``run_id,
    participant_id, provider``. ``runs``: ``run_id, limit_applied, languages, unresolved_total``.
    Partial services report the run's unresolved total; without a limit nothing is expected
    beyond what is there.
    """
    split = groups.withColumn("participant_id", split_participant_language("key")["participant_id"])
    sums = split.groupBy("run_id", "participant_id").agg(F.sum("ok").alias("valid"), F.sum("failed").alias("failed"))
    joined = people.join(sums, ["run_id", "participant_id"], "left").join(runs, "run_id")
    valid, failed = F.coalesce("valid", F.lit(0)), F.coalesce("failed", F.lit(0))
    planned = F.when(F.col("languages") > 0, F.col("limit_applied") * F.col("languages"))
    partial = is_partial_service("provider", "participant_id") & F.col("unresolved_total").isNotNull()
    unresolved = F.when(partial, F.col("unresolved_total")).otherwise(
        F.coalesce(F.greatest(planned - valid - failed, F.lit(0)), F.lit(0))
    )
    return joined.select(
        "run_id", "participant_id", valid.alias("valid"), failed.alias("failed"), unresolved.alias("unresolved"),
        F.coalesce(planned, valid + failed + unresolved).alias("expected"),
    )


def partial_service_gap(groups: DataFrame, services: Sequence[str] = domain.PARTIAL_SERVICE_IDS) -> DataFrame:
    """How many cells the partial services lack against the fullest participant per language."""
    split = groups.select(split_participant_language("key").alias("k"), (F.col("ok") + F.col("failed")).alias("total"))
    totals = split.where(F.col("k").isNotNull()).groupBy("k.participant_id", "k.language").agg(F.max("total").alias("total"))
    expected = totals.groupBy("language").agg(F.max("total").alias("expected"))
    own = totals.where(F.col("participant_id").isin(*services))
    present = own.select("participant_id").distinct()
    # At most a handful of services: one small array travels with the language rows.
    wanted = F.array(*[F.lit(name) for name in services])
    grid = expected.select("*", F.explode(wanted).alias("participant_id")).join(present, "participant_id", "left_semi")
    gaps = grid.join(own, ["participant_id", "language"], "left")
    missing = F.greatest(F.col("expected") - F.coalesce("total", F.lit(0)), F.lit(0))
    return gaps.agg(F.coalesce(F.sum(missing), F.lit(0)).alias("unresolved"))


def footnote(gap: DataFrame) -> DataFrame:
    """Footnote text; null when nothing is missing."""
    count = F.col("unresolved")
    text = F.format_string(
        "DeepL variants had %d unresolved translation %s combined; bars reflect scored samples only.",
        count, F.when(count == 1, "failure").otherwise("failures"),
    )
    return gap.select("unresolved", F.when(count > 0, text).alias("footnote"))


def recent_events(events: DataFrame, limit: int, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Newest events first: a top-k per task, merged on one."""
    return events.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def recent_failures(events: DataFrame, failures: DataFrame, limit: int = 5) -> DataFrame:
    """Newest failures out of events and of recorded failures no event speaks of."""
    seen = events.where(F.col("stable_key").isNotNull()).select("stable_key").distinct()
    extra = failures.join(seen, "stable_key", "left_anti")
    columns = ["stable_key", "ts", "seq", "error_class"]
    return recent_events(events.select(*columns, F.lit("event").alias("origin")).unionByName(
        extra.select(*columns, F.lit("record").alias("origin"))), limit)


def focus_list(snapshots: DataFrame, threshold: int) -> DataFrame:
    """Participants worth a progress line: in flight, the ten latest failed, the five with most left.

    Input: one row per participant (``ord, inflight, failed, remaining, last_failure_at``). Each
    branch is a top-k; a participant is listed once, where it ranks first. Up to ``threshold``
    participants are all listed.
    """
    def branch(df: DataFrame, number: int, *order: Column) -> DataFrame:
        # At most ten rows reach this window.
        return df.select("participant_id", F.lit(number).alias("branch"), F.row_number().over(Window.orderBy(*order)).alias("place"))

    from pyspark.sql import Window

    # Participants are a bounded dimension: one row each.
    snapshots = snapshots.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) <= threshold)
    everyone = snapshots.where("_all").select("participant_id", F.lit(0).alias("branch"), (F.col("ord") + 1).alias("place"))
    snapshots = snapshots.where("not _all")
    inflight = snapshots.where("inflight > 0").select("participant_id", F.lit(0).alias("branch"), (F.col("ord") + 1).alias("place"))
    failed_order = (F.desc_nulls_last("last_failure_at"), F.desc("failed"), F.asc("ord"))
    failed = snapshots.where("failed > 0").orderBy(*failed_order).limit(10)
    left_order = (F.desc("remaining"), F.asc("ord"))
    left = snapshots.where("remaining > 0").orderBy(*left_order).limit(5)
    ranked = everyone.unionByName(inflight).unionByName(branch(failed, 1, *failed_order)).unionByName(branch(left, 2, *left_order))
    best = ranked.groupBy("participant_id").agg(F.min(F.struct("branch", "place")).alias("b"))
    return best.select("participant_id", "b.branch", "b.place")
