"""Rules an item table must obey. Every rule reports; nothing stops at the first breach."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.keys import bucket_key
from gridscore.functions.rendering import model_input
from gridscore.functions.text import is_blank
from gridscore.operators.grid import authoring_grid


def _in(column: Column, values: tuple) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


def _turn_problems(turn: Column) -> Column:
    return ~_in(turn["speakerRole"], domain.SPEAKER_ROLES) | F.coalesce(turn["sourceText"] == "", F.lit(True))


def runtime_rules() -> dict[str, Column]:
    """Rule name to a condition that is true when the rule is broken."""
    turns, current = F.col("contextTurns"), F.col("currentSource")
    roles = F.array_distinct(F.transform(F.concat(turns, F.array(current)), lambda t: t["speakerRole"]))
    both = F.array_contains(roles, "self") & F.array_contains(roles, "other")
    return {
        "sample id missing": F.col("sampleId").isNull(),
        "turn count": ~_in(F.col("contextTurnCount"), domain.TURN_COUNTS),
        "speaker mode": ~_in(F.col("speakerMode"), domain.SPEAKER_MODES),
        "expectation": ~_in(F.col("contextExpectation"), domain.EXPECTATIONS),
        "primary phenomenon": ~_in(F.col("primaryPhenomenon"), domain.PRIMARY_PHENOMENA),
        "secondary phenomenon": F.col("secondaryPhenomena").isNull()
        | F.exists("secondaryPhenomena", lambda tag: ~_in(tag, domain.SECONDARY_PHENOMENA)),
        "turns do not match count": ~F.coalesce(F.size(turns) == F.col("contextTurnCount"), F.lit(False)),
        "turn malformed": F.exists(turns, _turn_problems) | _turn_problems(current),
        "current turn is not self": ~F.coalesce(current["speakerRole"] == "self", F.lit(False)),
        "current turn has a label": current["relativeTimeLabel"].isNotNull(),
        "single mode with several roles": (F.col("speakerMode") == "single") & (F.size(roles) != 1),
        "dyadic mode without both roles": (F.col("speakerMode") == "dyadic") & ~both,
    }


def internal_rules() -> dict[str, Column]:
    indices = F.col("relevantContextIndices")
    return {
        **runtime_rules(),
        "context index out of range": indices.isNull()
        | F.exists(indices, lambda i: i.isNull() | (i < 0) | (i >= F.size("contextTurns"))),
        "interpretation missing": F.coalesce(F.col("intendedInterpretation") == "", F.lit(True)),
        "no failure mode": F.coalesce(F.size("commonFailureModes") == 0, F.lit(True)),
        "empty failure mode": F.exists("commonFailureModes", lambda mode: F.coalesce(mode == "", F.lit(True))),
        "notes missing": F.coalesce(F.col("validationNotes") == "", F.lit(True)),
    }


def authored_rules() -> dict[str, Column]:
    """Internal rules on trimmed texts: white space does not count as content."""
    return {
        **internal_rules(),
        "turn malformed": F.exists("contextTurns", lambda t: _turn_problems(t) | is_blank(t["sourceText"]))
        | _turn_problems(F.col("currentSource"))
        | is_blank(F.col("currentSource.sourceText")),
        "interpretation missing": is_blank(F.col("intendedInterpretation")),
        "empty failure mode": F.exists("commonFailureModes", is_blank),
        "notes missing": is_blank(F.col("validationNotes")),
    }


def pristine_rules() -> dict[str, Column]:
    """Rules of an item nobody has filled yet (nested authoring form)."""

    def touched(turn: Column) -> Column:
        return (turn["speakerRole"] != "self") | turn["relativeTimeLabel"].isNotNull() | (turn["sourceText"] != "")

    return {
        "status is not todo": F.col("status") != "todo",
        "turns do not match count": F.size("fill.contextTurns") != F.col("locked.contextTurnCount"),
        "secondary phenomena filled": F.size("fill.secondaryPhenomena") != 0,
        "context indices filled": F.size("fill.relevantContextIndices") != 0,
        "failure modes filled": F.size("fill.commonFailureModes") != 0,
        "interpretation filled": F.col("fill.intendedInterpretation") != "",
        "notes filled": F.col("fill.validationNotes") != "",
        "turn filled": F.exists("fill.contextTurns", touched),
        "current turn filled": touched(F.col("fill.currentSource")),
    }


def violations(items: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Items with the names of the rules they break, in rule order."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items()]))
    return items.withColumn("violations", names)


def strict(items: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The items unchanged; the first broken rule stops the job."""
    checked = violations(items, rules)
    message = F.concat(F.col("sampleId"), F.lit(": "), F.array_join("violations", ", "))
    good = F.when(F.size("violations") == 0, True).otherwise(F.raise_error(message).cast("boolean"))
    return checked.where(good).drop("violations")


def duplicate_ids(items: DataFrame, column: str = "sampleId") -> DataFrame:
    return items.groupBy(column).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def bucket_balance(items: DataFrame) -> DataFrame:
    """Expected against actual items per bucket; buckets without items and buckets that are not planned show up with zero."""
    key = ["contextTurnCount", "speakerMode", "contextExpectation", "primaryPhenomenon"]
    expected = authoring_grid(items.sparkSession).groupBy(*key).agg(F.count(F.lit(1)).alias("expected"))
    actual = items.groupBy(*key).agg(F.count(F.lit(1)).alias("actual"))
    both = expected.join(actual, [expected[k].eqNullSafe(actual[k]) for k in key], "full")
    names = [F.coalesce(expected[k], actual[k]) for k in key]
    return both.select(
        bucket_key(*names).alias("bucket"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")
    ).withColumn("balanced", F.col("expected") == F.col("actual"))


def scaffold_totals(items: DataFrame) -> DataFrame:
    """One row: planned and actual items, buckets that are not balanced, ids that repeat, and whether all is well."""
    balance = bucket_balance(items).agg(
        F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.count_if(~F.col("balanced")).alias("unbalanced"),
    )
    repeated = duplicate_ids(items).agg(F.count(F.lit(1)).alias("repeated"))
    both = balance.withColumn("_one", F.lit(1)).join(repeated.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("complete", (F.col("expected") == F.col("actual")) & (F.col("unbalanced") == 0) & (F.col("repeated") == 0))


def scaffold_problems(existing: DataFrame, plan: DataFrame) -> DataFrame:
    """What keeps ``existing`` from being an untouched scaffold of ``plan``: ``sampleId, problem``, one row per id.

    Both are gathered by id once, as counts. Ids that are missing, not planned, recorded or planned twice, whose locked
    fields differ from the plan, or that somebody has filled are reported, in this order of precedence. A null id counts
    as an id; two empty tables have no problem.
    """
    touched = violations(existing, pristine_rules()).select("sampleId", "locked", (F.size("violations") > 0).alias("touched"), F.lit(0).alias("planned"))
    planned = plan.select("sampleId", "locked", F.lit(False).alias("touched"), F.lit(1).alias("planned"))
    ids = touched.unionByName(planned).groupBy("sampleId").agg(
        F.sum("planned").alias("planned"), F.sum(1 - F.col("planned")).alias("seen"), F.bool_or("touched").alias("touched"),
        F.min("locked").alias("_low"), F.max("locked").alias("_high"), F.count_distinct(F.isnull("locked")).alias("_kinds"),
    )
    problem = (
        F.when(F.col("planned") == 0, "unexpected")
        .when(F.col("seen") == 0, "missing")
        .when((F.col("seen") > 1) | (F.col("planned") > 1), "duplicate")
        .when((F.col("_low") != F.col("_high")) | (F.col("_kinds") > 1), "locked fields differ")
        .when(F.col("touched"), "not pristine")
    )
    return ids.select("sampleId", problem.alias("problem")).where(F.col("problem").isNotNull())


def locked_mismatches(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items whose locked metadata differ from the manifest, or that it does not know."""
    planned = manifest.select("sampleId", F.col("locked").alias("_planned"))
    return items.join(planned, "sampleId", "left").where(~F.col("locked").eqNullSafe(F.col("_planned"))).drop("_planned")


def coverage(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """Ids with a verdict: missing, duplicate or unexpected (ids in order are left out)."""
    planned = manifest.select("sampleId").distinct().withColumn("_planned", F.lit(True))
    seen = items.groupBy("sampleId").agg(F.count(F.lit(1)).alias("seen"))
    verdict = (
        F.when(F.col("_planned").isNull(), "unexpected")
        .when(F.col("seen").isNull(), "missing")
        .when(F.col("seen") > 1, "duplicate")
    )
    return planned.join(seen, "sampleId", "full").select("sampleId", verdict.alias("verdict")).where(F.col("verdict").isNotNull())


def in_manifest_order(manifest: DataFrame, items: DataFrame, order: str = "ord") -> DataFrame:
    """Items in the order of the manifest. An id that is missing, recorded twice or not planned stops the job."""
    copies = items.groupBy("sampleId").agg(F.count(F.lit(1)).alias("_copies"))
    planned = manifest.select("sampleId", order).withColumn("_planned", F.lit(True)).join(copies, "sampleId", "full")
    problem = (
        F.when(F.col("_planned").isNull(), "unexpected").when(F.col("_copies").isNull(), "missing").when(F.col("_copies") > 1, "duplicate")
    )
    stop = F.raise_error(F.concat(problem, F.lit(" item "), F.coalesce("sampleId", F.lit("null")))).cast("boolean")
    checked = planned.where(F.when(problem.isNull(), True).otherwise(stop)).select("sampleId", order)
    return checked.join(items, "sampleId").select(*items.columns, order).orderBy(order)


def is_filled() -> Column:
    """Whether an author has entered anything, whatever the status says."""
    fill = F.col("fill")
    return (
        (F.size(fill["secondaryPhenomena"]) > 0)
        | (F.size(fill["relevantContextIndices"]) > 0)
        | (F.size(fill["commonFailureModes"]) > 0)
        | F.exists(fill["contextTurns"], lambda t: ~is_blank(t["sourceText"]))
        | ~is_blank(fill["currentSource"]["sourceText"])
        | ~is_blank(fill["intendedInterpretation"])
        | ~is_blank(fill["validationNotes"])
    )


RUNTIME_FIELDS = ("contextTurnCount", "speakerMode", "contextExpectation", "primaryPhenomenon")


def runtime_items(authored: DataFrame) -> DataFrame:
    return authored.select(
        "sampleId",
        *[F.col(f"locked.{name}").alias(name) for name in RUNTIME_FIELDS],
        *[F.col(f"fill.{name}").alias(name) for name in ("secondaryPhenomena", "contextTurns", "currentSource")],
    )


def internal_items(authored: DataFrame) -> DataFrame:
    extra = ("relevantContextIndices", "intendedInterpretation", "commonFailureModes", "validationNotes")
    return authored.select(
        "sampleId",
        *[F.col(f"locked.{name}").alias(name) for name in RUNTIME_FIELDS],
        *[F.col(f"fill.{name}").alias(name) for name in ("secondaryPhenomena", "contextTurns", "currentSource", *extra)],
    )


def freeze_gate(authored: DataFrame) -> DataFrame:
    """One row: items, those not approved, and whether the set may be frozen."""
    return authored.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") != "approved").alias("not_approved")
    ).withColumn("may_freeze", F.col("not_approved") == 0)


def artifact_columns(items: DataFrame) -> DataFrame:
    """Context columns that travel with every output of an item."""
    return items.select(
        F.col("sampleId").alias("source_id"),
        F.lit("context").alias("dataset_kind"),
        F.col("contextTurnCount").alias("context_turn_count"),
        F.col("speakerMode").alias("speaker_mode"),
        F.col("contextExpectation").alias("context_expectation"),
        F.col("primaryPhenomenon").alias("primary_phenomenon"),
        F.col("secondaryPhenomena").alias("secondary_phenomena"),
    )


def describe(cases: DataFrame) -> DataFrame:
    """Uniform view of context items and plain sentences (``id, source, sourceLang``)."""
    is_context = F.col("sampleId").isNotNull()
    current = F.col("currentSource")
    return cases.select(
        F.when(is_context, F.col("sampleId")).otherwise(F.col("id").cast("string")).alias("source_id"),
        F.when(is_context, current["sourceText"]).otherwise(F.col("source")).alias("source_preview"),
        F.when(is_context, F.lit("Korean")).otherwise(F.col("sourceLang")).alias("source_lang"),
        F.when(is_context, model_input(F.col("contextTurns"), current)).otherwise(F.col("source")).alias("translation_input"),
        is_context.alias("is_context"),
    )
