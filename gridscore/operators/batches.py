"""Judge requests sent as batches: matching results to cells, finding lost submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.functions.annotations import is_complete_annotation, parse_annotation
from gridscore.functions.text import is_blank
from gridscore.operators.costs import with_cost


USAGE = ("provider", "model", "input_tokens", "output_tokens", "reasoning_tokens")


def _verdicts(results: DataFrame) -> DataFrame:
    """Every result line with what is wrong with it; only a good line keeps its text and usage."""
    content = F.coalesce("content", F.lit(""))
    failed_status = (F.col("status_code") < 200) | (F.col("status_code") >= 300)
    unreadable = ~is_complete_annotation(content) | parse_annotation(content)["problem"].isNotNull()
    problem = (
        F.when(F.col("error").isNotNull() & F.col("has_response"), "both response and error")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(failed_status, F.concat(F.lit("response status "), F.col("status_code").cast("string")))
        .when(unreadable, "invalid annotation")
    )
    judged = results.where(F.col("custom_id").isNotNull()).withColumn("problem", problem)
    usage = [F.when(F.col("problem").isNull(), F.col(name)).alias(name) for name in USAGE if set(USAGE) <= set(results.columns)]
    return judged.select("custom_id", "problem", F.when(F.col("problem").isNull(), content).alias("raw_text"), *usage)


def outcomes(results: DataFrame) -> DataFrame:
    """One outcome per custom id out of raw result lines.

    Input: ``custom_id, error, status_code, content, has_response`` and, if known, the columns ``USAGE``. A line is judged
    where it lies. Ids alone are counted to find lines that repeat, so a line repeated many times never gathers in one
    task and no text is aggregated. Without rows the result is empty; lines without an id belong to no request.
    """
    lines = _verdicts(results)
    repeated = results.where(F.col("custom_id").isNotNull()).groupBy("custom_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("custom_id")
    marked = repeated.withColumn("problem", F.lit("duplicate result line"))
    return lines.join(repeated, "custom_id", "left_anti").unionByName(marked, allowMissingColumns=True)


def correlate(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome per requested cell (``stable_key, custom_id``); a cell without result is marked.

    With ``USAGE`` columns in the results every good line also has its tokens, ``cost_usd`` and ``cost_status``.
    """
    joined = requests.select("stable_key", "custom_id").join(outcomes(results).withColumn("_found", F.lit(True)), "custom_id", "left")
    usage = [name for name in USAGE if name in joined.columns]
    problem = F.when(F.col("_found").isNull(), "no result").otherwise(F.col("problem"))
    found = joined.select("stable_key", "custom_id", problem.isNull().alias("ok"), problem.alias("problem"), "raw_text", *usage)
    return with_cost(found) if usage else found


def with_custom_ids(requests: DataFrame, derived: Column, id_map: DataFrame | None = None, jobs_recorded: bool = False) -> DataFrame:
    """The custom id of every requested key (``stable_key, custom_id``), one row per key.

    A stored map (``stable_key, custom_id``) wins over ``derived``, so that lines of jobs already sent keep their ids. The
    job stops if the map does not cover a requested key, gives a key two ids or an id to two keys, or has a blank entry
    for a key; without a map, if a key has two derived ids. Recorded jobs without a map are refused at once.
    """
    if id_map is None and jobs_recorded:
        raise ValueError("jobs are recorded but the map of custom ids is missing; sending again could submit lines twice")

    def stop(message: str, key: Column) -> Column:
        return F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(key, F.lit("null")))).cast("string")

    if id_map is None:
        ids = requests.select("stable_key", derived.alias("custom_id")).groupBy("stable_key").agg(F.min("custom_id").alias("_low"), F.max("custom_id").alias("_high"))
        return ids.select("stable_key", F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(stop("two ids for a key", F.col("stable_key"))).alias("custom_id"))
    shared = id_map.groupBy("custom_id").agg(F.count_distinct("stable_key").alias("_keys")).where("_keys > 1")
    stored = id_map.select("stable_key", "custom_id").join(shared, "custom_id", "left").groupBy("stable_key").agg(
        F.min("custom_id").alias("_low"), F.max("custom_id").alias("_high"), F.max("_keys").alias("_keys"), F.count(F.lit(1)).alias("_entries"), F.count("custom_id").alias("_ids")
    )
    keys = requests.select("stable_key").distinct()
    key = F.col("stable_key")
    checked = (
        F.when(F.col("_entries").isNull(), stop("the map does not cover a key", key))
        .when((F.col("_ids") < F.col("_entries")) | is_blank(F.col("_low")), stop("blank id for a key", key))
        .when(F.col("_low") != F.col("_high"), stop("two ids for a key", key))
        .when(F.col("_keys").isNotNull(), stop("an id is shared by keys", key))
        .otherwise(F.col("_low"))
    )
    return keys.join(stored, "stable_key", "left").select("stable_key", checked.alias("custom_id"))


def id_map_problems(id_map: DataFrame) -> DataFrame:
    """Why a stored id map cannot be trusted: blank entries, shared ids, keys with two ids."""
    blank = (F.trim(F.coalesce("custom_id", F.lit(""))) == "") | (F.trim(F.coalesce("stable_key", F.lit(""))) == "")
    blanks = id_map.where(blank).select(F.lit("blank entry").alias("problem"), F.coalesce("custom_id", F.lit("")).alias("id"))
    shared = id_map.groupBy("custom_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("shared id").alias("problem"), F.col("custom_id").alias("id"))
    split = id_map.groupBy("stable_key").agg(F.min("custom_id").alias("a"), F.max("custom_id").alias("b")).where("a <> b")
    return blanks.unionByName(shared).unionByName(split.select(F.lit("two ids for a key").alias("problem"), F.col("stable_key").alias("id")))


def orphaned_attempts(attempts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Submission attempts with an id that neither a rejected attempt nor a recorded job covers.

    Input: ``attempt_id, rejected, custom_ids`` and ``custom_id``.
    """
    ids = attempts.select("attempt_id", "rejected", F.explode("custom_ids").alias("custom_id"))
    covered = ids.where("rejected").select("custom_id").unionByName(recorded.select("custom_id")).distinct()
    open_ids = ids.where("NOT rejected").join(covered, "custom_id", "left_anti")
    return open_ids.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("uncovered_ids"))
