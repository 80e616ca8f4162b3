"""Expected cells: dimensions given in code, spread over rows without a cross join."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.functions.keys import stable_key


class Participant(NamedTuple):
    participant_id: str
    display_name: str


def participants(entries: Sequence[str | Participant | Mapping[str, str]]) -> list[Participant]:
    """Plain ids (named by themselves), pairs or mappings to an ordered participant list."""
    result = []
    for entry in entries:
        if isinstance(entry, str):
            result.append(Participant(entry, entry))
        elif isinstance(entry, Mapping):
            result.append(Participant(entry["participantId"], entry["displayName"]))
        else:
            result.append(Participant(*entry))
    return result


def participant_array(people: Sequence[Participant]) -> Column:
    """The dimension as one constant, however many participants there are."""
    rows = [{"participant_id": p.participant_id, "participant_display_name": p.display_name, "ord": ord_} for ord_, p in enumerate(people)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<participant_id:string,participant_display_name:string,ord:int>>")


def participant_table(spark: SparkSession, people: Sequence[Participant]) -> DataFrame:
    return spark.range(1).select(F.inline(participant_array(people)))


def with_participants(keys: DataFrame, people: Sequence[Participant]) -> DataFrame:
    """Every key row once per participant, in the given participant order (``ord``)."""
    return keys.select("*", F.inline(participant_array(people)))


def language_table(spark: SparkSession, languages: Sequence[str], column: str = "target_language") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(code) for code in languages])).alias(column))


def first_items(items: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` items in ``order``: a top-k, not a global sort."""
    return items.orderBy(order).limit(limit)


def cell_grid(items: DataFrame, languages: Sequence[str], people: Sequence[Participant], run: str) -> DataFrame:
    """All expected cells of the items (column ``source_id``) with their stable keys.

    The grid is as large as the result itself; each item row expands where it lies.
    """
    by_language = items.select("*", F.explode(F.array(*[F.lit(code) for code in languages])).alias("target_language"))
    return with_participants(by_language, people).withColumn(
        "stable_key", stable_key(F.lit(run), "source_id", "target_language", "participant_id")
    )


def authoring_grid(spark: SparkSession) -> DataFrame:
    """The fixed item plan: every structural bucket with its items per phenomenon."""
    from gridscore import domain

    def numbers(values: Sequence[int]) -> Column:
        return F.explode(F.array(*[F.lit(value) for value in values]))

    def names(values: Sequence[str]) -> Column:
        return F.explode(F.array(*[F.lit(value) for value in values]))

    plans = F.array(
        *[
            F.struct(F.lit(expectation).alias("contextExpectation"), F.lit(name).alias("primaryPhenomenon"),
                     F.lit(domain.ITEMS_PER_BUCKET[expectation]).alias("expected"), F.lit(number).alias("plan_no"))
            for number, (expectation, name) in enumerate(
                [("use", n) for n in domain.USE_PHENOMENA] + [("ignore", n) for n in domain.IGNORE_PHENOMENA]
            )
        ]
    )
    buckets = (
        spark.range(1)
        .select(numbers(domain.TURN_COUNTS).alias("contextTurnCount"))
        .select("*", names(domain.SPEAKER_MODES).alias("speakerMode"))
        .select("*", F.inline(plans))
    )
    grid = buckets.select("*", F.explode(F.sequence(F.lit(1), F.col("expected"))).alias("sequence"))
    sample_id = F.concat_ws(
        "-",
        F.concat(F.lit("ctx"), F.col("contextTurnCount").cast("string")),
        "speakerMode",
        "contextExpectation",
        "primaryPhenomenon",
        F.lpad(F.col("sequence").cast("string"), 3, "0"),
    )
    return grid.withColumn("sampleId", sample_id)
