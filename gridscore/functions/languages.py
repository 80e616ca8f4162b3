"""Language names as services and prompts spell them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.text import trimmed
from gridscore.session import small_table, strings


def service_language_table(spark: SparkSession) -> DataFrame:
    rows = [
        (service, role, name, code)
        for (service, role), codes in domain.SERVICE_LANGUAGES.items()
        for code, names in codes.items()
        for name in names
    ]
    return small_table(spark, strings("service", "role", "name", "code"), rows)


def with_service_codes(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``code`` for (``service``, ``role``, ``language``). Names are compared trimmed and in
    lower case. An unknown name is null for an optional source language, else an error."""
    named = rows.withColumn("name", F.lower(trimmed(F.col("language"))))
    looked_up = named.join(service_language_table(rows.sparkSession), ["service", "role", "name"], "left").drop("name")
    optional = F.col("service").isin(*domain.SERVICES_WITH_OPTIONAL_SOURCE) & (F.col("role") == "source")
    if not strict:
        return looked_up.withColumn("unsupported", F.col("code").isNull() & ~optional)
    message = F.concat_ws(" ", F.col("service"), F.lit("does not support"), F.col("role"), F.lit("language"), F.col("language"))
    failed = F.raise_error(message).cast("string")
    return looked_up.withColumn("code", F.when(F.col("code").isNull() & ~optional, failed).otherwise(F.col("code")))


def completion_language(label: Column) -> Column:
    result = label
    for name, spelled in domain.COMPLETION_LANGUAGE_NAMES.items():
        result = F.when(label == name, spelled).otherwise(result)
    return result


def rule_key(language: Column) -> Column:
    """Key of the writing rules for a target language; every kind of Chinese shares one."""
    name = F.lower(trimmed(language))
    return F.when(name.startswith("chinese"), "chinese").when(name.isin("japanese", "english", "korean"), name)


def example_slug(language: Column) -> Column:
    name = F.lower(trimmed(language))
    return F.when(name.isin("korean", "english", "japanese"), name).when(
        name.isin("chinese simplified", "zh-hans"), "chinese-simplified"
    )


def with_prompt_parts(rows: DataFrame, rules: DataFrame, examples: DataFrame, fallback: str) -> DataFrame:
    """Add ``rules`` and ``examples`` for (``source_name``, ``target_name``).

    ``rules`` has ``rule_key, rules``; ``examples`` has ``pair, examples``. Without a pair, only
    English targets get the fallback; all else is empty.
    """
    pair = F.concat(example_slug(F.col("source_name")), F.lit("-to-"), example_slug(F.col("target_name")))
    keyed = rows.withColumn("rule_key", rule_key(F.col("target_name"))).withColumn("pair", pair)
    joined = keyed.join(rules, "rule_key", "left").join(examples, "pair", "left")
    to_english = example_slug(F.col("target_name")) == "english"
    return (
        joined.withColumn("rules", F.coalesce("rules", F.lit("")))
        .withColumn("examples", F.coalesce(F.col("examples"), F.when(to_english, F.lit(fallback)), F.lit("")))
        .drop("rule_key", "pair")
    )
