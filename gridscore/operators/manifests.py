"""Run manifests and participant registries as tables: one row per run, participants nested."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore import domain

PARTICIPANT = (
    "struct<participantId:string,displayName:string,provider:string,providerModelId:string,messageLayout:string,"
    "promptFile:string,promptFingerprintSha256:string,llamaCppServerUrl:string,llamaCppMode:string>"
)
MANIFEST = (
    "manifestVersion int, runId string, benchmarkId string, datasetVersion string, datasetKind string, "
    "datasetFingerprintSha256 string, promptVersion string, promptFingerprintSha256 string, judgePromptVersion string, "
    "judgePromptSetId string, judgeBackend string, judgeModelId string, targetLanguages array<string>, "
    f"targetLanguageLabels map<string,string>, limitApplied bigint, participants array<{PARTICIPANT}>, "
    "translationConcurrencyPerModel bigint, resume boolean, forkFromRunId string, rejudgeFromRunId string, "
    "reusedTranslations boolean, forkPromptMismatchAllowed boolean"
)
_HEX = "^[a-fA-F0-9]{64}\\z"


def _empty(column: Column) -> Column:
    return F.coalesce(column == "", F.lit(True))


def _absent_or(column: Column, values: Sequence[str]) -> Column:
    return column.isNull() | column.isin(*values)


def participant_rules(person: Column) -> dict[str, Column]:
    """Broken-rule conditions of one participant snapshot."""
    fingerprint = person["promptFingerprintSha256"]
    return {
        "participantId": _empty(person["participantId"]),
        "displayName": _empty(person["displayName"]),
        "provider": _empty(person["provider"]),
        "providerModelId": _empty(person["providerModelId"]),
        "messageLayout": ~_absent_or(person["messageLayout"], domain.MESSAGE_LAYOUTS),
        "llamaCppMode": ~_absent_or(person["llamaCppMode"], domain.LLAMACPP_MODES),
        "llamaCppServerUrl": F.coalesce((person["provider"] == "llamacpp") & person["llamaCppServerUrl"].isNull(), F.lit(False)),
        "prompt file and fingerprint": person["promptFile"].isNull() != fingerprint.isNull(),
        "promptFingerprintSha256": fingerprint.isNotNull() & ~fingerprint.rlike(_HEX),
    }


def _broken(rules: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules.items()]))


def manifest_rules() -> dict[str, Column]:
    text = ("runId", "benchmarkId", "datasetVersion", "promptVersion", "judgePromptVersion")
    rules = {"manifestVersion": ~F.coalesce(F.col("manifestVersion") == domain.MANIFEST_VERSION, F.lit(False))}
    rules |= {name: _empty(F.col(name)) for name in text}
    rules |= {name: ~F.coalesce(F.col(name).rlike(_HEX), F.lit(False)) for name in ("datasetFingerprintSha256", "promptFingerprintSha256")}
    rules |= {
        "datasetKind": ~_absent_or(F.col("datasetKind"), domain.DATASET_KINDS),
        "judgeBackend": ~_absent_or(F.col("judgeBackend"), domain.JUDGE_BACKENDS),
        "judgePromptSetId": F.col("judgePromptSetId").isNotNull() & (F.col("judgePromptSetId") == ""),
        "judgeModelId": F.col("judgeModelId").isNotNull() & (F.col("judgeModelId") == ""),
        "targetLanguages": F.col("targetLanguages").isNull() | F.exists("targetLanguages", _empty),
        "targetLanguageLabels": F.col("targetLanguageLabels").isNull() | F.exists(F.map_values("targetLanguageLabels"), _empty),
        "limitApplied": ~F.coalesce(F.col("limitApplied") >= 0, F.lit(False)),
        "translationConcurrencyPerModel": ~F.coalesce(F.col("translationConcurrencyPerModel") >= 1, F.lit(False)),
        "resume": F.col("resume").isNull(),
        "participants": F.col("participants").isNull(),
    }
    return rules


def checked_manifests(runs: DataFrame) -> DataFrame:
    """Runs with defaults filled in and the names of broken rules (``violations``)."""
    own = _broken(manifest_rules())
    nested = F.flatten(F.transform("participants", lambda p, i: F.transform(_broken(participant_rules(p)), lambda name: F.concat(F.lit("participants["), i.cast("string"), F.lit("]."), name))))
    checked = runs.withColumn("violations", F.concat(own, F.coalesce(nested, F.array().cast("array<string>"))))
    return checked.withColumns(
        {
            "judgePromptSetId": F.coalesce("judgePromptSetId", "judgePromptVersion"),
            "datasetKind": F.coalesce("datasetKind", F.lit("sentence")),
            "judgeBackend": F.coalesce("judgeBackend", F.lit("vertex")),
            "datasetFingerprintSha256": F.lower("datasetFingerprintSha256"),
            "promptFingerprintSha256": F.lower("promptFingerprintSha256"),
        }
    )


_STATUS_NUMBERS = ("totalExpected", "totalNormalized", "translationFailureHistoricalCount", "translationFailureUnresolvedCount")
_STATUS_TYPE = (
    "struct<benchmarkValid:boolean,reuseOnly:boolean,benchmarkValidityNote:string," + ",".join(f"{name}:double" for name in _STATUS_NUMBERS)
    + ",missingDeepLKeys:array<string>,judgeFailureRatesByParticipantLanguage:map<string,struct<ok:double,failed:double>>>"
)


def public_status(value: Column) -> Column:
    """What of a run status (a JSON object as text) may be published, as a struct; a text that is no object is an error.

    Validity holds only if it is literally true, and so does reuse, which is null if absent. Texts and numbers of another type
    are null. Per participant and language, entries that are no objects go. Missing keys lose empty and untyped ones.
    """
    document = F.try_parse_json(value)
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")

    def number(v: Column, name: str) -> Column:
        return F.when(kind(field(v, name)).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, f"$.{name}", "double"))

    def true(name: str) -> Column:
        return F.coalesce((kind(field(document, name)) == "BOOLEAN") & F.try_variant_get(document, f"$.{name}", "boolean"), F.lit(False))

    note = F.when(kind(field(document, "benchmarkValidityNote")) == "STRING", F.try_variant_get(document, "$.benchmarkValidityNote", "string"))
    strings = F.transform(F.try_variant_get(document, "$.missingDeepLKeys", "array<variant>"), lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")))
    groups = F.map_filter(F.try_variant_get(document, "$.judgeFailureRatesByParticipantLanguage", "map<string,variant>"), lambda _, v: F.coalesce(kind(v) == "OBJECT", F.lit(False)))
    counts = F.transform_values(groups, lambda _, v: F.struct(number(v, "ok").alias("ok"), number(v, "failed").alias("failed")))
    fields = F.struct(
        true("benchmarkValid").alias("benchmarkValid"),
        F.when(field(document, "reuseOnly").isNotNull(), true("reuseOnly")).alias("reuseOnly"),
        note.alias("benchmarkValidityNote"),
        *[number(document, name).alias(name) for name in _STATUS_NUMBERS],
        F.filter(strings, lambda text: ~_empty(text)).alias("missingDeepLKeys"),
        counts.alias("judgeFailureRatesByParticipantLanguage"),
    )
    return F.when(F.coalesce(kind(document) == "OBJECT", F.lit(False)), fields).otherwise(F.raise_error(F.lit("a run status must be an object")).cast(_STATUS_TYPE))


def public_manifests(runs: DataFrame, fallback_run_id: str | None = None) -> DataFrame:
    """Whitelisted manifest columns with defaults; participants without id are dropped. A run without an id takes the value of
    the column ``fallback_run_id``, such as the name of its folder."""
    if fallback_run_id is not None:
        runs = runs.withColumn("runId", F.coalesce("runId", fallback_run_id))
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    kept = F.filter("participants", lambda p: ~_empty(p["participantId"]))
    people = F.transform(
        kept,
        lambda p: F.struct(
            p["participantId"].alias("participantId"),
            F.coalesce(p["displayName"], p["participantId"]).alias("displayName"),
            F.coalesce(p["provider"], F.lit("")).alias("provider"),
            F.coalesce(p["providerModelId"], F.lit("")).alias("providerModelId"),
        ),
    )
    languages = F.filter(F.coalesce("targetLanguages", F.array().cast("array<string>")), lambda code: ~_empty(code))
    return runs.select(
        *[text(name) for name in ("runId", "benchmarkId", "datasetVersion", "datasetFingerprintSha256", "promptVersion", "judgeBackend")],
        *["datasetKind", "promptFingerprintSha256", "judgePromptVersion", "judgePromptSetId", "judgeModelId"],
        languages.alias("targetLanguages"),
        "targetLanguageLabels",
        "limitApplied",
        F.coalesce(people, F.array().cast("array<struct<participantId:string,displayName:string,provider:string,providerModelId:string>>")).alias("participants"),
    )


def _differs(name: str) -> Column:
    return ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))


_SHARED = ("benchmarkId", "datasetVersion", "datasetKind", "datasetFingerprintSha256", "judgePromptSetId", "targetLanguages")
_PROMPT = ("promptVersion", "promptFingerprintSha256")


def _entries(name: str, side: str) -> Column:
    return F.array_sort(F.map_entries(F.col(f"{side}.{name}")))


def _labels_differ() -> Column:
    return ~_entries("targetLanguageLabels", "a").eqNullSafe(_entries("targetLanguageLabels", "b"))


def compatibility(candidates: DataFrame, mode: str, prompt_mismatch_allowed: bool = False) -> DataFrame:
    """Mismatching fields per candidate pair of runs (structs ``a`` existing, ``b`` requested).

    ``mode`` is ``fork``, ``rejudge`` or ``resume``. A fork needs identical snapshots of the
    participants both runs share; a resume may ask for a subset of them and may leave the
    judge model open on either side.
    """
    checks = {name: _differs(name) for name in _SHARED} | {"targetLanguageLabels": _labels_differ()}
    ids = lambda side: F.transform(F.col(f"{side}.participants"), lambda p: p["participantId"])
    known = F.filter("b.participants", lambda p: F.array_contains(ids("a"), p["participantId"]))
    changed = F.size(F.array_except(known, F.col("a.participants"))) > 0
    if mode == "fork":
        checks["judgePromptVersion"] = _differs("judgePromptVersion")
        checks |= {name: _differs(name) for name in _PROMPT}
        checks["participants"] = changed
        if prompt_mismatch_allowed:
            for name in ("benchmarkId", *_PROMPT):
                del checks[name]
    elif mode == "resume":
        rejudged = F.coalesce(F.col("a.reusedTranslations"), F.lit(False)) | F.col("a.rejudgeFromRunId").isNotNull()
        judge = F.col("a.judgeModelId").isNotNull() & F.col("b.judgeModelId").isNotNull()
        checks |= {name: _differs(name) for name in ("judgePromptVersion", "judgeBackend", "limitApplied", "forkFromRunId")}
        checks["judgeModelId"] = judge & (F.col("a.judgeModelId") != F.col("b.judgeModelId"))
        checks["participants"] = F.size(F.array_except(F.col("b.participants"), F.col("a.participants"))) > 0
        reused = lambda side: F.coalesce(F.col(f"{side}.reusedTranslations"), F.lit(False))
        strict = {name: _differs(name) for name in (*_PROMPT, "rejudgeFromRunId")} | {"reusedTranslations": reused("a") != reused("b")}
        checks |= {name: ~rejudged & condition for name, condition in strict.items()}
    elif mode != "rejudge":
        raise ValueError(f"unknown mode {mode}")
    return candidates.withColumn("mismatches", _broken(checks))


def checked_registry(entries: DataFrame) -> DataFrame:
    """Registry rows with broken rules; ids that occur twice break ``unique id``."""
    person = F.struct(*[
        (F.col(name) if name in entries.columns else F.lit(None).cast("string")).alias(name)
        for name in ("participantId", "displayName", "provider", "providerModelId", "messageLayout", "promptFile", "promptFingerprintSha256", "llamaCppServerUrl", "llamaCppMode")
    ])
    rules = participant_rules(person)
    del rules["prompt file and fingerprint"], rules["promptFingerprintSha256"]
    rules["provider"] = ~F.coalesce(F.col("provider").isin(*domain.REGISTRY_PROVIDERS), F.lit(False))
    copies = entries.groupBy("participantId").agg(F.count(F.lit(1)).alias("_copies"))
    counted = entries.join(copies, "participantId", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    return counted.withColumn("violations", _broken({**rules, "unique id": F.col("_copies") > 1})).drop("_copies")


def selected(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registry entries in request order (``participantId, ord``); an unknown id is a violation."""
    known = registry.withColumn("_known", F.lit(True))
    joined = wanted.join(known, "participantId", "left")
    return joined.withColumn("unknown", F.col("_known").isNull()).drop("_known").orderBy("ord")
