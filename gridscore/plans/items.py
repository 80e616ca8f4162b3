"""Queries over item tables and the texts rendered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions import languages, rendering
from gridscore.functions.keys import bucket_key, structural_bucket
from gridscore.operators import items as rules
from gridscore.operators.grid import authoring_grid
from gridscore.operators.windows import previous_rows, row_numbers
from gridscore.plans.registry import query
from gridscore.session import small_table, strings


@query("w8_context_window", """
SELECT conv_id, turn, coalesce(len(prior_texts), 0) AS n, coalesce(array_to_string(prior_texts, '|'), '') AS prior FROM item_base
""")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.turns(spark, sf_dir).select("conv_id", "turn", "source_text")
    windowed = previous_rows(rows, ["conv_id"], "turn", "source_text", 3, "prior")
    return windowed.select("conv_id", "turn", F.size("prior").cast("bigint").alias("n"), F.array_join("prior", "|").alias("prior"))


_RULES_SQL = """concat_ws(', ',
  CASE WHEN len([x for x in prior_texts if x = '']) > 0 OR cur_text = '' THEN 'turn malformed' END,
  CASE WHEN cur_role <> 'self' THEN 'current turn is not self' END,
  CASE WHEN cur_label IS NOT NULL THEN 'current turn has a label' END,
  CASE WHEN mode = 'single' AND len(list_distinct(list_append(prior_roles, cur_role))) <> 1 THEN 'single mode with several roles' END,
  CASE WHEN mode = 'dyadic' AND len(list_distinct(list_append(prior_roles, cur_role))) <> 2 THEN 'dyadic mode without both roles' END{more})"""


@query("p12_item_rules", f"SELECT sample_id, {_RULES_SQL.format(more='')} AS violations FROM item_rows")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rules.violations(fixtures.items(spark, sf_dir), rules.runtime_rules())
    return checked.select(F.col("sampleId").alias("sample_id"), F.array_join("violations", ", ").alias("violations"))


_INDEX_SQL = """,
  CASE WHEN number % 4 >= n_turns THEN 'context index out of range' END"""


@query("p13_internal_rules", "SELECT sample_id, " + _RULES_SQL.format(more=_INDEX_SQL + """,
  CASE WHEN number % 19 = 0 THEN 'no failure mode' END""") + " AS violations FROM item_rows")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rules.violations(rules.internal_items(fixtures.authored_items(spark, sf_dir)), rules.internal_rules())
    return checked.select(F.col("sampleId").alias("sample_id"), F.array_join("violations", ", ").alias("violations"))


@query("p14_authored_rules", "SELECT sample_id, " + _RULES_SQL.format(more=_INDEX_SQL + """,
  CASE WHEN number % 13 = 0 THEN 'interpretation missing' END, CASE WHEN number % 19 = 0 THEN 'no failure mode' END""") + " AS violations FROM item_rows")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rules.violations(rules.internal_items(fixtures.authored_items(spark, sf_dir)), rules.authored_rules())
    return checked.select(F.col("sampleId").alias("sample_id"), F.array_join("violations", ", ").alias("violations"))


def scaffold(spark: SparkSession, sf_dir: str, filled: bool = True) -> DataFrame:
    """Authored items of which every third, or (``filled=False``) every one, is still an empty scaffold."""
    number = F.col("conv_id") + F.col("turn")
    blank_turn = F.struct(F.lit("self").alias("speakerRole"), F.lit(None).cast("string").alias("relativeTimeLabel"), F.lit("").alias("sourceText"))
    blank = F.struct(
        F.array().cast("array<string>").alias("secondaryPhenomena"),
        F.transform("fill.contextTurns", lambda t: blank_turn).alias("contextTurns"),
        blank_turn.alias("currentSource"),
        F.array().cast("array<int>").alias("relevantContextIndices"),
        F.lit("").alias("intendedInterpretation"),
        F.array().cast("array<string>").alias("commonFailureModes"),
        F.lit("").alias("validationNotes"),
    )
    empty = number % 3 == 0 if filled else F.lit(True)
    return fixtures.authored_items(spark, sf_dir).select(
        "sampleId", "locked", F.when(empty, "todo").otherwise(F.col("status")).alias("status"),
        F.when(empty, blank).otherwise(F.col("fill")).alias("fill"), "conv_id", "turn",
    )


@query("p15_pristine_scaffold", """
SELECT sample_id, number % 3 = 0 AS pristine FROM item_rows
""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rules.violations(scaffold(spark, sf_dir), rules.pristine_rules())
    return checked.select(F.col("sampleId").alias("sample_id"), (F.size("violations") == 0).alias("pristine"))


@query("p16_filled_items", "SELECT sample_id FROM item_rows WHERE number % 3 <> 0")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold(spark, sf_dir).where(rules.is_filled()).select(F.col("sampleId").alias("sample_id"))


@query("p17_duplicate_ids", """
SELECT concat(lang, '/', source) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source").alias("id"))
    return rules.duplicate_ids(documents, "id")


_GRID = """
plan AS (SELECT t.n, m.mode, e.expectation, e.phenomenon, e.expected FROM (VALUES (1),(2),(3)) t(n), (VALUES ('single'),('dyadic')) m(mode),
 (VALUES ('use','referent_resolution',4),('use','ellipsis_completion',4),('use','sense_disambiguation',4),('use','pragmatic_intent_resolution',4),
  ('use','register_carryover',4),('use','temporal_or_causal_linkage',4),('ignore','topic_shift_independence',3),('ignore','false_lead_trap',3),
  ('ignore','stale_context_resistance',3),('ignore','metadata_nonliteral_resistance',3)) e(expectation, phenomenon, expected)),
have AS (SELECT n_turns AS n, mode, expectation, phenomenon, count(*) AS actual FROM item_rows GROUP BY ALL)
"""


@query("j2_authoring_grid", f"""
WITH {_GRID}
SELECT concat('ctx', CAST(n AS VARCHAR), '-', mode, '-', expectation, '-', phenomenon, '-', lpad(CAST(s.k AS VARCHAR), 3, '0')) AS sample_id,
  coalesce(actual, 0) AS items_in_bucket
FROM plan LEFT JOIN have USING (n, mode, expectation, phenomenon) JOIN (VALUES (1),(2),(3),(4)) s(k) ON s.k <= expected
""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned items, each with the number of real items its bucket already has."""
    key = ["contextTurnCount", "speakerMode", "contextExpectation", "primaryPhenomenon"]
    have = fixtures.items(spark, sf_dir).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    grid = authoring_grid(spark).join(have, key, "left")
    return grid.select(F.col("sampleId").alias("sample_id"), F.coalesce("n", F.lit(0)).alias("items_in_bucket"))


@query("p18_bucket_balance", f"""
WITH {_GRID}
SELECT concat(CAST(n AS VARCHAR), '::', mode, '::', expectation, '::', phenomenon) AS bucket, CAST(expected AS BIGINT) AS expected,
  coalesce(actual, 0) AS actual, coalesce(actual, 0) = expected AS balanced FROM plan LEFT JOIN have USING (n, mode, expectation, phenomenon)
""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.bucket_balance(fixtures.items(spark, sf_dir))


@query("p18_scaffold_totals", f"""
WITH {_GRID},
b AS (SELECT CAST(sum(coalesce(expected, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(actual, 0)) AS BIGINT) AS actual,
  count(*) FILTER (coalesce(expected, 0) <> coalesce(actual, 0)) AS unbalanced FROM plan FULL JOIN have USING (n, mode, expectation, phenomenon)),
r AS (SELECT count(*) AS repeated FROM (SELECT sample_id FROM item_rows GROUP BY 1 HAVING count(*) > 1))
SELECT *, expected = actual AND unbalanced = 0 AND repeated = 0 AS complete FROM b, r
""")
def p18_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scaffold_totals(fixtures.items(spark, sf_dir))


@query("x28_bucket_keys", """
SELECT sample_id, concat(CAST(n_turns AS VARCHAR), '::', mode, '::', expectation, '::', phenomenon) AS bucket,
  concat('ctx', CAST(n_turns AS VARCHAR), '-', mode) AS structural FROM item_rows
""")
def x28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.items(spark, sf_dir).select(
        F.col("sampleId").alias("sample_id"),
        bucket_key("contextTurnCount", "speakerMode", "contextExpectation", "primaryPhenomenon").alias("bucket"),
        structural_bucket("contextTurnCount", "speakerMode").alias("structural"),
    )


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan the authored items must follow: some ids are not planned, some are locked otherwise."""
    number = F.col("conv_id") + F.col("turn")
    changed = F.col("locked").withField("speakerMode", F.lit("other"))
    return (
        fixtures.authored_items(spark, sf_dir)
        .where(number % 29 != 0)
        .select("sampleId", F.when(number % 23 == 0, changed).otherwise(F.col("locked")).alias("locked"),
                F.struct("conv_id", "turn").alias("ord"))
    )


@query("p19_locked_mismatch", "SELECT sample_id FROM item_rows WHERE number % 29 = 0 OR number % 23 = 0")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.locked_mismatches(fixtures.authored_items(spark, sf_dir), _manifest(spark, sf_dir))
    return found.select(F.col("sampleId").alias("sample_id"))


@query("p20_freeze_gate", """
SELECT count(*) AS items, count(*) FILTER (number % 17 = 0) AS not_approved, count(*) FILTER (number % 17 = 0) = 0 AS may_freeze FROM item_rows
""")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.freeze_gate(fixtures.authored_items(spark, sf_dir))


@query("j14_coverage", """
SELECT sample_id, CASE WHEN number % 29 = 0 THEN 'unexpected' WHEN number % 31 = 0 THEN 'missing' ELSE 'duplicate' END AS verdict
FROM item_rows WHERE (number % 29 = 0 AND number % 31 <> 0) OR (number % 29 <> 0 AND (number % 31 = 0 OR number % 37 = 0))
""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("conv_id") + F.col("turn")
    authored = fixtures.authored_items(spark, sf_dir).select("sampleId", number.alias("number"))
    batches = authored.where("number % 31 <> 0").unionByName(authored.where("number % 37 = 0 AND number % 31 <> 0"))
    return rules.coverage(_manifest(spark, sf_dir), batches).select(F.col("sampleId").alias("sample_id"), "verdict")


@query("j15_manifest_order", "SELECT sample_id, conv_id, turn FROM item_rows WHERE number % 29 <> 0")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir)
    planned = fixtures.authored_items(spark, sf_dir).select("sampleId", "status").join(manifest.select("sampleId"), "sampleId", "left_semi")
    return rules.in_manifest_order(manifest, planned).select(F.col("sampleId").alias("sample_id"), "ord.conv_id", "ord.turn")


@query("w4_batches", """
SELECT sample_id, concat('ctx', CAST(n_turns AS VARCHAR), '-', mode, '-batch-', CASE WHEN b < 10 THEN '0' ELSE '' END, CAST(b AS VARCHAR)) AS batch_id
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY n_turns, mode ORDER BY conv_id, turn) - 1) / 12) AS BIGINT) + 1 AS b FROM item_rows)
""")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(fixtures.items(spark, sf_dir), 12).select(F.col("sampleId").alias("sample_id"), "batch_id")


def batches(items: DataFrame, size: int) -> DataFrame:
    """Batch id per item: structural bucket plus a running number, ``size`` items each."""
    ordered = items.withColumn("bucket", structural_bucket("contextTurnCount", "speakerMode")).withColumn("ord", F.struct("conv_id", "turn"))
    numbered = row_numbers(ordered, ["bucket"], ["conv_id", "turn"], "rn")
    number = F.floor((F.col("rn") - 1) / size) + 1
    return numbered.withColumn("batch_id", F.format_string("%s-batch-%02d", F.col("bucket"), number))


@query("w4_request_chunks", """
SELECT participant_id, CAST(floor((rn - 1) / 2000) AS BIGINT) AS chunk, count(*) AS requests FROM (
  SELECT participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY seq) AS rn FROM attempts) GROUP BY 1, 2
""")
def w4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in chunks of 2,000 per participant."""
    numbered = row_numbers(fixtures.attempts(spark, sf_dir).select("participant_id", "seq"), ["participant_id"], "seq", "rn")
    chunk = F.floor((F.col("rn") - 1) / 2000)
    return numbered.groupBy("participant_id", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("requests"))


@query("p3_runtime_projection", """
SELECT sample_id, CAST(n_turns AS BIGINT) AS context_turn_count, mode AS speaker_mode, array_to_string(prior_roles, ',') AS roles, cur_text AS current_text FROM item_rows
""")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime = rules.runtime_items(fixtures.authored_items(spark, sf_dir))
    return runtime.select(
        F.col("sampleId").alias("sample_id"), F.col("contextTurnCount").cast("bigint").alias("context_turn_count"),
        F.col("speakerMode").alias("speaker_mode"), F.array_join("contextTurns.speakerRole", ",").alias("roles"),
        F.col("currentSource.sourceText").alias("current_text"),
    )


@query("p4_artifact_columns", """
SELECT sample_id AS source_id, 'context' AS dataset_kind, CAST(n_turns AS BIGINT) AS context_turn_count, mode AS speaker_mode,
  expectation AS context_expectation, phenomenon AS primary_phenomenon FROM item_rows
""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = rules.artifact_columns(fixtures.items(spark, sf_dir))
    return columns.drop("secondary_phenomena").withColumn("context_turn_count", F.col("context_turn_count").cast("bigint"))


_INPUT_SQL = """concat('<context>', chr(10), array_to_string([concat('[', x[1], CASE WHEN x[2] = '' THEN '' ELSE concat(', ', x[2]) END, '] ', x[3]) for x in list_zip(prior_roles, prior_labels, prior_texts)], chr(10)), chr(10), '</context>', chr(10), chr(10),
  '<input>', chr(10), cur_text, chr(10), '</input>')"""


@query("p5_describe_cases", f"""
SELECT sample_id AS source_id, cur_text AS source_preview, 'Korean' AS source_lang, {_INPUT_SQL} AS translation_input, true AS is_context FROM item_rows
UNION ALL SELECT CAST(doc_id AS VARCHAR), text, lang, text, false FROM documents
""")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = fixtures.items(spark, sf_dir).select("sampleId", "contextTurns", "currentSource")
    plain = fixtures.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("source"), F.col("lang").alias("sourceLang")
    )
    return rules.describe(context.unionByName(plain, allowMissingColumns=True))


@query("x7_model_input", f"""
SELECT sample_id, {_INPUT_SQL} AS model_input, array_to_string([concat(CAST(x[4] AS VARCHAR), '. [', x[1], CASE WHEN x[2] = '' THEN '' ELSE concat(', ', x[2]) END, '] ', x[3])
  for x in list_zip(prior_roles, prior_labels, prior_texts, range(1, n_turns + 1))], chr(10)) AS context_block FROM item_rows
""")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, current = F.col("contextTurns"), F.col("currentSource")
    variables = rendering.judge_variables(turns, current, F.lit("t"), F.lit("English"))
    return fixtures.items(spark, sf_dir).select(
        F.col("sampleId").alias("sample_id"),
        rendering.model_input(turns, current).alias("model_input"),
        variables["contextBlock"].alias("context_block"),
    )


@query("x8_read_model_input", """
WITH s AS (SELECT sample_id, number, cur_text, [l for l in string_split(array_to_string([concat('[', x[1], CASE WHEN x[2] = '' THEN '' ELSE concat(', ', x[2]) END, '] ', x[3]) for x in list_zip(prior_roles, prior_labels, prior_texts)], chr(10)), chr(10)) if trim(l) <> ''] AS lines FROM item_rows)
SELECT sample_id, CASE WHEN number % 5 = 0 THEN NULL ELSE cur_text END AS current_source,
  CASE WHEN number % 5 = 0 THEN NULL ELSE array_to_string([concat(CAST(x[1] AS VARCHAR), '. ', trim(x[2])) for x in list_zip(range(1, len(lines) + 1), lines)], chr(10)) END AS context_turns
FROM s
""")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged inputs, the older heading form, and every fifth one as plain text."""
    text = rendering.model_input(F.col("contextTurns"), F.col("currentSource"))
    number = F.col("conv_id") + F.col("turn")
    current = F.col("currentSource.sourceText")
    headed = F.concat(F.substring_index(text, "<input>\n", 1), F.lit("Current input:\n"), current)
    shown = F.when(number % 5 == 0, current).when(number % 5 == 1, headed).otherwise(text)
    rows = fixtures.items(spark, sf_dir).select(F.col("sampleId").alias("sample_id"), rendering.read_model_input(shown).alias("r"))
    return rows.select("sample_id", "r.current_source", "r.context_turns")


@query("x9_templates", """
SELECT sample_id, concat('Lang ', mode, ': ', cur_text, ' $ ${later} ', cur_text) AS prompt,
  concat('T:', chr(10), '```', replace(replace(replace(cur_text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)), '```', '``\\`'), '```', chr(10), '${mode}') AS judged
FROM item_rows
""")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values hold variable marks themselves and must not be filled again."""
    current = F.col("currentSource.sourceText")
    prompt = rendering.fill_prompt("Lang ${lang}: ${text} $ ${later} ${text}", {"lang": F.col("speakerMode"), "text": current})
    judged = rendering.fill_judge_template("T:\n```${text}```\n${mark}", {"text": current, "mark": F.lit("${mode}")})
    return fixtures.items(spark, sf_dir).select(F.col("sampleId").alias("sample_id"), prompt.alias("prompt"), judged.alias("judged"))


_EXAMPLES = [("user", "Example source"), ("model", "Critical:\nno-error")]
_SYSTEM = "You annotate."


@query("x24_messages", """
SELECT sample_id, to_json([{'role': 'system', 'content': 'You annotate.'}, {'role': 'user', 'content': 'Example source'},
  {'role': 'assistant', 'content': concat('Critical:', chr(10), 'no-error')}, {'role': 'user', 'content': concat('Judge: ', cur_text)}])::VARCHAR AS messages FROM item_rows
""")
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = rendering.message_list(_SYSTEM, _EXAMPLES, F.concat(F.lit("Judge: "), F.col("currentSource.sourceText")))
    return fixtures.items(spark, sf_dir).select(F.col("sampleId").alias("sample_id"), F.to_json(messages).alias("messages"))


@query("x14_custom_id", """
SELECT doc_id, concat('j2-', substring(sha256(to_json([{'role': 'user', 'content': text}])::VARCHAR), 1, 24), '-',
  substring(sha256(concat('key-', CAST(doc_id AS VARCHAR))), 1, 8)) AS custom_id FROM documents
""")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = rendering.message_list("", [], F.col("text"))
    key = F.concat(F.lit("key-"), F.col("doc_id").cast("string"))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", rendering.custom_id(messages, key).alias("custom_id"))


@query("x29_flat_prompt", f"""
SELECT sample_id, concat('System instructions:', chr(10), 'You annotate.', chr(10), chr(10), '{domain.FLAT_PROMPT_FORMAT}', chr(10), chr(10),
  'Examples:', chr(10), chr(10), 'User:', chr(10), 'Example source', chr(10), chr(10), 'Judge:', chr(10), 'Critical:', chr(10), 'no-error', chr(10), chr(10),
  'Task:', chr(10), cur_text) AS prompt FROM item_rows
""")
def x29(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = rendering.message_list(_SYSTEM, _EXAMPLES, F.col("currentSource.sourceText"))
    prompt = rendering.flat_prompt(messages, domain.FLAT_PROMPT_FORMAT)
    return fixtures.items(spark, sf_dir).select(F.col("sampleId").alias("sample_id"), prompt.alias("prompt"))


@query("x19_prompt_parts", """
SELECT doc_id, CASE WHEN n % 4 = 2 THEN 'zh rules' WHEN n % 4 = 3 THEN '' ELSE 'en rules' END AS rules,
  CASE WHEN n % 4 = 0 THEN 'ko-en' WHEN n % 4 = 1 THEN 'fallback' ELSE '' END AS examples
FROM (SELECT doc_id, doc_id AS n FROM documents)
""")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id") % 4
    rows = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(number == 1, "French").otherwise(" KOREAN ").alias("source_name"),
        F.when(number < 2, "english").when(number == 2, "Chinese Traditional").otherwise("Thai").alias("target_name"),
    )
    rule_table = small_table(spark, strings("rule_key", "rules"), [("english", "en rules"), ("chinese", "zh rules")])
    example_table = small_table(spark, strings("pair", "examples"), [("korean-to-english", "ko-en")])
    return languages.with_prompt_parts(rows, rule_table, example_table, "fallback").select("doc_id", "rules", "examples")


@query("x27_service_languages", """
SELECT seq, CASE seq % 6 WHEN 0 THEN 'KO' WHEN 1 THEN NULL WHEN 2 THEN 'ZH-HANS' WHEN 3 THEN 'zh-TW' WHEN 4 THEN 'zh-CN' ELSE NULL END AS code,
  seq % 6 = 5 AS unsupported FROM attempts
""")
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("seq") % 6
    rows = fixtures.attempts(spark, sf_dir).select(
        "seq",
        F.when(case <= 2, "deepl").when(case == 3, "papago").otherwise("google-web").alias("service"),
        F.when(case.isin(0, 1, 5), "source").otherwise("target").alias("role"),
        F.when(case == 0, " Korean ").when(case == 1, "Welsh").when(case.isin(2, 4), "Chinese Simplified").when(case == 3, "ZH-Hant").otherwise("Welsh").alias("language"),
    )
    return languages.with_service_codes(rows, strict=False).select("seq", "code", "unsupported")


@query("p6_context_blind_input", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS blind FROM cells
""")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscore.functions.keys import is_context_blind

    case = F.col("event_id") % 5
    name = (
        F.when(case == 0, F.concat("participant_id", F.lit("-nocontext"))).when(case == 1, F.concat("participant_id", F.lit("-nocontext-baseline")))
        .when(case == 2, "google-translate-web").when(case == 3, "google-translate-web-2").otherwise(F.col("participant_id"))
    )
    return fixtures.cells(spark, sf_dir).select("event_id", is_context_blind(name).alias("blind"))
