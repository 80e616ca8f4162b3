"""The derived tables of ``gridscore.fixtures`` as plain SQL, for checking against another engine."""

VIEWS: dict[str, str] = {}

VIEWS["cells"] = """
SELECT event_id, ts, 'run-1' AS run_id,
  printf('s%06d', src) AS source_id,
  CASE lang_no WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE 'zh-Hans' END AS target_language,
  concat('p', CAST(event_id % 8 AS VARCHAR)) AS participant_id,
  CASE WHEN event_type = 'error' THEN 'judge_failed' ELSE 'ok' END AS status,
  CASE WHEN v % 23 = 0 THEN 1 ELSE 0 END AS critical_count,
  CAST(v % 3 AS INT) AS major_count, CAST(v % 4 AS INT) AS minor_count,
  CAST(src % 3 + 1 AS INT) AS context_turn_count,
  CASE WHEN src % 2 = 0 THEN 'single' ELSE 'dyadic' END AS speaker_mode,
  CASE WHEN src % 10 < 6 THEN 'use' ELSE 'ignore' END AS context_expectation,
  CAST(src % 10 AS INT) AS phenomenon_no,
  CASE WHEN event_type = 'error' THEN NULL WHEN v % 5 = 0 THEN 'used_correctly'
       WHEN v % 5 = 1 THEN 'missed_required_context' WHEN v % 5 = 2 THEN 'ignored_irrelevant_context'
       WHEN v % 5 = 3 THEN 'misused_context' ELSE 'unclear' END AS context_behavior
FROM (SELECT event_id, ts, event_type, CAST(floor(event_id / 24) AS BIGINT) AS src,
             CAST(floor(event_id / 8) AS BIGINT) % 3 AS lang_no, CAST(round(value * 100) AS BIGINT) AS v
      FROM events) e
"""

VIEWS["judgments"] = """
SELECT *,
  list_extract(['referent_resolution','ellipsis_completion','sense_disambiguation','pragmatic_intent_resolution',
    'register_carryover','temporal_or_causal_linkage','topic_shift_independence','false_lead_trap',
    'stale_context_resistance','metadata_nonliteral_resistance'], phenomenon_no + 1) AS primary_phenomenon,
  concat(run_id, '::', source_id, '::', target_language, '::', participant_id) AS stable_key,
  CASE WHEN status = 'ok' THEN CAST(25 * critical_count + 5 * major_count + minor_count AS BIGINT) END AS total_penalty,
  CASE WHEN status = 'ok' THEN concat(
    'Critical:', chr(10), CASE WHEN critical_count = 0 THEN concat('no-error', chr(10)) ELSE repeat(concat('accuracy/mistranslation - "x"', chr(10)), critical_count) END,
    'Major:', chr(10), CASE WHEN major_count = 0 THEN concat('no-error', chr(10)) ELSE repeat(concat('fluency-register - "y"', chr(10)), major_count) END,
    'Minor:', chr(10), CASE WHEN minor_count = 0 THEN concat('no-error', chr(10)) ELSE repeat(concat('style/awkward - "z"', chr(10)), minor_count) END,
    'contextBehavior: ', context_behavior)
  ELSE concat('Critical:', chr(10), 'unparseable line') END AS raw_judge_output
FROM cells
"""

VIEWS["people"] = """
SELECT participant_id, participant_display_name, ord FROM (VALUES
  ('p5','System 5',0),('p0','System 0',1),('p1','System 1',2),('p2','System 2',3),('p3','System 3',4),
  ('p4','System 4',5),('p6','System 6',6),('p7','System 7',7)) v(participant_id, participant_display_name, ord)
"""

VIEWS["more_people"] = """
SELECT participant_id, participant_display_name, ord FROM people
UNION ALL SELECT 'p-none', 'No rows', 8
"""

VIEWS["langs"] = "SELECT target_language FROM (VALUES ('en'),('ja'),('zh-Hans')) v(target_language)"

VIEWS["attempts"] = """
SELECT event_id AS seq, ts,
  concat('k', CAST(user_id AS VARCHAR)) AS item_key, concat('b', CAST(user_id % 4 AS VARCHAR)) AS bucket_key,
  concat('p', CAST(user_id % 8 AS VARCHAR)) AS participant_id,
  CASE WHEN event_id % 2 = 0 THEN 'translation' ELSE 'judge' END AS phase,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'retry' WHEN 'click' THEN 'recovered' ELSE 'success' END AS outcome,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'rate_limit' WHEN event_id % 3 = 1 THEN 'invalid_response' ELSE 'auth' END
                  WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'server_overload' ELSE 'timeout' END END AS error_class,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS latency_ms
FROM events
"""

VIEWS["usage_metrics"] = """
SELECT event_id AS seq, concat('k', CAST(event_id AS VARCHAR)) AS stable_key,
  CASE event_id % 4 WHEN 0 THEN 'deepseek' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'gemini' ELSE 'local' END AS provider,
  CASE event_id % 4 WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'google/gemini-3.7-flash' WHEN 2 THEN 'gemini-2.5-flash-lite' ELSE 'unpriced' END AS model,
  CASE WHEN event_id % 2 = 0 THEN 'translation' ELSE 'judge' END AS phase,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS input_tokens,
  CAST(round(value * 10) AS BIGINT) AS output_tokens,
  CASE WHEN event_id % 3 = 0 THEN CAST(round(value) AS BIGINT) END AS reasoning_tokens
FROM events
"""

VIEWS["run_translations"] = """
SELECT DISTINCT concat(item_key, '-', CAST(seq % 7 AS VARCHAR)) AS stable_key, participant_id FROM attempts WHERE outcome = 'success'
"""

VIEWS["run_failures"] = """
SELECT concat(item_key, '-', CAST(seq % 7 AS VARCHAR)) AS stable_key, participant_id, ts AS recorded_at, seq, error_class
FROM attempts WHERE outcome = 'failure'
"""

VIEWS["turns"] = """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'self' ELSE 'other' END AS speaker_role,
  CASE WHEN turn % 4 = 0 THEN CAST(NULL AS VARCHAR) ELSE concat(CAST(turn AS VARCHAR), ' min ago') END AS relative_time_label,
  text AS source_text
FROM conversations
"""

# One row per item with its prior turns as parallel lists.
VIEWS["item_base"] = """
SELECT conv_id, turn, speaker_role, relative_time_label, source_text,
  list(speaker_role) OVER w AS prior_roles, list(coalesce(relative_time_label, '')) OVER w AS prior_labels,
  list(source_text) OVER w AS prior_texts
FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
"""

VIEWS["item_rows"] = """
SELECT printf('c%06d-%03d', conv_id, turn) AS sample_id,
  conv_id, turn, len(prior_roles) AS n_turns, prior_roles, prior_labels, prior_texts,
  CASE WHEN len(list_distinct(list_append(prior_roles, speaker_role))) = 1 THEN 'single' ELSE 'dyadic' END AS mode,
  CASE WHEN (conv_id + turn) % 10 < 6 THEN 'use' ELSE 'ignore' END AS expectation,
  list_extract(['referent_resolution','ellipsis_completion','sense_disambiguation','pragmatic_intent_resolution',
    'register_carryover','temporal_or_causal_linkage','topic_shift_independence','false_lead_trap',
    'stale_context_resistance','metadata_nonliteral_resistance'], CAST((conv_id + turn) % 10 + 1 AS INT)) AS phenomenon,
  CASE WHEN turn % 5 = 0 THEN speaker_role ELSE 'self' END AS cur_role,
  CASE WHEN turn % 3 = 0 THEN relative_time_label END AS cur_label,
  source_text AS cur_text, conv_id + turn AS number
FROM item_base WHERE coalesce(len(prior_roles), 0) > 0
"""

VIEWS["ledger"] = """
SELECT *, concat(run_id, '::', source_id, '::', target_language, '::', participant_id) AS stable_key FROM (
SELECT 'run-1' AS run_id, user_id AS source_no, concat('s', CAST(user_id AS VARCHAR)) AS source_id,
  CASE CAST(floor(event_id / 8) AS BIGINT) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE 'zh-Hans' END AS target_language,
  concat('p', CAST(event_id % 8 AS VARCHAR)) AS participant_id, concat('m', CAST(event_id % 8 % 5 AS VARCHAR)) AS participant_model_id,
  event_id AS seq, ts, event_type IN ('click', 'purchase') AS succeeded, event_type = 'error' AS failed,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS latency_ms
FROM events) e
"""

VIEWS["led_translations"] = """
SELECT stable_key, source_no, source_id, target_language, participant_id, participant_model_id, min(seq) AS seq
FROM ledger WHERE succeeded GROUP BY ALL
"""

VIEWS["led_failures"] = """
SELECT stable_key, source_no, source_id, target_language, participant_id, participant_model_id, seq, ts AS recorded_at
FROM ledger WHERE failed
"""

VIEWS["led_unresolved"] = """
SELECT * FROM led_failures WHERE stable_key NOT IN (SELECT stable_key FROM led_translations)
QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY recorded_at DESC, seq DESC) = 1
"""

VIEWS["led_judgments"] = """
SELECT stable_key, 'run-1' AS run_id, source_id, target_language, participant_id,
  CASE WHEN source_no % 7 = 0 THEN 'judge_failed' ELSE 'ok' END AS status,
  CASE WHEN source_no % 3 = 0 THEN 'judge-b' ELSE 'judge-a' END AS judge_model_id
FROM led_translations
"""

VIEWS["led_copied"] = """
SELECT t.*, stable_key AS source_stable_key, concat('run-2::', source_id, '::', target_language, '::', participant_id) AS new_key
FROM led_translations t WHERE participant_id IN ('p0','p1','p2','p4','p5') AND source_no % 5 <> 0
"""
