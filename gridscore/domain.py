"""Closed value sets of the data model.

Every name in this file is a fixed value: results are only comparable when
these sets, weights and labels are exactly these.
"""

from __future__ import annotations

# Error classes of an annotation.
ERROR_CLASSES = (
    "accuracy/addition",
    "accuracy/mistranslation",
    "accuracy/omission",
    "accuracy/untranslated text",
    "fluency/character encoding",
    "fluency/grammar",
    "fluency/inconsistency",
    "fluency/punctuation",
    "fluency/register",
    "fluency/spelling",
    "style/awkward",
    "terminology/inappropriate for context",
    "terminology/inconsistent use",
    "non-translation",
    "other",
)

# How an output dealt with the context of its item.
BEHAVIORS = (
    "used_correctly",
    "missed_required_context",
    "ignored_irrelevant_context",
    "misused_context",
    "unclear",
)

# Penalty points per severity.
SEVERITY_POINTS = {"critical": 25, "major": 5, "minor": 1}

# Target languages, label to code.
LANGUAGE_CODES = {"English": "en", "Japanese": "ja", "Chinese Simplified": "zh-Hans"}
LANGUAGES = tuple(LANGUAGE_CODES.values())

# Item structure.
TURN_COUNTS = (1, 2, 3)
SPEAKER_MODES = ("single", "dyadic")
SPEAKER_ROLES = ("self", "other")
EXPECTATIONS = ("use", "ignore")
USE_PHENOMENA = (
    "referent_resolution",
    "ellipsis_completion",
    "sense_disambiguation",
    "pragmatic_intent_resolution",
    "register_carryover",
    "temporal_or_causal_linkage",
)
IGNORE_PHENOMENA = (
    "topic_shift_independence",
    "false_lead_trap",
    "stale_context_resistance",
    "metadata_nonliteral_resistance",
)
PRIMARY_PHENOMENA = USE_PHENOMENA + IGNORE_PHENOMENA
SECONDARY_PHENOMENA = (
    "speaker_role_resolution",
    "self_other_deixis",
    "response_pair_dependency",
    "addressivity",
    "emotion_flip",
    "repair_or_self_correction",
    "sarcasm_or_teasing",
    "location_time_deixis",
)
ITEMS_PER_BUCKET = {"use": 4, "ignore": 3}

# Call phases and error classes of a provider call.
PHASES = ("translation", "judge")
CALL_ERROR_CLASSES = (
    "rate_limit",
    "timeout",
    "server_overload",
    "network",
    "invalid_response",
    "auth",
    "bad_request",
    "unknown",
)
RETRYABLE_CLASSES = (
    "rate_limit",
    "timeout",
    "server_overload",
    "network",
    "invalid_response",
    "unknown",
)

# Systems that count as commercial services in rankings.
COMMERCIAL_IDS = (
    "deepl-api",
    "deepl-api-nocontext",
    "google-cloud-translate-basic",
    "papago-web",
)
PARTIAL_SERVICE_IDS = ("deepl-api", "deepl-api-nocontext")
CONTEXT_BLIND_IDS = ("google-cloud-translate-basic", "google-translate-web")

# Retry back-off table (index = attempt, entry 0 unused), window, cooldown.
RETRY_DELAYS_MS = (0, 2000, 5000, 10000, 20000)
FAILURE_WINDOW_SECONDS = 60
COOLDOWN_MS = 30000
LONG_RETRY_AFTER_MS = 10000
FAILURE_STREAK = 3

# Text limits in code points.
PREVIEW_CODE_POINTS = 120
ERROR_TEXT_CODE_POINTS = 4000

# USD per million tokens (provider, model, input, output).
# Prices quoted in CNY are divided by 7.25 and rounded to six digits.
CNY_PER_USD = 7.25
USD_PRICES = (
    ("vertex", "gemini-3.1-pro-preview", "2", "12"),
    ("vertex", "gemini-2.5-flash", "0.15", "1.25"),
    ("gemini", "gemini-3-flash-preview", "0.5", "3"),
    ("gemini", "gemini-3.1-flash-lite-preview", "0.25", "1.5"),
    ("gemini", "gemini-2.5-flash-lite", "0.1", "0.4"),
    ("deepseek", "deepseek-v4-flash", "0.14", "0.28"),
    ("openrouter", "deepseek/deepseek-v4-flash", "0.14", "0.28"),
    ("deepseek", "deepseek-v4-pro", "0.435", "0.87"),
    ("openrouter", "deepseek/deepseek-v4-pro", "0.435", "0.87"),
    ("openrouter", "google/gemini-3.7-flash", "0.375", "1.875"),
    ("openrouter-batch", "google/gemini-3.7-flash", "0.1875", "0.9375"),
)
CNY_PRICES = (
    ("qwen", "qwen3.6-plus", "2", "12"),
    ("qwen", "qwen3.6-flash", "1.2", "7.2"),
    ("qwen", "qwen3.5-plus", "0.8", "4.8"),
    ("qwen", "qwen3.5-flash", "0.2", "2"),
)

# Providers a participant registry may name, and optional enums.
REGISTRY_PROVIDERS = (
    "gemini",
    "qwen",
    "openrouter",
    "deepseek",
    "deepl",
    "google-translate-basic",
    "google-web",
    "llamacpp",
    "papago",
)
MESSAGE_LAYOUTS = ("system-context",)
LLAMACPP_MODES = ("chat", "completion")
JUDGE_BACKENDS = ("vertex", "gemini-cli", "openrouter-batch")
DATASET_KINDS = ("sentence", "context")
MANIFEST_VERSION = 3

# CSV columns printed with six decimals, and columns always quoted.
CSV_SIX_DECIMALS = ("mean_penalty", "missed_required_context_rate", "misused_context_rate")
CSV_FORCE_QUOTE = ("caveat", "provenance")

# Output format section of a one-text judge prompt.
FLAT_PROMPT_FORMAT = """Return the annotation in exactly this text format:

Critical:
no-error | <MQM class> - "<translated span>"
Major:
no-error | <MQM class> - "<translated span>"
Minor:
no-error | <MQM class> - "<translated span>"
contextBehavior: used_correctly | missed_required_context | ignored_irrelevant_context | misused_context | unclear

- List each error under its severity heading (Critical:, Major:, Minor:).
- Write error lines as <MQM class> - "<translated span>".
- Write no-error under a heading that has no errors.
- End with the contextBehavior line.
- Do not return JSON, Markdown, prose, or extra sections."""

# Language codes of translation services, by role: code, then the names it goes by.
_KOREAN = {"ko": ("korean", "ko")}
_THREE_TARGETS = {"en": ("en", "english"), "ja": ("ja", "japanese"), "zh-CN": ("zh-hans", "chinese simplified")}
_SIXTEEN = {
    "ko": ("korean", "ko"),
    "en": ("english", "en"),
    "ja": ("japanese", "ja"),
    "zh-CN": ("zh-hans", "zh-cn", "chinese simplified"),
    "zh-TW": ("zh-tw", "zh-hant", "chinese traditional"),
    "es": ("spanish", "es"),
    "fr": ("french", "fr"),
    "de": ("german", "de"),
    "ru": ("russian", "ru"),
    "pt": ("portuguese", "pt"),
    "it": ("italian", "it"),
    "vi": ("vietnamese", "vi"),
    "th": ("thai", "th"),
    "id": ("indonesian", "id"),
    "hi": ("hindi", "hi"),
    "ar": ("arabic", "ar"),
}
SERVICE_LANGUAGES = {
    ("deepl", "source"): {"KO": ("korean", "ko")},
    ("deepl", "target"): {"EN": ("en", "english"), "JA": ("ja", "japanese"), "ZH-HANS": ("zh-hans", "chinese simplified")},
    ("papago", "source"): _SIXTEEN,
    ("papago", "target"): _SIXTEEN,
    ("google-web", "source"): _KOREAN,
    ("google-web", "target"): _THREE_TARGETS,
    ("google-translate-basic", "source"): _KOREAN,
    ("google-translate-basic", "target"): _THREE_TARGETS,
}
# An unknown source language is left out by these services, an error for the others.
SERVICES_WITH_OPTIONAL_SOURCE = ("deepl",)
# Language names of local completion models that differ from the label.
COMPLETION_LANGUAGE_NAMES = {"Chinese Simplified": "Chinese (Simplified)"}
