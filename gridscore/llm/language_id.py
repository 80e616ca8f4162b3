"""Language of web pages from several kinds of evidence, put together by Bayes' rule.

Text: byte trigrams, with counts per language from labelled texts. Declared language: how often a language is declared as
each value, whatever the declaration is worth. Address: a prior of the host, smoothed towards its suffix, which is smoothed
towards all pages. Declarations and priors are grouped counts over the pages themselves, taken by the language that the
text alone suggests; a page's own count is left out of its evidence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm import ragged
from gridscore.llm.components import stored

BUCKETS = 1 << 15
#: Different languages of the labels; more mean that the label column holds something else.
MOST_LANGUAGES = 500
TRIGRAM_WEIGHT = 0.3  # neighbouring trigrams share bytes, so each counts less than independent evidence
SUFFIX_WEIGHT = 20.0  # pages that the prior of all pages counts for in a suffix's prior
HOST_WEIGHT = 5.0  # pages that the suffix's prior counts for in a host's
DECLARED_WEIGHT = 2.0

_NOT_TEXT = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
TEXT_RESULT = T.StructType([T.StructField("likelihood", T.ArrayType(T.DoubleType(), False), False), T.StructField("text_bytes", T.LongType(), False)])


@dataclass
class TextModel:
    languages: list[str]
    log_share: np.ndarray  # buckets x languages


def trigrams(batch: ragged.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every trigram within a text, A-Z lower-cased."""
    data = ragged.LOWER[batch.data].astype(np.int64)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    inside = ragged.whole_windows(batch.offsets, 3)
    bucket = (ragged.mixed(code[inside].astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(batch.offsets, inside, side="right") - 1


def train(labelled: DataFrame, text: str, language: str) -> TextModel:
    """Trigram counts of all labelled texts; rows without text or language are left out. Tasks send one table each."""
    rows = labelled.where(labelled[f"`{text}`"].isNotNull() & labelled[f"`{language}`"].isNotNull()).select(labelled[f"`{text}`"].alias("text"), labelled[f"`{language}`"].alias("language"))
    languages = sorted(r[0] for r in rows.select("language").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in column {language}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        number = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            for piece in ragged.pieces(batch, "text"):
                bucket, owner = trigrams(ragged.texts(piece.column("text")))
                kind = np.array([number[name] for name in piece.column("language").to_pylist()])
                total += np.bincount(kind[owner] * BUCKETS + bucket, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["entry", "n"])

    counts = np.ones(len(languages) * BUCKETS) * 0.5
    for entry, n in rows.mapInArrow(run, "entry bigint, n bigint").groupBy("entry").agg(F.sum("n")).collect():
        counts[entry] += n
    counts = counts.reshape(len(languages), BUCKETS)
    return TextModel(languages, np.log(counts / counts.sum(1)[:, None]).T.copy())


def visible(page: str | None) -> str:
    return " ".join(html.unescape(_NOT_TEXT.sub(" ", page or "")).split())


def likelihoods(batch: ragged.Texts, model: TextModel) -> np.ndarray:
    """Log likelihood of every text in every language."""
    bucket, owner = trigrams(batch)
    columns = [np.bincount(owner, weights=model.log_share[bucket, k], minlength=len(batch)) for k in range(len(model.languages))]
    return np.stack(columns, 1) if columns else np.zeros((len(batch), 0))


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host without www and port, and its last label; null where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    host = F.when(host != "", host)
    suffix = F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1)
    return host, F.when(suffix != "", suffix)


def grouped(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Per ``key`` the number of pages whose text suggests each language. Counted per language first, so a host with very
    many pages is a few counts from each task."""
    sums = [F.sum((F.col("text_language") == k).cast("bigint")).alias(f"n{k}") for k in range(n)]
    counts = rows.where(F.col(key).isNotNull() & F.col("text_language").isNotNull()).groupBy(key).agg(*sums)
    return stored(counts.select(F.col(key).alias(f"{name}_key"), F.array(*[f"n{k}" for k in range(n)]).alias(name)), name)


def identify(
    pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", text: str = "text", language: str = "lang",
) -> DataFrame:
    """One row per page: ``page_id``, ``lang``, ``probability``, and the single pieces of evidence: ``text_lang``, ``declared``,
    ``host``, ``suffix``, ``text_bytes`` (visible text).

    Evidence that is missing (no visible text of three bytes, no declaration, no address) is left out; a page without any gets
    the most frequent language. Ties go to the language that comes first in order. Without labels ``lang`` is null. Null
    ids stay and rows that repeat stay.
    """
    model = train(labelled, text, language)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    n = len(model.languages)
    content = F.col(f"`{page}`")
    declared = F.lower(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    host, suffix = address_parts(F.col(f"`{url}`"))
    source = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.when(declared != "", declared).alias("declared"), host.alias("host"), suffix.alias("suffix"), content.alias("page"))

    def compute(column: pa.Array) -> list[pa.Array]:
        batch = ragged.texts(pa.array([visible(v) for v in column.to_pylist()], pa.string()))
        sizes = np.diff(batch.offsets)
        found = likelihoods(batch, shared.value) * TRIGRAM_WEIGHT
        offsets = pa.array((np.arange(len(sizes) + 1) * n).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), pa.array(sizes)]

    rows = ragged.annotate(source, "page", TEXT_RESULT, compute, ["page_id", "declared", "host", "suffix"], "t").select("page_id", "declared", "host", "suffix", "t.*")
    best = F.when((F.col("text_bytes") >= 3) & (F.size("likelihood") > 0), F.array_position("likelihood", F.array_max("likelihood")) - 1)
    rows = stored(rows.withColumn("text_language", best), "evidence")
    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "suffix", "text_bytes")

    totals = rows.agg(*[F.sum((F.col("text_language") == k).cast("bigint")) for k in range(n)]).first()
    totals = [t or 0 for t in totals]
    shares = [(t + 1) / (sum(totals) + n) for t in totals]
    for key in ("host", "suffix", "declared"):
        counts = grouped(rows, key, n, f"{key}_counts")
        rows = rows.join(counts, F.col(key) == F.col(f"{key}_counts_key"), "left").drop(f"{key}_counts_key")

    own = [(F.col("text_language") == k).cast("int") for k in range(n)]
    own = [F.coalesce(o, F.lit(0)) for o in own]
    without = lambda name, k: F.coalesce(F.col(name)[k] - own[k], F.lit(0))
    size = lambda name: sum((without(name, k) for k in range(n)), F.lit(0))
    logs = []
    for k in range(n):
        in_suffix = (without("suffix_counts", k) + SUFFIX_WEIGHT * shares[k]) / (size("suffix_counts") + SUFFIX_WEIGHT)
        in_host = (without("host_counts", k) + HOST_WEIGHT * in_suffix) / (size("host_counts") + HOST_WEIGHT)
        share = (size("declared_counts") + 1.0) / (sum(totals) + 1.0)  # how often this value is declared at all
        of_declared = (without("declared_counts", k) + DECLARED_WEIGHT * share) / (F.lit(totals[k]) - own[k] + DECLARED_WEIGHT)
        said = F.when(F.col("declared").isNotNull(), F.log(of_declared)).otherwise(0.0)
        read = F.when(F.col("text_language").isNotNull(), F.col("likelihood")[k]).otherwise(0.0)
        logs.append(F.log(in_host) + said + read)
    names = F.array(*map(F.lit, model.languages))
    ranked = [F.struct(log.alias("log"), F.lit(-k).alias("order"), F.lit(name).alias("lang")) for k, (log, name) in enumerate(zip(logs, model.languages))]
    rows = rows.withColumn("evidence", F.array(*ranked))
    best = F.array_max("evidence")
    total = F.aggregate("evidence", F.lit(0.0), lambda acc, x: acc + F.exp(x.log - best.log))
    return rows.select(
        "page_id", best.lang.alias("lang"), (1 / total).alias("probability"), F.get(names, F.col("text_language").cast("int")).alias("text_lang"), "declared", "host", "suffix",
        "text_bytes",
    )
