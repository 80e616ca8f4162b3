"""The registered queries of this package, and what DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.llm import (
    clustering, collocations, components, decontamination, hmm, language_id, merge_replay, near_dup, pieces, quality, ragged, sharding, suffix_dedup, token_counts, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(builder: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = builder
        if sql:
            ORACLES[name] = sql
        return builder

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_wu_manber_decontamination", r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), il AS (SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM il)),
places AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (SELECT doc_id, item_id, p, places.k AS k FROM places JOIN windows USING (s) WHERE places.k = windows.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query("op10_quality_ledger", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
places AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM places) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
), f AS (
  SELECT *, (n_words < 20)::BIGINT AS b0, (100 * n_repeat_words > 30 * n_words)::BIGINT AS b1, (10 * n_symbols > n_words)::BIGINT AS b2,
         (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT AS b3, (word_chars < 2 * n_words)::BIGINT AS b4, (word_chars > 20 * n_words)::BIGINT AS b5,
         (n_dup_lines > 0)::BIGINT AS b6
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 + b1 > 0 AS base_failed, b0 + b1 + b2 + b3 + b4 + b5 = 0 AS kept,
       b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 AS failures
FROM f
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    bits = F.col("ledger.failures")
    return rows.select(
        "doc_id", *(f"ledger.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~quality.passes(bits, quality.POLICIES[0])).alias("base_failed"), quality.passes(bits).alias("kept"), bits.alias("failures"),
    )


BASE32_SQL = " || ".join(
    f"substr('{warc.BASE32}', 1 + ((('0x' || substr(sha1(coalesce(html, '')), {5 * group + 1}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    for group in range(8) for shift in (15, 10, 5, 0)
)


@query("op1_warc_chunks", f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, {BASE32_SQL} AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html")
    urn = lambda key: F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("none")))
    chunks = warc.chunk_rows(
        pages, urn(F.col("page_id")), F.col("url"), F.col("html"), F.when(F.col("first_key").isNotNull(), urn(F.col("first_key"))),
        F.col("payload_digest"), F.col("payload_bytes"),
    )
    back = warc.read_chunks(warc.write_archives(chunks, warc.archive_folder(spark))).where("is_last")
    whole = F.col("record_type") == "response"
    intact = (F.col("declared_digest") == F.col("payload_digest")) & (F.col("declared_bytes") == F.col("payload_bytes"))
    page = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    digest = F.when(~whole | intact, F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of "), "record_id")))
    return back.select(
        page("record_id").alias("page_id"), F.col("declared_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"),
    )


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "counts.n_bytes", "counts.n_tokens", (F.col("counts.n_tokens") > 512).alias("over_limit"))


@query("op6_minimax_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.crc32(content).alias("text_crc32"))
    placed = sharding.assign(rows, 16, F.col("content"), F.octet_length("content") + 1, ["doc_id"], drop=["content"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_chosen_path_near_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), settings=near_dup.Settings(percent=85))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    cut = ragged.annotate(texts, "text", suffix_dedup.KEPT, suffix_dedup.compute_kept, ["text_key", "spans"], "kept", ["spans"])
    cut = cut.select("text_key", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept.kept", 256).alias("kept_sha256"))
    result = rows.join(components.stored(cut, "cut"), "text_key", "left")
    none = F.lit(0).cast("bigint")
    return result.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


@query("op9_suffix_array_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    plain = F.translate(F.coalesce("text", F.lit("")), pieces.BLANK, " ")  # the blank letter itself comes back as a blank
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(plain).alias("print"))
    back = pieces.encoded(docs, model, carry=["doc_id", "print"], decoded=True).select("doc_id", "print", "encoded.*")
    return back.select(
        "doc_id", F.octet_length("decoded").cast("bigint").alias("n_bytes"), F.size("ids").cast("bigint").alias("n_pieces"), "n_byte_pieces",
        "ids", (F.xxhash64("decoded") == F.col("print")).alias("round_trip"),
    )


@query("op7_hidden_markov_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


@query("op5_bayesian_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 6))


@query("op11_merge_replay")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = merge_replay.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    ids = F.col("encoded.ids")
    return back.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("encoded.decoded"), 256).alias("decoded_sha256"),
    )


def _rounds_sql(rounds: int) -> str:
    """Assignments ``a0``, ``a1``, ... of vectors to the centroids ``c0``, ``c1``, ..."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT i, c, list_sum(list_transform(list_zip(v.e, k.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{n} AS k
  ) GROUP BY i
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS (
  SELECT c, coalesce(m.e, k.e) AS e FROM c{n} AS k LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS e
    FROM (SELECT c, p, sum(e[p])::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (i), unnest(range(1, 65)) AS r(p) GROUP BY c, p) GROUP BY c
  ) AS m USING (c)
)""")
    return ",\n".join(steps)


@query("op12_pca_filtered_clusters", f"""
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), false)
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16
),
{_rounds_sql(3)},
s AS (SELECT c, sum(d)::BIGINT AS inertia FROM a3 GROUP BY c)
SELECT vec_id, a3.c::INT AS cluster, d AS distance, s.inertia AS cluster_inertia, (SELECT sum(inertia)::BIGINT FROM s) AS inertia,
       sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN v USING (i) JOIN c3 ON c3.c = a3.c JOIN s ON s.c = a3.c
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, about = clustering.clusters(table(spark, sf_dir, "embeddings"))
    whole = about.agg(F.sum("inertia").cast("bigint")).first()[0]
    about = about.select("cluster", F.col("inertia").alias("cluster_inertia"), F.lit(whole).cast("bigint").alias("inertia"), "centroid_sha256")
    return found.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_stream_collocations", r"""
WITH t AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), piece AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
f AS (
  SELECT lang, s, len(s) AS k, count(*)::HUGEINT AS f
  FROM (SELECT lang, k, w[p:p + k - 1] AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, range(1, 6) AS r(k) WHERE len(w) >= k)) GROUP BY lang, s
  HAVING count(*) >= 100
), total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
cut AS (
  SELECT c.lang, c.s, c.f AS a, c.k, l.f AS l, r.f AS r, n, (1000 * c.f * n) // (l.f * r.f) AS score, row_number() OVER (PARTITION BY c.lang, c.s ORDER BY (1000 * c.f * n) // (l.f * r.f), j) AS cheapest
  FROM f AS c, range(1, 5) AS g(j), f AS l, f AS r, total
  WHERE c.k > j AND l.lang = c.lang AND r.lang = c.lang AND total.lang = c.lang AND l.s = c.s[1:j] AND r.s = c.s[j + 1:c.k]
), inside AS (
  SELECT DISTINCT lang, x.s AS s FROM (
    SELECT lang, f, k, unnest(flatten(list_transform(range(2, k), lambda z: list_transform(range(1, k - z + 2), lambda b: {'s': s[b:b + z - 1]})))) AS x FROM f WHERE k > 2
  ) AS longer JOIN f AS own USING (lang) WHERE own.s = x.s AND 100 * longer.f >= 100 * own.f
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(s, ' '))) AS rank, array_to_string(s, ' ') AS phrase, a, l, r, n, score
  FROM cut WHERE cheapest = 1 AND NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = cut.lang AND inside.s = cut.s)
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_GRID = ", ".join(
    f"({p.version}, {p.mask}, '{r.name}', {1 << r.bit})" for p in quality.POLICIES for r in quality.RULES if r.name in p.rules
)


@query("quality_ablation", f"""
WITH q AS ({ORACLES["op10_quality_ledger"]}), g(policy, mask, rule, bit) AS (VALUES {_GRID})
SELECT policy, rule, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failures & mask <> 0) AS BIGINT) AS n_rejected,
       CAST(count(*) FILTER (failures & mask = bit) AS BIGINT) AS n_only_this, bit_or(failures) AS bits_seen
FROM q, g GROUP BY policy, rule
""")
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects alone, from the stored bits."""
    rows = quality.ledger(table(spark, sf_dir, "documents")).select(F.col("ledger.failures").alias("failures"))
    return quality.ablation(rows)
