"""The queries of the driver's contract: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_join, langid, line_dedup, minhash, mixing, packing, sharding, suffix_dedup, url_filter

URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.get("mix_positions", F.lit(0))
    light = plan.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"), first.alias("position"),
    )
    # What is not taken stands after the end of training, spread out.
    at = F.coalesce("position", 1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20))
    return light.repartitionByRange(at).sortWithinPartitions(at)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


def _op2_sql() -> str:
    def terms(words: tuple[str, ...]) -> str:
        return " + ".join(rf"regexp_matches(u, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::BIGINT" for w in words)

    fits = "\n".join(
        f"UNION ALL SELECT page_id, '{r.text}', '{r.action}', {len(r.text)} FROM parts WHERE (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        for r in URL_RULES
    ).removeprefix("UNION ALL ")
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH cut AS (
  SELECT page_id, {fold.format("coalesce(url, '')")} AS u,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, {fold.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM cut),
fits(page_id, rule, action, len) AS ({fits}),
best AS (SELECT page_id, arg_max(rule, len) AS rule, arg_max(action, len) AS action FROM fits GROUP BY page_id),
hits AS (SELECT page_id, ({terms(url_filter.STRICT)})::BIGINT AS n_strict, ({terms(url_filter.SOFT)})::BIGINT AS n_soft FROM parts)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.Vocabulary().soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft
FROM parts JOIN hits USING (page_id) LEFT JOIN best USING (page_id)"""


SIMILARITY = 0.8


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), SIMILARITY)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_vectors(_read(spark, sf_dir, "embeddings"), 0.98)


_OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.id = vec_id"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"), 40, law="rows")
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


LINE_RATIO, LINE_MIN_PAGES = 0.1, 3


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.dedup_lines(docs, ratio=LINE_RATIO, min_pages=LINE_MIN_PAGES, dropped="n_dropped")
    return out.select("doc_id", "source", "n_dropped", "text")


_OP7_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS k FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
found AS (
  SELECT source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY source, k)
  JOIN pages USING (source) WHERE n >= {LINE_MIN_PAGES} AND n > pages * {LINE_RATIO}::DOUBLE),
marked AS (SELECT keyed.*, found.k IS NOT NULL AS bad FROM keyed LEFT JOIN found ON keyed.source = found.source AND keyed.k = found.k)
SELECT doc_id, source, count(*) FILTER (WHERE bad) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text
FROM marked GROUP BY doc_id, source"""


SEQUENCE = 4096


def word_tokenizer() -> str:
    """The path of the public word-level BPE vocabulary, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), word_tokenizer(), length=SEQUENCE)


ANN_FACTOR = 0.8


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, factor=ANN_FACTOR)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langid.fit(langid.training_rows(docs))
    out = langid.identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", F.coalesce(langid.remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_minhash_dedup, op4_embedding_dedup, op5_suffix_dedup, op6_sharding, op7_line_dedup, op8_packing, op9_nearest, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _op2_sql(), "op4_embedding_dedup": _OP4_SQL, "op7_line_dedup": _OP7_SQL}
