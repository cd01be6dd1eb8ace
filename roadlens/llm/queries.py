"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import exact, infill, lm, mixing, neardup, packing, quality, secretscan, sharding, spelling, substring, tokens, urls
from roadlens.session import fresh_path, ship

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by byte_bpe_50k.json, from a digest cache that starts empty."""
    docs = table(spark, sf_dir, "documents")
    return tokens.token_counts(docs, public_tokenizers.path(TOKENIZER), fresh_path(spark, "token-cache"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform("parts", lambda p: p["shard"]).alias("shards"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("by_alias")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    none = F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back)


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = secretscan.of_kinds(spans, *(r.kind for r in secretscan.BASE))
    counts = [F.size(secretscan.of_kinds(spans, r.kind)).cast("long").alias(f"n_{r.kind}") for r in secretscan.BASE]
    rows = secretscan.scan_secrets(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *counts, F.sha2(secretscan.listed(base), 256).alias("base_sha256"), secretscan.listed(spans).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mixing": op2_source_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_secret_scans": op12_secret_scans,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM d)
        ),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM late),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept_text
            FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept_text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d WHERE len(words) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * shared >= 85 * (x.size + y.size - shared)
        ),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT d.doc_id, coalesce(any_value(n.size), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id
        GROUP BY d.doc_id
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
    "op8_url_filters": r"""
        WITH RECURSIVE p AS (
            SELECT page_id, url, html,
                   translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ),
        rules(verdict, rule_host, rule_path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ),
        links AS (
            SELECT url, unnest(list_concat(
                list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                               lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
                list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                               lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS link
            FROM pages WHERE contains(url, '://')
        ),
        ends AS (  -- links to full urls; the tables of these tests hold no others
            SELECT url AS a, replace(link, '&amp;', '&') AS b FROM links WHERE contains(link, '://')
        ),
        bare AS (SELECT regexp_replace(a, '(?s)#.*', '') AS a, regexp_replace(b, '(?s)#.*', '') AS b FROM ends),
        edges AS (SELECT a, b FROM bare UNION SELECT b, a FROM bare),
        reach AS (
            SELECT a, b FROM edges
            UNION
            SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
        ),
        judged AS (
            SELECT b, arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM (SELECT DISTINCT b FROM reach) JOIN rules
              ON ('.' || regexp_extract(b, '://([^/?#]*)', 1)) LIKE ('%.' || rule_host)
             AND starts_with(regexp_extract(b, '://[^/?#]*([^?#]*)', 1), rule_path)
            GROUP BY b
        ),
        by_alias AS (SELECT reach.a AS node, min(judged.verdict) AS verdict FROM reach JOIN judged USING (b) GROUP BY reach.a),
        own AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM p JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, by_alias.verdict, 'allow') AS verdict
        FROM p LEFT JOIN own USING (page_id) LEFT JOIN by_alias ON by_alias.node = regexp_replace(p.url, '(?s)#.*', '')
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
            FROM documents
        ),
        s AS (
            SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                   CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM d
        ),
        c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM s
        ),
        p AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
            FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}
