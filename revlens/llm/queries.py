"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import (
    exact_dedup, graph_search, hard_negatives, language_id, licenses, lm_scoring, mixing, near_dup, packing, prefix_trie, suffix_dedup,
    url_filter, warc,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, _read(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", packing.ids_crc32("ids")).drop("ids")


#: The rules of the registered URL query (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(spark, _read(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, _read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = near_dup.join(spark, _read(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_duplicates(spark, _read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, _read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicate(spark, _read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, _read(spark, sf_dir, "pages"), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(spark, _read(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(spark, _read(spark, sf_dir, "embeddings"), relabel=shifted)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(spark, _read(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(spark, _read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_graph_search": op10_graph_search,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL = {
    "op3_url_filter": """
        WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
                 ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
             cut AS (SELECT row_number() OVER () AS n, page_id,
                            CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
                     FROM pages),
             u AS (SELECT n, page_id,
                          translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                   FROM cut),
             fit AS (SELECT u.n, max({'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
                     FROM u JOIN rules r
                       ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
                     GROUP BY u.n)
        SELECT u.page_id, u.host, u.path, fit.best.rule AS rule, coalesce(fit.best.verdict, 'allow') AS verdict
        FROM u LEFT JOIN fit ON u.n = fit.n
    """,
    "op4_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))) AS h
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
            FROM d GROUP BY source),
        capped(round, shut) AS (  -- round by round, close the sources whose share is above their limit
            SELECT 0, CAST([] AS VARCHAR[])
            UNION ALL
            SELECT round + 1, more FROM (
                SELECT c.round, c.shut,
                       (SELECT list(coalesce('=' || s.source, '-') ORDER BY 1) FROM s
                        WHERE list_contains(c.shut, coalesce('=' || s.source, '-'))
                           OR s.weight * ((SELECT 1.5 * sum(source_size) FROM s)::DOUBLE
                                - coalesce((SELECT 2.0 * sum(z.source_size) FROM s z WHERE list_contains(c.shut, coalesce('=' || z.source, '-'))), 0)::DOUBLE)
                              / (SELECT sum(z.weight) FROM s z WHERE NOT list_contains(c.shut, coalesce('=' || z.source, '-'))) > 2.0 * s.source_size) AS more
                FROM capped c)
            WHERE more IS NOT NULL AND len(more) > len(shut)),
        fin AS (SELECT shut FROM capped ORDER BY round DESC LIMIT 1),
        t AS (
            SELECT s.source, s.source_size,
                   CASE WHEN list_contains(fin.shut, coalesce('=' || s.source, '-')) THEN 2.0 * s.source_size
                        ELSE ((SELECT 1.5 * sum(source_size) FROM s)::DOUBLE
                              - coalesce((SELECT 2.0 * sum(z.source_size) FROM s z WHERE list_contains(fin.shut, coalesce('=' || z.source, '-'))), 0)::DOUBLE)
                             / (SELECT sum(z.weight) FROM s z WHERE NOT list_contains(fin.shut, coalesce('=' || z.source, '-'))) * s.weight
                   END::DOUBLE AS target
            FROM s, fin),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
        e AS (
            SELECT d.doc_id, d.size, d.source, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS fraction,
                   CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
        k AS (
            SELECT source, seed, abs(sum(size * whole) + sum(CASE WHEN ((a + seed * b) % 4294967296) / 4294967296.0::DOUBLE < fraction THEN size ELSE 0 END)
                                     - any_value(target)) AS off
            FROM e, (SELECT unnest(range(32)) AS seed) GROUP BY source, seed),
        best AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM k GROUP BY source)
        SELECT e.doc_id, e.size, e.source_size, e.target,
               CAST(e.size * (e.whole + CASE WHEN ((a + best.seed * b) % 4294967296) / 4294967296.0::DOUBLE < fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM e JOIN best ON e.source IS NOT DISTINCT FROM best.source
    """,
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op12_prefix_trie": """
        WITH told AS (
            SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        head AS (
            SELECT c, turns,
                   list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + strlen(CAST(c AS VARCHAR))),
                       lambda k: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT))),
                     lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(k AS BIGINT) FOR k IN range(8)]),
                       lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
            FROM told),
        built AS (
            SELECT h.c, list_concat(coalesce(b.turns, [])[1 : xor(h.crc, 4294967295) % 9], h.turns[xor(h.crc, 4294967295) % 9 + 1 :]) AS turns
            FROM head h LEFT JOIN told b ON b.c = h.c - h.c % 5),
        steps AS (
            SELECT c, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
        nodes AS (
            SELECT turns[1 : depth] AS prefix, depth, min(c) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = len(turns)), '') AS ends
            FROM steps GROUP BY ALL),
        links AS (
            SELECT p.*, a.conv_id AS parent_conv_id FROM nodes p LEFT JOIN nodes a ON p.depth > 0 AND a.prefix = p.prefix[1 : p.depth - 1]),
        kids AS (SELECT prefix[1 : depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        own AS (
            SELECT l.*, coalesce(k.n, 0) AS n_children,
                   CASE WHEN l.depth = 0 THEN 0 ELSE (l.n_convs - 1) * strlen(l.prefix[l.depth].t) END AS saved
            FROM links l LEFT JOIN kids k ON l.prefix = k.prefix),
        up AS (SELECT prefix, n_children, saved, unnest(range(depth + 1)) AS d FROM own),
        below AS (
            SELECT prefix[1 : d] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
            FROM up GROUP BY ALL)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
               sha256(ends) AS ends_sha256
        FROM own JOIN below ON own.prefix = below.prefix
    """,
}
