"""The registered queries of the ten operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontam, licenses, mixing, neardup, quality_rules, sharding, tokens, url_rules
from .common import read_table

#: Target weights of the sources of ``documents``.
WEIGHTS = {f"src{i}": 1.0 + (i % 4) * 0.5 for i in range(20)} | {"*": 1.0}
MIX_SEED = 7


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(spark, sharding.shard_to_files(spark, read_table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), WEIGHTS, seed=MIX_SEED)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(spark, tokens.encode_to_files(spark, read_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(read_table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return classifier.score_quality(docs, weights)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_sharding, op3_mixing, op4_token_files, op5_decontamination, op6_url_filter, op7_licenses, op8_quality_rules, op9_quality_classifier, op10_token_counts, pipeline)}


def _mix_sql() -> str:
    weights = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
    named = ", ".join(f"'{s}'" for s in WEIGHTS if s != "*")
    return f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS label FROM documents),
w(label, weight) AS (VALUES {weights}),
c AS (SELECT label, count(*) AS n FROM d GROUP BY label),
r AS (SELECT c.label, weight / (SELECT sum(weight) FROM w JOIN c USING (label)) * (SELECT count(*) FROM d) / c.n AS mean FROM c JOIN w USING (label)),
k(label, mean, i, p, total) AS (
  SELECT label, mean, 0, exp(-mean), exp(-mean) FROM r
  UNION ALL SELECT label, mean, i + 1, p * mean / (i + 1), total + p * mean / (i + 1) FROM k WHERE i < mean OR total + p * mean / (i + 1) <> total),
u AS (SELECT *, (('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS x FROM d),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, CAST(count(*) FILTER (WHERE u.x >= k.total) AS INTEGER) AS n_copies, row_number() OVER () AS rid
      FROM (SELECT *, row_number() OVER () AS rid FROM u) u JOIN k ON k.label = u.label GROUP BY u.rid, u.doc_id, u.text, u.lang, u.source, u.n_chars)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy, n_copies FROM (SELECT *, unnest(range(n_copies)) AS c FROM n)
"""


def _urls_sql() -> str:
    rules = ", ".join(f"({i}, '{v}', '{h}', '{p}')" for i, (v, h, p) in enumerate(url_rules.RULES))
    like = lambda g: "'" + g.replace("_", "\\_").replace("*", "%").replace("?", "_") + "' ESCAPE '\\'"
    globs = " OR ".join(f"(host LIKE {like(h)} AND path LIKE {like(p)})" for h, p in url_rules.GLOBS)
    return f"""
WITH p AS (
  SELECT page_id, position('://' IN coalesce(url, '')) AS mark, url FROM pages),
h AS (
  SELECT page_id, translate(CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^([^/?#]*)([^?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^([^/?#]*)([^?#]*)', 2) ELSE '' END AS path, row_number() OVER () AS rid FROM p),
r(i, verdict, rhost, rpath) AS (VALUES {rules}),
f AS (SELECT rid, arg_min(struct_pack(rule := rhost || rpath, verdict := verdict), -length(rhost || rpath) * 1000 + i) AS best
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN {globs} THEN 'block' ELSE 'allow' END) AS verdict, ({globs}) AS glob
FROM h LEFT JOIN f USING (rid)
"""


def _quality_sql() -> str:
    p = quality_rules.DEFAULT_RULES
    ws = "[\\x20\\x09-\\x0D]"
    mark = "[#*$%&|<>!]$"
    end = "[.!?…:;\"''”’)\\]»]$"
    boiler = " OR ".join(f"contains(lower(line), '{b}')" for b in p.boilerplate)
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '{ws}+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, {words("text")} AS ws, length(regexp_replace(text, '{ws}', '', 'g')) AS chars FROM d),
pos AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT rid, i, word, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM pos WINDOW x AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
l AS (SELECT rid, line, {words("line")} AS ws FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT rid, line, len(ws) AS n, len(list_filter(ws, lambda x: regexp_matches(x, '{mark}'))) AS marked, len(list_filter(ws, lambda x: x IN ('|', '»', '›', '·', '•'))) AS bars,
             len(list_filter(ws, lambda x: regexp_matches(x, '{end}'))) AS ended FROM l WHERE len(ws) > 0),
j AS (SELECT rid, line, length(regexp_replace(line, '{ws}', '', 'g')) AS chars,
             (marked > {p.mark_least} AND marked > {p.max_marked_share} * n) OR (bars >= 2 AND bars > {p.max_separator_share} * n)
             OR (n <= {p.boilerplate_words} AND ({boiler})) OR (n > {p.heading_words} AND ended = 0) AS bad FROM m),
s AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE bad) AS n_bad, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost FROM j GROUP BY rid),
o AS (SELECT doc_id, len(ws) AS n_words, chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS dup, coalesce(n_repeat, 0) AS n_repeat, coalesce(n_bad, 0) AS n_bad, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN s USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
       (n_words < {p.min_words} OR 100 * n_repeat > {p.max_repeat_percent} * n_words) AS base_failed,
       NOT (n_words < {p.min_words} OR 100 * n_repeat > {p.max_repeat_percent} * n_words) AND chars - lost >= {p.min_kept_share} * chars AS kept,
       CAST(n_bad AS BIGINT) AS n_failed_lines, CAST(lost AS BIGINT) AS lost_chars FROM o
"""


ORACLE_SQL = {"op3_mixing": _mix_sql(), "op6_url_filter": _urls_sql(), "op8_quality_rules": _quality_sql()}
