"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB oracle text over the same tables.

Every query reads the driver's tables (or frames Spark derives from them)
in full; column names and types are aligned with the oracle (bigint counts,
double scores rounded where float summation order differs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ingest as ing
from ..operators.prompts import REPLY_FORMS
from ..operators.rca import classify
from ..sources.logs import load_log_lines
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.tables import read_parquet

    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _parsed(spark, sf_dir):
    return ing.parse_lines(load_log_lines(spark, sf_dir))


def _entries(spark, sf_dir):
    return ing.ingest(load_log_lines(spark, sf_dir))


# --- ingest ---------------------------------------------------------------

@register("clean_lines", f"WITH {O.parsed_cte()} SELECT source, line_no, line FROM parsed WHERE line IS NOT NULL")
def q_clean_lines(spark, sf_dir):
    return ing.clean_lines(load_log_lines(spark, sf_dir)).select("source", "line_no", "line")


@register("format_counts", f"""WITH {O.parsed_cte()}
SELECT CASE WHEN starts_with(line, '{{') THEN 'json' ELSE 'plain' END AS format, count(*) AS n
FROM parsed WHERE line IS NOT NULL GROUP BY 1""")
def q_format_counts(spark, sf_dir):
    df = ing.tag_format(ing.clean_lines(load_log_lines(spark, sf_dir)))
    return df.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


_FIELDS = "line_no, ts_text, level_text, service, message"


@register("parse_plain_service", f"WITH {O.parsed_cte()} SELECT {_FIELDS} FROM parsed WHERE branch = 'service'")
def q_parse_plain_service(spark, sf_dir):
    return _parsed(spark, sf_dir).where(F.col("branch") == "service").select(*_FIELDS.split(", "))


@register("parse_plain_noservice", f"WITH {O.parsed_cte()} SELECT {_FIELDS} FROM parsed WHERE branch = 'noservice'")
def q_parse_plain_noservice(spark, sf_dir):
    return _parsed(spark, sf_dir).where(F.col("branch") == "noservice").select(*_FIELDS.split(", "))


@register("json_alias", f"WITH {O.parsed_cte()} SELECT {_FIELDS} FROM parsed WHERE branch = 'json'")
def q_json_alias(spark, sf_dir):
    return _parsed(spark, sf_dir).where(F.col("branch") == "json").select(*_FIELDS.split(", "))


@register("rejected_lines", f"WITH {O.parsed_cte()} SELECT source, line_no, line FROM parsed WHERE line IS NOT NULL AND branch IS NULL")
def q_rejected_lines(spark, sf_dir):
    return ing.rejected_lines(load_log_lines(spark, sf_dir))


@register("parse_ts", f"""WITH {O.parsed_cte()}
SELECT line_no, ts_text, {O.ts_expr('ts_text')} AS ts FROM parsed WHERE branch IS NOT NULL""")
def q_parse_ts(spark, sf_dir):
    p = _parsed(spark, sf_dir).where(F.col("branch").isNotNull())
    return p.select("line_no", "ts_text", ing.parse_ts("ts_text").alias("ts"))


@register("level_counts", f"WITH {O.entries_cte()} SELECT level, count(*) AS n FROM log_entries GROUP BY level")
def q_level_counts(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@register("log_entries", f"WITH {O.entries_cte()} SELECT * FROM log_entries")
def q_log_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


@register("ingest_stats", f"""WITH {O.parsed_cte()}
SELECT count(*) AS total_lines,
       count(*) FILTER (WHERE line IS NULL) AS blank_lines,
       count(*) FILTER (WHERE branch IS NOT NULL) AS parsed_lines,
       count(*) FILTER (WHERE line IS NOT NULL AND branch IS NULL) AS rejected_lines,
       round(count(*) FILTER (WHERE branch IS NOT NULL) / count(*), 6) AS parse_rate
FROM parsed""")
def q_ingest_stats(spark, sf_dir):
    from ..operators.stats import ingest_stats

    return ingest_stats(load_log_lines(spark, sf_dir))


@register("heuristic_rca_entries", f"""WITH {O.entries_cte()}
SELECT {O.rule_case('message', fixed.RULES, fixed.DEFAULT_RULE, 1)} AS error_pattern,
       {O.rule_case('message', fixed.RULES, fixed.DEFAULT_RULE, 4)} AS confidence_score,
       count(*) AS n
FROM log_entries GROUP BY 1, 2""")
def q_heuristic_rca_entries(spark, sf_dir):
    e = classify(_entries(spark, sf_dir))
    return e.groupBy("error_pattern", "confidence_score").agg(F.count(F.lit(1)).alias("n"))


# --- features ------------------------------------------------------------

def _docs_templated(spark, sf_dir):
    from ..operators.features import with_template

    return with_template(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


_DOC_T = f"(SELECT doc_id, {O.template_expr('text')} AS t FROM documents)"


@register("doc_templates", f"SELECT doc_id, {O.template_expr('text')} AS template FROM documents")
def q_doc_templates(spark, sf_dir):
    return _docs_templated(spark, sf_dir).select("doc_id", "template")


@register("template_counts", f"""WITH {O.entries_cte()}, et AS (SELECT {O.template_expr('message')} AS t, source, line_no FROM log_entries)
SELECT t AS template, n, f.s AS first_source, f.l AS first_line_no
FROM (SELECT t, count(*) AS c, min({{'s': source, 'l': line_no}}) AS f FROM et GROUP BY t) x(t, n, f)""")
def q_template_counts(spark, sf_dir):
    from ..operators.features import template_counts, with_template

    return template_counts(with_template(_entries(spark, sf_dir)))


@register("bigram_features", f"""SELECT doc_id, k::BIGINT AS k, sum(w)::DOUBLE AS w
FROM {O.cells_sql(_DOC_T, 'doc_id', 't')} WHERE kind = 'b' GROUP BY doc_id, k""")
def q_bigram_features(spark, sf_dir):
    from ..operators.features import ngram_features

    f = ngram_features(_docs_templated(spark, sf_dir), "doc_id", kinds=("bigram",))
    return f.select("doc_id", F.col("k").cast("long").alias("k"), F.col("w").cast("double").alias("w"))


@register("unigram_features", f"""SELECT doc_id, k::BIGINT AS k, sum(w)::DOUBLE AS w
FROM {O.cells_sql(_DOC_T, 'doc_id', 't')} WHERE kind = 'u' GROUP BY doc_id, k""")
def q_unigram_features(spark, sf_dir):
    from ..operators.features import ngram_features

    f = ngram_features(_docs_templated(spark, sf_dir), "doc_id", kinds=("unigram",))
    return f.select("doc_id", F.col("k").cast("long").alias("k"), F.col("w").cast("double").alias("w"))


@register("l2_norm", """WITH c AS (SELECT vec_id, (i - 1)::BIGINT AS k, embedding[i] AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
m AS (SELECT vec_id, sum((v * v)::DOUBLE) AS ss FROM c GROUP BY vec_id)
SELECT vec_id, k, round(CASE WHEN ss > 0 THEN (v / sqrt(ss))::FLOAT ELSE v END::DOUBLE, 6) AS value
FROM c JOIN m USING (vec_id)""")
def q_l2_norm(spark, sf_dir):
    from ..operators.features import l2_normalize_long

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "w"))
    out = l2_normalize_long(e, "vec_id")
    return out.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.col("value").cast("double"), 6).alias("value"))


@register("embed_sparse", f"""SELECT doc_id, k::BIGINT AS k, round(x::DOUBLE, 6) AS value
FROM {O.vectors_sql(_DOC_T, 'doc_id', 't')}""")
def q_embed_sparse(spark, sf_dir):
    from ..operators.features import embed, sparse_cells

    v = sparse_cells(embed(table(spark, sf_dir, "documents"), "doc_id", "text", dedupe=False), "doc_id")
    return v.select("doc_id", F.col("k").cast("long").alias("k"), F.round(F.col("value").cast("double"), 6).alias("value"))


# --- similarity and clusters -------------------------------------------------

_EMB_COS = """(SELECT a.vec_id AS i, b.vec_id AS j,
   list_sum([(a.embedding[x] * b.embedding[x])::DOUBLE FOR x IN range(1, len(a.embedding) + 1)]) /
   (sqrt(list_sum([(a.embedding[x] * a.embedding[x])::DOUBLE FOR x IN range(1, len(a.embedding) + 1)])) *
    sqrt(list_sum([(b.embedding[x] * b.embedding[x])::DOUBLE FOR x IN range(1, len(b.embedding) + 1)]))) AS cosine
 FROM embeddings a JOIN embeddings b ON {cond})"""


@register("cosine_pairs", f"SELECT i, j, round(cosine, 6) AS cosine FROM {_EMB_COS.format(cond='b.vec_id = a.vec_id + 1')}")
def q_cosine_pairs(spark, sf_dir):
    from ..operators.similarity import cosine

    e = table(spark, sf_dir, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    p = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return p.select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"),
                    F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


EMB_THRESHOLD = 0.3


@register("similar_pairs", f"SELECT i, j, round(cosine, 6) AS cosine FROM {_EMB_COS.format(cond='a.vec_id < b.vec_id')} WHERE cosine >= {EMB_THRESHOLD}")
def q_similar_pairs(spark, sf_dir):
    from ..operators.similarity import similar_pairs

    e = table(spark, sf_dir, "embeddings")
    p = similar_pairs(e, "vec_id", "embedding", EMB_THRESHOLD, block_size=256)
    return p.select("i", "j", F.round("cosine", 6).alias("cosine"))


_CLUSTERING: dict = {}


def clustering(spark, sf_dir):
    """One clustering per (session, directory) inside a process; the frames
    are lazily re-read from checkpoints, so reuse is safe."""
    from .analyze import cluster_entries

    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect session
        app = id(spark)
    key = (app, sf_dir)
    if key not in _CLUSTERING:
        _CLUSTERING[key] = cluster_entries(_entries(spark, sf_dir))
    return _CLUSTERING[key]


def forget_clusterings() -> None:
    """Delete what the clusterings of this process wrote and forget them."""
    for c in _CLUSTERING.values():
        c.release()
    _CLUSTERING.clear()


@register("template_pairs", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT ta AS template_a, tb AS template_b, round(cosine, 6) AS cosine FROM tedges""")
def q_template_pairs(spark, sf_dir):
    c = clustering(spark, sf_dir)
    t = c.templates.select("vkey", "template")
    e = c.edges.join(t.withColumnRenamed("vkey", "i").withColumnRenamed("template", "ti"), "i").join(
        t.withColumnRenamed("vkey", "j").withColumnRenamed("template", "tj"), "j")
    return e.select(F.least("ti", "tj").alias("template_a"), F.greatest("ti", "tj").alias("template_b"),
                    F.round("cosine", 6).alias("cosine"))


@register("log_clusters", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT comp.t AS template, cl.cluster_no::BIGINT AS cluster_no FROM comp JOIN clusters cl ON cl.c = comp.c""")
def q_log_clusters(spark, sf_dir):
    c = clustering(spark, sf_dir)
    return c.templates.join(c.clusters.where(F.col("component").isNotNull()), "component").select(
        "template", F.col("cluster_no").cast("long").alias("cluster_no"))


@register("cluster_labels", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no::BIGINT AS cluster_no, 'Cluster-' || cluster_no AS cluster_label, rep_source, rep_line_no, size
FROM clusters""")
def q_cluster_labels(spark, sf_dir):
    c = clustering(spark, sf_dir).clusters
    return c.select(F.col("cluster_no").cast("long").alias("cluster_no"), "cluster_label", "rep_source",
                    "rep_line_no", "size")


@register("cluster_members", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no::BIGINT AS cluster_no, id, line_no FROM members""")
def q_cluster_members(spark, sf_dir):
    m = clustering(spark, sf_dir).members
    return m.select(F.col("cluster_no").cast("long").alias("cluster_no"), "id", "line_no")


@register("cluster_sizes", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no::BIGINT AS cluster_no, count(*) AS size FROM members GROUP BY cluster_no""")
def q_cluster_sizes(spark, sf_dir):
    from ..operators.stats import cluster_sizes

    m = clustering(spark, sf_dir).members
    return cluster_sizes(m).select(F.col("cluster_no").cast("long").alias("cluster_no"), "size")


@register("cluster_entries", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT m.cluster_no::BIGINT AS cluster_no, e.id, e.level, e.service, e.message
FROM members m JOIN log_entries e ON e.id = m.id""")
def q_cluster_entries(spark, sf_dir):
    from ..operators.clusters import join_entries

    m = clustering(spark, sf_dir).members
    j = join_entries(m, _entries(spark, sf_dir))
    return j.select(F.col("cluster_no").cast("long").alias("cluster_no"), "id", "level", "service", "message")


@register("small_clusters", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no::BIGINT AS cluster_no, size, size < {fixed.SMALL_CLUSTER_SIZE} AS low_confidence FROM clusters""")
def q_small_clusters(spark, sf_dir):
    from ..operators.clusters import flag_small

    c = flag_small(clustering(spark, sf_dir).clusters)
    return c.select(F.col("cluster_no").cast("long").alias("cluster_no"), "size", "low_confidence")


@register("representatives", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no::BIGINT AS cluster_no, rep_id, rep_line_no, rep_message FROM clusters""")
def q_representatives(spark, sf_dir):
    c = clustering(spark, sf_dir).clusters
    return c.select(F.col("cluster_no").cast("long").alias("cluster_no"), "rep_id", "rep_line_no", "rep_message")


_RES_SQL = f"""SELECT cluster_no::BIGINT AS cluster_no, 'Cluster-' || cluster_no || ':' || rep_id AS log_entry_id, 'rules' AS source,
  {O.rule_case('rep_message', fixed.RULES, fixed.DEFAULT_RULE, 1)} AS error_pattern,
  {O.rule_case('rep_message', fixed.RULES, fixed.DEFAULT_RULE, 2)} AS root_cause,
  {O.rule_case('rep_message', fixed.RULES, fixed.DEFAULT_RULE, 3)} AS fix_suggestion,
  {O.rule_case('rep_message', fixed.RULES, fixed.DEFAULT_RULE, 4)} AS confidence_score, size
FROM clusters"""


@register("heuristic_rca", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no, error_pattern, confidence_score FROM ({_RES_SQL})""")
def q_heuristic_rca(spark, sf_dir):
    from .analyze import heuristic_results

    r = heuristic_results(clustering(spark, sf_dir).clusters)
    return r.select(F.col("cluster_no").cast("long").alias("cluster_no"), "error_pattern", "confidence_score")


@register("rca_results", f"WITH RECURSIVE {O.clusters_cte()} {_RES_SQL}")
def q_rca_results(spark, sf_dir):
    from .analyze import heuristic_results

    r = heuristic_results(clustering(spark, sf_dir).clusters)
    return r.withColumn("cluster_no", F.col("cluster_no").cast("long"))


# --- JSON fields ---------------------------------------------------------------

@register("json_kv", f"""SELECT event_id, i::BIGINT AS pos, ks[i] AS key, {O.kv_val('qv[i]', 'rv[i]')} AS value
FROM (SELECT event_id, ks, qv, rv, unnest(range(1, len(ks) + 1)) AS i
      FROM (SELECT event_id, {O.kv_cols('props')} FROM events))""")
def q_json_kv(spark, sf_dir):
    from ..functions.jsonfields import json_pairs

    e = table(spark, sf_dir, "events").select("event_id", F.posexplode(json_pairs("props")).alias("p", "kv"))
    return e.select("event_id", (F.col("p") + 1).cast("long").alias("pos"),
                    F.col("kv.k").alias("key"), F.col("kv.v").alias("value"))


@register("json_wide", f"""SELECT event_id, {O.lookup(('k',), None)} AS k
FROM (SELECT event_id, {O.kv_list()} AS kv FROM (SELECT event_id, {O.kv_cols('props')} FROM events))""")
def q_json_wide(spark, sf_dir):
    from ..functions.jsonfields import json_aliased

    e = table(spark, sf_dir, "events")
    return e.select("event_id", json_aliased("props", {"k": (("k",), None)})["k"].alias("k"))


_LL = O.log_lines_cte()


@register("json_string", f"""WITH {_LL}
SELECT line_no, CASE WHEN regexp_matches(raw_line, {O.q(O.field_pat('string', 'service'))})
  THEN {O.unesc_str(f"regexp_extract(raw_line, {O.q(O.field_pat('string', 'service'))}, 1)")} END AS service
FROM log_lines""")
def q_json_string(spark, sf_dir):
    from ..functions.jsonfields import json_string

    return load_log_lines(spark, sf_dir).select("line_no", json_string("raw_line", "service").alias("service"))


@register("json_number", f"""SELECT event_id, NULLIF(regexp_extract(props, {O.q(O.field_pat('number', 'k'))}, 1), '') AS k_text,
  TRY_CAST(NULLIF(regexp_extract(props, {O.q(O.field_pat('number', 'k'))}, 1), '') AS DOUBLE) AS k_value
FROM events""")
def q_json_number(spark, sf_dir):
    from ..functions.jsonfields import json_number_text

    e = table(spark, sf_dir, "events").select("event_id", json_number_text("props", "k").alias("k_text"))
    return e.select("event_id", "k_text", F.col("k_text").try_cast("double").alias("k_value"))


_ARR_INNER = (f"CASE WHEN regexp_matches(raw_line, {O.q(O.field_pat('array', 'tags'))}) "
              f"THEN regexp_extract(raw_line, {O.q(O.field_pat('array', 'tags'))}, 1) ELSE '' END")


@register("json_string_array", f"""WITH {_LL}
SELECT line_no, array_to_string(arr, '|') AS tags, len(arr)::BIGINT AS n_tags FROM (
  SELECT line_no, list_transform(regexp_extract_all({_ARR_INNER}, {O.q('"(' + O.QSTR + ')"')}, 1),
         lambda s: replace(replace(s, '\\"', '"'), '\\\\', '\\')) AS arr FROM log_lines)""")
def q_json_string_array(spark, sf_dir):
    from ..functions.jsonfields import json_string_array

    ll = load_log_lines(spark, sf_dir).select("line_no", json_string_array("raw_line", "tags").alias("arr"))
    return ll.select("line_no", F.array_join("arr", "|").alias("tags"), F.size("arr").cast("long").alias("n_tags"))


@register("rows_to_json", f"""SELECT o_orderkey, '{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
  ',"o_orderstatus":"' || {O.esc_full('o_orderstatus')} || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) ||
  ',"o_orderdate":"' || {O.iso_local('o_orderdate')} || '","o_orderpriority":"' ||
  {O.esc_full('o_orderpriority')} || '"}}' AS json FROM orders""")
def q_rows_to_json(spark, sf_dir):
    from ..functions.jsonfields import rows_to_json

    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", rows_to_json(o).alias("json"))


_NESTED = f"""'{{"ts":' || coalesce('"' || {O.iso_local('ts')} || '"', 'null') || ',"who":{{"user":' || user_id || ',"name":' ||
  CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || {O.esc_full('event_type')} || '"' END || '}},"tags":[' ||
  CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"' || {O.esc_full('props')} || '"' END || ',"x"],"by":{{"k\\"1":' || (value > 50) ||
  '}},"raw":"' || to_base64(encode(event_type)) || '","none":null}}'"""


@register("nested_to_json", f"SELECT event_id, {_NESTED} AS json FROM (SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + to_microseconds(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 120000 WHEN 2 THEN 123456 ELSE 1 END) END AS ts) FROM events)")
def q_nested_to_json(spark, sf_dir):
    """Fractions of seconds, NULLs inside structs and arrays, maps, binary."""
    from ..functions.jsonfields import rows_to_json

    e = table(spark, sf_dir, "events")
    micros = F.expr("CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 120000 WHEN 2 THEN 123456 ELSE 1 END")
    ts = F.when(F.col("event_id") % 11 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1e6).cast("decimal(18,6)")))
    rows = e.select(
        "event_id", ts.alias("ts"),
        F.struct(F.col("user_id").alias("user"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("name")).alias("who"),
        F.array(F.when(F.col("event_id") % 2 != 0, F.col("props")), F.lit("x")).alias("tags"),
        F.create_map(F.lit('k"1'), F.col("value") > 50).alias("by"),
        F.encode("event_type", "UTF-8").alias("raw"), F.lit(None).cast("string").alias("none"))
    return rows.select("event_id", rows_to_json(rows.drop("event_id")).alias("json"))


_PAIRS = "'{\"k\":1,' || substr(props, 2, length(props) - 2) || ',\"a\":\" x\",\"k\":\"null\",\"a\":\"y' || event_id || '\"}'"


@register("json_repeated_keys", f"""SELECT event_id, {O.lookup(('k',), 'none')} AS k, {O.lookup(('a',), None)} AS a, {O.lookup(('z', 'a'), None)} AS za
FROM (SELECT event_id, {O.kv_list()} AS kv FROM (SELECT event_id, {O.kv_cols('p')} FROM (SELECT event_id, {_PAIRS} AS p FROM events)))""")
def q_json_repeated_keys(spark, sf_dir):
    """Several keys, repeated: the last value counts, also a null one."""
    from ..functions.jsonfields import json_aliased

    e = table(spark, sf_dir, "events").selectExpr("event_id", _PAIRS.replace('\\"', '"') + " AS p")
    f = json_aliased("p", {"k": (("k",), "none"), "a": (("a",), None), "za": (("z", "a"), None)})
    return e.select("event_id", f["k"].alias("k"), f["a"].alias("a"), f["za"].alias("za"))


_LENIENT = ("concat(CAST(2020 + event_id % 5 AS {t}), '-', lpad(CAST(1 + event_id % 13 AS {t}), 2, '0'), '-', lpad(CAST(26 + event_id % 7 AS {t}), 2, '0'),"
            " CASE WHEN event_id % 2 = 0 THEN 'T' ELSE ' ' END, lpad(CAST(22 + event_id % 4 AS {t}), 2, '0'), CASE event_id % 3 WHEN 0 THEN ':00:00' WHEN 1 THEN ':00:01' ELSE ':00:00.000' END)")


@register("parse_ts_lenient", f"""SELECT event_id, txt, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND (h < 24 OR (h = 24 AND s LIKE ':00:00%')) THEN
  CAST(make_date(y, m, 1) + CAST(least(d, day(last_day(make_date(y, m, 1)))) - 1 AS INTEGER) AS TIMESTAMP) + to_hours(h) + to_seconds(CAST(substr(s, 5, 2) AS INTEGER)) END AS ts
FROM (SELECT event_id, txt, CAST(substr(txt, 1, 4) AS INTEGER) AS y, CAST(substr(txt, 6, 2) AS INTEGER) AS m, CAST(substr(txt, 9, 2) AS INTEGER) AS d,
  CAST(substr(txt, 12, 2) AS INTEGER) AS h, substr(txt, 14) AS s FROM (SELECT event_id, {_LENIENT.format(t='VARCHAR')} AS txt FROM events))""")
def q_parse_ts_lenient(spark, sf_dir):
    """Days that a month lacks, hour 24 and months and days beyond the calendar."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", _LENIENT.format(t="STRING") + " AS txt")
    return e.select("event_id", "txt", ing.parse_ts("txt").alias("ts"))


# --- payload sources ---------------------------------------------------------------

@register("payload_split_lines", """SELECT doc_id, i::BIGINT AS line_no, parts[i] AS raw_line FROM (
  SELECT doc_id, parts, unnest(range(1, last + 1)) AS i FROM (
    SELECT doc_id, parts, coalesce(list_max(list_transform(range(1, len(parts) + 1),
           lambda i: CASE WHEN length(parts[i]) > 0 THEN i ELSE 0 END)), 0) AS last
    FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS parts FROM documents)))""")
def q_payload_split_lines(spark, sf_dir):
    from ..sources.logs import split_payload

    d = table(spark, sf_dir, "documents")
    return split_payload(d, "text", "doc_id").select("doc_id", "line_no", "raw_line")


@register("payload_blank_reject", f"SELECT doc_id, NOT {O.is_blank('text')} AS accepted FROM documents")
def q_payload_blank_reject(spark, sf_dir):
    from ..functions.text import is_blank

    return table(spark, sf_dir, "documents").select("doc_id", (~is_blank("text")).alias("accepted"))


@register("payload_accepted", f"SELECT doc_id FROM documents WHERE NOT {O.is_blank('text')}")
def q_payload_accepted(spark, sf_dir):
    from ..sources.logs import filter_payloads

    return filter_payloads(table(spark, sf_dir, "documents"), "text").select("doc_id")


# --- prompts, requests, replies -------------------------------------------------------

_TOP = """top AS (SELECT m.cluster_no, row_number() OVER (PARTITION BY m.cluster_no ORDER BY e.source, e.line_no) AS n,
  e.line_no, e.raw_line FROM members m JOIN log_entries e ON e.id = m.id QUALIFY n <= {fixed_k}),
prompts AS (SELECT c.cluster_no, '{header}' || string_agg('[' || t.n || '] ' || t.raw_line || chr(10), '' ORDER BY t.n)
  || CASE WHEN c.size > {fixed_k} THEN '{more}' ELSE '' END
  || '{footer}' AS prompt FROM clusters c JOIN top t ON t.cluster_no = c.cluster_no GROUP BY c.cluster_no, c.size)"""
_MORE = fixed.PROMPT_MORE.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{n}", f"' || (c.size - {fixed.MAX_LINES_PER_CLUSTER}) || '")
_TOP = _TOP.format(more=_MORE, fixed_k=fixed.MAX_LINES_PER_CLUSTER, header=fixed.PROMPT_HEADER.replace("'", "''").replace("\n", "' || chr(10) || '"),
                   footer=fixed.PROMPT_FOOTER.replace("'", "''").replace("\n", "' || chr(10) || '"))


def _sample(spark, sf_dir):
    from ..operators.prompts import sample_lines

    return sample_lines(clustering(spark, sf_dir).assigned)


@register("cluster_top20", f"""WITH RECURSIVE {O.clusters_cte()}, {_TOP}
SELECT cluster_no::BIGINT AS cluster_no, n::BIGINT AS n, line_no, raw_line FROM top""")
def q_cluster_top20(spark, sf_dir):
    s = _sample(spark, sf_dir)
    return s.select(F.col("cluster_no").cast("long").alias("cluster_no"), "n", "line_no", "raw_line")


@register("prompt_table", f"""WITH RECURSIVE {O.clusters_cte()}, {_TOP}
SELECT cluster_no::BIGINT AS cluster_no, prompt FROM prompts""")
def q_prompt_table(spark, sf_dir):
    from ..operators.prompts import build_prompts

    p = build_prompts(_sample(spark, sf_dir), clustering(spark, sf_dir).clusters)
    return p.select(F.col("cluster_no").cast("long").alias("cluster_no"), "prompt")


@register("request_table", f"""WITH RECURSIVE {O.clusters_cte()}, {_TOP}
SELECT cluster_no::BIGINT AS cluster_no,
  '{{"model":"{fixed.DEFAULT_MODEL}","max_tokens":{fixed.MAX_TOKENS},"messages":[{{"role":"user","content":"' || {O.esc_full('prompt')} || '"}}]}}' AS request
FROM prompts""")
def q_request_table(spark, sf_dir):
    from ..operators.prompts import build_prompts, build_requests

    p = build_prompts(_sample(spark, sf_dir), clustering(spark, sf_dir).clusters)
    r = build_requests(p)
    return r.select(F.col("cluster_no").cast("long").alias("cluster_no"), "request")


_TEXT_PAT = O.q('"text"' + O.JS + "*:" + O.JS + '*"(' + O.QSTR + ')"')
_RESP = """'{"content":[{"type":"text","text":"' || """ + O.esc_full("text") + """ || '"}],"role":"' || role || '"}'"""
_REPLY_TEXT = f"CASE WHEN regexp_matches(resp, {_TEXT_PAT}) THEN {O.unesc_reply(f'regexp_extract(resp, {_TEXT_PAT}, 1)')} END"


def _reply_parse_sql(src: str, keys: str) -> str:
    """Parse reply texts ``rt`` of ``src`` (columns ``keys``) into the four fields."""
    cleaned = O.jtrim(f"replace(replace(rt, {O.q(fixed.CODE_FENCES[0])}, ''), {O.q(fixed.CODE_FENCES[1])}, '')")
    pre, er, mr, d = fixed.HEURISTIC_PREFIX, fixed.EMPTY_REPLY, fixed.MALFORMED_REPLY, fixed.REPLY_DEFAULTS
    return f"""(
SELECT {keys}, CASE WHEN {O.is_blank('rt')} THEN {O.q(pre + er[0])}
         WHEN NOT ok THEN {O.q(pre + mr[0])} ELSE {O.lookup(('errorPattern',), d['errorPattern'])} END AS error_pattern,
       CASE WHEN {O.is_blank('rt')} THEN {O.q(er[1])} WHEN NOT ok THEN rt
         ELSE {O.lookup(('rootCause',), d['rootCause'])} END AS root_cause,
       CASE WHEN {O.is_blank('rt')} THEN {O.q(er[2])} WHEN NOT ok THEN {O.q(mr[1])}
         ELSE {O.lookup(('fixSuggestion',), d['fixSuggestion'])} END AS fix_suggestion,
       CASE WHEN {O.is_blank('rt')} OR NOT ok THEN 0.0 ELSE
         (CASE WHEN isnan(cf) THEN cf ELSE greatest(0.0, least(1.0, cf)) END) END AS confidence_score
FROM (SELECT *, {O.kv_list()} AS kv,
        coalesce(TRY_CAST({O.jtrim(O.lookup(('confidenceScore',), str(d['confidenceScore'])).replace('kv', O.kv_list()))} AS DOUBLE), 1.0) AS cf
      FROM (SELECT *, {O.kv_cols('blk')} FROM (
        SELECT *, CASE WHEN ok THEN substr(cl, st, en - st + 1) END AS blk FROM (
          SELECT *, st > 0 AND has_close AND en >= st AS ok FROM (
            SELECT *, strpos(cl, '{{') AS st, regexp_matches(cl, '[}}]') AS has_close,
                   length(regexp_extract(cl, '(?s)^(.*)[}}]', 1)) + 1 AS en
            FROM (SELECT *, {cleaned} AS cl FROM {src})))))))"""


@register("reply_text", f"""SELECT conv_id, turn, {_REPLY_TEXT} AS reply_text
FROM (SELECT conv_id, turn, {_RESP} AS resp FROM conversations)""")
def q_reply_text(spark, sf_dir):
    from ..functions.text import json_escape_full
    from ..operators.prompts import reply_text

    c = table(spark, sf_dir, "conversations")
    resp = F.concat(F.lit('{"content":[{"type":"text","text":"'), json_escape_full("text"),
                    F.lit('"}],"role":"'), F.col("role"), F.lit('"}'))
    return c.select("conv_id", "turn", reply_text(resp).alias("reply_text"))


@register("reply_parsed", f"""SELECT conv_id, turn, error_pattern, root_cause, fix_suggestion, round(confidence_score, 6) AS confidence_score
FROM {_reply_parse_sql(f"(SELECT conv_id, turn, {_REPLY_TEXT} AS rt FROM (SELECT conv_id, turn, {_RESP} AS resp FROM conversations))", 'conv_id, turn')}""")
def q_reply_parsed(spark, sf_dir):
    from ..functions.text import json_escape_full
    from ..operators.prompts import parse_reply, reply_text

    c = table(spark, sf_dir, "conversations")
    resp = F.concat(F.lit('{"content":[{"type":"text","text":"'), json_escape_full("text"),
                    F.lit('"}],"role":"'), F.col("role"), F.lit('"}'))
    p = c.select("conv_id", "turn", parse_reply(reply_text(resp)).alias("p"))
    return p.select("conv_id", "turn", "p.error_pattern", "p.root_cause", "p.fix_suggestion",
                    F.round("p.confidence_score", 6).alias("confidence_score"))


_FORMS = "[" + ", ".join(O.q(f) for f in REPLY_FORMS) + "]"


def _form_text(no: str) -> str:
    """The reply form of row ``no`` around the whole ``text``."""
    words = "regexp_replace(text, '[\\x00-\\x1F\"\\\\{}`]', ' ', 'g')"
    return f"replace({_FORMS}[({no} % {len(REPLY_FORMS)}) + 1], '{{t}}', {words})"


_BODY = """'{{"content":[{{"type":"text","text":"' || {esc} || '"}}],"role":"assistant"}}'"""


@register("reply_parsed_json", f"""SELECT conv_id, turn, error_pattern, root_cause, fix_suggestion, round(confidence_score, 6) AS confidence_score
FROM {_reply_parse_sql(f"(SELECT conv_id, turn, {_REPLY_TEXT} AS rt FROM (SELECT conv_id, turn, {_BODY.format(esc=O.esc_full('f'))} AS resp FROM (SELECT conv_id, turn, {_form_text('(conv_id + turn)')} AS f FROM conversations)))", 'conv_id, turn')}""")
def q_reply_parsed_json(spark, sf_dir):
    """Every form of reply that the parser tells apart."""
    from ..operators.prompts import parse_reply, reply_body, reply_form, reply_text

    c = table(spark, sf_dir, "conversations")
    body = reply_body(reply_form(F.col("conv_id") + F.col("turn"), "text"))
    p = c.select("conv_id", "turn", parse_reply(reply_text(body)).alias("p"))
    return p.select("conv_id", "turn", "p.error_pattern", "p.root_cause", "p.fix_suggestion",
                    F.round("p.confidence_score", 6).alias("confidence_score"))


_REPLIES = f"""replies AS (SELECT cluster_no, {_BODY.format(esc=O.esc_full('f'))} AS resp
  FROM (SELECT cluster_no, {_form_text('cluster_no')} AS f
        FROM (SELECT text, row_number() OVER (ORDER BY conv_id, turn, text) AS cluster_no FROM conversations WHERE role = 'assistant')))"""


def _resolved_sql(results: str, empty: str = "false") -> str:
    """Results ``results`` with replies ``got``; ``empty`` marks clusters without entries."""
    pick = lambda c: f"CASE WHEN {empty} OR g.cluster_no IS NULL THEN r.{c} ELSE g.{c} END"
    return f"""SELECT r.cluster_no, r.log_entry_id, CASE WHEN {empty} THEN 'empty' WHEN g.cluster_no IS NULL THEN 'rules' ELSE 'reply' END AS source,
  {pick('error_pattern')} AS error_pattern, {pick('root_cause')} AS root_cause, {pick('fix_suggestion')} AS fix_suggestion,
  round({pick('confidence_score')}, 6) AS confidence_score, r.size
FROM {results} r LEFT JOIN got g ON g.cluster_no = r.cluster_no"""


_GOT = f"got AS {_reply_parse_sql(f'(SELECT cluster_no, {_REPLY_TEXT} AS rt FROM replies)', 'cluster_no')}"


def _resolved(df):
    return df.select(F.col("cluster_no").cast("long").alias("cluster_no"), "log_entry_id", "source", "error_pattern",
                     "root_cause", "fix_suggestion", F.round("confidence_score", 6).alias("confidence_score"), "size")


@register("rca_resolved", f"""WITH RECURSIVE {O.clusters_cte()}, {_REPLIES}, res AS ({_RES_SQL}), {_GOT}
{_resolved_sql('res')}""")
def q_rca_resolved(spark, sf_dir):
    from ..operators.prompts import replies_from_conversations
    from .analyze import resolve

    c = clustering(spark, sf_dir).clusters
    return _resolved(resolve(c, replies_from_conversations(table(spark, sf_dir, "conversations"))))


_CALLER = """SELECT conv_id + 1 AS cluster_no, 'Cluster-' || (conv_id + 1) AS cluster_label,
  CASE WHEN conv_id % 5 <> 3 THEN 'c' || conv_id END AS rep_id, text AS rep_message, CASE WHEN conv_id % 4 = 1 THEN 0 ELSE turn + 1 END AS size
FROM conversations WHERE turn = 0"""
_NONE = "(size = 0 OR rep_id IS NULL)"
_CALLER_RES = ", ".join(
    f"CASE WHEN {_NONE} THEN {empty} ELSE {O.rule_case('rep_message', fixed.RULES, fixed.DEFAULT_RULE, k)} END AS {name}"
    for k, (name, empty) in enumerate([
        ("error_pattern", O.q(fixed.HEURISTIC_PREFIX + fixed.EMPTY_CLUSTER[1])), ("root_cause", O.q(fixed.EMPTY_CLUSTER[2])),
        ("fix_suggestion", O.q(fixed.EMPTY_CLUSTER[3])), ("confidence_score", f"CAST({fixed.EMPTY_CLUSTER[4]} AS DOUBLE)")], 1))


@register("rca_caller_clusters", f"""WITH {_REPLIES}, own AS ({_CALLER}), res AS (SELECT cluster_no, {_NONE} AS none,
  cluster_label || ':' || CASE WHEN {_NONE} THEN {O.q(fixed.EMPTY_CLUSTER[0])} ELSE rep_id END AS log_entry_id, {_CALLER_RES}, size FROM own), {_GOT}
{_resolved_sql('res', 'r.none')}""")
def q_rca_caller_clusters(spark, sf_dir):
    """Clusters made by the caller, some of them without entries, with replies for some."""
    from ..operators.prompts import replies_from_conversations
    from .analyze import resolve

    conv = table(spark, sf_dir, "conversations")
    own = conv.where("turn = 0").selectExpr(
        "conv_id + 1 AS cluster_no", "concat('Cluster-', conv_id + 1) AS cluster_label",
        "CASE WHEN conv_id % 5 <> 3 THEN concat('c', conv_id) END AS rep_id", "text AS rep_message",
        "CAST(CASE WHEN conv_id % 4 = 1 THEN 0 ELSE turn + 1 END AS BIGINT) AS size")
    return _resolved(resolve(own, replies_from_conversations(conv)))


# --- sinks and reports --------------------------------------------------------------

def _results(spark, sf_dir):
    from .analyze import heuristic_results

    return heuristic_results(clustering(spark, sf_dir).clusters)


_JSON_OBJ = """'{"errorPattern":"' || """ + O.esc("coalesce(error_pattern, '')") + """ || '","rootCause":"' || """ + \
    O.esc("coalesce(root_cause, '')") + """ || '","fixSuggestion":"' || """ + O.esc("coalesce(fix_suggestion, '')") + \
    """ || '","confidenceScore":' || CAST(confidence_score AS VARCHAR) || '}'"""


@register("results_json", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no, {_JSON_OBJ} AS json FROM ({_RES_SQL})""")
def q_results_json(spark, sf_dir):
    from ..sources.sinks import results_to_json

    return results_to_json(_results(spark, sf_dir))


@register("results_json_pages", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT ((cluster_no - 1) // 1000)::BIGINT AS page_no, count(*) AS n_results,
  '[' || string_agg({_JSON_OBJ}, ',' ORDER BY cluster_no) || ']' AS json
FROM ({_RES_SQL}) GROUP BY 1""")
def q_results_json_pages(spark, sf_dir):
    from ..sources.sinks import results_json_pages

    return results_json_pages(_results(spark, sf_dir), page_size=1000)


@register("results_json_small_pages", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT size % 2 AS parity, ((cluster_no - 1) // 50)::BIGINT AS page_no, count(*) AS n_results,
  '[' || string_agg({_JSON_OBJ}, ',' ORDER BY cluster_no) || ']' AS json
FROM ({_RES_SQL}) GROUP BY ALL""")
def q_results_json_small_pages(spark, sf_dir):
    """Several pages, for each of two groups."""
    from ..sources.sinks import results_json_pages

    r = _results(spark, sf_dir).withColumn("parity", F.col("size") % 2)
    return results_json_pages(r, page_size=50, group_cols=("parity",))


#: A given time of analysis, so that reports can be compared.
_AT = "timestamp_ntz'2024-05-06 07:08:09.25'"


@register("report_rows", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT cluster_no, 'Cluster ' || cluster_no || ' of ' || (SELECT count(*) FROM clusters) AS heading,
  coalesce(error_pattern, 'N/A') AS pattern, coalesce(root_cause, 'N/A') AS root_cause,
  coalesce(fix_suggestion, 'N/A') AS fix_suggestion, printf('%.0f%%', confidence_score * 100) AS confidence,
  '2024-05-06T07:08:09.250' AS analyzed_at
FROM ({_RES_SQL})""")
def q_report_rows(spark, sf_dir):
    from ..sources.sinks import report_rows

    return report_rows(_results(spark, sf_dir).withColumn("analyzed_at", F.expr(_AT)))


@register("stage_stats", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT (SELECT count(*) FROM log_lines) AS lines, (SELECT count(*) FROM log_entries) AS entries,
  (SELECT count(DISTINCT t) FROM vec) AS vectors, (SELECT count(*) FROM tpl) AS templates,
  (SELECT count(*) FROM tedges) AS edges, (SELECT count(*) FROM clusters) AS clusters,
  (SELECT count(*) FROM clusters WHERE c IS NULL) AS singleton_clusters""")
def q_stage_stats(spark, sf_dir):
    from ..operators.stats import stage_stats

    return stage_stats(load_log_lines(spark, sf_dir), clustering(spark, sf_dir))


@register("alerts", f"""WITH RECURSIVE {O.clusters_cte()},
mx AS (SELECT m.cluster_no, max(e.level = 'FATAL')::INT AS f, max(e.level = 'ERROR')::INT AS er, max(e.level = 'WARN')::INT AS w,
  string_agg(DISTINCT e.service, ',' ORDER BY e.service) AS svcs
  FROM members m JOIN log_entries e ON e.id = m.id GROUP BY m.cluster_no)
SELECT r.cluster_no, CASE WHEN f = 1 THEN 'CRITICAL' WHEN er = 1 THEN 'HIGH' WHEN w = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  r.error_pattern AS summary, coalesce(svcs, '') AS affected_services, r.root_cause AS llm_summary
FROM ({_RES_SQL}) r JOIN mx ON mx.cluster_no = r.cluster_no""")
def q_alerts(spark, sf_dir):
    from ..operators.alerts import build_alerts

    c = clustering(spark, sf_dir)
    a = build_alerts(_results(spark, sf_dir), c.assigned)
    return a.select(F.col("cluster_no").cast("long").alias("cluster_no"), "severity", "summary",
                    F.array_join("affected_services", ",").alias("affected_services"), "llm_summary")


# --- declared-only: dedupe, sliding windows, approximate pairs ----------------------

@register("dedupe_entries", f"""WITH {O.entries_cte()},
et AS (SELECT *, {O.template_expr('message')} AS template FROM log_entries)
SELECT level, service, template, f.source AS source, f.line_no AS line_no, f.id AS id, dup_count FROM (
  SELECT level, service, template, min({{'s': source, 'l': line_no, 'id': id}}) AS f0, count(*) AS dup_count
  FROM et GROUP BY level, service, template) x, LATERAL (SELECT f0.s AS source, f0.l AS line_no, f0.id AS id) f""")
def q_dedupe_entries(spark, sf_dir):
    from ..functions.text import message_template
    from ..operators.dedupe import dedupe

    e = _entries(spark, sf_dir).withColumn("template", message_template("message"))
    # The kept entry's id derives from its (source, line_no): nothing to fetch.
    d = dedupe(e, ["level", "service", "template"], keep=[])
    return d.select("level", "service", "template", "source", "line_no", ing.entry_id().alias("id"), "dup_count")


@register("sliding_template_counts", f"""WITH {O.entries_cte()},
et AS (SELECT ts, {O.template_expr('message')} AS t FROM log_entries),
w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS ws, ts, t
      FROM et, range(0, 4) r(k) WHERE ts IS NOT NULL)
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, t AS template, count(*) AS n
FROM w WHERE ts < ws + INTERVAL 1 HOUR GROUP BY ws, t
UNION ALL SELECT NULL, NULL, t, count(*) FROM et WHERE ts IS NULL GROUP BY t""")
def q_sliding_template_counts(spark, sf_dir):
    from ..streaming.stream import untimed_template_counts, windowed_template_counts

    e = _entries(spark, sf_dir)
    return windowed_template_counts(e, "1 hour", "15 minutes").unionByName(untimed_template_counts(e))


@register("dedupe_within", f"""WITH {O.entries_cte()},
g AS (SELECT level, service, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
      FROM log_entries WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY level, service ORDER BY ts)),
b AS (SELECT level, service, ts, sum(new) OVER (PARTITION BY level, service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT level, service, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS dup_count FROM b GROUP BY level, service, no
UNION ALL SELECT level, service, NULL, NULL, count(*) FROM log_entries WHERE ts IS NULL GROUP BY ALL""")
def q_dedupe_within(spark, sf_dir):
    from ..operators.dedupe import dedupe_within

    return dedupe_within(_entries(spark, sf_dir), ["level", "service"], "30 minutes")


@register("approx_template_pairs", f"""WITH RECURSIVE {O.clusters_cte()}
SELECT ta AS template_a, tb AS template_b, round(cosine, 6) AS cosine FROM tedges""")
def q_approx_template_pairs(spark, sf_dir):
    """Approximate pairs with a designed recall of 0.9999: a pair is missed
    less often than the planes are drawn anew."""
    from ..operators.similarity import similar_pairs_approx

    c = clustering(spark, sf_dir)
    p = similar_pairs_approx(c.vectors, "vkey", "vector", fixed.SIMILARITY_THRESHOLD, recall=0.9999)
    t = c.templates.select("vkey", "template")
    e = p.join(t.withColumnRenamed("vkey", "i").withColumnRenamed("template", "ti"), "i").join(
        t.withColumnRenamed("vkey", "j").withColumnRenamed("template", "tj"), "j")
    return e.select(F.least("ti", "tj").alias("template_a"), F.greatest("ti", "tj").alias("template_b"),
                    F.round("cosine", 6).alias("cosine"))


@register("heuristic_rca_rule_table", f"""WITH {O.entries_cte()}
SELECT {O.rule_case('message', fixed.RULES, fixed.DEFAULT_RULE, 1)} AS error_pattern,
       {O.rule_case('message', fixed.RULES, fixed.DEFAULT_RULE, 4)} AS confidence_score,
       count(*) AS n
FROM log_entries GROUP BY 1, 2""")
def q_heuristic_rca_rule_table(spark, sf_dir):
    from ..operators.rca import classify_with_rule_table, rules_table

    e = classify_with_rule_table(_entries(spark, sf_dir), rules_table(spark))
    return e.groupBy("error_pattern", "confidence_score").agg(F.count(F.lit(1)).alias("n"))


APPROX_THRESHOLD = 0.15


@register("approx_pairs_quality", f"""WITH RECURSIVE {O.clusters_cte()}, p AS (SELECT * FROM {_EMB_COS.format(cond='a.vec_id < b.vec_id')})
SELECT 'embeddings' AS vectors, count(*) AS n_exact, 0::BIGINT AS n_false, true AS recall_reached FROM p WHERE cosine >= {APPROX_THRESHOLD}
UNION ALL SELECT 'templates', count(*), 0, true FROM tedges""")
def q_approx_pairs_quality(spark, sf_dir):
    """The approximate pairs of all log templates, and of a table with thousands
    of pairs, against the exact ones: none may be false, and nine in ten must
    be found."""
    from ..operators.similarity import approx_quality, similar_pairs_approx

    e, c = table(spark, sf_dir, "embeddings"), clustering(spark, sf_dir)
    of_e = similar_pairs_approx(e, "vec_id", "embedding", APPROX_THRESHOLD, recall=0.92, bits=6, count=True)
    of_t = similar_pairs_approx(c.vectors, "vkey", "vector", c.threshold, recall=0.9999, count=True)
    q = approx_quality(e, of_e, "vec_id", "embedding", APPROX_THRESHOLD).select(F.lit("embeddings").alias("vectors"), "*").unionByName(
        approx_quality(c.vectors, of_t, "vkey", "vector", c.threshold, c.block_size, c.n_templates).select(F.lit("templates").alias("vectors"), "*"))
    return q.select("vectors", "n_exact", "n_false", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("recall_reached"))


# --- file scan, empty input, deduplicated vectors, escalations ---------------------

FILES = 16


@register("file_lines", f"""WITH {O.log_lines_cte()}
SELECT line_no % {FILES} AS file, row_number() OVER (PARTITION BY line_no % {FILES} ORDER BY line_no) AS line_no, raw_line FROM log_lines""")
def q_file_lines(spark, sf_dir):
    """The lines written as text files and scanned with their numbers."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..sources.logs import read_log_lines, write_lines

    path = os.path.join(checkpoint_dir(spark), f"lines-{uuid.uuid4().hex}")
    write_lines(load_log_lines(spark, sf_dir), path, F.col("line_no") % FILES)
    got = read_log_lines(spark, f"{path}/file=*")
    return got.select(F.regexp_extract("source", "file=([0-9]+)/", 1).cast("long").alias("file"), "line_no", "raw_line")


@register("rca_of_rejected", f"""WITH {O.parsed_cte()}
SELECT count(*) AS lines, 0::BIGINT AS entries, 0::BIGINT AS results FROM parsed WHERE branch IS NULL""")
def q_rca_of_rejected(spark, sf_dir):
    """An analysis of lines none of which can be parsed is empty."""
    from .analyze import analyze

    bad = _parsed(spark, sf_dir).where("branch IS NULL").select("source", "line_no", "raw_line")
    n = lambda df: df.select(F.count(F.lit(1))).scalar()
    return bad.agg(F.count(F.lit(1)).alias("lines")).select("lines", n(ing.ingest(bad)).alias("entries"), n(analyze(bad)).alias("results"))


@register("embed_deduped", ORACLES["embed_sparse"])
def q_embed_deduped(spark, sf_dir):
    """Vectors made once for each different template."""
    from ..operators.features import embed, sparse_cells

    v = embed(table(spark, sf_dir, "documents"), "doc_id", "text", dedupe=True)
    return sparse_cells(v, "doc_id").select("doc_id", F.col("k").cast("long").alias("k"), F.round(F.col("value").cast("double"), 6).alias("value"))


_RANK = "CASE level " + " ".join(f"WHEN '{lv}' THEN {len(fixed.SEVERITY_BY_LEVEL) - k}" for k, (lv, _) in enumerate(fixed.SEVERITY_BY_LEVEL)) + " ELSE 0 END"
_SEVERITY = "CASE r " + " ".join(f"WHEN {len(fixed.SEVERITY_BY_LEVEL) - k} THEN '{s}'" for k, (_, s) in enumerate(fixed.SEVERITY_BY_LEVEL)) + " END"


@register("alert_escalations", f"""WITH {O.entries_cte()},
t AS (SELECT service, ts, {_RANK} AS r FROM log_entries WHERE ts IS NOT NULL),
g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY service ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM t WHERE r > 0),
b AS (SELECT *, sum(new) OVER (PARTITION BY service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
one AS (SELECT service, no, ts, max(r) AS r FROM b GROUP BY ALL),
told AS (SELECT *, coalesce(max(r) OVER (PARTITION BY service, no ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one)
SELECT service, ts AS at, {_SEVERITY} AS severity FROM told WHERE r > before""")
def q_alert_escalations(spark, sf_dir):
    """One alert for each rise of a service's severity."""
    from ..operators.alerts import escalations

    return escalations(_entries(spark, sf_dir), "service", "30 minutes")


_OWN_RULES = ((5, "tide"), (5, "quay"), (3, "customs"), (4, "of"), (4, "crane"), (9, ""), (2, "ñ"), (1, "no such word"), (4, "ce"))


@register("rca_own_rules", f"""WITH {O.entries_cte()},
rules(priority, keyword) AS (VALUES {', '.join(f"({p}, {O.q(k)})" for p, k in _OWN_RULES)}),
best AS (SELECT e.id, min(r.priority) AS p FROM log_entries e LEFT JOIN rules r ON contains(lower(coalesce(e.message, '')), r.keyword) GROUP BY e.id)
SELECT '[Heuristic] P' || p AS error_pattern, p / 10 AS confidence_score, count(*) AS n FROM best GROUP BY ALL""")
def q_rca_own_rules(spark, sf_dir):
    """A rule table of the caller's, with short, missing and empty keywords."""
    from ..operators.rca import classify_with_rule_table

    rules = spark.createDataFrame([(p, k, f"P{p}", "c", "f", p / 10) for p, k in _OWN_RULES],
                                  "priority int, keyword string, pattern string, root_cause string, fix_suggestion string, confidence double")
    e = classify_with_rule_table(_entries(spark, sf_dir), rules)
    return e.groupBy("error_pattern", "confidence_score").agg(F.count(F.lit(1)).alias("n"))
