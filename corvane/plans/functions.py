"""Queries that apply the library's functions to the driver's tables, where no operator's module has one of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts, structured
from ..functions import text as X
from ..operators import dataset, evaluate, runs
from ..streaming.checkpoint import PROVIDER


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Prices as bytes, nanoseconds and plain numbers, rounded as Python does."""
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", X.size_gb(F.col("o_totalprice") * 4e5).alias("size_gb"), X.ns_to_ms(F.col("o_totalprice") * 1000).alias("ms"), *[X.py_round(F.col("o_totalprice") / 8, k).alias(f"rounded_{k}") for k in (0, 1, 2, 4)], evaluate.disk_mb(F.col("o_totalprice")).alias("mb"))


def percent_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each order's price against the customer's order before; null without one or after a price of nothing."""
    o = _t(spark, d, "orders")
    before = F.lag(F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(F.col("o_totalprice"))).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select("o_orderkey", F.round(X.percent_change(before, F.col("o_totalprice")), 6).alias("percent"))


def symbol_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names of functions and methods, and links to their lines."""
    p = _t(spark, d, "part")
    owner = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    base = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("https://host/"), F.col("p_brand"), F.lit("//")))
    return p.select("p_partkey", X.symbol_path(owner, F.col("p_name")).alias("symbol"), X.source_url(base, F.col("p_type"), F.col("p_size")).alias("url"))


def path_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses in the order of paths, component by component, host by host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    w = Window.partitionBy("host").orderBy(dataset.path_order(F.col("path")), "page_id")
    return _t(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path")).select("page_id", F.row_number().over(w).cast("long").alias("place"))


def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Events' JSON inside answers of several kinds: bare, fenced, in prose, broken. The first two by SQL functions, all by the reader of answers."""
    e = _t(spark, d, "events")
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Well:\n```json\n"), F.col("props"), F.lit("\n``` done"))).when(kind == 2, F.concat(F.lit("so {"), F.col("props"))).when(kind == 3, F.concat(F.lit("then "), F.col("props"), F.lit(" and {}")))
    schema = structured.Schema((structured.Field("k", "int", least=10),))
    got = structured.validated(e.select("event_id", raw.alias("raw")), "raw", schema)
    native = structured.native_json(F.col("raw"), "k int")["k"]
    return got.select("event_id", native.alias("native_k"), F.col("answer.valid").alias("valid"), F.get_json_object("answer.data", "$.k").cast("int").alias("k"), F.substring_index(F.get("answer.errors", 0), ":", 1).alias("error"))


def corrective_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What prompts of a query generator hold for documents as units: their texts, but neither names nor places."""
    docs = _t(spark, d, "documents")
    units = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("repository"), F.lit("p").alias("file_path"), F.lit("function").alias("symbol_type"), F.coalesce("text", F.lit("")).alias("source_code"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("docstring"),
        F.struct(F.when(F.col("doc_id") % 3 == 0, "Holder").alias("class_name"), F.lit(None).cast("string").alias("module_docstring"), F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("os"), F.lit("re"))).otherwise(F.array().cast("array<string>")).alias("imports"), F.array().cast("array<string>").alias("parent_methods")).alias("context"),
    )
    asked = prompts.blind(units)
    prompts.assert_blind(asked)
    return asked.select(F.col("id").alias("doc_id"), F.md5(prompts.context_block()).alias("context"), F.contains(prompts.query_prompt(), F.col("source_code")).alias("has_code"), F.md5(F.substring_index(prompts.label_prompt(), "\n\n", -1)).isNotNull().alias("has_prompt"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of queries and relevance over customers' orders."""
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("s"))  # five priorities
    return _t(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", dataset.query_gate(F.coalesce("p", F.array().cast("array<string>"))).alias("query"), dataset.relevance_gate(F.col("s") * 1.25).alias("relevance"))


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and differences of the documents that are labelled and those in English."""
    docs, labels = _t(spark, d, "documents").filter("lang = 'en'").select("doc_id"), _t(spark, d, "labels").select("doc_id")
    sets = {"union": docs.union(labels).distinct(), "both": docs.intersect(labels), "only english": docs.subtract(labels), "only labelled": labels.subtract(docs)}
    out = None
    for name, ids in sets.items():
        one = ids.agg(F.lit(name).alias("set"), F.count("*").alias("n"), F.min("doc_id").alias("least"), F.sum("doc_id").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def bag_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three tables put together as they come, repeated ones too."""
    parts = [_t(spark, d, t).select(F.lit(t).alias("source"), F.col(c).cast("long").alias("id")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("events", "user_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources"))


def timing_sums(spark: SparkSession, d: str) -> DataFrame:
    """Generation time of each user's attempts, of all and of those that were tried again."""
    a = runs.attempt_sequence(_t(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase")
    return a.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total_ms"), F.round(F.sum(F.when(F.col("will_retry"), F.col("value"))), 6).alias("retried_ms"), F.count_if("first_success").alias("successes"))


def sibling_names(spark: SparkSession, d: str) -> DataFrame:
    """Brands as classes: each part's siblings are the other sizes of its brand."""
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    names = p.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_size")).alias("sizes"))  # fifty sizes
    return p.join(names, "p_brand").select("p_partkey", F.array_join(F.array_remove("sizes", F.col("p_size")).cast("array<string>"), ",").alias("siblings"))


def provider_failures(spark: SparkSession, d: str) -> DataFrame:
    """Which error kinds count for the breaker, event by event."""
    e = runs._events(spark, d)
    return e.select("event_id", (F.coalesce(F.col("failure_category").isin(*PROVIDER), F.lit(False)) & ~F.col("success")).alias("counts"), F.coalesce(F.col("failure_category").isin(*runs.VALIDATION), F.lit(False)).alias("retryable"))


def redacted_units(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their texts, in the order of a report."""
    return dataset.redacted(_t(spark, d, "documents"), ["text"]).orderBy("source", "doc_id")


def dataset_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Units, lines and labels by language, by source and altogether, in one pass."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left").select("lang", "source", X.line_count(F.col("text")).alias("lines"), F.length("text").alias("chars"), "quality")
    counts = [F.count("*").alias("units"), F.round(F.avg("lines"), 6).alias("avg_lines"), F.round(F.avg("chars"), 6).alias("avg_chars"), F.count("quality").alias("labelled")]
    return rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(*counts)


_F = lambda x, k: f"CAST(printf('%.{k}f', {x}) AS DOUBLE)"
_SETS = "e AS (SELECT doc_id FROM documents WHERE lang = 'en'), l AS (SELECT DISTINCT doc_id FROM labels)"
_ONE = "SELECT '{0}' AS set, count(*) AS n, min(doc_id) AS least, CAST(sum(doc_id) AS BIGINT) AS total FROM ({1})"
ORACLE = {
    "rounded_sizes": f"SELECT o_orderkey, {_F('o_totalprice * 4e5 / 1073741824.0::DOUBLE', 2)} AS size_gb, {_F('o_totalprice * 1000 / 1e6', 1)} AS ms, " + ", ".join(f"{_F('o_totalprice / 8', k)} AS rounded_{k}" for k in (0, 1, 2, 4)) + ", o_totalprice / 1000000 AS mb FROM orders",
    "percent_changes": "WITH p AS (SELECT o_orderkey, o_totalprice AS now, lag(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT o_orderkey, CASE WHEN before <> 0 THEN round((now - before) / before * 100, 6) END AS percent FROM p",
    "symbol_paths": "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand || '.' ELSE '' END || p_name AS symbol, CASE WHEN p_size % 5 <> 0 THEN 'https://host/' || p_brand || '/blob/main/' || p_type || '#L' || p_size ELSE '' END AS url FROM part",
    "path_ranks": "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages) SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY string_split(path, '/'), page_id) AS place FROM p",
    "json_answers": f"""WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT event_id, CASE WHEN event_id % 5 < 2 THEN k END AS native_k, event_id % 5 IN (0, 1, 3) AND k >= 10 AS valid, CASE WHEN event_id % 5 IN (0, 1, 3) AND k >= 10 THEN k END AS k,
        CASE WHEN event_id % 5 NOT IN (0, 1, 3) THEN 'MalformedJSONError' WHEN k < 10 THEN 'ConstraintViolationError' END AS error FROM r""",
    "corrective_prompts": """SELECT doc_id, md5(array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'Class: Holder' END, CASE WHEN doc_id % 5 <> 0 THEN 'Imports: os, re' END, CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN 'Documentation: ' || lang END], lambda x: x IS NOT NULL), chr(10))) AS context, true AS has_code, true AS has_prompt FROM documents""",
    "gates": "SELECT c_custkey, count(o_orderpriority) > 0 AS query, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE WHEN o_orderstatus IS NOT NULL THEN 0 END) * 1.25 BETWEEN 0 AND 1 AS relevance FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "id_sets": f"WITH {_SETS} " + " UNION ALL ".join(_ONE.format(n, q) for n, q in (("union", "SELECT * FROM e UNION SELECT * FROM l"), ("both", "SELECT * FROM e INTERSECT SELECT * FROM l"), ("only english", "SELECT * FROM e EXCEPT SELECT * FROM l"), ("only labelled", "SELECT * FROM l EXCEPT SELECT * FROM e"))),
    "bag_union": "SELECT id, count(*) AS rows, count(DISTINCT s) AS sources FROM (SELECT 1 AS s, o_custkey AS id FROM orders UNION ALL SELECT 2, c_custkey FROM customer UNION ALL SELECT 3, user_id FROM events) GROUP BY 1",
    "timing_sums": "WITH a AS (SELECT user_id, value, lead(1) OVER w IS NOT NULL AS again, event_type = 'purchase' AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(sum(value), 6) AS total_ms, round(sum(value) FILTER (again), 6) AS retried_ms, CAST(max(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS successes FROM a GROUP BY 1",
    "sibling_names": "WITH s AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY 1) SELECT p_partkey, array_to_string(list_filter(sizes, lambda x: x <> p_size), ',') AS siblings FROM part JOIN s USING (p_brand)",
    "provider_failures": "SELECT event_id, event_type = 'error' AND user_id % 5 IN (2, 3) AS counts, event_type = 'error' AND user_id % 5 IN (1, 4) AS retryable FROM events",
    "redacted_units": "SELECT doc_id, lang, source, n_chars FROM documents",
    "dataset_breakdown": f"SELECT lang, source, count(*) AS units, round(avg({dataset._LINES}), 6) AS avg_lines, round(avg(length(text)), 6) AS avg_chars, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())",
}
QUERIES = {
    "rounded_sizes": rounded_sizes, "percent_changes": percent_changes, "symbol_paths": symbol_paths, "path_ranks": path_ranks, "json_answers": json_answers, "corrective_prompts": corrective_prompts, "gates": gates, "id_sets": id_sets, "bag_union": bag_union,
    "timing_sums": timing_sums, "sibling_names": sibling_names, "provider_failures": provider_failures, "redacted_units": redacted_units, "dataset_breakdown": dataset_breakdown,
}
