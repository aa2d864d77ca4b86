"""Building a dataset of code units: de-duplication, splits, gates, statistics, selection and validation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import SPLITS


def first_of_each(df: DataFrame, key: Column, order: Column, keep: Iterable[str]) -> DataFrame:
    """The first row of each key by `order`, with the number of rows of the key as `copies`.

    One aggregate with map-side combining: a key with a third of all rows costs its task one row per mapper.
    """
    columns = list(keep)
    g = df.groupBy(key.alias("dedup_key")).agg(F.min_by(F.struct(*columns), order).alias("row"), F.count("*").alias("copies"))
    return g.select("dedup_key", *[F.col("row")[c].alias(c) for c in columns], "copies")


def group_stats(df: DataFrame, key: str) -> DataFrame:
    """records, unique_ids, duplicate_groups, max_multiplicity (0 if nothing repeats) and extra_records, one row."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count("*").alias("unique_ids"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.max(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("max_multiplicity"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_records"),
    )


def duplicate_sample(df: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """The first keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(key).limit(limit)


class UnknownRepository(ValueError):
    """A unit's repository isn't in the manifest."""


def assign_splits(units: DataFrame, manifest: DataFrame, key: str = "repository", check: bool = True) -> DataFrame:
    """units with their repository's split. The manifest's size decides how Spark joins; an unknown repository is an error."""
    if check:
        unknown = units.select(key).distinct().join(manifest.select(key), key, "left_anti").orderBy(key).limit(5).collect()
        if unknown:
            raise UnknownRepository(", ".join(str(r[0]) for r in unknown))
    return units.join(manifest.select(key, "split"), key)


def split_counts(units: DataFrame, key: str = "repository") -> DataFrame:
    """Units and repositories of each split; a split without units has zeros."""
    domain = units.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    n = units.groupBy("split").agg(F.count("*").alias("units"), F.count_distinct(key).alias("repositories"))
    return domain.join(n, "split", "left").select("split", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("repositories", F.lit(0)).alias("repositories"))


def shared_repositories(units: DataFrame, key: str = "repository") -> DataFrame:
    """Repositories whose units are in more than one split; none in a sound dataset."""
    return units.groupBy(key).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def count_consistency(totals: DataFrame) -> DataFrame:
    """totals (extracted, duplicates, total, train, validation, test) with both checks; the second is skipped at 0 extracted."""
    return totals.withColumn("splits_add_up", F.col("total") == F.col("train") + F.col("validation") + F.col("test")).withColumn("extraction_adds_up", (F.col("extracted") == 0) | (F.col("extracted") - F.col("duplicates") == F.col("total")))


def size_gate(lines: Column, least: int = 3, most: int = 100) -> Column:
    return lines.between(least, most)


def label_gate(description: Column, concepts: Column) -> Column:
    """20 to 256 words and two concepts at least."""
    return X.word_count(description).between(20, 256) & (F.size(concepts) >= 2)


def query_gate(relevant: Column) -> Column:
    return F.size(relevant) >= 1


def relevance_gate(score: Column) -> Column:
    return score.between(0.0, 1.0)


#: Folders that a scan leaves out.
EXCLUDED_DIRS = ("tests", "test", "vendor", "generated", ".git", "__pycache__", ".tox", "node_modules", ".eggs")


def path_allowed(path: Column) -> Column:
    """Python files outside of excluded folders that are no tests by name."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    inside = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(*EXCLUDED_DIRS) | F.endswith(x, F.lit(".egg-info")))
    return ~inside & F.endswith(name, F.lit(".py")) & ~F.startswith(name, F.lit("test_")) & ~F.endswith(name, F.lit("_test.py"))


def path_order(path: Column) -> Column:
    """Sort key: component by component, so a/b.py comes before a-b.py."""
    return F.split(path, "/")


def public_name(name: Column) -> Column:
    """Names with one leading underscore are private; dunder and mangled names are kept."""
    return ~(F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("__")))


def seed_order(unit: Column, seed: int = 42) -> Column:
    """A fixed random order of ids."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), unit.cast("string")), 256)


def select_seeded(df: DataFrame, key: str, n: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """n rows of the seeded order; with `exact`, fewer rows than that are refused. Prefixes of the order are nested."""
    out = df.orderBy(seed_order(F.col(key), seed), key).limit(n)
    if exact and out.count() < n:
        raise ValueError(f"fewer than {n} rows to choose from")
    return out


def missing_references(rows: DataFrame, refs: Column, targets: DataFrame, target: str) -> DataFrame:
    """Distinct references that no target has, with the number of rows that make them."""
    r = rows.select(refs.alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    return r.join(targets.select(F.col(target).alias("ref")).distinct(), "ref", "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side that the other lacks, counted, one row."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNull()).alias("left_only"), F.count_if(F.col("r").isNotNull() & F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def validate(checks: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(check, violations): each check is a DataFrame of offending rows."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "check string, violations long")


def training_prompt(source: Column, answer: Column, instruction: str = "Describe what this code does.") -> Column:
    return F.concat_ws("\n", F.lit("### Task"), F.lit(instruction), F.lit("### Code"), source, F.lit("### Answer"), answer)


def redacted(df: DataFrame, columns: Iterable[str] = ("source_code",)) -> DataFrame:
    """Without the columns that hold source text."""
    return df.drop(*columns)


# ---------------------------------------------------------------- queries over the driver's tables


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _manifest(docs: DataFrame) -> DataFrame:
    """Sources as repositories: the number in a source's name decides its split."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 4
    return docs.select("source").distinct().select(F.col("source").alias("repository"), F.when(n < 2, "train").when(n == 2, "validation").otherwise("test").alias("split"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "source")
    return assign_splits(docs.withColumnRenamed("source", "repository"), _manifest(docs), check=False)


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "source", X.content_hash(F.col("text")).alias("content_hash"))
    return first_of_each(docs, F.col("content_hash"), F.col("doc_id"), ["doc_id", "source"]).withColumnRenamed("dedup_key", "content_hash")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return group_stats(_t(spark, d, "documents").select(X.content_hash(F.col("text")).alias("h")), "h")


def dedup_sample(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_sample(_t(spark, d, "documents").select(X.content_hash(F.col("text")).alias("content_hash")), "content_hash")


def size_eligibility(spark: SparkSession, d: str) -> DataFrame:
    n = X.line_count(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", n.cast("long").alias("n_lines")).withColumn("eligible", size_gate(F.col("n_lines")))


def label_gate_query(spark: SparkSession, d: str) -> DataFrame:
    concepts = F.array_distinct(F.array("lang", "source"))
    return _t(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"), label_gate(F.col("text"), concepts).alias("passes"))


def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("doc_id", "repository", "split")


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return split_counts(_units(spark, d))


def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose documents, dealt out by language, come in more than one split, beside the splits by source."""
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "validation").otherwise("test")
    by_language = _t(spark, d, "documents").select(F.col("source").alias("repository"), split.alias("split"))
    return validate({"repository in two splits": shared_repositories(_units(spark, d)), "repository in two splits by language": shared_repositories(by_language)}, spark)


def count_check(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "source", X.content_hash(F.col("text")).alias("h"))
    kept = first_of_each(docs, F.col("h"), F.col("doc_id"), ["doc_id", "source"]).withColumnRenamed("source", "repository")
    kept = assign_splits(kept, _manifest(docs), check=False)
    totals = kept.agg(F.sum("copies").alias("extracted"), F.sum(F.col("copies") - 1).alias("duplicates"), F.count("*").alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return count_consistency(totals)


_SUFFIX = ["", " see .py files", " in repo12", " x .ts", " GitHub.comx", " def run(x)", " import os", " my_test.py", " on GITLAB.com", " bitbucket.org/a", " Main.java of src0 with a.js"]


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    """Queries are whole texts of documents and, by doc_id, a suffix that leaks or doesn't."""
    docs = _t(spark, d, "documents")
    chosen = F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("doc_id") % len(_SUFFIX)).cast("int") + 1)
    v = leak_columns(docs.select("doc_id", "source", F.concat("text", chosen).alias("query")))
    return v.select("doc_id", F.array_join("violations", ",").alias("violations"), (F.size("violations") == 0).alias("passed"))


def leak_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", X.leak_violations(F.col("query"), F.col("source"), F.lit(""), F.lit("core")))


def unit_ids(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", "url", X.content_hash(F.col("html")).alias("h"))
    return p.select("page_id", X.unit_id(F.lit("web"), F.col("url"), F.concat(F.lit("page."), F.col("page_id").cast("string")), F.col("h")).alias("unit_id"), X.candidate_id(F.col("h")).alias("candidate_id"), X.source_url(F.lit("https://host/"), F.col("url"), F.col("page_id")).alias("source_url"))


_TAILS = ["/test_a.py", "/b.py", "/tests/c.py", "/tests.py", "/a.egg-info/x.py", "/_private.py", "/__init__.py", "/x_test.py", "/vendored/y.py", "/z.pyc", "/vendor/y.py"]


def path_filter(spark: SparkSession, d: str) -> DataFrame:
    """Page paths, with the ends of source files, as file paths: which of them a scan would take, and whether their names are public."""
    path = F.concat(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("page_id") % len(_TAILS)).cast("int") + 1))
    p = _t(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", "path", path_allowed(F.col("path")).alias("allowed"), public_name(F.regexp_extract("path", "([^/]*)$", 1)).alias("public"))


def pending_units(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def verbatim_subset(spark: SparkSession, d: str) -> DataFrame:
    toxic = _t(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return _t(spark, d, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", "text")


def seed_selection(spark: SparkSession, d: str) -> DataFrame:
    return select_seeded(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", 45)


def train_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Nested subsets of the seeded order: the smallest size that takes a document in."""
    top = select_seeded(_t(spark, d, "documents").select("doc_id"), "doc_id", 225)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(seed_order(F.col("doc_id")), "doc_id"))  # 225 rows
    return top.withColumn("place", place).select("doc_id", F.when(F.col("place") <= 50, 50).when(F.col("place") <= 112, 112).otherwise(225).alias("subset"))


def review_sample(spark: SparkSession, d: str, n: int = 50) -> DataFrame:
    """n units of each split in seeded order, found by a bounded aggregate instead of sorting whole splits."""
    u = _units(spark, d).select("split", "doc_id", seed_order(F.col("doc_id")).alias("o"))
    from pyspark.sql import Window

    w = Window.partitionBy("split").orderBy("o", "doc_id")
    return u.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("split", "doc_id", F.col("place").cast("long").alias("place"))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    lines = X.line_count(F.col("text"))
    by = docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("units"), F.count_distinct("source").alias("repositories"), F.round(F.avg(lines), 6).alias("avg_lines"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.count("quality").alias("labelled"), F.round(F.count("quality") / F.count("*"), 6).alias("label_coverage"))
    return by


def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = _t(spark, d, "lineitem"), _t(spark, d, "orders"), _t(spark, d, "customer")
    return validate({"line without order": missing_references(li, F.col("l_orderkey"), o, "o_orderkey"), "order without customer": missing_references(o, F.col("o_custkey"), c, "c_custkey"), "order in two segments": o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderkey").agg(F.count_distinct("c_mktsegment").alias("n")).filter("n > 1")}, spark)


def relevance_coverage(spark: SparkSession, d: str) -> DataFrame:
    c, o = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return coverage(c, o, "k")


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a good label over all labelled documents, against the limit of 0.8."""
    r = _t(spark, d, "labels").agg(F.round(F.count_if(F.col("quality") > 0.5) / F.count("*"), 6).alias("ratio"))
    return r.withColumn("enough", F.col("ratio") > 0.8)


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "documents").join(_t(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return u.select("doc_id", F.md5(training_prompt(F.col("text"), F.col("lang"))).alias("prompt_md5"))


def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return validate(
        {
            "repeated id": docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"),
            "label without document": labels.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti"),
            "label out of range": labels.filter(~relevance_gate(F.col("quality").cast("double"))),
            "blank text": docs.filter(X.word_count(F.coalesce("text", F.lit(""))) == 0),
        },
        spark,
    )


_SP, _LB = X.SQL_SPACE, X.SQL_LINE_BREAK


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '\A{_SP}+|{_SP}+\z', '', 'g')"


_HASH = f"sha256({_strip('text')})"
_LINES = rf"len(list_filter(string_split_regex(text, '{_LB}'), lambda x: {_strip('x')} <> ''))"
_WORDS = rf"len(list_filter(string_split_regex(text, '{_SP}+'), lambda x: x <> ''))"
_SPLIT = "CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 < 2 THEN 'train' WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 = 2 THEN 'validation' ELSE 'test' END"
# the same in RE2, whose \\b and \\w know ASCII alone
_leaks = """CASE WHEN regexp_matches(query, '(?i)\\.py(?:$|[^\\pL\\pN_])') THEN '\\.py\\b' END,
        CASE WHEN regexp_matches(query, '(?i)\\.java(?:$|[^\\pL\\pN_])') THEN '\\.java\\b' END,
        CASE WHEN regexp_matches(query, '(?i)\\.js(?:$|[^\\pL\\pN_])') THEN '\\.js\\b' END,
        CASE WHEN regexp_matches(query, '(?i)\\.ts(?:$|[^\\pL\\pN_])') THEN '\\.ts\\b' END,
        CASE WHEN contains(lower(query), 'github.com') THEN 'github\\.com' END,
        CASE WHEN contains(lower(query), 'gitlab.com') THEN 'gitlab\\.com' END,
        CASE WHEN contains(lower(query), 'bitbucket.org') THEN 'bitbucket\\.org' END,
        CASE WHEN regexp_matches(query, '(?i)(?:^|[^\\pL\\pN_])repo\\p{Nd}+(?:$|[^\\pL\\pN_])') THEN '\\brepo\\d+\\b' END,
        CASE WHEN regexp_matches(query, '(?i)(?:^|[^\\pL\\pN_])test_[\\pL\\pN_]+\\.py(?:$|[^\\pL\\pN_])') THEN '\\btest_\\w+\\.py\\b' END,
        CASE WHEN regexp_matches(query, '(?i)[\\pL\\pN_]_test\\.py(?:$|[^\\pL\\pN_])') THEN '\\w+_test\\.py\\b' END"""

ORACLE = {
    "content_dedup": f"SELECT {_HASH} AS content_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY 1",
    "dedup_stats": f"SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(max(n) FILTER (n > 1), 0) AS max_multiplicity, CAST(sum(n - 1) AS BIGINT) AS extra_records FROM (SELECT count(*) AS n FROM documents GROUP BY {_HASH})",
    "dedup_sample": f"SELECT {_HASH} AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5",
    "size_eligibility": f"SELECT doc_id, {_LINES} AS n_lines, {_LINES} BETWEEN 3 AND 100 AS eligible FROM documents",
    "label_gate": f"SELECT doc_id, {_WORDS} AS n_words, {_WORDS} BETWEEN 20 AND 256 AND lang <> source AS passes FROM documents",
    "split_assign": f"SELECT doc_id, source AS repository, {_SPLIT} AS split FROM documents",
    "split_stats": f"SELECT s.split, count(d.doc_id) AS units, count(DISTINCT d.source) AS repositories FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN (SELECT *, {_SPLIT} AS split FROM documents) d ON d.split = s.split GROUP BY 1",
    "split_disjoint": f"""SELECT 'repository in two splits' AS "check", count(*) AS violations FROM (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT {_SPLIT}) > 1)
        UNION ALL SELECT 'repository in two splits by language', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT CASE WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END) > 1)""",
    "count_check": f"""WITH k AS (SELECT {_HASH} AS h, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY 1), t AS (SELECT CAST(sum(copies) AS BIGINT) AS extracted, CAST(sum(copies - 1) AS BIGINT) AS duplicates, count(*) AS total,
        count(*) FILTER ({_SPLIT} = 'train') AS train, count(*) FILTER ({_SPLIT} = 'validation') AS validation, count(*) FILTER ({_SPLIT} = 'test') AS test FROM k)
        SELECT *, total = train + validation + test AS splits_add_up, extracted = 0 OR extracted - duplicates = total AS extraction_adds_up FROM t""",
    "leakage_check": f"""WITH q AS (SELECT doc_id, source, text || ({_SUFFIX!r})[doc_id % 11 + 1] AS query FROM documents),
        v AS (SELECT doc_id, list_filter([{_leaks}, CASE WHEN contains(query, source) THEN 'repository' END, CASE WHEN contains(query, 'core') THEN 'symbol' END], lambda x: x IS NOT NULL) AS v FROM q)
        SELECT doc_id, array_to_string(v, ',') AS violations, len(v) = 0 AS passed FROM v""",
    "unit_ids": f"SELECT page_id, 'web_py_' || translate(url, '\\/.', '___') || '__page_' || page_id || '_' || substr(sha256({_strip('html')}), 1, 12) AS unit_id, 'candidate_' || sha256({_strip('html')}) AS candidate_id, 'https://host/blob/main/' || url || '#L' || page_id AS source_url FROM pages",
    "path_filter": rf"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || ({_TAILS!r})[page_id % {len(_TAILS)} + 1] AS path FROM pages),
        n AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[1:-2] AS folders FROM p)
        SELECT page_id, path, suffix(name, '.py') AND NOT prefix(name, 'test_') AND NOT suffix(name, '_test.py') AND NOT list_has_any(folders, ['tests', 'test', 'vendor', 'generated', '.git', '__pycache__', '.tox', 'node_modules', '.eggs'])
        AND len(list_filter(folders, lambda x: suffix(x, '.egg-info'))) = 0 AS allowed, NOT prefix(name, '_') OR prefix(name, '__') AS public FROM n""",
    "pending_units": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "verbatim_subset": "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "seed_selection": "SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 45",
    "train_subsets": "SELECT doc_id, CAST(CASE WHEN place <= 50 THEN 50 WHEN place <= 112 THEN 112 ELSE 225 END AS INT) AS subset FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 225",
    "review_sample": f"SELECT split, doc_id, place FROM (SELECT {_SPLIT} AS split, doc_id, row_number() OVER (PARTITION BY {_SPLIT} ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 50",
    "dataset_stats": f"SELECT lang, count(*) AS units, count(DISTINCT source) AS repositories, round(avg({_LINES}), 6) AS avg_lines, round(avg(n_chars), 6) AS avg_chars, count(quality) AS labelled, round(count(quality) / count(*), 6) AS label_coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "referential_integrity": """SELECT 'line without order' AS "check", count(*) AS violations FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
        UNION ALL SELECT 'order without customer', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
        UNION ALL SELECT 'order in two segments', count(*) FROM (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1)""",
    "relevance_coverage": "SELECT count(*) FILTER (o IS NULL) AS left_only, count(*) FILTER (c IS NULL) AS right_only, count(*) FILTER (o IS NOT NULL AND c IS NOT NULL) AS \"both\" FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o",
    "coverage_ratio": "SELECT round(count(*) FILTER (quality > 0.5) / count(*), 6) AS ratio, count(*) FILTER (quality > 0.5) / count(*) > 0.8 AS enough FROM labels",
    "training_rows": "SELECT doc_id, md5('### Task\nDescribe what this code does.\n### Code\n' || text || '\n### Answer\n' || lang) AS prompt_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "dataset_validation": f"""SELECT 'repeated id' AS "check", count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'label out of range', count(*) FROM labels WHERE NOT quality BETWEEN 0 AND 1
        UNION ALL SELECT 'blank text', count(*) FROM documents WHERE text IS NULL OR {_WORDS} = 0""",
}
QUERIES = {
    "content_dedup": content_dedup, "dedup_stats": dedup_stats, "dedup_sample": dedup_sample, "size_eligibility": size_eligibility, "label_gate": label_gate_query, "split_assign": split_assign, "split_stats": split_stats,
    "split_disjoint": split_disjoint, "count_check": count_check, "leakage_check": leakage_check, "unit_ids": unit_ids, "path_filter": path_filter, "pending_units": pending_units, "verbatim_subset": verbatim_subset, "seed_selection": seed_selection,
    "train_subsets": train_subsets, "review_sample": review_sample, "dataset_stats": dataset_stats, "referential_integrity": referential_integrity, "relevance_coverage": relevance_coverage, "coverage_ratio": coverage_ratio,
    "training_rows": training_rows, "dataset_validation": dataset_validation,
}
