"""Quality rules in built-in functions alone, with cutoffs chosen under a proven risk.

A rule rejects a document when a feature exceeds a cutoff, and a document goes if any rule rejects it. For each stratum, sets of
cutoffs are tested in a fixed order: all rules together go down a fixed grid from the most lenient cutoff on, one rule a
step, so that each set rejects whatever the one before does. The null hypothesis "this set rejects more than `risk` of the good
documents" is dismissed when the exact binomial tail P(Bin(n, risk) <= k) is at most the stratum's error level, n and k being
the good labelled documents and those of them that the set rejects. Testing stops at the first set that fails:
fixed-sequence testing needs no correction along the steps, and as it is whole sets that are tested, neither level nor risk is
shared among the rules. Among the strata the level is shared by their numbers of labelled documents (weighted
Bonferroni). Within the last set that passed, any more lenient cutoff or fewer rules reject less and are as safe: of those, each
rule takes the cutoff that gains most.

All labelled documents count. What leaves the corpus is a histogram of (stratum, rule, grid step, label).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, free_name, let, table

WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs")
GRID = (5, 10, 20, 50, 100, 200, 300, 400, 500, 600, 700, 800, 900)


@dataclass(frozen=True)
class Quality:
    """At most `risk` of the good documents of a stratum are rejected by its cutoffs, with confidence 1 - `error` for all strata.

    max_strata bounds the strata whose cutoffs go into the plan as literals; with more of them, the cutoffs are joined.
    """

    risk: float = 0.02
    error: float = 0.05
    stratum: str = "lang"
    max_strata: int = 500


def _rules(f: Column) -> dict[str, Column]:
    """Features per thousand words (per thousand lines of words for repeated lines it is n_words too), as integers."""
    words = F.greatest(f["n_words"], F.lit(1))
    return {
        "symbols": F.floor(1000 * f["n_symbols"] / words),
        "repeats": F.floor(1000 * f["n_repeat_words"] / words),
        "lines": F.floor(10000 * f["n_dup_lines"] / words),
        "bangs": F.floor(1000 * f["n_bangs"] / words),
    }


RULES = ("symbols", "repeats", "lines", "bangs")
#: The histogram's name for all rules together, and the number of sets that are tested.
SET, STEPS = "all of them", len(GRID) * len(RULES)


def _repeat_words(hashes: Column) -> Column:
    """Words in 5-word windows that occur twice or more. Windows are told apart by 64-bit hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(pairs: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1)["h"], F.get(pairs, i + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n"), (x + WINDOW).alias("end")), lambda a: a["n"])

    def count(w: Column) -> Column:
        paired = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(paired, covered)).otherwise(F.lit(0))

    return F.when(F.size(hashes) >= WINDOW, let(hashes, lambda h: let(windows(h), count))).otherwise(F.lit(0))


def with_features(docs: DataFrame, out: str = "quality", text_col: str = "text") -> DataFrame:
    """docs and a struct column `out` of FEATURES (long). A null text has no words: all features are 0."""
    text, words = free_name(docs, "whole_text"), free_name(docs, "text_words")
    d = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    t = F.col(text)
    bare = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    d = d.withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP)))
    w = F.col(words)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    repeated = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": repeated,
        "n_repeat_words": _repeat_words(F.transform(w, lambda x: F.xxhash64(x))),
        "n_bangs": F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!"), F.lit(""))),
    }
    features = F.struct(*[counts[k].cast("long").alias(k) for k in FEATURES])
    # out of a generator, the features are computed once: filters and projections that use them can't be merged with it
    return d.drop(out).withColumn(out, F.explode(F.array(features))).drop(text, words)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def _tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), by logarithms; 1 where k is at least the mean, which can't be small."""

    def term(acc: Column, i: Column) -> Column:
        at = acc["at"] + F.log(n - i + 1) - F.log(i.cast("double")) + F.log(F.lit(risk / (1 - risk)))
        top = F.greatest(acc["sum"], at)
        return F.struct(at.alias("at"), (top + F.log1p(F.exp(F.least(acc["sum"], at) - top))).alias("sum"))

    first = n * F.log(F.lit(1 - risk))
    sum_ = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("at"), first.alias("sum")), term, lambda a: F.exp(a["sum"]))
    return F.when(k >= n * risk, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(sum_)


def cutoffs(docs: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_good_rejected, n_bad_rejected, tail) of the cutoffs that are proven to be safe; see cutoffs_of()."""
    stratum = [p.stratum] if p.stratum in docs.columns else []
    return cutoffs_of(with_features(docs.select(id_col, *stratum, text_col), "f", text_col), labels, p, id_col, "f")


def _stratum(df: DataFrame, p: Quality) -> Column:
    return F.col(p.stratum).cast("string") if p.stratum in df.columns else F.lit("all")


def cutoffs_of(featured: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", out: str = "quality") -> DataFrame:
    """cutoffs() of a table that has its features already, in the column `out`.

    The counts are those of the rule by itself, the tail that of the whole set which was proven safe. A cutoff that rejects no more bad documents
    than good ones isn't used, and a rule without another has no row; of cutoffs that gain as much (bad ones less good ones) the
    most lenient is taken. A label table that names a document twice counts it once, as bad if either says so. Labels
    other than 0 and 1 and null ids are left out; a null stratum is a stratum of its own.
    """
    truth = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good")).filter("good in (0, 1) and id is not null").groupBy("id").agg(F.min("good").alias("good"))
    f = F.col(out)
    rows = featured.filter(~base_failed(f)).select(F.col(id_col).cast("long").alias("id"), _stratum(featured, p).alias("stratum"), *[v.cast("long").alias(k) for k, v in _rules(f).items()])
    rows = rows.join(truth, "id")
    # a document of step s is rejected by a rule's s most severe cutoffs: those at grid places 0 to s-1
    step = {k: sum((F.when(F.col(k) > c, 1).otherwise(0) for c in GRID), F.lit(0)) for k in RULES}
    # and of the sets from the one that adds the most lenient of these cutoffs on; STEPS if from none
    first = F.least(*[F.when(s > 0, (len(GRID) - s) * len(RULES) + r).otherwise(STEPS) for r, s in enumerate(step.values())])
    steps = F.array(*[F.struct(F.lit(k).alias("rule"), s.alias("step")) for k, s in step.items()], F.struct(F.lit(SET).alias("rule"), first.alias("step")))
    bins = rows.select("stratum", "good", F.explode(steps).alias("x")).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.step").alias("step")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    bins = cut(bins)  # a row per stratum, rule and step

    sets = bins.filter(F.col("rule") == SET)
    labelled = sets.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 0
    tested = sets.select("stratum", "step", "good", "bad", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("place")).groupBy("stratum", "place").agg(
        F.sum("good").alias("n_good"),
        F.sum(F.when(F.col("step") <= F.col("place"), F.col("good")).otherwise(0)).alias("rejected"),
        F.sum(F.col("good") + F.col("bad")).alias("n"),
    )
    tested = tested.withColumn("tail", _tail(F.col("n_good"), F.col("rejected"), p.risk))
    passed = F.col("tail") <= F.lit(p.error) * F.col("n") / F.lit(max(1, labelled))
    lenient_first = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # STEPS rows
    safe = tested.withColumn("safe", F.min(passed.cast("int")).over(lenient_first)).filter("safe = 1")
    safe = safe.groupBy("stratum").agg(F.max("place").alias("last"), F.max_by("tail", "place").alias("tail"))

    single = bins.filter(F.col("rule") != SET).select("stratum", "rule", "step", "good", "bad", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("place"))
    single = single.groupBy("stratum", "rule", "place").agg(
        F.sum("good").alias("n_good"),
        F.sum(F.when(F.col("step") > F.col("place"), F.col("good")).otherwise(0)).alias("n_good_rejected"),
        F.sum(F.when(F.col("step") > F.col("place"), F.col("bad")).otherwise(0)).alias("n_bad_rejected"),
    )
    number = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule")) - 1
    single = single.withColumn("from", (len(GRID) - 1 - F.col("place")) * len(RULES) + number).join(safe.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")))
    best = single.filter("`from` <= last and n_bad_rejected > n_good_rejected").groupBy("stratum", "rule").agg(
        F.max_by(F.struct("place", "n_good", "n_good_rejected", "n_bad_rejected", "tail"), F.struct(F.col("n_bad_rejected") - F.col("n_good_rejected"), F.col("place"))).alias("x")
    )
    return best.select("stratum", "rule", F.element_at(F.array(*map(F.lit, GRID)), F.col("x.place") + 1).alias("cutoff"), "x.n_good", "x.n_good_rejected", "x.n_bad_rejected", "x.tail")


def judge(docs: DataFrame, chosen: DataFrame, p: Quality = Quality(), text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with the struct `out` of FEATURES, base_failed and kept."""
    return judged(with_features(docs, out, text_col), chosen, p, out)


def judged(d: DataFrame, chosen: DataFrame, p: Quality = Quality(), out: str = "quality") -> DataFrame:
    """judge() of a table that has its features already, in the column `out`.

    A stratum that has cutoffs has at least log(error)/log(1-risk) labelled documents, and a row of `chosen` for each rule at
    most; up to max_strata of them become literals of the plan.
    """
    f, rules = F.col(out), _rules(F.col(out))
    stratum = _stratum(d, p)
    rows = chosen.select("stratum", "rule", "cutoff").limit(p.max_strata * len(RULES) + 1).collect()
    if len(rows) <= p.max_strata * len(RULES):
        broken = F.lit(False)
        for r in sorted(rows, key=lambda r: (r.stratum or "", r.rule)):
            broken = broken | (stratum.eqNullSafe(F.lit(r.stratum)) & (rules[r.rule] > r.cutoff))
        extra: list[str] = []
    else:
        key, limits = free_name(d, "cutoff_stratum"), free_name(d, "cutoff_limits")
        wide = chosen.groupBy(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null")).alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(limits))
        d = d.withColumn(key, F.coalesce(F.concat(F.lit("="), stratum), F.lit("null"))).join(wide, key, "left")
        broken = F.lit(False)
        for k in RULES:
            broken = broken | F.coalesce(rules[k] > F.try_element_at(F.col(limits), F.lit(k)), F.lit(False))
        extra = [key, limits]
    failed = base_failed(f)
    return d.withColumn(out, F.struct(*[f[k].alias(k) for k in FEATURES], failed.alias("base_failed"), (~failed & ~broken).alias("kept"))).drop(*extra)


def passing(docs: DataFrame, labels: DataFrame, p: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the base rules and the cutoffs from `labels` keep.

    The cutoffs come from features that are stored without the texts. For the verdict they are computed once more: that costs less memory than to store and
    read the texts with them, and no disk.
    """
    out = free_name(docs, "quality")
    stratum = [p.stratum] if p.stratum in docs.columns else []
    featured = cut(with_features(docs.select(id_col, *stratum, text_col), "f", text_col).drop(text_col))
    kept = judge(docs, cutoffs_of(featured, labels, p, id_col, "f"), p, text_col, out).filter(F.col(out)["kept"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document; cutoffs from all labels. Features are computed once and stored without the texts."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    featured = cut(with_features(docs.select("doc_id", "lang", "text")).drop("text"))
    d = judged(featured, cutoffs_of(featured, labels))
    q = F.col("quality")
    return d.select("doc_id", *[q[k].alias(k) for k in FEATURES[:5]], q["base_failed"].alias("base_failed"), q["kept"].alias("kept"))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_quality": op4_quality}
