"""Secret scan in built-in functions alone: three base patterns, and sliding-window entropy on candidate strings.

Positions come from splitting a text by the pattern that also extracts the matches: pieces and matches
alternate, so running lengths give every start. The entropy of a window of w characters is
log2(w) - sum(c * log2 c) / w over its character counts c; moving on by one character changes two counts, and
the sum follows by two table look-ups in exact integers (millionths).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Runs are maximal, so a lower limit in the pattern keeps just the matches that the open pattern keeps afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<s:int,o:int,kind:string,e:int>>"


@dataclass(frozen=True)
class CharClass:
    """Candidates that `pattern` matches are flagged from `bits` of entropy in some window of `window` characters."""

    name: str
    pattern: str
    window: int
    bits: float


@dataclass(frozen=True)
class SecretScan:
    """The first class that fits a candidate decides; candidates that the allow-list matches are suppressed.

    The allow-list holds regular expressions: documentation keys, alphabets and digit runs in order, UUIDs, slash or
    dash separated plain words.
    """

    classes: tuple[CharClass, ...] = (
        CharClass("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", 16, 2.8),
        CharClass("mixed", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 20, 3.5),
        CharClass("one case", r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])", 20, 3.4),
    )
    allow: tuple[str, ...] = field(
        default=(
            r"EXAMPLE",
            r"(?i)abcdefghij|0123456789|qwertyuiop",
            r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
            r"^[A-Za-z]+(?:[/_-][A-Za-z]+)*[/_-]?[0-9]{0,4}$",
            r"(.)\1{7,}",
        )
    )


def _spans(text: Column, pattern: str, kind: str, least_group: int | None = None) -> Column:
    """All matches as (start, order, kind, end); with least_group, group 2 must have that many characters."""
    order = KINDS.index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_group else whole
    pieces = F.split(text, pattern, -1)

    def walk(parts: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["piece"])
            end = start + F.length(x["whole"])
            span = F.struct(start.alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), end.alias("e"))
            keep = x["whole"].isNotNull() & (F.length(x["value"]) >= F.lit(least_group or 0))
            return F.struct(F.coalesce(end, start).alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(parts, empty, step, lambda acc: acc["out"])

    return walk(F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), value.alias("value")))


def least_log_sum(candidate: Column, window: int) -> Column:
    """The least sum of c * log2 c, in millionths, over all windows of a candidate of at least `window` characters."""
    f = F.array(*[F.lit(round(c * math.log2(c) * 1e6) if c else 0) for c in range(window + 2)])
    codes = F.filter(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda k: k > 0)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 60).cast("long").alias("best"))

    def slide(code: Column, table: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.get(code, i)
            old = F.when(i >= window, F.get(code, i - window)).otherwise(F.lit(0))

            def moved(new: Column, old: Column) -> Column:
                up = F.get(acc["n"], new)
                down = F.get(acc["n"], old)
                gain = F.get(table, up + 1) - F.get(table, up)
                loss = F.when(old > 0, F.get(table, down) - F.get(table, down - 1)).otherwise(F.lit(0))
                return F.when(new == old, acc["sum"]).otherwise(acc["sum"] + gain - loss)

            counts = F.transform(acc["n"], lambda x, k: x + F.when(k == new, 1).otherwise(0) - F.when((k == old) & (old > 0), 1).otherwise(0))
            now = moved(new, old).cast("long")
            return F.struct(counts.alias("n"), now.alias("sum"), F.when(i >= window - 1, F.least(acc["best"], now)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), zero, step, lambda acc: acc["best"])

    return let(codes, lambda code: let(f, lambda t: slide(code, t)))


def _is_secret(candidate: Column, p: SecretScan) -> Column:
    out = F.lit(False)
    for c in reversed(p.classes):
        limit = int((math.log2(c.window) - c.bits) * c.window * 1e6)
        out = F.when(F.rlike(candidate, F.lit(c.pattern)), least_log_sum(candidate, c.window) <= F.lit(limit)).otherwise(out)
    for pattern in p.allow:
        out = F.when(F.rlike(candidate, F.lit(pattern)), F.lit(False)).otherwise(out)
    return out


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, p: SecretScan = SecretScan(), text_col: str = "text", out: str = "secret") -> DataFrame:
    """docs and one struct column `out` (base, extra: arrays of (s, o, kind, e)) sorted by start, then kind.

    `extra` has entropy spans that overlap no base span. Positions count code points, ends are exclusive. A null or
    empty text has none. The work is per row: no shuffle, nothing depends on other rows or columns.
    """
    text, names = free_name(docs, "whole_text"), {}
    none = F.array().cast(SPAN)
    d = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    t = F.col(text)
    for kind, column in (
        ("assign", F.when(t.rlike(ASSIGN_HINT), _spans(t, ASSIGN, "assign", 6)).otherwise(none)),
        ("access", F.when(t.contains("AKIA"), _spans(t, ACCESS, "access")).otherwise(none)),
        ("hex", F.when(t.rlike(HEX), _spans(t, HEX, "hex")).otherwise(none)),
        # a flagged candidate has a digit
        ("entropy", F.when(t.rlike(r"[0-9]") & t.rlike(r"[A-Za-z0-9+/_-]{20}"), _candidates(t, p)).otherwise(none)),
    ):
        names[kind] = free_name(d, f"found_{kind}")
        d = d.withColumn(names[kind], column)
    base = free_name(d, "base_spans")
    d = d.withColumn(base, F.sort_array(F.concat(names["assign"], names["access"], names["hex"])))
    extra = F.filter(F.col(names["entropy"]), lambda x: ~F.exists(F.col(base), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return d.withColumn(out, F.struct(F.col(base).alias("base"), extra.alias("extra"))).drop(text, base, *names.values())


def _candidates(text: Column, p: SecretScan) -> Column:
    spans = _spans_with_text(text, CANDIDATE)
    secret = F.filter(spans, lambda x: _is_secret(x["text"], p))
    return F.transform(secret, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("entropy")).alias("o"), F.lit("entropy").alias("kind"), x["e"].alias("e")))


def _spans_with_text(text: Column, pattern: str) -> Column:
    kind = "array<struct<s:int,e:int,text:string>>"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("s"), end.alias("e"), x["whole"].alias("text"))
        # letters alone are never flagged, and most candidates are long words
        keep = x["whole"].isNotNull() & F.rlike(x["whole"], F.lit("[0-9]"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def digest(found: DataFrame, out: str = "secret", id_col: str = "doc_id") -> DataFrame:
    """Counts, a digest of the base spans and all spans as text, one row per row."""
    base, extra = F.col(out)["base"], F.col(out)["extra"]

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        F.col(id_col).alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_told(base), 256).alias("base_sha256"),
        _told(F.sort_array(F.concat(base, extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_entropy"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_secrets": op3_secrets}
