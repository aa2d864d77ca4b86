"""Column functions that agree with Python's string methods, character by character."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.split() and str.strip() take for white space.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The same white space for RE2, which has no Unicode mode, in DuckDB SQL.
SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def word_count(text: Column) -> Column:
    """len(text.split())"""
    return F.size(F.filter(F.split(text, rf"(?U){SPACE}+"), lambda x: x != ""))


def line_count(text: Column) -> Column:
    """Lines with more than white space."""
    return F.size(F.filter(F.split(text, LINE_BREAK), lambda x: strip(x) != ""))


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def symbol_path(class_name: Column, function: Column) -> Column:
    return F.concat_ws(".", class_name, function)


def unit_id(repository: Column, file_path: Column, symbol: Column, digest: Column) -> Column:
    """repository_py_path__symbol_hash, path and symbol with underscores, the first 12 digits of the hash."""
    return F.concat(repository, F.lit("_py_"), F.translate(file_path, "\\/.", "___"), F.lit("__"), F.translate(symbol, ".", "_"), F.lit("_"), F.substr(digest, F.lit(1), F.lit(12)))


def candidate_id(unit: Column) -> Column:
    return F.concat(F.lit("candidate_"), unit)


def source_url(base: Column, file_path: Column, line: Column) -> Column:
    """Link to a line on the main branch; empty without a base."""
    return F.when(F.coalesce(base, F.lit("")) == "", "").otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/blob/main/"), file_path, F.lit("#L"), line.cast("string")))


def py_round(x: Column, digits: int) -> Column:
    """round(x, digits) of Python for up to 6 digits: half to even on the binary value, so that 2.675, which is a bit less, gives 2.67.

    bround() goes by the decimal rendering. Here the part behind the point is an integer in units of 2^-62 (of 2^-73 below 2^-10), which
    hold all of its bits, and the rest is exact arithmetic.
    """
    ten = 10**digits

    def rounded(size: Column) -> Column:
        small, whole = size < 2.0**-10, F.floor(size)
        # twice this is one
        half = F.when(small, F.lit(Decimal(1 << 72)).cast("decimal(23,0)")).otherwise(F.lit(1 << 61).cast("decimal(23,0)"))
        fine = (size - whole) * F.when(small, 2.0**73).otherwise(2.0**62)

        def put_together(scaled: Column, one: Column) -> Column:
            def decided(up: Column) -> Column:
                rest = (scaled - up * one).cast("decimal(38,0)") * 2
                below = (whole.cast("decimal(20,0)") * F.lit(ten).cast("decimal(7,0)")).cast("decimal(38,0)") + up
                more = (rest > one) | ((rest == one) & (below % 2 == 1))
                return ((below + F.when(more, 1).otherwise(0)).cast("decimal(31,0)") / F.lit(ten).cast("decimal(7,0)")).cast("double")

            return _let(F.floor(scaled / one).cast("decimal(8,0)"), decided)

        scaled = (F.floor(fine).cast("decimal(38,0)") * F.lit(ten).cast("decimal(7,0)")).cast("decimal(38,0)")
        return _let(F.struct(scaled.alias("scaled"), (half * 2).cast("decimal(24,0)").alias("one")), lambda v: put_together(v["scaled"], v["one"]))

    def signed(value: Column) -> Column:
        size = F.abs(value)
        return F.when(size < 2.0**52, _let(size, rounded) * F.when(value < 0, -1.0).otherwise(1.0)).otherwise(value)

    return _let(x.cast("double"), signed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that is computed once and used in several places."""
    return F.element_at(F.transform(F.array(value), body), 1)


def size_gb(size: Column) -> Column:
    return py_round(size / F.lit(1024.0**3), 2)


def ns_to_ms(ns: Column) -> Column:
    return py_round(ns / F.lit(1e6), 1)


def percent_change(before: Column, after: Column) -> Column:
    """Null where there is nothing to compare with."""
    return F.when(before != 0, (after - before) / before * 100)


#: What gives a query's source away, as patterns of Python's re module, in any case. They also name the leaks found.
LEAKS: tuple[str, ...] = (
    r"\.py\b",
    r"\.java\b",
    r"\.js\b",
    r"\.ts\b",
    r"github\.com",
    r"gitlab\.com",
    r"bitbucket\.org",
    r"\brepo\d+\b",
    r"\btest_\w+\.py\b",
    r"\w+_test\.py\b",
)
_W = r"[\p{L}\p{N}_]"


def java_pattern(python: str) -> str:
    """A pattern of the kind in LEAKS with the word borders, letters and digits of Python's re module, for Java's."""
    out = re.sub(r"\\b(?=\\|$)", lambda m: rf"(?!{_W})" if m.end() == len(python) else m[0], python)
    out = re.sub(r"^\\b", lambda m: rf"(?<!{_W})", out)
    return "(?iu)" + out.replace(r"\w", _W).replace(r"\d", r"\p{Nd}")


def leak_violations(query: Column, repository: Column, file_path: Column, symbol: Column) -> Column:
    """The leaks found: patterns in any case, then the unit's own names as they are written; empty names are skipped."""
    found = [F.when(F.rlike(query, F.lit(java_pattern(p))), F.lit(p)) for p in LEAKS]
    found += [F.when((F.coalesce(c, F.lit("")) != "") & F.contains(query, c), F.lit(k)) for k, c in (("repository", repository), ("file path", file_path), ("symbol", symbol))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
