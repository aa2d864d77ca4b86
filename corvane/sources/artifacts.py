"""JSON-lines artifacts: strict scans that tell where a file is broken, repair of torn ends, and verbatim copies.

Lines come from Spark's text reader, which splits files; where a line stands is known by its block and its place in the task's
reading, so errors count their line's number only when there are any. The repair of a torn end looks at the end of a
file alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

TAIL = 1 << 16


class BrokenArtifact(ValueError):
    """An artifact can't be read as it is."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


#: Where a line stands: sorting by this gives the order of the files and of the lines in each.
PLACE = "struct<file:string,block:bigint,row:bigint>"


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value) of all lines, blank ones too; none if the path doesn't exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"place {PLACE}, value string")
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(place.alias("place"), "value")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the lines that aren't blank; none if the path doesn't exist."""
    return placed_lines(spark, path).select("place.file", "value").filter(strip(F.col("value")) != "")


def file_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines path with their `place`, so that the first of them can be told."""
    lines = placed_lines(spark, path).filter(strip(F.col("value")) != "")
    return lines.select("place", F.from_json("value", schema).alias("r")).select("r.*", "place")


def _is_object(value: Column) -> Column:
    """Whether a text is one JSON object, by the strict parser."""
    return F.coalesce(F.json_object_keys(value).isNotNull(), F.lit(False)) & F.coalesce(F.get_json_object(value, "$").isNotNull(), F.lit(False))


def record_shape(value: Column) -> Column:
    """Why a line is no record, else null: an object with a non-empty text code_unit_id and a boolean success is needed."""
    unit = F.get_json_object(value, "$.code_unit_id")
    typed = F.from_json(value, "code_unit_id string, success boolean", {"mode": "PERMISSIVE"})
    quoted = F.rlike(value, F.lit(r'"code_unit_id"\s*:\s*"'))
    return (
        F.when(~_is_object(value), "not a JSON object")
        .when(F.coalesce(unit, F.lit("")) == "", "no code_unit_id")
        .when(~quoted, "code_unit_id is no text")
        .when(typed["success"].isNull() | F.rlike(value, F.lit(r'"success"\s*:\s*"')), "success is no boolean")
    )


def strict_records(spark: SparkSession, path: str, schema: T.StructType, keep_raw: bool = False) -> DataFrame:
    """Records of a JSON-lines path; the first broken lines are an error. keep_raw: the line itself as column `raw`."""
    placed = placed_lines(spark, path)
    lines = placed.filter(strip(F.col("value")) != "").withColumn("wrong", record_shape(F.col("value")))
    bad = lines.filter("wrong is not null").select("place", "wrong", F.substr("value", F.lit(1), F.lit(80)).alias("start")).orderBy("place").limit(5).collect()
    if bad:
        before = [F.count_if((F.col("place.file") == r.place.file) & (F.col("place") <= F.struct(*[F.lit(x).alias(k) for k, x in r.place.asDict().items()]))) for r in bad]
        numbers = placed.agg(*[n.alias(str(k)) for k, n in enumerate(before)]).first()
        raise BrokenArtifact("; ".join(f"{r.place.file}:{n}: {r.wrong}: {r.start!r}" for r, n in zip(bad, numbers, strict=True)))
    rows = lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias("raw"))
    return rows.select("r.*", *["raw"] * keep_raw)


def load_store(spark: SparkSession, successes: str, failures: str, schema: T.StructType, keep_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both artifacts of a store. A unit twice in one, a wrong outcome, or a unit in both is an error."""
    a, b = strict_records(spark, successes, schema, keep_raw), strict_records(spark, failures, schema, keep_raw)
    for name, df, outcome in (("successes", a, True), ("failures", b, False)):
        wrong = df.filter(F.col("success") != outcome).select("code_unit_id").orderBy("code_unit_id").limit(5).collect()
        if wrong:
            raise BrokenArtifact(f"{name}: other outcome: {', '.join(r[0] for r in wrong)}")
        twice = df.groupBy("code_unit_id").agg(F.count("*").alias("n")).filter("n > 1").orderBy("code_unit_id").limit(5).collect()
        if twice:
            raise BrokenArtifact(f"{name}: repeated: {', '.join(r[0] for r in twice)}")
    both = a.select("code_unit_id").intersect(b.select("code_unit_id")).orderBy("code_unit_id").limit(5).collect()
    if both:
        raise BrokenArtifact(f"in both artifacts: {', '.join(r[0] for r in both)}")
    return a, b


def repair_torn_end(spark: SparkSession, path: str) -> int:
    """Cut what follows the last line end of a file that doesn't end in one, as a write that died leaves it; returns the bytes cut.

    A broken line in the middle stays, for the strict scan to refuse.
    """
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return 0
    size = fs.getFileStatus(p).getLen()
    end, keep = size, None
    while end > 0 and keep is None:
        start = max(0, end - TAIL)
        stream = fs.open(p)
        try:
            stream.seek(start)
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - start))
        finally:
            stream.close()
        if end == size and data.endswith(b"\n"):
            return 0
        at = data.rfind(b"\n")
        keep = start + at + 1 if at >= 0 else None
        end = start
    keep = keep or 0
    if keep == size:
        return 0
    draft = spark._jvm.org.apache.hadoop.fs.Path(path + ".repair")
    source, out = fs.open(p), fs.create(draft, True)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, keep)
        out.hsync()
    finally:
        source.close()
        out.close()
    fs.delete(p, False)
    fs.rename(draft, p)
    return size - keep


def verbatim_subset(spark: SparkSession, path: str, ids: DataFrame, id_of: Column) -> DataFrame:
    """Lines of a JSON-lines path, unchanged, whose id is among `ids` (one column). A missing or an ambiguous id is an error."""
    lines = raw_lines(spark, path).select("value", id_of.alias("id"))
    wanted = ids.toDF("id").distinct()
    found = lines.join(wanted, "id", "left_semi")
    n = wanted.join(found.groupBy("id").agg(F.count("*").alias("n")), "id", "left").filter("n is null or n > 1").orderBy("id").limit(5).collect()
    if n:
        raise BrokenArtifact(", ".join(f"{r.id}: {r.n or 0} rows" for r in n))
    return found.select("value")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document in a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
