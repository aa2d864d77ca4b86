"""Source trees: finding Python files, parsing them and taking functions and methods out."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.dataset import path_allowed, path_order

OUTCOME = "file_path string, outcome string, error_type string, message string, n_units long"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_files(spark: SparkSession, root: str, repository: str = "") -> DataFrame:
    """(repository, file_path, content) of the files that a scan takes; content is read only for those. A missing root gives none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or fs.getFileStatus(path).isFile():
        return spark.createDataFrame([], "repository string, file_path string, content binary")
    base = fs.resolvePath(path).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    rel = F.substr("path", F.instr(F.col("path"), base.split(":", 1)[-1].lstrip("/")) + len(base.split(":", 1)[-1].lstrip("/")))
    # Spark plans no task for files without bytes; their names are taken from the listing
    blank, found = [], fs.listFiles(path, True)
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(".py"):
            blank.append((f.getPath().toString(), bytearray()))
    files = files.select("path", "content").unionByName(spark.createDataFrame(blank, "path string, content binary"))
    return files.select(F.lit(repository).alias("repository"), rel.alias("file_path"), "content").filter(path_allowed(F.col("file_path")))


def in_path_order(files: DataFrame) -> DataFrame:
    return files.orderBy(path_order(F.col("file_path")))


def _imports(tree: ast.Module) -> list[str]:
    out: list[str] = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            out.extend(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append(node.module)
    return out


def _candidates(tree: ast.Module) -> Iterator[tuple[ast.AST, str | None, list[str]]]:
    """Functions of the module and methods of its classes, in page order, with their class and the other methods' names."""
    for node in tree.body:
        if isinstance(node, _FUNCTIONS):
            yield node, None, []
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, _FUNCTIONS)]
            for m in methods:
                yield m, node.name, [x.name for x in methods if x.name != m.name]


def _non_blank(text: str) -> int:
    return sum(1 for line in text.splitlines() if line.strip())


def parse_file(content: bytes) -> tuple[list[dict], str, str]:
    """Units of one file, and the class and message of the error that stopped it. A byte order mark is an error."""
    try:
        source = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return [], "UnicodeDecodeError", str(e)
    source = source.replace("\r\n", "\n").replace("\r", "\n")  # as text files are read
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, TypeError):
        return [], "SyntaxError", "the file can't be parsed"
    except RecursionError as e:
        return [], "RecursionError", str(e)
    lines, module_doc, imports = source.splitlines(keepends=True), ast.get_docstring(tree), _imports(tree)
    units = []
    for node, owner, others in _candidates(tree):
        name = node.name
        if name.startswith("_") and not name.startswith("__"):
            continue
        first = (node.decorator_list[0] if node.decorator_list else node).lineno
        code = "".join(lines[first - 1 : node.end_lineno or node.lineno])
        if 3 <= _non_blank(code) <= 100:
            units.append(
                {
                    "symbol": f"{owner}.{name}" if owner else name,
                    "symbol_type": "method" if owner else "function",
                    "source_code": code,
                    "context": {"class_name": owner, "module_docstring": module_doc or None, "imports": imports, "parent_methods": others},
                    "first_line": first,
                    "docstring": ast.get_docstring(node) or "",
                    "source_file_lines": len(lines),
                    "content_hash": hashlib.sha256(code.strip().encode()).hexdigest(),
                }
            )
    return units, "", ""


_UNIT = pa.struct(
    [
        ("symbol", pa.string()), ("symbol_type", pa.string()), ("source_code", pa.string()),
        ("context", pa.struct([("class_name", pa.string()), ("module_docstring", pa.string()), ("imports", pa.list_(pa.string())), ("parent_methods", pa.list_(pa.string()))])),
        ("first_line", pa.int64()), ("docstring", pa.string()), ("source_file_lines", pa.int64()), ("content_hash", pa.string()),
    ]
)
_UNIT_DDL = "struct<symbol:string,symbol_type:string,source_code:string,context:struct<class_name:string,module_docstring:string,imports:array<string>,parent_methods:array<string>>,first_line:long,docstring:string,source_file_lines:long,content_hash:string>"


def parsed(files: DataFrame) -> DataFrame:
    """(repository, file_path, units, error_type, message), one row per file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse_file(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.list_(_UNIT)), pa.array([x[1] for x in got]), pa.array([x[2] for x in got])], names=["repository", "file_path", "units", "error_type", "message"])

    return files.select("repository", "file_path", "content").mapInArrow(run, f"repository string, file_path string, units array<{_UNIT_DDL}>, error_type string, message string")


def units_of(files: DataFrame, base_url: str = "", extracted_at: str | None = None) -> DataFrame:
    """Code units with their id, ordered by nothing; `position` orders them within a file."""
    at = extracted_at or datetime.now(timezone.utc).isoformat()
    u = files.select("repository", "file_path", F.posexplode("units").alias("position", "u"))
    return u.select(
        X.unit_id(F.col("repository"), F.col("file_path"), F.col("u.symbol"), F.col("u.content_hash")).alias("id"),
        "repository", F.lit("python").alias("language"), "file_path", "u.symbol", "u.symbol_type", "u.source_code", "u.context",
        X.source_url(F.lit(base_url), F.col("file_path"), F.col("u.first_line")).alias("source_url"),
        F.lit(True).alias("is_public"), "u.docstring", "u.source_file_lines", "u.content_hash", F.lit(at).alias("extracted_at"), "position",
    )


def outcomes(files: DataFrame) -> DataFrame:
    """What became of each file: units, empty or parse_error."""
    n = F.size("units").cast("long")
    kind = F.when(F.col("error_type") != "", "parse_error").when(n == 0, "empty").otherwise("units")
    return files.select("file_path", kind.alias("outcome"), "error_type", "message", n.alias("n_units"))
