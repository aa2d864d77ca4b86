"""Extraction from source trees."""

import hashlib

from corvane.plans import jobs
from corvane.sources import code

SIMPLE = "def add(a, b):\n    total = a + b\n    return total\n"
MODULE = '''"""Module text."""
import os
import a.b, c
from x.y import z
from . import q

@deco
def decorated(x):
    """Doc."""

    return x


async def later(x):
    y = x
    return y


def _private(x):
    y = x
    return y


def short(): return 1


class Box:
    def __init__(self):
        self.a = 1
        self.b = 2

    def __mangled(self):
        a = 1
        return a

    def _hidden(self):
        a = 1
        return a

    @staticmethod
    def make():
        def inner():
            a = 1
            return a
        return inner

    class Deep:
        def never(self):
            a = 1
            return a


if True:
    def guarded():
        a = 1
        return a
'''


def tree(tmp_path):
    files = {
        "a-b.py": SIMPLE, "a/b.py": MODULE, "tests/c.py": SIMPLE, "pkg/test_d.py": SIMPLE, "pkg/e_test.py": SIMPLE, "x.egg-info/f.py": SIMPLE, "g.txt": SIMPLE,
        "bad.py": "def f(:\n", "empty.py": "", "long.py": "def f():\n" + "    x = 1\n" * 101, "edge.py": "def f():\n" + "    x = 1\n\n" * 99, "bom.py": "﻿" + SIMPLE, "latin.py": None, "vendor/h.py": SIMPLE,
    }
    for name, text in files.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x = '\xe9'\n" if text is None else text.encode())
    return str(tmp_path / "repo")


def test_scan_and_extract(spark, tmp_path):
    root = tree(tmp_path)
    files = code.python_files(spark, root, "r1")
    assert [r.file_path for r in code.in_path_order(files).collect()] == ["a/b.py", "a-b.py", "bad.py", "bom.py", "edge.py", "empty.py", "latin.py", "long.py"]
    parsed = code.parsed(files)
    out = {r.file_path: (r.outcome, r.error_type) for r in code.outcomes(parsed).collect()}
    assert out == {"a/b.py": ("units", ""), "a-b.py": ("units", ""), "bad.py": ("parse_error", "SyntaxError"), "bom.py": ("parse_error", "SyntaxError"), "edge.py": ("units", ""), "empty.py": ("empty", ""), "latin.py": ("parse_error", "UnicodeDecodeError"), "long.py": ("empty", "")}
    units = {r.symbol: r for r in code.units_of(parsed, "https://host/x/").filter("file_path = 'a/b.py'").collect()}
    assert sorted(units) == ["Box.__init__", "Box.__mangled", "Box.make", "decorated", "later"]
    u = units["decorated"]
    assert u.source_code.startswith("@deco\n") and u.docstring == "Doc." and u.source_url == "https://host/x/blob/main/a/b.py#L7"
    assert u.context.imports == ["os", "a.b", "c", "x.y"] and u.context.module_docstring == "Module text." and u.symbol_type == "function"
    digest = hashlib.sha256(u.source_code.strip().encode()).hexdigest()
    assert u.content_hash == digest and u.id == f"r1_py_a_b_py__decorated_{digest[:12]}"
    assert units["Box.make"].context.class_name == "Box" and units["Box.make"].context.parent_methods == ["__init__", "__mangled", "_hidden"]
    assert code.python_files(spark, root + "/none").count() == 0


def test_build_dataset(spark, tmp_path):
    root = tree(tmp_path)
    roots = [{"id": "r1", "path": root, "split": "train"}, {"id": "r2", "path": root, "split": "test"}]
    row = jobs.build_dataset(spark, roots, str(tmp_path / "out")).first()
    assert (row.extracted, row.duplicates, row.total, row.train, row.test) == (14, 7, 7, 7, 0) and row.splits_add_up and row.extraction_adds_up
    assert spark.read.json(str(tmp_path / "out/splits")).count() == 7
