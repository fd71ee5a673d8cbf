"""Facts of source texts in SQL: a registry of parsers, a table function over texts, and a data source that reads a tree.

A parser is a function of a text that yields (kind, line, subject); the registry names one or more for each language.
``table_function`` makes the function for ``FROM files, LATERAL code_facts(file, text)``: rows stay where they are, and a
parser travels with the function, so one that a user adds needs no change here.  A parser that raises gives a row of kind
``problem`` after what it has found; a null text and a file of no known language give none.

``TreeSource`` (format ``code_tree``) reads the files below a folder that all executors see.  The driver lists two levels
alone; each directory below them is a partition that its task walks, so listing and reading are spread over tasks and a
lost one is walked again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from .code import LANGUAGES, python_lazy, python_statements, script_lazy
from .imports import go_statements, script_statements

Parser = Callable[[str], Iterable[tuple[str, int, str | None]]]
FACT = "kind string, line bigint, subject string"
FILE = "file string, text string"


def _imports(find):
    return lambda text: (("import", *x[:2]) for x in find(text))


def _python(text):
    # `from . import a` names its module with the dots alone
    return (("import", line, base if base else name) for line, base, name in python_statements(text))


def _late(find):
    return lambda text: ((kind, line, None) for line, kind in find(text))


def parsers() -> dict[str, list[Parser]]:
    """The parsers of each language; a copy that a caller may add to."""
    return {"go": [_imports(go_statements)], "python": [_python, _late(python_lazy)], "typescript": [_imports(script_statements), _late(script_lazy)]}


def table_function(known: dict[str, list[Parser]] | None = None, extensions: dict[str, list[str]] | None = None):
    """The table function (file, text) -> FACT of these parsers; extensions adds to those of the languages."""
    known = parsers() if known is None else known
    by = {e: known.get(name, []) for name, found in (LANGUAGES | (extensions or {})).items() for e in found}

    class Facts:
        def eval(self, file: str, text: str):
            if text is None or file is None:
                return
            for parse in by.get(os.path.splitext(file)[1][1:], ()):
                try:
                    yield from parse(text)
                except Exception as e:  # any error of a parser is a fact about its file
                    yield "problem", None, f"{type(e).__name__}: {e}"

    return udtf(Facts, returnType=FACT)


def register(spark: SparkSession, name: str = "code_facts", known: dict[str, list[Parser]] | None = None, extensions: dict[str, list[str]] | None = None) -> None:
    spark.udtf.register(name, table_function(known, extensions))
    spark.dataSource.register(TreeSource)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeSource(DataSource):
    """``spark.read.format("code_tree").load(folder)``: FILE; text is null where a file is not UTF-8.  Links are not followed; names of files and directories that begin with a dot are left out."""

    @classmethod
    def name(cls):
        return "code_tree"

    def schema(self):
        return FILE

    def reader(self, schema):
        return TreeReader(self.options["path"])


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.removeprefix("file://")

    def _directories(self, path: str) -> list[str]:
        with os.scandir(path) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and not e.name.startswith("."))

    def partitions(self):
        first = self._directories(self.root)
        second = [d for p in first for d in self._directories(p)]
        return [Folder(self.root, False), *(Folder(p, False) for p in first), *(Folder(p, True) for p in second)]

    def read(self, partition):
        for at, below, names in os.walk(partition.path):
            below[:] = sorted(d for d in below if not d.startswith(".")) if partition.deep else []
            for name in sorted(n for n in names if not n.startswith(".")):
                path = os.path.join(at, name)
                if os.path.islink(path):
                    continue
                with open(path, "rb") as f:
                    raw = f.read()
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = None
                yield os.path.relpath(path, self.root), text
