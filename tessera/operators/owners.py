"""Owners of files by an owners document (a pattern and its owners a line), the last match wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_regex(pattern: str) -> str | None:
    """A shell pattern whose wildcards stay inside a path segment; None where it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            m = re.match(r"\[\^?((?:[^\\\]]|\\.)+)\]", pattern[i:])
            if not m:
                return None
            out.append(f"(?!/)[{'^' if m[0][1] == '^' else ''}{re.sub(r'([\[&~])', r'\\\1', m[1])}]")
            i += len(m[0])
            continue
        if c == "\\":
            i += 1
            if i == len(pattern):
                return None
            c = pattern[i]
            out.append(re.escape(c))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "".join(out)


def parse(text: str) -> list[tuple[int, str, str]]:
    """(place, regex, owner) of the rules; lines without an owner and malformed patterns name nothing."""
    rules = []
    for at, line in enumerate(text.splitlines()):
        words = line.split()
        if len(words) < 2 or words[0].startswith("#"):
            continue
        pattern = words[0].removeprefix("/")
        if pattern.endswith("/"):
            regex = re.escape(pattern[:-1]) + "(?:/.*)?"  # a directory, by its name as written
        else:
            regex = segment_regex(pattern)
            if regex is None:
                continue
            inner = "/" in pattern or words[0].startswith("/")
            regex = f"(?:{regex})(?:/.*)?" if inner else f"(?:.*/)?(?:{regex})"
        rules.append((at, f"^{regex}$", words[1]))
    return rules


def owned(files: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """files with the owner of each; files that no rule names are left out.  Rules are a document: one pass over the files."""
    if not rules:
        return files.withColumn("owner", F.lit(None).cast("string")).where("false")
    last = F.coalesce(*(F.when(F.col("file").rlike(regex), owner) for _, regex, owner in reversed(rules)))
    return files.withColumn("owner", last).where("owner IS NOT NULL")


def by_module(owned_files: DataFrame) -> DataFrame:
    """(module, owner, files): the owner of most files of a module, the first by name among equals."""
    n = owned_files.groupBy("module", "owner").agg(F.count("*").alias("files"))
    return n.groupBy("module").agg(F.min_by("owner", F.struct(-F.col("files"), "owner")).alias("owner"), F.max("files").alias("files"))
