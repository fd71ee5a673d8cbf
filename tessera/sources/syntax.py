"""Functions and types of source texts, with the lines that they range over.

Texts with braces (Go, script files, Rust, C#) run through an automaton over
tokens: strings, patterns and comments are skipped, every brace opens a scope, and
what stands before it since the last boundary says whether the scope is a function,
a type or neither.  Python texts are parsed; one that does not parse has no facts
but a problem.  One text is held at a time.
"""

from __future__ import annotations

import ast
import re
import warnings
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code import scanned
from .scratch import cut

RANGES = "kind string, name string, start bigint, end bigint"
_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|`(?:[^`\\]|\\[\s\S])*`?|(?P<raw>r#*\"[\s\S]*?\"#*)|'(?:[^'\\\n]|\\.)'|(?P<tick>'[A-Za-z_]\w*\b(?!'))|'(?:[^'\\\n]|\\.)*'?|=>|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]"
)
#: A raw string of Go ends at the next back quote, whatever stands before it.
_GO_TOKEN = re.compile(_TOKEN.pattern.replace(r"`(?:[^`\\]|\\[\s\S])*`?", "`[^`]*`?"))
#: Words by language (fixed values): what declares a function, what declares a type, and what opens a scope of neither kind.
FUNCTION = {"go": {"func"}, "typescript": {"function"}, "rust": {"fn"}, "dotnet": set()}
TYPE = {"go": {"struct", "interface"}, "typescript": {"class", "interface", "enum"}, "rust": {"struct", "enum", "trait", "union"}, "dotnet": {"class", "struct", "interface", "enum", "record"}}
CONTROL = {"if", "for", "while", "switch", "catch", "else", "do", "try", "finally", "with", "match", "loop", "select", "return", "lock", "using", "foreach", "fixed", "unsafe", "new", "throw", "await", "case"}


def _parens(head: list[str]) -> list[str]:
    """Tokens of the innermost bracket that is still open, or of all; a closed pair of round ones stays as '()'."""
    levels: list[list[str]] = [[]]
    for t in head:
        if t in "([":
            levels.append([])
        elif t in ")]":
            if len(levels) > 1:
                levels.pop()
                if t == ")":
                    levels[-1].append("()")
        elif t == "," and len(levels) > 1:
            levels[-1] = []
        else:
            levels[-1].append(t)
    return levels[-1]


def _word(t: str) -> bool:
    return bool(t) and (t[0].isalpha() or t[0] in "_$")


def _declares(lang: str, head: list[str], in_type: bool) -> tuple[str, str] | None:
    """(kind, name) of the scope that follows a head; null for other scopes."""
    flat = _parens(head)
    words = [t for t in flat if _word(t)]
    for k, t in enumerate(flat):
        if t in FUNCTION[lang]:
            after = [x for x in flat[k + 1 :] if x != "*"]
            if lang == "go" and after[:1] == ["()"] and len(after) > 1 and _word(after[1]) and after[2:3] == ["()"]:
                after = after[1:]  # a method's receiver
            name = after[0] if after and _word(after[0]) else ""
            if not name and lang == "typescript":
                name = _assigned(flat[:k])
            return "function", name
    if lang == "go":
        return ("type", words[words.index("type") + 1] if "type" in words and words.index("type") + 1 < len(words) - 1 else "") if words and words[-1] in TYPE["go"] and "type" in words else None
    for k, t in enumerate(words):
        if t in TYPE[lang] and not (k and words[k - 1] == "."):
            name = words[k + 1] if k + 1 < len(words) and words[k + 1] not in ("extends", "implements") else ""
            return "type", name
    if lang == "rust":
        return None
    if flat and flat[-1] == "=>":
        return "function", _assigned(flat)
    if "()" in flat and in_type and not any(w in CONTROL for w in words):
        at = flat.index("()")
        if at and _word(flat[at - 1]) and "=" not in flat[:at]:
            return "function", flat[at - 1]
    return None


def _assigned(flat: list[str]) -> str:
    """The name that a value is given: before its last = or :."""
    for k in range(len(flat) - 1, 0, -1):
        if flat[k] in ("=", ":") and _word(flat[k - 1]):
            return flat[k - 1]
    return ""


def braced(text: str, lang: str):
    """(kind, name, start, end): start is the line of the declaration, end that of the closing brace; an open scope ends with the text."""
    line = at = 0
    head: list[tuple[str, int]] = []
    scopes: list[tuple[tuple[str, str] | None, int, int]] = []
    depth = 0
    for m in (_GO_TOKEN if lang == "go" else _TOKEN).finditer(text):
        t = m[0]
        line += text.count("\n", at, m.start())
        at = m.start()
        if t.startswith(("//", "/*")):
            continue
        if t[0] in "\"'`" or m["raw"] or m["tick"]:
            t = '""'
        if t in "([":
            depth += 1
        elif t in ")]":
            depth = max(0, depth - 1)
        if t == "{":
            in_type = bool(scopes) and scopes[-1][0] is not None and scopes[-1][0][0] == "type"
            found = _declares(lang, [x for x, _ in head], in_type)
            begin = next((n for x, n in head if x not in ")],;"), line)
            scopes.append((found, begin, depth))
            head, depth = [], 0
        elif t == "}":
            if scopes:
                found, begin, depth = scopes.pop()
                if found:
                    yield *found, begin + 1, line + 1
            head = []
        elif t == ";" and not depth:
            head = []
        else:
            if head and not depth and lang == "go" and head[-1][1] != line and head[-1][0] not in (",", "(", "="):
                head = []  # a line ends a statement there
            head.append((t, line))
    line += text.count("\n", at)
    while scopes:
        found, begin, _ = scopes.pop()
        if found:
            yield *found, begin + 1, line + 1


def python_ranges(text: str):
    """(kind, name, start, end) of Python functions and classes; one row of kind ``problem`` for a text that does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield "problem", "", getattr(e, "lineno", None) or 0, 0
        return
    for node in ast.walk(parsed):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "function", node.name, node.lineno, node.end_lineno
        elif isinstance(node, ast.ClassDef):
            yield "type", node.name, node.lineno, node.end_lineno


def ranges(files: DataFrame) -> DataFrame:
    """(file, kind, name, start, end) of functions and types, and problems, of files whose language is known."""
    return scanned(files, RANGES, {"python": python_ranges} | {name: partial(braced, lang=name) for name in FUNCTION})


def lengths(found: DataFrame, files: DataFrame, over: int = 60) -> DataFrame:
    """(module, files, observed, functions, p50, p90, longest, over) of function lengths; files: file, module, and all that should have been seen.

    observed counts the files with facts and no problem, so a share below one says how far the numbers reach.
    """
    size = F.col("end") - F.col("start") + 1
    found = cut(found.where("kind IN ('function', 'problem')").select("file", "kind", size.alias("size")), "ranges")  # read twice
    functions = found.where("kind = 'function'").select("file", "size")
    bad = found.where("kind = 'problem'").select("file").distinct().withColumn("bad", F.lit(True))
    seen = files.select("file", "module").distinct().join(bad, "file", "left")
    total = seen.groupBy("module").agg(F.count("*").alias("files"), F.count_if(F.col("bad").isNull()).alias("observed"))

    def at(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY size)").cast("long")

    by = seen.join(functions, "file").groupBy("module").agg(F.count("*").alias("functions"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("size").alias("longest"), F.count_if(F.col("size") > over).alias("over"))
    return total.join(by, "module", "left").fillna(0, ["functions", "over"])
