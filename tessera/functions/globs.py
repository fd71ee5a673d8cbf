"""Path globs as regular expressions and literal prefixes."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """A doublestar glob as an anchored regex without look-around, valid in Java and RE2."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob[i:] == "**" and out and out[-1] == "/":
            out[-1] = "(?:/.*)?"  # a trailing /** also names the directory itself
            i += 2
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            out.append(f"[{'^/' if negated else ''}{re.sub(r'([\\\[\]&~])', r'\\\1', body[negated:])}]")
            i = end + 1
        elif c == "{":
            out.append("(?:")
            depth += 1
            i += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c) if c in ".^$+()|" else c)
            i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return "^" + "".join(out) + "$"


def literal_prefix(glob: str) -> str:
    """What every path that matches starts with."""
    return re.split(r"[*?\[{\\]", glob, maxsplit=1)[0]


def literal_root(glob: str) -> str:
    """The longest path on whole segments that is, or holds, every path that matches; '' where there is none."""
    start = literal_prefix(glob)
    return start if start == glob else start.rpartition("/")[0]


def specificity(glob: str) -> int:
    return len(literal_prefix(glob).encode())
