"""Nested documents (JSON, and YAML without anchors, tags and multi-line plain text) as rows, one a value."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it hands them on: its memory does not follow what a batch of documents holds.
GATHERED = 8192
VALUES = "doc string, at int, keys array<string>, kind string, value string"
_INT, _FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][-+]?[0-9]+)?")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")


class Unreadable(ValueError):
    pass


def _scalar(word: str) -> tuple[str, str | None]:
    if word[:1] in "&*!|>%@`" and word:
        raise Unreadable(f"not read: {word[:20]}")
    if word in ("", "~", "null"):
        return "null", None
    if word in ("true", "false"):
        return "bool", word
    return ("int" if _INT.fullmatch(word) else "float" if _FLOAT.fullmatch(word) else "string"), word


def _quoted(s: str, i: int) -> tuple[str, int]:
    end = i + 1
    while end < len(s) and (s[end] != s[i] or (s[i] == "'" and s[end : end + 2] == "''")):
        end += 2 if s[end] == "\\" and s[i] == '"' or s[end] == "'" else 1
    if end >= len(s):
        raise Unreadable("a quote is left open")
    body = s[i : end + 1]
    try:
        return (json.loads(body, strict=False) if s[i] == '"' else body[1:-1].replace("''", "'")), end + 1
    except ValueError as e:
        raise Unreadable(f"bad escape in {body[:20]}") from e


def _bare(line: str) -> str:
    """A line without its comment."""
    i = 0
    while i < len(line):
        if line[i] in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
            try:
                i = _quoted(line, i)[1]
                continue
            except Unreadable:
                return line
        if line[i] == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
        i += 1
    return line.rstrip()


class Reader:
    """One document; ``rows`` gets (keys, kind, value) of every value in document order."""

    def __init__(self, text: str):
        self.rows: list[tuple[list[str], str, str | None]] = []
        raw = text.replace("\r\n", "\n").removeprefix("\ufeff").split("\n")
        self.raw, self.lines = raw, []
        for no, line in enumerate(raw):
            bare = _bare(line)
            if bare.strip() and not (bare in ("---", "...") and not self.lines):
                if "\t" in bare[: len(bare) - len(bare.lstrip())]:
                    raise Unreadable(f"line {no + 1} is indented by tabs")
                self.lines.append((len(bare) - len(bare.lstrip()), bare.strip(), no))
        self.i = 0
        if not self.lines:
            self.put([], "null", None)
            return
        self.block([], self.lines[0][0])
        if self.i < len(self.lines):
            raise Unreadable(f"line {self.lines[self.i][2] + 1} fits nowhere")

    def put(self, keys: list[str], kind: str, value: str | None) -> None:
        self.rows.append((keys, kind, value))

    def block(self, keys: list[str], indent: int) -> None:
        content = self.lines[self.i][1]
        if content == "-" or content.startswith("- "):
            self.sequence(keys, indent)
        elif _KEY.match(content) and content[0] not in "[{":
            self.mapping(keys, indent)
        else:
            self.i += 1
            self.inline(keys, content)

    def sequence(self, keys: list[str], indent: int) -> None:
        at = len(self.rows)
        self.put(keys, "list", None)
        n = 0
        while self.i < len(self.lines) and self.lines[self.i][0] == indent and (self.lines[self.i][1] == "-" or self.lines[self.i][1].startswith("- ")):
            _, content, no = self.lines[self.i]
            rest, own = content[1:].lstrip(), [*keys, f"[{n}]"]
            if rest:
                self.lines[self.i] = (indent + len(content) - len(rest), rest, no)
                self.block(own, indent + len(content) - len(rest))
            else:
                self.below(own, indent + 1)
            n += 1
        self.rows[at] = (keys, "list", str(n))

    def mapping(self, keys: list[str], indent: int) -> None:
        at, seen = len(self.rows), set()
        self.put(keys, "map", None)
        while self.i < len(self.lines) and self.lines[self.i][0] == indent:
            _, content, no = self.lines[self.i]
            m = _KEY.match(content)
            if not m:
                raise Unreadable(f"line {no + 1} has no key")
            name = _quoted(m[1], 0)[0] if m[1][0] in "\"'" else m[1]
            own, rest = [*keys, name], content[m.end() :]
            if name in seen:
                self.put(own, "duplicate", None)
            seen.add(name)
            self.i += 1
            if not rest:
                self.below(own, indent + 1, indent)
            elif rest[0] in "|>":
                self.text(own, indent, rest)
            else:
                self.inline(own, rest)
        if self.i < len(self.lines) and self.lines[self.i][0] > indent:
            raise Unreadable(f"line {self.lines[self.i][2] + 1} is indented too far")
        self.rows[at] = (keys, "map", str(len(seen)))

    def below(self, keys: list[str], least: int, list_at: int = -1) -> None:
        """What stands below a key or a dash: deeper, or a list as deep as its key."""
        if self.i < len(self.lines) and self.lines[self.i][1] == "-" and self.lines[self.i][0] < least and list_at < 0:
            self.i += 1
        here = self.lines[self.i] if self.i < len(self.lines) else (-1, "", 0)
        if here[0] >= least or (here[0] == list_at and (here[1] == "-" or here[1].startswith("- "))):
            self.block(keys, here[0])
        else:
            self.put(keys, "null", None)

    def text(self, keys: list[str], indent: int, mark: str) -> None:
        """A block of text: lines kept (|) or folded (>)."""
        no = self.lines[self.i - 1][2] + 1
        body = []
        while no < len(self.raw) and (not self.raw[no].strip() or len(self.raw[no]) - len(self.raw[no].lstrip()) > indent):
            body.append(self.raw[no])
            no += 1
        while self.i < len(self.lines) and self.lines[self.i][2] < no:
            self.i += 1
        cut = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
        body = [x[cut:] for x in body]
        while body and not body[-1].strip():
            body.pop()
        self.put(keys, "string", ("\n" if mark[0] == "|" else " ").join(body) + ("" if mark[1:2] == "-" or not body else "\n"))

    def inline(self, keys: list[str], s: str) -> None:
        """A scalar or a bracketed value, which may go on over lines."""
        if s[0] in "[{":
            while True:
                try:
                    end = self.flow(keys, s, 0)
                    break
                except EOFError:
                    if self.i >= len(self.lines):
                        raise Unreadable("a bracket is left open") from None
                    del self.rows[self.mark :]
                    s += " " + self.lines[self.i][1]
                    self.i += 1
            if s[end:].strip():
                raise Unreadable(f"text after a value: {s[end:][:20]}")
        elif s[0] in "\"'":
            value, end = _quoted(s, 0)
            if s[end:].strip():
                raise Unreadable(f"text after a quote: {s[end:][:20]}")
            self.put(keys, "string", value)
        else:
            self.put(keys, *_scalar(s))

    def flow(self, keys: list[str], s: str, i: int, top: bool = True) -> int:
        if top:
            self.mark = len(self.rows)

        def skip(i: int) -> int:
            while i < len(s) and s[i].isspace():
                i += 1
            if i >= len(s):
                raise EOFError
            return i

        i = skip(i)
        if s[i] in "[{":
            close, kind = ("]", "list") if s[i] == "[" else ("}", "map")
            at, n, seen = len(self.rows), 0, set()
            self.put(keys, kind, None)
            i = skip(i + 1)
            while s[i] != close:
                if kind == "map":
                    name, i = _quoted(s, i) if s[i] in "\"'" else self.plain(s, i, ":,}]")
                    i = skip(i)
                    if s[i] != ":":
                        raise Unreadable(f"no value for {name[:20]}")
                    if name in seen:
                        self.put([*keys, name], "duplicate", None)
                    seen.add(name)
                    i = skip(i + 1)
                i = skip(self.flow([*keys, name if kind == "map" else f"[{n}]"], s, i, False))
                n += 1
                if s[i] == ",":
                    i = skip(i + 1)
                elif s[i] != close:
                    raise Unreadable(f"no comma before {s[i:][:20]}")
            self.rows[at] = (keys, kind, str(len(seen) if kind == "map" else n))
            return i + 1
        if s[i] in "\"'":
            value, i = _quoted(s, i)
            self.put(keys, "string", value)
            return i
        word, i = self.plain(s, i, ",]}")
        self.put(keys, *_scalar(word))
        return i

    @staticmethod
    def plain(s: str, i: int, stops: str) -> tuple[str, int]:
        end = i
        while end < len(s) and not (s[end] in stops and (s[end] != ":" or s[end + 1 : end + 2] in ("", " "))):
            end += 1
        if end == len(s):
            raise EOFError
        return s[i:end].strip(), end


def flat(text: str | None) -> list[tuple[list[str], str, str | None]]:
    """(keys, kind, value) of every value; kind ``unreadable`` with the reason if the text is no such document."""
    try:
        return Reader(text or "").rows
    except (Unreadable, RecursionError) as e:
        return [([], "unreadable", str(e))]


def values(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Rows of VALUES for each document: its values in order, containers with how many they hold."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]

        def made(out):
            cols = list(zip(*out)) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc", "at", "keys", "kind", "value"])

        out = []
        for b in batches:
            for d, t in zip(*(b.column(i) for i in (0, 1))):
                d = d.as_py()
                for k, (keys, kind, value) in enumerate(flat(t.as_py())):
                    out.append((d, k, keys, kind, value))
                    if len(out) >= GATHERED:
                        yield made(out)
                        out = []
        yield made(out)

    return docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).mapInArrow(run, VALUES)
