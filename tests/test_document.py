import json

import pytest

from tessera.sources.document import flat


def nest(rows):
    """The rows as a nested value again."""
    def build(keys, k):
        kind, value = rows[k][1], rows[k][2]
        if kind not in ("map", "list"):
            return {"int": int, "float": float, "bool": lambda v: v == "true", "null": lambda v: None}.get(kind, str)(value)
        own = [(r[0][-1], j) for j, r in enumerate(rows) if r[0][:-1] == keys and len(r[0]) == len(keys) + 1]
        assert int(value) == len(own)
        return {n: build([*keys, n], j) for n, j in own} if kind == "map" else [build([*keys, n], j) for n, j in own]

    return build([], 0)


CASES = [
    ("a: 1\nb: [x, 'y z', \"q\\n\"]\nc:\n  d: true # note\n  e: ~\n", {"a": 1, "b": ["x", "y z", "q\n"], "c": {"d": True, "e": None}}),
    ("rules:\n  - id: one\n    deny: { from: [a, b/**], to: database/sql }\n    why: it's so.\n  - id: two\n    note: x\n", {"rules": [{"id": "one", "deny": {"from": ["a", "b/**"], "to": "database/sql"}, "why": "it's so."}, {"id": "two", "note": "x"}]}),
    ("list:\n- a\n- b: 1\n  c: 2\n- - x\n  - y\n", {"list": ["a", {"b": 1, "c": 2}, ["x", "y"]]}),
    ("why: |\n  two\n   lines\n\nnext: >-\n  folded\n  text\n", {"why": "two\n lines\n", "next": "folded text"}),
    ("---\n# only a comment\nday: 2027-01-31\nn: -1.5\nurl: http://a.b/c#d\n", {"day": "2027-01-31", "n": -1.5, "url": "http://a.b/c#d"}),
    ("a: [1,\n  2, # two\n  {b: [],\n c: {}}]\nz: end", {"a": [1, 2, {"b": [], "c": {}}], "z": "end"}),
    ("'**/*.go': \"a # b\"\n", {"**/*.go": "a # b"}), ("", None), ("a:\nb:\n  c:\n", {"a": None, "b": {"c": None}}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_documents(text, want):
    assert nest(flat(text)) == want


def test_json_is_read():
    doc = {"a": [1, 2.5, None, True, "x: y", {"k": []}], "b": {"c": "é \" , ] }"}, "long": "w " * 50}
    assert nest(flat(json.dumps(doc))) == doc and nest(flat(json.dumps(doc, indent=2))) == doc


@pytest.mark.parametrize("text", ["a: [1", "a: {b 1}", "a: 'x", "a: 1\n   b: 2\n", "a: &x 1", "a: 1\nnothing\n", "\ta: 1", '{"a": 1} x'])
def test_unreadable(text):
    assert [r[1] for r in flat(text)] == ["unreadable"]


def test_duplicates_are_told():
    assert [r[0] for r in flat("a: 1\nb: {c: 1, c: 2}\na: 3\n") if r[1] == "duplicate"] == [["b", "c"], ["a"]]
