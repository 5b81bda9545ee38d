import random

import pytest

from structjson.schema import TOKENS, BuildOptions
from structjson.sources.scanner import decode_key, scan
from structjson.sources.vectors import scan_many

NAMES = ["tok", "raw", "role", "kind", "depth", "start", "end", "coarse", "parent", "close", "tape", "key", "val", "val_text", "text"]


def table(doc, **options):
    cols, error = scan(doc.encode() if isinstance(doc, str) else doc, **options)
    assert error is None
    return [dict(zip(NAMES, row)) for row in zip(*cols)]


def test_small_array():
    got = [(r["raw"], r["start"], r["end"], r["depth"], r["parent"], r["close"], r["tape"], r["role"]) for r in table('{"a":[1,2]}')]
    assert got == [
        ("{", 0, 11, 0, None, 8, 0, "None"), ("Quote", 1, 4, 1, 0, None, 1, "Key"), (":", 4, 5, 1, 0, None, None, "None"),
        ("[", 5, 10, 1, 0, 7, 2, "Value"), ("Scalar", 6, 7, 2, 3, None, 3, "Elem"), (",", 7, 8, 2, 3, None, None, "None"),
        ("Scalar", 8, 9, 2, 3, None, 4, "Elem"), ("]", 9, 10, 1, 0, None, 5, "None"), ("}", 10, 11, 0, None, None, 6, "None"),
    ]


@pytest.mark.parametrize("doc, n", [("", 0), ("42", 0), ("true", 0), ('"abc"', 1), ('{"k":"te\\"st"}', 5), ("{}", 2)])
def test_counts(doc, n):
    assert len(table(doc)) == n


@pytest.mark.parametrize(
    "doc, error", [("}", "underflow"), ("{", "unclosed container"), ('{"a', "unterminated string"), ('{"a\\', "unterminated string")]
)
def test_errors(doc, error):
    assert scan(doc.encode()) == ([], error)


def test_long_strings_and_escapes_keep_one_quote_each():
    for body in ("a" * 120, "x" * 58 + '\\\\\\"end'):
        rows = table('{"k":"' + body + '"}')
        assert [r["raw"] for r in rows] == ["{", "Quote", ":", "Quote", "}"]


def test_bytes_not_characters():
    rows = table('{"é":1}')
    assert (rows[1]["start"], rows[1]["end"], rows[2]["start"], rows[1]["key"]) == (1, 5, 5, "é")


def test_several_roots_and_mismatched_brackets():
    assert [r["parent"] for r in table('{"a":1}\n{"a":2}') if r["raw"] == "{"] == [None, None]
    assert table('{"a":1]')[0]["close"] == 4


def test_value_of_malformed_key_is_missing():
    rows = table('{"k":NaN,"j":1}')
    assert [(r["key"], r["val"]) for r in rows if r["role"] == "Key"] == [("k", None), ("j", 6)]


def test_key_is_not_a_value():
    rows = table('{"k":"x","x":1}')
    assert [r["tok"] for r in rows if r["key"] == "x"] == [5]
    assert rows[3]["role"] == "Value"


def test_decode_key():
    assert decode_key(b"a\\nb") == "a\nb"
    assert decode_key(b"\\ud83d\\ude00") == "\U0001f600"
    assert decode_key(b"\\q\\u00e9") == "qé"


def test_without_keys():
    rows = table('{"a":1}', keys=False)
    assert {r["role"] for r in rows} == {None} and rows[1]["kind"] == "String" and rows[1]["key"] is None
    assert not BuildOptions.minimal().keys and BuildOptions.keys_only().keys and BuildOptions.with_tape().tape


def _random_json(rng, depth=0):
    kind = rng.random()
    pad = rng.choice(["", " ", "\n"])
    if depth > 3 or kind < 0.4:
        return rng.choice(["1", "-2.5e3", "true", "null", '"x"', '"a\\"b"', '"é,]"', '""'])
    if kind < 0.7:
        return "[" + ("," + pad).join(_random_json(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    return "{" + ",".join(f'"k{rng.randrange(3)}"{pad}:{pad}' + _random_json(rng, depth + 1) for _ in range(rng.randrange(4))) + "}"


def _by_byte(doc: bytes):
    """Structural characters outside strings, one byte at a time: (start, character, depth, innermost open)."""
    out, stack, i = [], [], 0
    while i < len(doc):
        c = chr(doc[i])
        if c == '"':
            out.append((i, '"', len(stack), stack[-1] if stack else None))
            i += 1
            while chr(doc[i]) != '"':
                i += 2 if chr(doc[i]) == "\\" else 1
        elif c in "}]":
            stack.pop()
            out.append((i, c, len(stack), stack[-1] if stack else None))
        elif c in "{[:,":
            out.append((i, c, len(stack), stack[-1] if stack else None))
            if c in "{[":
                stack.append(i)
        i += 1
    return out


def test_agrees_with_a_byte_by_byte_scan():
    rng = random.Random(5)
    for _ in range(300):
        doc = _random_json(rng).encode()
        rows = table(doc)
        starts = [r["start"] for r in rows]
        got = [
            (r["start"], '"' if r["raw"] == "Quote" else r["raw"], r["depth"], None if r["parent"] is None else starts[r["parent"]])
            for r in rows if r["raw"] != "Scalar"
        ]
        assert got == _by_byte(doc)


def _soup(rng):
    """Text that is JSON by luck only."""
    pieces = ["{", "}", "[", "]", ":", ",", '"a"', '"', "\\", '\\"', " ", "1", "-2.5", "true", "x", "é", "\n", '"k":', '"k\\u0041":', "null"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(25))).encode()


@pytest.mark.parametrize("keys, whole, only", [(True, True, None), (False, False, None), (True, False, ["k0", "kA", "a"])])
def test_many_at_once_equal_one_by_one(keys, whole, only):
    rng = random.Random(7)
    docs = [rng.choice([_soup(rng), _random_json(rng).encode(), b"", b"\xff" + _random_json(rng).encode()]) for _ in range(1500)]
    docs += [b"[" * 40 + b"]" * 40, b'"' + b"\\" * 7, b'["' + b"\\" * 8 + b'"]']
    columns, tokens, left_out = TOKENS.names[1:], 0, 0
    for at in range(0, len(docs), 29):
        part = docs[at : at + 29]
        doc, made, rest = scan_many(part, set(columns), keys, whole, only)
        rows = list(zip(*(made[c].to_pylist() for c in columns)))
        for i, d in enumerate(part):
            got = [r for r, of in zip(rows, doc) if of == i]
            found, error = scan(d, keys, whole)
            want = [r for r in zip(*found) if only is None or r[columns.index("key")] in only]
            if i in rest:
                assert not got
                left_out += error is None
            else:
                assert error is None and got == want
                tokens += len(got)
    assert tokens > (900 if only is None else 100) and left_out < 400
    assert scan_many([], set(columns))[0].size == 0
