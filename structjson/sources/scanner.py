"""The scanner: one regular expression pass over a document's bytes."""

from __future__ import annotations

import re

_PIECE = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[ \t\n\r]++|[^{}\[\]:," \t\n\r]++|"', re.S)
_SCALAR_END = re.compile(rb"[^,}\] \t\n\r]*")
_STARTS = frozenset(b"-0123456789tfn")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\u.{0,4}|\\(.)", re.S)
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_KINDS = {"{": "Object", "[": "Array", "}": "ObjectEnd", "]": "ArrayEnd", "s": "Scalar"}


def decode_key(body: bytes) -> str:
    """The name that a key's string body spells."""
    text = body.decode("utf-8", "replace")
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return "" if m[2] is None else _SHORT.get(m[2], m[2])

    out = _ESCAPE.sub(one, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")


def scan(data: bytes, keys: bool = True, container_text: bool = True) -> tuple[list[list], str | None]:
    """``(columns, error)`` of a document: the columns of the token table after ``doc_id``.

    A document with an error has no tokens. Bracket types need not match, several
    roots may follow each other, and text that is no token is passed over.
    """
    raw: list[str] = []
    start: list[int] = []
    end: list[int] = []
    depth: list[int] = []
    parent: list[int | None] = []
    close: list[int | None] = []
    tape: list[int | None] = []
    stack: list[int] = []
    before, values = b"", 0
    for m in _PIECE.finditer(data):
        piece = m[0]
        first = piece[:1]
        if first in b" \t\n\r":
            continue
        at, stop = m.span()
        n = len(raw)
        if first == b'"':
            if len(piece) == 1:
                return [], "unterminated string"
            kind = '"'
        elif first in b"{}[]:,":
            kind = first.decode()
        else:
            if before not in (b":", b",", b"[") or piece[0] not in _STARTS:
                before = b"x"
                continue
            kind, stop = "s", _SCALAR_END.match(data, at).end()
        before = first if kind != "s" else b"x"
        if kind in "}]":
            if not stack:
                return [], "underflow"
            close[stack.pop()] = n
        raw.append(kind)
        start.append(at)
        end.append(stop)
        depth.append(len(stack))
        parent.append(stack[-1] if stack else None)
        close.append(None)
        if kind in ":,":
            tape.append(None)
        else:
            tape.append(values)
            values += 1
        if kind in "{[":
            stack.append(n)
    if stack:
        return [], "unclosed container"
    n = len(raw)
    coarse = [*start[1:], start[-1] + 1] if n else []
    role: list[str | None] = [None] * n
    kinds: list[str | None] = [None] * n
    key: list[str | None] = [None] * n
    val: list[int | None] = [None] * n
    for i, kind in enumerate(raw):
        if kind in "{[":
            end[i] = coarse[i] = end[close[i]]
        elif kind != '"' and kind != "s":
            coarse[i] = end[i]
        owner = raw[parent[i]] if parent[i] is not None else None
        if kind in ":,}]":
            role[i] = "None"
        elif kind == '"' and owner == "{" and i + 1 < n and raw[i + 1] == ":":
            role[i] = "Key"
        elif owner == "[":
            role[i] = "Elem"
        elif kind in "{[" and owner is None:
            role[i] = "None"
        else:
            role[i] = "Value"
        kinds[i] = _KINDS.get(kind, ("Key" if keys and role[i] == "Key" else "String") if kind == '"' else None)
        if role[i] == "Key" and keys:
            key[i] = decode_key(data[start[i] + 1 : end[i] - 1])
            if i + 2 < n and raw[i + 2] in '{["s':
                val[i] = i + 2
    text: list[str | None] = [
        None if kind in "{[" and not container_text else data[a:b].decode("utf-8", "replace") for kind, a, b in zip(raw, start, end)
    ]
    raw_names = ["Quote" if k == '"' else "Scalar" if k == "s" else k for k in raw]
    if not keys:
        role = [None] * n
    value_text = [None if v is None else text[v] for v in val]
    return [list(range(n)), raw_names, role, kinds, depth, start, end, coarse, parent, close, tape, key, val, value_text, text], None
