"""A recursive reader of small JSON documents, for answers to compare with."""

import json
import random


class Token:
    def __init__(self, raw, start, depth, parent):
        self.raw, self.start, self.end, self.depth, self.parent = raw, start, start + 1, depth, parent
        self.close = self.key = self.value = None

    def text(self, doc):
        return doc[self.start : self.end]


def read(doc: str) -> list[Token]:
    """The tokens of an ASCII document without blanks."""
    out: list[Token] = []

    def add(raw, at, depth, parent):
        out.append(Token(raw, at, depth, parent))
        return len(out) - 1

    def leaf(at, depth, parent):
        _, end = json.JSONDecoder().raw_decode(doc, at)
        n = add('"' if doc[at] == '"' else "s", at, depth, parent)
        out[n].end = end
        return n, end

    def value(at, depth, parent):
        if doc[at] not in "{[":
            return leaf(at, depth, parent)
        n, close = add(doc[at], at, depth, parent), "}" if doc[at] == "{" else "]"
        at += 1
        while doc[at] != close:
            if doc[at] == ",":
                add(",", at, depth + 1, n)
                at += 1
            if close == "}":
                k, at = leaf(at, depth + 1, n)
                out[k].key = json.loads(out[k].text(doc))
                add(":", at, depth + 1, n)
                out[k].value, at = value(at + 1, depth + 1, n)
            else:
                _, at = value(at, depth + 1, n)
        out[n].close = add(close, at, depth, parent)
        out[n].end = at + 1
        return n, at + 1

    value(0, 0, None)
    return out


def around(tokens: list[Token], n: int) -> list[int]:
    """The containers that hold a token, innermost first."""
    held = []
    while (n := tokens[n].parent) is not None:
        held.append(n)
    return held


def below(tokens: list[Token], n: int) -> list[int]:
    return list(range(n, (tokens[n].close if tokens[n].close is not None else n) + 1))


def some_documents(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)

    def pairs(depth):
        return "{" + ",".join(f'"{rng.choice(["lamp", "size", "rug", "w"])}":{one(depth + 1)}' for _ in range(rng.randrange(4))) + "}"

    def one(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.35:
            return rng.choice(["1", "1.0", "-3", "true", "null", '"on"', '"off"', '"1"', '"a\\"b"', '"]{"'])
        return "[" + ",".join(one(depth + 1) for _ in range(rng.randrange(4))) + "]" if kind < 0.55 else pairs(depth)

    return [pairs(0) for _ in range(count)]
