"""A small algebra of token sets that compiles to DataFrame operations.

A plan folds its steps over a state that starts as all tokens. Steps of constant
class (loads) narrow the state; every other step maps the state, and the set
operations evaluate both of their sides on it. Catalyst plans the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import value_matches
from ..operators import core
from ..operators.core import ORDER, sorted_join


class CardClass(Enum):
    """How a step changes the number of tokens."""

    CONSTANT = "constant"
    SUBSET = "subset"
    EXPAND = "expand"
    REDUCE = "reduce"
    SINGLE = "single"


class Op:
    """A step; subclasses say how it maps a state ``(doc_id, tok)``."""

    card = CardClass.SUBSET
    demand = False

    def test(self) -> Column | None:
        """The condition on a token that gives the step's result from all tokens, if one does."""
        return None

    def apply(self, tokens: DataFrame, state: DataFrame) -> DataFrame:
        raise NotImplementedError


def card_class(op: Op) -> CardClass:
    return op.card


def supports_demand(op: Op) -> bool:
    """Whether a step needs a bounded part of what comes before it only."""
    return op.demand


class _Load(Op):
    card = CardClass.CONSTANT


class _Both(Op):
    """A set operation; of two conditions it is one filter."""

    def apply(self, tokens, state):
        test = self.test()
        if test is not None:
            return tokens.where(test).select(*ORDER).distinct()
        return self._meet(self.a.apply(tokens, state), self.b.apply(tokens, state))

    def test(self):
        a, b = self.a.test(), self.b.test()
        return None if a is None or b is None else self._combine(a, F.coalesce(b, F.lit(False)))


@dataclass(frozen=True)
class LoadKey(_Load):
    name: str

    def test(self):
        return core.key_test(self.name)

    def apply(self, tokens, state):
        return core.keys_named(tokens, self.name)


@dataclass(frozen=True)
class LoadDepth(_Load):
    depth: int

    def test(self):
        return F.col("depth") == self.depth

    def apply(self, tokens, state):
        return tokens.where(self.test()).select(*ORDER)


@dataclass(frozen=True)
class LoadSubtree(_Load):
    """The subtree of one token number, or of each document's tokens in ``roots``."""

    root: object

    def apply(self, tokens, state):
        return core.descendants(tokens, _anchors(tokens, self.root))


@dataclass(frozen=True)
class LoadAll(_Load):
    def test(self):
        return F.lit(True)

    def apply(self, tokens, state):
        return tokens.select(*ORDER)


@dataclass(frozen=True)
class LoadOne(_Load):
    tok: object

    def apply(self, tokens, state):
        return _anchors(tokens, self.tok)


def _anchors(tokens: DataFrame, at: object) -> DataFrame:
    """A token number of every document, or a frame of ``(doc_id, tok)``."""
    rows = tokens.select(*ORDER)
    return rows.join(sorted_join(at.select(*ORDER).distinct()), ORDER, "left_semi") if isinstance(at, DataFrame) else rows.where(F.col("tok") == at)


@dataclass(frozen=True)
class And(_Both):
    a: Op
    b: Op

    def _combine(self, a, b):
        return a & b

    def _meet(self, a, b):
        return a.distinct().join(sorted_join(b), ORDER, "left_semi")


@dataclass(frozen=True)
class Or(_Both):
    a: Op
    b: Op

    def _combine(self, a, b):
        return a | b

    def _meet(self, a, b):
        return a.union(b).distinct()


@dataclass(frozen=True)
class Sub(_Both):
    a: Op
    b: Op

    def _combine(self, a, b):
        return a & ~b

    def _meet(self, a, b):
        return a.distinct().join(sorted_join(b), ORDER, "left_anti")


@dataclass(frozen=True)
class FieldOf(Op):
    name: str

    def apply(self, tokens, state):
        return core.field_of(tokens, state, self.name).select(*ORDER)


@dataclass(frozen=True)
class Descendants(Op):
    card = CardClass.EXPAND

    def apply(self, tokens, state):
        return core.descendants(tokens, state)


@dataclass(frozen=True)
class AllChildren(Op):
    card = CardClass.EXPAND

    def apply(self, tokens, state):
        return core.children(tokens, state)


@dataclass(frozen=True)
class ValueEqLit(Op):
    """Tokens whose own text equals a literal: of a key its name, of a container its raw text."""

    literal: str

    def apply(self, tokens, state):
        return tokens.where(value_matches(F.col("text"), self.literal)).select(*ORDER).join(sorted_join(state), ORDER, "left_semi")


class _Reduce(Op):
    card = CardClass.REDUCE
    demand = True


@dataclass(frozen=True)
class First(_Reduce):
    def apply(self, tokens, state):
        return state.groupBy("doc_id").agg(F.min("tok").alias("tok"))


@dataclass(frozen=True)
class Last(_Reduce):
    def apply(self, tokens, state):
        return state.groupBy("doc_id").agg(F.max("tok").alias("tok"))


@dataclass(frozen=True)
class Nth(_Reduce):
    k: int

    def apply(self, tokens, state):
        w = Window.partitionBy("doc_id").orderBy("tok")
        return state.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == self.k + 1).select(*ORDER)


@dataclass(frozen=True)
class Count(_Reduce):
    """Ends a plan: the state becomes the number of its tokens, of every document that has tokens."""

    def apply(self, tokens, state):
        n = state.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
        return tokens.select("doc_id").distinct().join(sorted_join(n), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("tok"))


@dataclass(frozen=True)
class OpPlan:
    """An immutable pipeline; each builder method returns a longer one."""

    ops: tuple[Op, ...] = ()

    def push(self, op: Op) -> OpPlan:
        if self.ops and isinstance(self.ops[-1], Count):
            raise ValueError("count() ends a plan")
        return OpPlan((*self.ops, op))

    def all(self) -> OpPlan:
        return self.push(LoadAll())

    def by_key(self, name: str) -> OpPlan:
        return self.push(LoadKey(name))

    def at_depth(self, depth: int) -> OpPlan:
        return self.push(LoadDepth(depth))

    def within(self, root) -> OpPlan:
        return self.push(LoadSubtree(root))

    def anchor(self, tok) -> OpPlan:
        return self.push(LoadOne(tok))

    def field(self, name: str) -> OpPlan:
        return self.push(FieldOf(name))

    def descend(self) -> OpPlan:
        return self.push(Descendants())

    def children(self) -> OpPlan:
        return self.push(AllChildren())

    def value_eq(self, literal: str) -> OpPlan:
        return self.push(ValueEqLit(literal))

    def first(self) -> OpPlan:
        return self.push(First())

    def last(self) -> OpPlan:
        return self.push(Last())

    def nth(self, k: int) -> OpPlan:
        return self.push(Nth(k))

    def count(self) -> OpPlan:
        return self.push(Count())

    def optimize(self) -> OpPlan:
        """Drops a load of everything before a step that narrows, and folds two key loads
        at the start into one intersection. Elsewhere they narrow the state one by one."""
        ops = list(self.ops)
        while True:
            before = len(ops)
            ops = [
                op for i, op in enumerate(ops)
                if not (isinstance(op, LoadAll) and i + 1 < len(ops) and ops[i + 1].card in (CardClass.CONSTANT, CardClass.SUBSET)
                        and all(isinstance(x, LoadAll) for x in ops[:i]))
            ]
            if len(ops) > 1 and isinstance(ops[0], LoadKey) and isinstance(ops[1], LoadKey):
                ops[:2] = [And(ops[0], ops[1])]
            if len(ops) == before:
                return OpPlan(tuple(ops))

    def run(self, tokens: DataFrame) -> DataFrame:
        """The final state ``(doc_id, tok)`` of the optimised plan.

        Steps read ``tokens`` again; give a stored table (``sources.index.stored_index``)
        where there are several.
        """

        every = lambda: tokens.select(*ORDER)
        ops, state = list(self.optimize().ops), None  # no state: all tokens
        loads = []  # of a plan that starts with conditions; two keys are folded into one step
        while ops and (op := ops[0]).test() is not None and (op.card is CardClass.CONSTANT or not loads):
            loads.append(ops.pop(0))
        if loads:
            state = tokens.where(reduce(and_, (op.test() for op in loads))).select(*ORDER)
            state = state.distinct() if isinstance(loads[0], _Both) else state
        while ops:
            op = ops.pop(0)
            if isinstance(op, Descendants):
                # What loads keep of the subtrees is all that is looked for in them.
                tests = []
                while ops and isinstance(ops[0], (LoadKey, LoadDepth)):
                    tests.append(ops.pop(0).test())
                among = tokens.where(reduce(and_, tests)).select(*ORDER) if tests else None
                state = core.descendants(tokens, every() if state is None else state, among=among)
            elif op.card is CardClass.CONSTANT:
                found = op.apply(tokens, state)
                state = found if state is None else state.join(sorted_join(found), ORDER, "left_semi")
            elif isinstance(op, FieldOf):
                state = op.apply(tokens, state)
            else:
                state = op.apply(tokens, every() if state is None else state)
        return every() if state is None else state


def run_first(plan: OpPlan, tokens: DataFrame) -> DataFrame:
    return plan.run(tokens).groupBy("doc_id").agg(F.min("tok").alias("tok"))


def run_count(plan: OpPlan, tokens: DataFrame) -> DataFrame:
    """Tokens of the result by document; 1 for a plan that ends in ``count()``, whose result is a number."""
    return plan.run(tokens).groupBy("doc_id").agg(F.count("*").alias("n"))
