"""Estimates and actual rows of a query's plan, read from Catalyst."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

JOINS = ("Join", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def option(x) -> int | None:
    return int(str(x.get())) if x.isDefined() else None


def is_join(name: str) -> bool:
    return name in JOINS


@dataclass
class Node:
    """A plan node: its name, estimated or actual rows, expression text and children."""

    name: str
    rows: int | None
    text: str
    children: list[Node]

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def estimated_rows(plan) -> int:
    """Of a JVM plan: Catalyst's row count, or where it only knows bytes, the rows that these make by the default sizes of the types."""
    known = option(plan.stats().rowCount())
    width = 8 + sum(a.dataType().defaultSize() for a in seq(plan.output()))
    return int(str(plan.stats().sizeInBytes())) // width if known is None else known


def logical(df: DataFrame, from_bytes: bool = False) -> Node:
    """The optimised plan with the estimates Catalyst has; from_bytes: those it only has as bytes too."""
    def node(p) -> Node:
        return Node(p.nodeName(), estimated_rows(p) if from_bytes else option(p.stats().rowCount()), p.simpleString(200), [node(c) for c in seq(p.children())])

    return node(df._jdf.queryExecution().optimizedPlan())


def physical(df: DataFrame) -> Node:
    """The plan that ran, adaptive changes included, with the rows each node gave out; to be called after an action on df."""
    def node(p) -> Node:
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return node(p.executedPlan())
        if name.endswith("QueryStage"):
            return node(p.plan())
        found = p.metrics().get("numOutputRows")
        return Node(re.sub(r" \(\d+\)", "", name), int(found.get().value()) if found.isDefined() else None, p.simpleString(200), [node(c) for c in seq(p.children())])

    return node(df._jdf.queryExecution().executedPlan())


def root_estimate(df: DataFrame) -> int:
    """0 where Catalyst has none."""
    return logical(df).rows or 0


def joins(plan: Node) -> list[Node]:
    """In pre-order."""
    return [n for n in plan.walk() if is_join(n.name)]


def join_depth(plan: Node) -> int:
    """Greatest nesting of joins."""
    return max((join_depth(c) for c in plan.children), default=0) + is_join(plan.name)


def predicate_count(plan: Node) -> int:
    """Conjuncts of filters and join conditions."""
    return sum(len(re.findall(r"(?i)\bAND\b", n.text)) + 1 for n in plan.walk() if n.name == "Filter" or is_join(n.name))


@dataclass(frozen=True)
class CorrectionFeatures:
    baseline: float = 0
    left_rows: float = 0
    right_rows: float = 0
    left_distinct: float = 0
    right_distinct: float = 0
    predicate_count: float = 0
    join_depth: float = 0

    def to_list(self) -> list[float]:
        return [float(getattr(self, n)) for n in FEATURES]


#: The order of the vector that correctors learn from.
FEATURES = ("baseline", "left_rows", "right_rows", "left_distinct", "right_distinct", "predicate_count", "join_depth")


def features(plan: Node, distinct: dict[str, int] | None = None) -> CorrectionFeatures:
    """Of the outermost join, or of the plan where it has none: the one definition for training and use."""
    top = next(iter(joins(plan)), None)
    sides = [c.rows or 0 for c in top.children[:2]] if top else [plan.rows or 0, 0]
    most = lambda n: max((v for k, v in (distinct or {}).items() if any(re.search(rf"\b{re.escape(k)}#", x.text) for x in n.walk())), default=0)
    d = [most(c) for c in top.children[:2]] if top else [0, 0]
    return CorrectionFeatures(plan.rows or 0, *sides, *d, predicate_count(plan), join_depth(plan))


@dataclass
class Outcome:
    estimate: int
    actual: int
    seconds: float
    features: CorrectionFeatures
    joins: list[tuple[str, int | None, int | None]]


def _single_number(df: DataFrame) -> bool:
    """Whether the plan gives one row at most, of one bigint."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return [t for _, t in df.dtypes] == ["bigint"] and most.isDefined() and int(str(most.get())) <= 1


def actual_rows(df: DataFrame) -> int:
    """Rows of the result, or the value of a result of one row and one bigint. Runs df's own execution, whose metrics it fills, and collects one row at most."""
    if _single_number(df):
        rows = df.collect()
        return rows[0][0] or 0 if rows else 0
    n = df._jdf.queryExecution().toRdd().count()
    if n == 1 and [t for _, t in df.dtypes] == ["bigint"]:  # one row by chance
        return df.first()[0] or 0
    return n


def observe(df: DataFrame) -> Outcome:
    """Runs df once and pairs each join's estimate with its rows.

    Adaptive execution may change the order of joins, so nodes are paired by the keys in their conditions. df is planned
    anew, as metrics add up over the runs of one plan.
    """
    df = DataFrame(df._jdf.toDF(), df.sparkSession)
    before = logical(df, from_bytes=True)
    began = time.perf_counter()
    actual = actual_rows(df)
    seconds = time.perf_counter() - began
    key = lambda text: frozenset(re.findall(r"\w+#\d+", text))
    ran = [(key(n.text), n) for n in joins(physical(df))]
    pairs = []
    for n in joins(before):
        fit = max(ran, key=lambda r: len(r[0] & key(n.text)), default=None)
        pairs.append((n.text, n.rows, fit[1].rows if fit and fit[0] & key(n.text) else None))
    return Outcome(before.rows or 0, actual, seconds, features(before), pairs)
