"""A measuring harness: trials over selected queries, reports, calibration and ablation of correctors."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path
from threading import Timer

from pyspark.sql import SparkSession

from cardlens.operators.bounds import saturating_clamp
from cardlens.plans import capture
from cardlens.plans.correctors import Corrector
from cardlens.plans.feedback import FeedbackStore, Observation, q_error_floored
from cardlens.sources.tables import evict_page_cache


@dataclass
class QueryOutcome:
    query: str
    trial: int
    seconds: float
    estimate: int = 0
    corrected: int = 0
    actual: int = 0
    error: str | None = None
    features: dict = field(default_factory=dict)
    joins: list = field(default_factory=list)

    @property
    def q_error(self) -> float:
        return q_error_floored(self.corrected, self.actual)


def select(names: list[str], only: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """only first, then exclude."""
    return [n for n in names if (not only or n in only) and n not in (exclude or [])]


def run(spark: SparkSession, queries: dict, folder: str, trials: int = 1, only=None, exclude=None, timeout: float = 0, cold: bool = False, corrector: Corrector | None = None, ceiling: int = 2**40, store: FeedbackStore | None = None, report: str | None = None) -> list[QueryOutcome]:
    """Every outcome is kept, failures and timeouts too; the report is rewritten after each query."""
    out: list[QueryOutcome] = []
    for name in select(list(queries), only, exclude):
        for trial in range(trials):
            if cold:
                spark.catalog.clearCache()
                evict_page_cache(folder)
            tag = uuid.uuid4().hex
            spark.addTag(tag)
            timer = Timer(timeout, lambda tag=tag: spark.interruptTag(tag)) if timeout else None
            began = time.perf_counter()
            try:
                if timer:
                    timer.start()
                seen = capture.observe(queries[name](spark, folder))
                found = corrector.correct(seen.features) if corrector else None
                corrected = seen.estimate if found is None else saturating_clamp(found, ceiling)
                out.append(QueryOutcome(name, trial, seen.seconds, seen.estimate, corrected, seen.actual, None, asdict(seen.features), seen.joins))
                if store:
                    store.record(Observation(name, name, seen.estimate, seen.actual, seen.seconds * 1000, seen.features))
            except Exception as e:  # noqa: BLE001  recorded as this query's outcome
                out.append(QueryOutcome(name, trial, time.perf_counter() - began, error=str(e)[:300]))
            finally:
                if timer:
                    timer.cancel()
                spark.removeTag(tag)
            if report:
                Path(report).write_text(json.dumps({"n_queries": len({o.query for o in out}), "outcomes": [asdict(o) for o in out]}, default=str))
    return out


def load_report(path: str) -> list[QueryOutcome]:
    """The outcomes of a report that run() wrote."""
    return [QueryOutcome(**{k: o[k] for k in QueryOutcome.__dataclass_fields__}) for o in json.loads(Path(path).read_text())["outcomes"]]


def geomean(x: list[float]) -> float:
    return math.exp(sum(map(math.log, x)) / len(x)) if x else math.nan


def q_summary(outcomes: list[QueryOutcome]) -> dict:
    q = [o.q_error for o in outcomes if not o.error]
    finite = [x for x in q if math.isfinite(x)]
    return {"geomean": geomean(finite), "max": max(finite, default=math.nan), "non_finite": len(q) - len(finite), "failed": sum(bool(o.error) for o in outcomes)}


def join_q_summary(outcomes: list[QueryOutcome]) -> dict:
    q = [q_error_floored(e, a) for o in outcomes for _, e, a in o.joins if e is not None and a is not None]
    return {"geomean": geomean(q), "max": max(q, default=math.nan), "joins": len(q)}


def compare(before: list[QueryOutcome], after: list[QueryOutcome]) -> dict:
    """Ratio of mean times by query, and its geometric mean."""
    mean = lambda rows, n: sum(o.seconds for o in rows if o.query == n and not o.error) / max(1, sum(o.query == n and not o.error for o in rows))
    names = sorted({o.query for o in before if not o.error} & {o.query for o in after if not o.error})
    ratios = {n: mean(before, n) / max(1e-9, mean(after, n)) for n in names}
    return {"ratios": ratios, "geomean": geomean(list(ratios.values()))}


def calibrate(before: list[QueryOutcome], after: list[QueryOutcome]) -> dict:
    """Average q-errors, and how many queries improved."""
    q = lambda rows: {o.query: o.q_error for o in rows if not o.error}
    a, b = q(before), q(after)
    both = sorted(a.keys() & b.keys())
    average = lambda x: sum(x[n] for n in both) / max(1, len(both))
    return {"before": average(a), "after": average(b), "improved": sum(b[n] < a[n] for n in both), "queries": len(both)}


def ablation(estimate: int, recalled: int | None, ceiling: int, multiplicative: float | None = None, additive: float | None = None) -> dict[str, int]:
    """Estimates layer by layer: native, recalled, under the ceiling, and corrected in either way."""
    layers = {"native": estimate, "recall": estimate if recalled is None else recalled}
    layers["ceiling"] = min(layers["recall"], ceiling) or ceiling
    layers["multiplicative"] = layers["ceiling"] if multiplicative is None else saturating_clamp(layers["ceiling"] * math.exp(min(multiplicative, 700)), ceiling)
    layers["additive"] = layers["multiplicative"] if additive is None else saturating_clamp(additive, ceiling)
    return layers


def dispatch(previous: int) -> str:
    """An additive corrector where there is nothing to multiply."""
    return "additive" if previous == 0 else "multiplicative"
