"""The catalog: primitives by name, validation of plans, and provenance of results."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from graphloom.functions import tolerant_json
from graphloom.operators import graph as G
from graphloom.operators import primitives as P
from graphloom.operators.search import is_trend_question
from graphloom.plans.kg import KnowledgeGraph

MAX_STEPS = 3


@dataclass(frozen=True)
class Primitive:
    name: str
    fn: Callable[..., DataFrame]
    tier: str

    @property
    def params(self) -> dict[str, inspect.Parameter]:
        return {k: v for k, v in inspect.signature(self.fn).parameters.items() if k != "kg"}

    @property
    def required(self) -> set[str]:
        return {k for k, v in self.params.items() if v.default is inspect.Parameter.empty}


def connection_path(kg: KnowledgeGraph, source: str, target: str, max_hops: int = 6) -> DataFrame:
    return G.shortest_path(kg, source, target, max_hops)


def personalized_pagerank(kg: KnowledgeGraph, seeds: list[str], top_n: int = 20) -> DataFrame:
    from pyspark.sql import functions as F

    from graphloom.schema import clamp_top_n

    r = G.pagerank(G.build_graph(kg.relations), seeds=[s for s in seeds if s and s.strip()])
    return r.orderBy(F.desc("score"), "name").limit(clamp_top_n(top_n))


_FAMILIES = {
    "aggregation": "count_entities count_relationships distribution_by_type distribution_by_relation_type distribution_by_polarity top_entities_by_mentions top_entities_by_degree",
    "connection": "entity_dossier neighbors_by_relation cooccurrence common_connections shared_identifier_entities identifier_lookup",
    "community": "community_overview entity_communities top_central_entities link_prediction",
    "dynamics": "relationship_timeline whats_changed topic_trend polarity_evolution entity_activity",
    "event": "new_events entity_new_connections event_dossier event_timeline trending_events alerts",
    "quality": "contradictions orphans incomplete_entities merge_candidates",
    "signal": "risk_score investigate_next recommended_merges review_queue circular_ownership",
    "domain": "issue_resolution_stats communication_stats numeric_rollup",
}
CATALOG: dict[str, Primitive] = {n: Primitive(n, getattr(P, n), tier) for tier, names in _FAMILIES.items() for n in names.split()}
CATALOG["connection_path"] = Primitive("connection_path", connection_path, "connection")
CATALOG["personalized_pagerank"] = Primitive("personalized_pagerank", personalized_pagerank, "community")


def register(name: str, fn: Callable[..., DataFrame], tier: str = "custom") -> None:
    """Adds a primitive; an existing name is replaced."""
    CATALOG[name] = Primitive(name, fn, tier)


def run(name: str, kg: KnowledgeGraph, **params: Any) -> DataFrame:
    """A primitive by name; parameters that it does not have are ignored."""
    p = CATALOG[name]
    return p.fn(kg, **{k: v for k, v in params.items() if k in p.params})


@dataclass(frozen=True)
class PrimitiveCall:
    primitive: str
    params: dict[str, Any] = field(default_factory=dict)


def parse_plan(text: str, labels: tuple[str, ...] = (), max_steps: int = MAX_STEPS, **given: Any) -> list[PrimitiveCall]:
    """Steps of a plan in JSON, wherever it stands in the text; of a plan that was cut off, the complete ones.

    Unknown primitives and steps without their required parameters are dropped; a type is brought to the case of the
    known labels, an unknown one means all. ``given`` are parameters that the caller adds (such as today).
    """
    plan, cut = tolerant_json.scan(text)
    steps = plan.get("steps", []) if isinstance(plan, dict) else plan
    canon = {x.lower(): x for x in labels}
    out = []
    for s in steps if isinstance(steps, list) else []:
        p = CATALOG.get(s.get("primitive", "")) if isinstance(s, dict) and not any(s is c for c in cut) else None
        if p is None:
            continue
        params = {k: v for k, v in {**given, **(s.get("params") or {})}.items() if k in p.params and v is not None}
        if labels and "type" in params:
            params["type"] = canon.get(str(params["type"]).strip().lower())
            if params["type"] is None:
                del params["type"]
        if p.required <= set(params):
            out.append(PrimitiveCall(p.name, params))
    return out[:max_steps]


def trend_fallback(question: str, **given: Any) -> list[PrimitiveCall]:
    """Steps for a question about trends that no plan was found for: what is mentioned most and what is new; none for other questions."""
    if not is_trend_question(question):
        return []
    return [PrimitiveCall(n, {k: v for k, v in given.items() if k in CATALOG[n].params}) for n in ("top_entities_by_mentions", "new_events") if n in CATALOG]


@dataclass(frozen=True)
class Step:
    primitive: str
    params: dict[str, Any]
    rows: list[dict]
    error: str | None = None


def execute(kg: KnowledgeGraph, calls: list[PrimitiveCall], most: int = 10_000) -> list[Step]:
    """Runs the steps in turn; a failed step says so and does not stop the others. A step's first ``most`` rows are taken."""
    out = []
    for c in calls:
        try:
            out.append(Step(c.primitive, c.params, [r.asDict(recursive=True) for r in run(c.primitive, kg, **c.params).limit(most).collect()]))
        except Exception as e:  # noqa: BLE001
            out.append(Step(c.primitive, c.params, [], str(e)))
    return out
