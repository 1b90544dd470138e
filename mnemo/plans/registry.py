"""Named functions with checked arguments, and bundles of them by instance type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from mnemo.operators import clinical, graph, portfolio, recall, research, search


@dataclass(frozen=True)
class Function:
    """A context function: bounds are {argument: (least, most)} for numbers or a set of allowed values."""

    name: str
    run: Callable[..., DataFrame]
    bounds: dict = field(default_factory=dict)

    def __call__(self, *tables, **args) -> DataFrame:
        for k, b in self.bounds.items():
            if k in args and (args[k] not in b if isinstance(b, (set, frozenset)) else not b[0] <= args[k] <= b[1]):
                raise ValueError(f"{self.name}: {k} must be within {b}")
        return self.run(*tables, **args)


class Registry(dict):
    def add(self, name: str, run: Callable, **bounds) -> None:
        if name in self:
            raise ValueError(f"{name} is registered already")
        self[name] = Function(name, run, bounds)

    def bundle(self, kind: str) -> dict[str, Function]:
        return {n: self[n] for n in BUNDLES[kind]}


FUNCTIONS = Registry()
for _name, _run, _bounds in (
    ("get_recent_activity", graph.recent_activity, {"limit": (1, 1000)}),
    ("get_timeline", graph.timeline, {"hops": (1, 3)}),
    ("get_neighborhood", graph.neighborhood, {"most": (1, 500), "direction": {"in", "out", "both"}}),
    ("get_context_packet", recall.context_packet, {"limit": (1, 50)}),
    ("associate", recall.associate, {"limit": (1, 30)}),
    ("working_memory", recall.working_memory, {"limit": (1, 50)}),
    ("recall_episode", recall.recall_episode, {"limit": (1, 50)}),
    ("get_people_context", recall.people_context, {}),
    ("get_decision_log", recall.log_of_kinds, {"limit": (1, 50)}),
    ("find_cohort", clinical.cohort, {}),
    ("get_medication_adherence", clinical.adherence, {}),
    ("compare_observations", clinical.compare, {}),
    ("get_trending", research.trending, {}),
    ("get_landscape", research.landscape, {"n": (1, 100)}),
    ("get_entity_network", research.network, {"depth": (1, 2)}),
    ("get_cross_project_impact", portfolio.cross_project_impact, {"depth": (1, 4)}),
    ("get_dependency_graph", portfolio.dependency_graph, {}),
    ("find_stale_projects", portfolio.stale, {"days": (1, 3650)}),
    ("search_vectors", search.nearest, {"k": (1, 1000)}),
):
    FUNCTIONS.add(_name, _run, **_bounds)

BUNDLES = {
    "general": ["get_recent_activity", "get_timeline", "get_neighborhood", "get_context_packet", "associate", "working_memory", "recall_episode", "get_people_context", "get_decision_log", "search_vectors"],
    "clinical": ["find_cohort", "get_medication_adherence", "compare_observations"],
    "research": ["get_trending", "get_landscape", "get_entity_network"],
    "portfolio": ["get_cross_project_impact", "get_dependency_graph", "find_stale_projects"],
}
