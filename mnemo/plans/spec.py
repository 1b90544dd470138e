"""Declared graph schemas: labels, edge kinds and their validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


# Tables as schema texts.
RESERVED = {"IN_EPISODE", "SUPERSEDES", "SUMMARIZES", "REINFORCED_BY", "ALIAS_OF", "IS_A"}
ATOM = ("id string, content string, kind string, salience string, created_at timestamp, last_accessed timestamp, access_count bigint, source_instance string, cwd string, source_kind string, tier string, extracted boolean, superseded_by string, foreign_episode struct<instance: string, episode_id: string>, embedding array<float>")
ENTITY = ("id string, name string, type string, first_seen timestamp, last_seen timestamp, mention_count bigint, aliases array<string>, status string, embedding array<float>")
EPISODE = ("id string, start_time timestamp, end_time timestamp, source_instance string, cwd string, summary_memory_id string, message_count bigint, closed boolean")
MENTION = ("atom_id string, entity_id string, kind string, prominence double, created_at timestamp")
ASSOC = ("a string, b string, kind string, weight bigint, last_reinforced timestamp")
CANONICAL = (
    "activity struct<source: string, source_id: string, timestamp: timestamp, kind: string, snippet: string, url: string, thread_ts: string, parent_id: string, message_count: int>, "
    "person struct<person_key: string, display_name: string, source: string, source_id: string, avatar: string>, container struct<source: string, container_id: string, name: string, kind: string>, "
    "account struct<source: string, account_id: string, linked_person_key: string>, topics array<struct<name: string, tier: string>>, mentions array<string>, urls array<string>"
)


@dataclass(frozen=True)
class GraphSpec:
    """Kinds of atoms, entities, occurrences and associations, and the resolver's thresholds and weights."""

    atom_kinds: list[str]
    entity_types: list[str]
    occurrences: list[str]
    associations: dict[str, bool]  # kind -> weighted
    accept: float = 0.75
    uncertain: float = 0.50
    weights: dict[str, float] = field(default_factory=lambda: {"name": 0.35, "recency": 0.15, "context": 0.30, "type": 0.10, "place": 0.10})
    ageing: bool = True

    def __post_init__(self):
        edges = [*self.occurrences, *self.associations]
        for what, names in (("atom kinds", self.atom_kinds), ("entity types", self.entity_types), ("occurrences", self.occurrences), ("associations", list(self.associations))):
            if not names:
                raise ValueError(f"{what} are empty")
        for e in edges:
            if not re.fullmatch(r"[A-Z][A-Z0-9_]*", e):
                raise ValueError(f"{e} is not UPPER_SNAKE")
            if e in RESERVED:
                raise ValueError(f"{e} is reserved")
        if len(set(edges)) < len(edges) or len(set(self.atom_kinds)) < len(self.atom_kinds):
            raise ValueError("names repeat")
        if not 0 <= self.uncertain < self.accept <= 1:
            raise ValueError("0 <= uncertain < accept <= 1 must hold")


GENERAL = GraphSpec(["note", "decision", "insight", "preference", "session"], ["person", "project", "tool", "concept"], ["MENTIONS"], {"ASSOCIATED": True, "RELATED": False})
