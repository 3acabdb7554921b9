"""What a rule pack holds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True)
class Criterion:
    id: str
    label: str
    role: str  # C core, D extra
    line: str  # a line that matches is a hit
    needs: tuple[str, ...] = ()  # every match of ``line`` holds one of these words; empty: no such words
    condition: str | None = None
    codes: tuple[str, ...] = ()
    codes_fixed_or_part_time: tuple[str, ...] | None = None
    codes_part_time: tuple[str, ...] | None = None

    @property
    def topic(self) -> str:
        return self.id[:2]


@dataclass(frozen=True)
class Topic:
    id: str
    key: str
    label: str
    criteria: tuple[Criterion, ...]
    core: str  # wording that bears on the core criteria of the topic
    conditional: bool = False
    links: tuple[str, ...] = ()


@dataclass(frozen=True)
class RulePack:
    name: str
    topics: tuple[Topic, ...]
    undecided: str
    external: str
    negated: str
    negation_status: dict[str, tuple[str, str | None]]  # criterion -> (status, provisional tag)
    fixed_term_id: str | None = None  # criterion that carries term_type
    indefinite: str | None = None
    hours_id: str | None = None  # criterion that needs an hour figure
    hours: str | None = None
    workday: str | None = None  # workday counts, never evidence for the rest-day topic
    workday_line: str | None = None
    holiday_line: str | None = None
    holiday_word: str | None = None
    rest_topic: str | None = None
    catch_all_head: str | None = None
    catch_all_tail: str | None = None
    condition_word: str | None = None
    presence_only: tuple[str, ...] = ()
    neutral_targets: tuple[str, ...] = ()
    applicability_targets: tuple[str, ...] = ()
    applicability_links: tuple[str, ...] = ()
    links: dict[str, str] = field(default_factory=dict)

    @cached_property
    def digest(self) -> str:
        """Names the pack by its content."""
        return hashlib.sha256(repr(self).encode()).hexdigest()

    @property
    def criteria(self) -> list[Criterion]:
        return [c for t in self.topics for c in t.criteria]

    @property
    def criterion_ids(self) -> list[str]:
        return [c.id for c in self.criteria]

    @property
    def topic_ids(self) -> list[str]:
        return [t.id for t in self.topics]

    @property
    def core_ids(self) -> list[str]:
        return [c.id for c in self.criteria if c.role == "C"]
