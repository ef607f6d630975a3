"""Adapters by language: what each can measure and how its facts are read from a tree of files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import dialects

CAPABILITIES = ("ca", "ce", "instability", "abstractness", "distance", "lcom", "circular", "duplication")


@dataclass(frozen=True)
class Adapter:
    language: str
    capabilities: frozenset[str]
    facts: Callable[[DataFrame, str], DataFrame]

    def __post_init__(self):
        if unknown := self.capabilities - {*CAPABILITIES}:
            raise ValueError(f"unknown capabilities {sorted(unknown)}")

    def warnings(self) -> list[dict]:
        """A warning for each metric that is always zero."""
        return [{"code": "unsupported-metric", "message": f"{self.language} has no {c}", "module": ""} for c in CAPABILITIES if c not in self.capabilities]


@dataclass
class Registry:
    adapters: dict[str, Adapter] = field(default_factory=dict)

    def add(self, adapter: Adapter) -> None:
        if adapter.language in self.adapters:
            raise ValueError(f"{adapter.language} is registered already")
        self.adapters[adapter.language] = adapter

    def get(self, language: str) -> Adapter:
        if language not in self.adapters:
            raise LookupError(f"no adapter for {language}")
        return self.adapters[language]


def default() -> Registry:
    out = Registry()
    for language in ("go", "python", "typescript"):
        able = CAPABILITIES if language == "go" else CAPABILITIES[:-1]
        out.add(Adapter(language, frozenset(able), lambda files, kind, language=language: dialects.facts(files, language, kind)))
    return out
