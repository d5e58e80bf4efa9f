"""Providers: a log's schema, taxonomy, thresholds and own feature groups under one name.

A provider's configuration is a mapping or a YAML file, read when first asked for. Its taxonomy sections
are merged into the base taxonomy key by key, at any depth; lists and single values replace.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import cached_property
from typing import Any

from logtide.operators.locations import FeatureGroup
from logtide.operators.rules import BASE_TAXONOMY, RuleSet, merge_taxonomy
from logtide.plans.run import RunConfig
from logtide.schema import LogSchema, get_schema

#: Fixed: configuration sections that are merged into the base taxonomy.
TAXONOMY_SECTIONS = ("taxonomy", "behavior_type", "automation_category", "required_features", "derived_columns")


def load_config(path: str) -> dict[str, Any]:
    """A YAML file as a mapping; an empty file is an empty one. Missing or malformed files raise."""
    import yaml
    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    if not isinstance(config, dict):
        raise ValueError(f"{path}: a configuration is a mapping, not {type(config).__name__}")
    return config


def _chosen(kind: type, given: dict[str, Any], where: str) -> dict[str, Any]:
    unknown = sorted(set(given) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{where}: unknown settings {unknown}")
    return given


@dataclass(frozen=True)
class Provider:
    """One log source. ``config`` may name a base schema preset (``schema.preset``) and override its fields,
    override taxonomy sections and set thresholds of the rules (``rule_based``)."""

    name: str
    config: dict[str, Any] = field(default_factory=dict, hash=False)
    config_path: str | None = None
    extractors: tuple[FeatureGroup, ...] = ()

    @cached_property
    def settings(self) -> dict[str, Any]:
        """The file's configuration with ``config`` merged over it."""
        return merge_taxonomy(load_config(self.config_path) if self.config_path else {}, self.config)

    @cached_property
    def schema(self) -> LogSchema:
        given = dict(self.settings.get("schema", {}))
        base = get_schema(given.pop("preset", "default"))
        return base.with_options(**_chosen(LogSchema, given, f"provider {self.name}, schema"))

    @cached_property
    def taxonomy(self) -> dict[str, Any]:
        own = {k: v for k, v in self.settings.items() if k in TAXONOMY_SECTIONS}
        return merge_taxonomy(BASE_TAXONOMY, own)

    @property
    def behavior_type(self) -> dict[str, Any]:
        return self.taxonomy.get("behavior_type", {})

    @property
    def automation_category(self) -> dict[str, Any]:
        return self.taxonomy.get("automation_category", {})

    @cached_property
    def rules(self) -> RuleSet:
        own = _chosen(RuleSet, self.settings.get("rule_based", {}), f"provider {self.name}, rule_based")
        return replace(RuleSet(taxonomy=self.taxonomy), **own)

    def run_config(self, extractors: tuple[str, ...] | None = None, **options: Any) -> RunConfig:
        """Options of a run of this provider: its schema and rules, and its extractors (all, or those named)."""
        known = {g.name: g for g in self.extractors}
        unknown = sorted(set(extractors or ()) - set(known))
        if unknown:
            raise ValueError(f"provider {self.name} has no extractors {unknown}; it has {sorted(known)}")
        groups = tuple(known.values()) if extractors is None else tuple(known[n] for n in extractors)
        return RunConfig(**{"schema": self.schema, "rules": self.rules, "custom_groups": groups} | options)


_PROVIDERS: dict[str, Provider] = {}
DEFAULT = "archive"


def register_provider(provider: Provider) -> Provider:
    """Make a provider known under its name; a later one of that name replaces it."""
    _PROVIDERS[provider.name] = provider
    return provider


def get_provider(name: str = DEFAULT) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; available: {provider_names()}")
    return _PROVIDERS[name]


def provider_names() -> list[str]:
    return sorted(_PROVIDERS)


register_provider(Provider(DEFAULT, {"schema": {"preset": "archive"}}))
