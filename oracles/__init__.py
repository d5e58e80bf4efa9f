"""DuckDB oracles for the registered queries."""

from oracles import features, labels, providers, reports, streams


def all_oracles() -> dict[str, str]:
    return {**features.oracles(), **labels.oracles(), **reports.oracles(), **streams.oracles(), **providers.oracles()}
