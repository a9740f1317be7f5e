"""How a module of queries collects them."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, each with the SQL that gives the same rows, or none."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return keep
