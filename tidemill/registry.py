"""Registries of named builders."""

from __future__ import annotations

from collections.abc import Callable

from tidemill.errors import ConfigurationError


class Registry:
    """Names to callables.  Names are case-insensitive, ``-`` and ``_`` are the same, and none is taken twice."""

    def __init__(self, what: str):
        self.what = what
        self._found: dict[str, Callable] = {}

    @staticmethod
    def key(name: str) -> str:
        return name.strip().lower().replace("-", "_")

    def register(self, *names: str) -> Callable[[Callable], Callable]:
        def add(builder: Callable) -> Callable:
            for name in names:
                if self.key(name) in self._found:
                    raise ConfigurationError(f"{self.what} {name!r} exists already")
                self._found[self.key(name)] = builder
            return builder

        return add

    def get(self, name: str) -> Callable:
        try:
            return self._found[self.key(name)]
        except KeyError:
            raise ConfigurationError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self._found))}") from None

    def names(self) -> list[str]:
        return sorted(self._found)
