"""Which rasters a list of names needs, in what order, each once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from ..schema import Raster
from .registry import FeatureRegistry, FeatureSpec


class FeaturePlan:
    """The rasters of one source and resolution: names to lazy plans, shared between names and requests.

    A raster that several others are built from is marked for reuse, since Spark plans
    each branch anew; ``reuse`` decides what that means (the engine persists it).
    """

    def __init__(self, registry: FeatureRegistry, reuse: Callable[[Raster], Raster] = lambda r: r) -> None:
        self.registry, self.reuse = registry, reuse
        self._made: dict[str, Raster] = {}
        self._targets: list[str] = []
        self._specs: dict[str, FeatureSpec] = {}
        self._uses: Counter[str] = Counter()

    def request(self, names: Iterable[str]) -> None:
        """Set the targets and find all that they need; a cycle is an error, shared needs are not."""
        self._targets, self._specs, self._uses = list(dict.fromkeys(names)), {}, Counter()
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in open_:
                raise ValueError("dependency cycle: " + " -> ".join([*open_[open_.index(name) :], name]))
            if name in self._made or name in self._specs:
                return
            open_.append(name)
            spec = self.registry.match(name)
            for need in spec.requires:
                visit(need)
                self._uses[need] += 1
            open_.pop()
            self._specs[name] = spec

        for name in self._targets:
            visit(name)

    def base_features(self) -> dict[str, FeatureSpec]:
        """The base features that no earlier request has made."""
        return {n: s for n, s in self._specs.items() if s.is_base}

    def submit(self, name: str, raster: Raster) -> None:
        self._made[name] = raster

    def available_features(self) -> list[str]:
        return list(self._made)

    def get(self, name: str) -> Raster:
        """A raster of this request or an earlier one."""
        if name not in self._made:
            spec = self._specs.get(name) or self.registry.match(name)
            if spec.build is None:
                raise ValueError(f"the base feature {name!r} was not submitted")
            made = spec.build(self.get)
            self._made[name] = self.reuse(made) if self._uses[name] > 1 else made
        return self._made[name]

    def targets(self) -> dict[str, Raster]:
        return {name: self.get(name) for name in self._targets}
