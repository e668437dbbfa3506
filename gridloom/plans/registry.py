"""Registries: feature families by the names they match, strategies by key."""

from __future__ import annotations

import inspect
import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import LookupFailed
from ..schema import Raster

Fetch = Callable[[str], Raster]


@dataclass(frozen=True)
class FeatureSpec:
    """A parsed name: its family, what the name says, and the names it needs.

    A base feature has ``column``, which adds it to a point table; a derived one has
    ``build``, which makes its raster from those it fetches.
    """

    name: str
    family: str
    args: Mapping[str, Any]
    requires: tuple[str, ...] = ()
    column: Callable[[DataFrame], Any] | None = None
    build: Callable[[Fetch], Raster] | None = None

    @property
    def is_base(self) -> bool:
        return self.column is not None


@dataclass(frozen=True)
class Family:
    """Names of one form, and how a name becomes a spec, or None if it isn't of the form."""

    name: str
    form: str
    parse: Callable[[str], FeatureSpec | None]


@dataclass
class FeatureRegistry:
    """Families; the way for users to add features of their own (``feature``)."""

    families: list[Family] = field(default_factory=list)
    fallback: Callable[[str], FeatureSpec] | None = None

    def register(self, family: Family) -> Family:
        if any(f.form == family.form for f in self.families):
            raise LookupFailed(f"a family of the form {family.form!r} is registered already")
        self.families.append(family)
        return family

    def register_fallback(self, parse: Callable[[str], FeatureSpec]) -> None:
        if self.fallback is not None:
            raise LookupFailed("there is a fallback already")
        self.fallback = parse

    def feature(self, pattern: str, *, base: bool = False, requires: Callable[..., Sequence[str]] | None = None):
        """Decorator: a function of the groups of a regular expression that the whole name must match.

        It returns a Column of the point table (``base``) or, given the rasters it requires, a
        raster.  Without ``requires`` a derived feature needs what its group ``base_feature`` names.
        """
        compiled = re.compile(pattern)

        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            def parse(name: str) -> FeatureSpec | None:
                m = compiled.fullmatch(name)
                if m is None:
                    return None
                args = m.groupdict()
                if base:
                    return FeatureSpec(name, f.__name__, args, column=lambda points: f(points, **args))
                needs = tuple(requires(**args)) if requires else ((args["base_feature"],) if args.get("base_feature") else ())
                return FeatureSpec(name, f.__name__, args, needs, build=lambda fetch: f(*[fetch(n) for n in needs], **args))

            self.register(Family(f.__name__, pattern, parse))
            return f

        return add

    def match(self, name: str) -> FeatureSpec:
        """What the one family that can read the whole name makes of it, else the fallback."""
        found = [spec for family in self.families if (spec := family.parse(name)) is not None]
        if len(found) > 1:
            raise LookupFailed(f"{name!r} is read by several families: {', '.join(spec.family for spec in found)}")
        if found:
            return found[0]
        if self.fallback is None:
            raise LookupFailed(f"no family reads {name!r}")
        return self.fallback(name)

    def copy(self) -> FeatureRegistry:
        return FeatureRegistry(list(self.families), self.fallback)


@dataclass
class StrategyRegistry:
    """Strategy classes by key."""

    kind: type
    entries: dict[str, type] = field(default_factory=dict)

    def register(self, key: str, strategy: type | None = None):
        def add(s: type) -> type:
            if key in self.entries:
                raise LookupFailed(f"{self.kind.__name__} {key!r} is registered already")
            self.entries[key] = s
            return s

        return add if strategy is None else add(strategy)

    def get_strategy(self, key: str) -> type:
        if key not in self.entries:
            raise LookupFailed(f"no {self.kind.__name__} {key!r}; there are {', '.join(sorted(self.entries))}")
        return self.entries[key]

    def key_of(self, strategy: Any) -> str:
        """The key of a strategy or its class; of a class that isn't registered, that of the nearest base class that is."""
        kind = strategy if isinstance(strategy, type) else type(strategy)
        keys = {s: key for key, s in self.entries.items()}
        for base in kind.__mro__:
            if base in keys:
                return keys[base]
        raise LookupFailed(f"{kind.__name__} is not registered")

    def create(self, key: str, **options: Any) -> Any:
        """A strategy; options that it doesn't know are an error, or dropped with a warning if it says it takes any."""
        strategy = self.get_strategy(key)
        parameters = inspect.signature(strategy).parameters
        if any(p.kind is p.VAR_KEYWORD for p in parameters.values()):
            unknown = sorted(set(options) - set(parameters))
            if unknown:
                warnings.warn(f"{key}: unknown options {unknown} are ignored", stacklevel=2)
            options = {k: v for k, v in options.items() if k not in unknown}
        return strategy(**options)

    def coerce(self, value: Any) -> Any:
        """A strategy from itself, its key, or a pair of key and options."""
        if isinstance(value, self.kind):
            return value
        if isinstance(value, str):
            return self.create(value)
        if isinstance(value, type) and issubclass(value, self.kind):
            return value()
        if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], str) and isinstance(value[1], Mapping):
            return self.create(value[0], **value[1])
        raise TypeError(f"a {self.kind.__name__}, its key or (key, options) is needed, not {value!r}")
