"""The feature names that the engine knows.

A name is parts between underscores.  Its first part is its family's word; a family's
``Form`` says what may follow: an axis, the name of another feature, and a tail that is as
long as it can be.  ``average``, ``sum`` and ``norm`` take a list in parentheses, and red
relief takes its arguments there.  Names that no family can read are scalar fields of just
that name.  Values are checked when the raster is planned, but those of red relief when the
name is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import functions as F

from ..operators import projection, rasters, red_relief
from ..operators.interpolation import Cubic, Delaunay, Interpolation, Linear, Nearest
from ..operators.projection import Orthographic, Perspective, Projection, Spherical
from ..schema import Raster
from .registry import Family, FeatureRegistry, FeatureSpec, StrategyRegistry

PROJECTIONS = StrategyRegistry(Projection)
PROJECTIONS.register("orthographic", Orthographic)
PROJECTIONS.register("spherical", Spherical)
PROJECTIONS.register("perspective", Perspective)
INTERPOLATIONS = StrategyRegistry(Interpolation)
INTERPOLATIONS.register("linear", Linear)
INTERPOLATIONS.register("nearest_neighbor", Nearest)
INTERPOLATIONS.register("cubic", Cubic)
INTERPOLATIONS.register("delaunay", Delaunay)

FEATURES = FeatureRegistry()


# Numbers: each reader gives the value of a text that is such a number, else None.


def whole(text: str) -> int | None:
    return int(text) if text.isdecimal() else None


def decimal(text: str) -> float | None:
    """Digits, or digits, a point and digits."""
    return float(text) if all(p.isdecimal() for p in text.split(".", 1)) else None


def signed(text: str) -> float | None:
    value = decimal(text[1:] if text[:1] in ("+", "-") else text)
    return value if value is None else -value if text[0] == "-" else value


def scientific(text: str) -> float | None:
    """A signed number that may have an exponent."""
    mantissa, mark, exponent = text.replace("E", "e").partition("e")
    if mark and signed(exponent) is None or "." in exponent or signed(mantissa) is None:
        return None
    return float(text)


def pair(text: str) -> tuple[float, float] | None:
    low, _, high = text.partition("-")
    return None if decimal(low) is None or decimal(high) is None else (float(low), float(high))


def scales(text: str) -> tuple[float, ...] | None:
    values = [decimal(t) for t in text.split("-")]
    return None if None in values else tuple(values)  # type: ignore[arg-type]


# Options: words of the language (fixed values), each with the setting it changes, what it
# means by itself, and how what follows it is read.


@dataclass(frozen=True)
class Option:
    word: str
    target: str
    plain: Any = None
    number: Callable[[str], Any] | None = None

    def read(self, token: str) -> Any:
        """The setting's value that ``token`` asks for; None if it isn't this option."""
        if token == self.word and self.plain is not None:
            return self.plain
        if self.number is None or not token.startswith(self.word):
            return None
        return self.number(token[len(self.word) :])


FUSING = (
    Option("max", "fuse", "max"), Option("mean", "fuse", "mean"), Option("sum", "fuse", "sum"),
    Option("raw", "scaled", False), Option("nonorm", "scaled", False), Option("norm", "scaled", True), Option("scale", "scaled", True),
)
MAGNITUDE = (Option("mag", "magnitude", True), Option("components", "magnitude", True))
MASKING = (
    Option("thresh", "threshold", number=scientific), Option("sigmae", "edge_sigma", number=scientific), Option("dilate", "dilate", number=whole),
    Option("soft", "soft", 0.3, scientific), Option("mask", "with_mask", True),
)
RELIEF = (
    Option("r", "distance", number=whole), Option("d", "directions", number=whole), Option("sclip", "slope_clip", number=pair),
    Option("oclip", "structure_clip", number=pair), Option("z", "z", number=scientific), Option("red", "red", number=signed),
)
COMPONENTS = ("slope", "positive", "negative", "structure")


def read_option(token: str, options: Sequence[Option]) -> dict[str, Any] | None:
    """The setting that one of the options gives, or None."""
    for option in options:
        value = option.read(token)
        if value is not None:
            return {option.target: value}
    return None


def read_options(tokens: Sequence[str], options: Sequence[Option]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for token in tokens:
        found = read_option(token.lower(), options)
        if found is None:
            raise ValueError(f"unknown option {token!r}")
        out |= found
    return out


# Tails: what may stand after the base name.  Given the parts, a tail gives, from the longest
# on, how many parts it leaves to the base name and what the others say.

Tail = Callable[[list[str]], Iterator[tuple[int, dict[str, Any]]]]


def bare(parts: list[str]) -> Iterator[tuple[int, dict[str, Any]]]:
    yield len(parts), {}


def spaced(parts: list[str]) -> Iterator[tuple[int, dict[str, Any]]]:
    """``pxNUM``, the pixels' spacing."""
    if found := read_option(parts[-1], [Option("px", "spacing", number=decimal)]):
        yield len(parts) - 1, found
    yield from bare(parts)


def numbered(*names: str, least: int = 0, each: bool = False) -> Tail:
    """Numbers of these names: all or, unless ``least`` says otherwise, none; with ``each``, any first few of them."""

    def tail(parts: list[str]) -> Iterator[tuple[int, dict[str, Any]]]:
        for k in range(len(names), least - 1, -1):
            values = [decimal(p) for p in parts[len(parts) - k :]]
            if k <= len(parts) and None not in values and (each or k in (0, len(names))):
                yield len(parts) - k, dict(zip(names, values, strict=False))

    return tail


def scaled(extra: str) -> Tail:
    """Scales, and options of letters, digits, ``-`` and the characters of ``extra``; they are read when the raster is planned."""

    def tail(parts: list[str]) -> Iterator[tuple[int, dict[str, Any]]]:
        for k in range(1, len(parts)):
            rest = parts[k + 1 :]
            known = all(c.isascii() and c.isalnum() or c in "-" + extra for p in rest for c in p)
            if scales(parts[k]) and known and rest != [""]:
                yield k, {"scales": scales(parts[k]), "options": tuple(rest)}

    return tail


@dataclass(frozen=True)
class Form:
    """What follows a family's word: an axis ("no", "must", "may"), a base name, a tail; ``default`` stands for a missing base name."""

    word: str
    axis: str = "no"
    tail: Tail = bare
    default: str | None = None

    def read(self, name: str) -> dict[str, Any] | None:
        """What the name says, or None if it isn't of this form."""
        first, *parts = name.split("_")
        if first != self.word or "\n" in name:
            return None
        if not parts:
            return None if self.default is None else {"base": self.default}
        if self.axis != "no" and parts[0] in ("x", "y") and (told := self._rest(parts[1:])):
            return {"axis": parts[0]} | told
        return None if self.axis == "must" else self._rest(parts)

    def _rest(self, parts: list[str]) -> dict[str, Any] | None:
        for k, told in self.tail(parts) if parts else ():
            if base := "_".join(parts[:k]):
                return {"base": base} | told
        return None


def split_names(text: str) -> list[str]:
    """The parts between commas that no parenthesis encloses, stripped."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[last:i].strip())
            last = i + 1
    return [*parts, text[last:].strip()]


def enclosed(name: str, word: str) -> str | None:
    """What stands in the parentheses of ``word_(...)``."""
    return name[len(word) + 2 : -1] if name.startswith(f"{word}_(") and name.endswith(")") and "\n" not in name else None


# Base features.


def scalar_field(points: Any, field: str):
    if field not in points.columns:
        raise ValueError(f"the points have no scalar field {field!r}")
    return F.col(f"`{field}`")


def _field(name: str, field: str) -> FeatureSpec:
    return FeatureSpec(name, "scalar_field", {"field": field}, column=lambda points: scalar_field(points, field))


def _prefixed_field(name: str) -> FeatureSpec | None:
    field = name.removeprefix("scalar_field_")
    return _field(name, field) if field and field != name and "\n" not in field else None


FEATURES.register(Family("range", "range", lambda name: FeatureSpec(name, "range", {}, column=lambda _: projection.distance()) if name == "range" else None))
FEATURES.register(Family("scalar_field", "scalar_field_<field>", _prefixed_field))
FEATURES.register_fallback(lambda name: _field(name, name))


# Features of one other feature.


def _derived(form: Form, build: Callable[..., Raster]) -> None:
    def parse(name: str) -> FeatureSpec | None:
        told = form.read(name)
        if told is None:
            return None
        base = told["base"]
        given = {k: v for k, v in told.items() if k != "base"}
        return FeatureSpec(name, form.word, told, (base,), build=lambda fetch: build(fetch(base), **given))

    FEATURES.register(Family(form.word, f"{form.word}_<base>", parse))


def _multigrad(raster: Raster, scales: Sequence[float], options: Sequence[str], axis: str | None = None) -> Raster:
    told = read_options(options, FUSING + MAGNITUDE)
    if told.pop("magnitude", False) and axis is not None:
        raise ValueError("magnitudes and components do not go with an axis")
    return rasters.multigrad(raster, list(scales), axis, **told)


def _multigradocc(raster: Raster, scales: Sequence[float], options: Sequence[str], axis: str | None = None) -> Raster:
    return rasters.multigradocc(raster, list(scales), axis, **read_options(options, FUSING + MASKING))


_derived(Form("gradient", "must", spaced), lambda raster, axis, spacing=100.0: rasters.gradient(raster, axis, spacing))
_derived(Form("sobel", "must"), rasters.sobel)
_derived(Form("normalized", tail=numbered("low", "high")), lambda raster, low=0.0, high=100.0: rasters.normalized(raster, low, high))
_derived(Form("clip", tail=numbered("low", "high", least=2)), rasters.clip)
_derived(Form("log"), rasters.logarithm)
_derived(Form("square"), rasters.square)
_derived(Form("sqrt"), rasters.square_root)
_derived(Form("hillshade", tail=numbered("azimuth", "altitude", "z", each=True), default="range"), rasters.hillshade)
_derived(Form("multigrad", "may", scaled("")), _multigrad)
_derived(Form("multigradocc", "may", scaled(".")), _multigradocc)


# Features of several others.


def _combined(word: str, build: Callable[[Sequence[Raster]], Raster]) -> None:
    def parse(name: str) -> FeatureSpec | None:
        inside = enclosed(name, word)
        pieces = (inside or "").split(",")
        if len(pieces) < 2 or not all(pieces):
            return None
        names = tuple(split_names(inside or ""))
        return FeatureSpec(name, word, {"names": names}, names, build=lambda fetch: build([fetch(n) for n in names]))

    FEATURES.register(Family(word, f"{word}_(<names>)", parse))


_combined("average", rasters.average)
_combined("sum", rasters.add)
_combined("norm", rasters.norm)


# Red relief.


def relief_settings(args: str) -> tuple[str, red_relief.Settings]:
    """Base name (range if none is given) and checked settings; a first argument that reads as an option is one."""
    base, settings = "range", red_relief.Settings()
    for k, token in enumerate(t for t in split_names(args) if t):
        found = read_option(token, RELIEF)
        if found is not None:
            settings = replace(settings, **found)
        elif k == 0:
            base = token
        else:
            raise ValueError(f"unknown red relief option {token!r}")
    return base, settings.checked()


def format_number(value: float) -> str:
    """Whole numbers without a fraction, others in the shortest form that reads back the same."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def pack_name(base: str, settings: red_relief.Settings) -> str:
    """The name under which packs are shared: of all settings only those that the pack depends on."""
    return f"rrim_pack_({base},r{settings.distance},d{settings.directions},z{format_number(settings.z)})"


def _relief_pack(name: str) -> FeatureSpec | None:
    args = enclosed(name, "rrim_pack")
    if args is None:
        return None
    base, settings = relief_settings(args)
    return FeatureSpec(name, "rrim_pack", {"base": base, "settings": settings}, (base,), build=lambda fetch: red_relief.pack(fetch(base), settings))


def _relief_component(name: str) -> FeatureSpec | None:
    args = enclosed(name, "rrim_component")
    if args is None:
        return None
    first, *rest = [t for t in split_names(args) if t] or [""]
    component = first.lower()
    if component not in COMPONENTS:
        raise ValueError(f"a component is one of {', '.join(COMPONENTS)}, not {component!r}")
    base, settings = relief_settings(",".join(rest))
    told = {"base": base, "settings": settings, "component": component}
    if component == "slope":
        return FeatureSpec(name, "rrim_component", told, (base,), build=lambda fetch: red_relief.slope(fetch(base), settings))
    packed = pack_name(base, settings)
    return FeatureSpec(name, "rrim_component", told, (packed,), build=lambda fetch: fetch(packed).select({"v": F.col(component)}))


def _relief(name: str) -> FeatureSpec | None:
    args = "" if name == "rrim" else enclosed(name, "rrim")
    if args is None:
        return None
    base, settings = relief_settings(args)
    packed = pack_name(base, settings)

    def build(fetch: Callable[[str], Raster]) -> Raster:
        structure = fetch(packed).select({"v": F.col("structure")})
        return red_relief.compose(red_relief.slope(fetch(base), settings), structure, settings)

    return FeatureSpec(name, "rrim", {"base": base, "settings": settings}, (base, packed), build=build)


def enable_red_relief(registry: FeatureRegistry = FEATURES) -> FeatureRegistry:
    """Register the red relief names; they are opt-in, and registered once."""
    if not any(f.name.startswith("rrim") for f in registry.families):
        registry.register(Family("rrim_pack", "rrim_pack_(<args>)", _relief_pack))
        registry.register(Family("rrim_component", "rrim_component_(<args>)", _relief_component))
        registry.register(Family("rrim", "rrim[_(<args>)]", _relief))
    return registry
