"""Recipes: an ordered list of steps, how to measure, and an optional calibration; kept as JSON."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

from ..operators.adjust import MEASURED
from ..operators.measure import Calibration, Options, PositiveRule
from .arrays import Raster
from .catalog import STEPS, lookup

FORMAT, VERSION = "pixelgrain-recipe", 1


@dataclass(frozen=True)
class Step:
    kind: str
    values: dict[str, float] = field(default_factory=dict)
    enabled: bool = True

    def get(self, key: str) -> float:
        """The value, or the 8-bit default where it is missing."""
        return self.values[key] if key in self.values else lookup(self.kind).fallback(key)

    def signature(self) -> str:
        return f"{self.kind}|{int(self.enabled)}|" + ",".join(f"{k}={v!r}" for k, v in sorted(self.values.items()))

    @classmethod
    def create(cls, kind: str, image: Raster | None = None, **values: float) -> Step:
        """A step with its parameters resolved against an image, and some of them set."""
        params = [p.resolve(image) if image is not None else p for p in lookup(kind).params]
        return cls(kind, {p.key: float(values.get(p.key, p.default if image is not None else lookup(kind).fallback(p.key))) for p in params})


@dataclass(frozen=True)
class Measure:
    min_area: float = 0.0
    max_area: float = 0.0
    exclude_edges: bool = False
    eight_connected: bool = True
    intensity_from_original: bool = True
    channel: str = "luminance"
    classify: bool = False
    positive_threshold: float = 0.0
    positive_above: bool = True

    def options(self, calibration: Calibration | None = None, label: str | None = None) -> Options:
        rule = PositiveRule(self.positive_threshold, self.positive_above) if self.classify else None
        return Options(self.min_area, self.max_area, self.exclude_edges, self.eight_connected, (), rule, label or self.channel, calibration or Calibration())


_CAMEL = {f: "".join(w if k == 0 else w.title() for k, w in enumerate(f.split("_"))) for f in Measure.__dataclass_fields__}


@dataclass(frozen=True)
class Recipe:
    """Immutable; edits return a new recipe."""

    name: str = "recipe"
    steps: tuple[Step, ...] = ()
    measure: Measure = Measure()
    calibration: Calibration | None = None

    def add(self, step: Step, after: int | None = None) -> Recipe:
        at = len(self.steps) if after is None else after + 1
        return replace(self, steps=(*self.steps[:at], step, *self.steps[at:]))

    def remove(self, index: int) -> Recipe:
        return replace(self, steps=self.steps[:index] + self.steps[index + 1 :])

    def move(self, index: int, by: int) -> Recipe:
        steps = list(self.steps)
        step = steps.pop(index)
        steps.insert(min(max(index + by, 0), len(steps)), step)
        return replace(self, steps=tuple(steps))

    def duplicate(self, index: int) -> Recipe:
        return self.add(self.steps[index], index)

    def toggle(self, index: int) -> Recipe:
        s = self.steps[index]
        return replace(self, steps=(*self.steps[:index], replace(s, enabled=not s.enabled), *self.steps[index + 1 :]))

    def set_value(self, index: int, key: str, value: float, image: Raster | None = None) -> Recipe:
        """A value clamped to its range and snapped to its step."""
        s = self.steps[index]
        p = next(p for p in lookup(s.kind).params if p.key == key)
        p = p.resolve(image) if image is not None else p
        snapped = min(max(p.low + round((value - p.low) / p.step) * p.step, p.low), p.high) if p.scale != "value" and p.scale != "span" else min(max(value, p.low), p.high)
        return replace(self, steps=(*self.steps[:index], replace(s, values=s.values | {key: snapped}), *self.steps[index + 1 :]))

    def clear(self) -> Recipe:
        return replace(self, steps=())

    def rename(self, name: str) -> Recipe:
        return replace(self, name=name.strip() or "recipe")

    def to_json(self) -> str:
        body = {
            "format": FORMAT,
            "version": VERSION,
            "name": self.name,
            "steps": [{"kind": s.kind, "enabled": s.enabled, "values": dict(sorted(s.values.items()))} for s in self.steps],
            "measure": {_CAMEL[k]: v for k, v in asdict(self.measure).items()},
        }
        if self.calibration is not None and self.calibration.is_calibrated:
            body["calibration"] = {"unitsPerPixel": self.calibration.units_per_pixel, "unit": self.calibration.unit}
        return json.dumps(body, ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        """ValueError for anything that is not a recipe of this version or older, or that names an unknown step."""
        try:
            body = json.loads(text)
        except ValueError as e:
            raise ValueError("not a recipe file") from e
        if not isinstance(body, dict) or body.get("format") != FORMAT:
            raise ValueError("not a recipe file")
        if body.get("version", 0) > VERSION:
            raise ValueError("the recipe was made by a newer version")
        steps = []
        for s in body.get("steps") or []:
            if s.get("kind") not in STEPS:
                raise ValueError(f"unknown step {s.get('kind')!r}")
            steps.append(Step(s["kind"], {k: float(v) for k, v in (s.get("values") or {}).items() if math.isfinite(v)}, s.get("enabled", True)))
        given = body.get("measure") or {}
        measure = Measure(**{f: given[c] for f, c in _CAMEL.items() if c in given})
        if measure.channel not in MEASURED:
            raise ValueError(f"unknown channel {measure.channel!r}")
        c = body.get("calibration")
        try:
            calibration = Calibration(c["unitsPerPixel"], c["unit"]) if c else None
        except (ValueError, KeyError):
            calibration = None
        return cls((body.get("name") or "").strip() or "recipe", tuple(steps), measure, calibration)
