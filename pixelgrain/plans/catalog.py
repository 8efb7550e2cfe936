"""The 31 kinds of step: parameters with defaults and ranges, and what each does to the state of an image.

Recipes store every parameter as a number (choices by place, toggles as 0 or 1), so the order of choices matters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from .. import kernels
from ..operators.measure import Calibration
from ..operators.stats import METHODS
from . import arrays
from .arrays import Raster


class StepNotApplicable(Exception):
    """The step cannot be used on this state; the state passes through and the reason is kept."""


@dataclass(frozen=True)
class State:
    """original gets geometry steps only and is the source of intensities."""

    original: Raster
    image: Raster
    mask: np.ndarray | None = None
    calibration: Calibration = Calibration()
    info: str | None = None
    warning: str | None = None


@dataclass(frozen=True)
class Param:
    """scale: plain, value (share of the image's range), span (share of its width) or pixels (share of its size)."""

    key: str
    default: float
    low: float
    high: float
    step: float = 1.0
    unit: str = ""
    scale: str = "plain"
    choices: tuple[str, ...] = ()

    def resolve(self, image: Raster) -> Param:
        if self.scale == "value":
            lo, span = _value_range(image)
            return replace(self, default=lo + self.default * span, low=lo, high=lo + span)
        if self.scale == "span":
            _, span = _value_range(image)
            return replace(self, default=self.default * span, low=self.low * span, high=self.high * span)
        if self.scale == "pixels":
            return replace(self, high=float(max(image.size)))
        return self


def _value_range(image: Raster) -> tuple[float, float]:
    if image.eight_bit:
        return 0.0, 255.0
    g = image.gray()
    return float(g.min()), max(float(g.max()) - float(g.min()), 1.0)


Apply = Callable[[State, Callable[[str], float]], State]


@dataclass(frozen=True)
class StepDef:
    kind: str
    category: str
    params: tuple[Param, ...]
    apply: Apply
    needs_mask: bool = False

    def fallback(self, key: str) -> float:
        """Default of a missing value, as on an 8-bit image."""
        p = next(p for p in self.params if p.key == key)
        return p.default * 255 if p.scale in ("value", "span") else p.default


STEPS: dict[str, StepDef] = {}


def _add(kind: str, category: str, apply: Apply, *params: Param, needs_mask: bool = False) -> None:
    STEPS[kind] = StepDef(kind, category, params, apply, needs_mask)


def lookup(kind: str) -> StepDef:
    if kind not in STEPS:
        raise KeyError(f"unknown step {kind!r}")
    return STEPS[kind]


def _image(f: Callable[[Raster, Callable[[str], float]], Raster]) -> Apply:
    return lambda s, p: replace(s, image=f(s.image, p))


def _mask(f: Callable[[np.ndarray, Callable[[str], float]], np.ndarray]) -> Apply:
    def run(s: State, p: Callable[[str], float]) -> State:
        if s.mask is None:
            raise StepNotApplicable("there is no mask yet; a segmentation step has to come first")
        return replace(s, mask=f(s.mask, p))

    return run


def whole(v: float) -> int:
    return int(np.rint(v))


def _color_only(s: State) -> None:
    if not s.image.is_color:
        raise StepNotApplicable("this step needs a colour image")


def _share(mask: np.ndarray) -> str:
    return f"object {100 * mask.mean():.1f}%"


def _channel(s: State, p: Callable[[str], float]) -> State:
    if not s.image.is_color:
        return replace(s, warning="the image is gray already and stays as it is")
    return replace(s, image=s.image.put(s.image.data[:, :, min(max(whole(p("channel")), 0), 2)], clamp=False))


def _stain(s: State, p: Callable[[str], float]) -> State:
    _color_only(s)
    out = arrays.stain(s.image, whole(p("stain")))
    return replace(s, image=out, info=f"mean amount {out.data.mean():.3f}")


def _geometry(s: State, f: Callable[[np.ndarray], np.ndarray]) -> State:
    """The same transform for original, image and mask."""
    move = lambda r: replace(r, data=np.ascontiguousarray(f(r.data)))
    return replace(s, original=move(s.original), image=move(s.image), mask=None if s.mask is None else np.ascontiguousarray(f(s.mask)))


def _auto_crop(s: State, p: Callable[[str], float]) -> State:
    box = arrays.content_box(s.image, p("threshold"), whole(p("bright")) == 0, whole(p("margin")))
    if box is None:
        raise StepNotApplicable("no content was found")
    return replace(_geometry(s, lambda a: arrays.crop(a, *box)), info=f"{box[2]} x {box[3]} px kept")


def _resize(s: State, p: Callable[[str], float]) -> State:
    if s.mask is not None:
        raise StepNotApplicable("resizing has to come before segmentation")
    f = min(max(p("factor"), 0.05), 1.0)
    return replace(s, original=arrays.resize(s.original, f), image=arrays.resize(s.image, f), calibration=s.calibration.scaled(f))


def _threshold(s: State, p: Callable[[str], float]) -> State:
    method = METHODS[whole(p("method"))]
    t = p("value") if method == "manual" else arrays.find_threshold(s.image, method)
    g = s.image.gray()
    mask = g >= t if whole(p("bright")) == 0 else g < t
    return replace(s, mask=mask, info=f"threshold {t:.6g}, {_share(mask)}")


def _color_threshold(s: State, p: Callable[[str], float]) -> State:
    _color_only(s)
    mask = arrays.hsv_mask(s.image, (p("hueMin"), p("hueMax")), (p("satMin") / 100, p("satMax") / 100), (p("valMin") / 100, p("valMax") / 100))
    return replace(s, mask=mask, info=_share(mask))


def _kmeans(s: State, p: Callable[[str], float]) -> State:
    own, centers, shown = arrays.kmeans(s.image, whole(p("k")))
    pick = min(max(whole(p("cluster")), 1), len(centers)) - 1
    mask = own == pick
    return replace(s, image=shown, mask=mask, info=f"class {pick + 1} of {len(centers)}, {_share(mask)}")


def _shape_filter(s: State, p: Callable[[str], float]) -> State:
    from .engine import shape_table

    if s.mask is None:
        raise StepNotApplicable("there is no mask yet; a segmentation step has to come first")
    labels, n = kernels.label(s.mask)
    e = 1e-9
    keep = np.zeros(n + 1, bool)
    for k, m in enumerate(shape_table(labels, n), 1):
        keep[k] = p("circMin") - e <= m["circularity"] <= p("circMax") + e and m["solidity"] >= p("solidityMin") - e and (p("aspectMax") <= 0 or m["aspect_ratio"] <= p("aspectMax") + e)
    return replace(s, mask=keep[labels], info=f"{int(keep.sum())} of {n} kept")


_add("gray", "adjust", _image(lambda i, p: i.put(i.gray(), clamp=False)))
_add("channel", "adjust", _channel, Param("channel", 0, 0, 2, choices=("red", "green", "blue")))
_add("stain", "adjust", _stain, Param("stain", 3, 0, 3, choices=("hematoxylin_he", "eosin_he", "hematoxylin_hdab", "dab")))
_add("invert", "adjust", _image(lambda i, p: i.put(i.lo + i.hi - i.data)))
_add("windowLevel", "adjust", _image(lambda i, p: Raster.of(np.clip((i.data - (p("level") - max(p("width"), 1e-6) / 2)) * (255 / max(p("width"), 1e-6)), 0, 255))), Param("level", 0.5, 0, 1, scale="value"), Param("width", 1, 0.005, 1, scale="span"))
_add("autoContrast", "adjust", _image(lambda i, p: arrays.auto_contrast(i, p("saturated"))), Param("saturated", 0.35, 0, 5, 0.05, "%"))
_add("brightnessContrast", "adjust", _image(lambda i, p: i.put((i.data - (i.lo + i.span / 2)) * p("contrast") + (i.lo + i.span / 2) + p("brightness") / 100 * i.span)), Param("brightness", 0, -100, 100, 1, "%"), Param("contrast", 1, 0.1, 4, 0.05, "x"))


def _gamma(i: Raster, p: Callable[[str], float]) -> Raster:
    if not p("gamma") > 0:
        raise ValueError("gamma must be positive")
    return i.put(i.lo + i.span * np.power(np.clip((i.data - i.lo) / i.span, 0, 1), p("gamma")))


_add("gamma", "adjust", _image(_gamma), Param("gamma", 0.7, 0.1, 5, 0.05))
_add("equalize", "adjust", _image(lambda i, p: arrays.equalize(i)))
_add("clahe", "adjust", _image(lambda i, p: arrays.clahe(i, whole(p("tiles")), p("clip"))), Param("tiles", 8, 2, 16), Param("clip", 2.5, 1, 10, 0.1, "x"))
_add("gaussian", "filter", _image(lambda i, p: arrays.blur(i, p("sigma"))), Param("sigma", 1.5, 0.3, 30, 0.1, "px"))
_add("median", "filter", _image(lambda i, p: i.put(arrays.planes(i, lambda a: kernels.median_filter(a, whole(p("radius")))), clamp=False)), Param("radius", 1, 1, 5, 1, "px"))
_add("sharpen", "filter", _image(lambda i, p: i.put(i.data + p("amount") * (i.data - arrays.blur(i, p("sigma")).data))), Param("sigma", 1.5, 0.3, 10, 0.1, "px"), Param("amount", 0.8, 0.1, 4, 0.1))
_add("sobel", "filter", _image(lambda i, p: arrays.sobel(i)))
_add("background", "filter", _image(lambda i, p: arrays.background(i, p("sigma"), whole(p("mode")) == 1)), Param("sigma", 40, 5, 300, 1, "px"), Param("mode", 0, 0, 1, choices=("dark", "bright")))
_add("noise", "filter", _image(lambda i, p: arrays.noise(i, p("sd") / 100, p("salt") / 100, whole(p("seed")))), Param("sd", 5, 0, 30, 0.5, "%"), Param("salt", 0, 0, 20, 0.5, "%"), Param("seed", 1, 1, 999))
_add("crop", "shape", lambda s, p: _geometry(s, lambda a: arrays.crop(a, whole(p("x")), whole(p("y")), whole(p("width")), whole(p("height")))), *(Param(k, d, m, 1, 1, "px", "pixels") for k, d, m in (("x", 0, 0), ("y", 0, 0), ("width", 256, 1), ("height", 256, 1))))
_add("autoCrop", "shape", _auto_crop, Param("threshold", 0.06, 0, 1, scale="value"), Param("bright", 0, 0, 1, choices=("bright", "dark")), Param("margin", 4, 0, 100, 1, "px"))
_add("flip", "shape", lambda s, p: _geometry(s, lambda a: a[:, ::-1] if whole(p("direction")) == 0 else a[::-1]), Param("direction", 0, 0, 1, choices=("horizontal", "vertical")))
_add("rotate", "shape", lambda s, p: _geometry(s, lambda a: np.rot90(a, (-1, 2, 1)[whole(p("rotation"))])), Param("rotation", 0, 0, 2, choices=("right", "half", "left")))
_add("resize", "shape", _resize, Param("factor", 0.5, 0.1, 1, 0.05, "x"))
_add("threshold", "segment", _threshold, Param("method", 1, 0, 4, choices=METHODS), Param("value", 0.5, 0, 1, scale="value"), Param("bright", 0, 0, 1, choices=("bright", "dark")))
_add("colorThreshold", "segment", _color_threshold, Param("hueMin", 220, 0, 360, 1, "°"), Param("hueMax", 300, 0, 360, 1, "°"), Param("satMin", 20, 0, 100, 1, "%"), Param("satMax", 100, 0, 100, 1, "%"), Param("valMin", 0, 0, 100, 1, "%"), Param("valMax", 100, 0, 100, 1, "%"))
_add("kmeans", "segment", _kmeans, Param("k", 3, 2, 8), Param("cluster", 1, 1, 8))
_add("morphology", "refine", _mask(lambda m, p: kernels.morphology(m, kernels.MORPHOLOGY[whole(p("op"))], p("radius"))), Param("op", 2, 0, 3, choices=kernels.MORPHOLOGY), Param("radius", 1.5, 0.5, 20, 0.5, "px"), needs_mask=True)
_add("fillHoles", "refine", _mask(lambda m, p: kernels.fill_holes(m)), needs_mask=True)
_add("watershed", "refine", _mask(lambda m, p: kernels.watershed(m, p("tolerance"))), Param("tolerance", 1.0, 0.2, 10, 0.1, "px"), needs_mask=True)
_add("sizeFilter", "refine", _mask(lambda m, p: kernels.size_filter(m, p("min"), p("max"))), Param("min", 20, 0, 5000, 1, "px"), Param("max", 0, 0, 1_000_000, 10, "px"), needs_mask=True)
_add("shapeFilter", "refine", _shape_filter, Param("circMin", 0, 0, 1, 0.01), Param("circMax", 1, 0, 1, 0.01), Param("aspectMax", 0, 0, 20, 0.1), Param("solidityMin", 0, 0, 1, 0.01), needs_mask=True)
_add("clearBorder", "refine", _mask(lambda m, p: kernels.clear_border(m)), needs_mask=True)
_add("invertMask", "refine", _mask(lambda m, p: ~m), needs_mask=True)
