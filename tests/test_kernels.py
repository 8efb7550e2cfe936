"""Array kernels and steps against brute force and analytic values."""

import math

import numpy as np
import pytest

from pixelgrain import kernels
from pixelgrain.functions.expressions import DAB, HEMATOXYLIN, inverse, stain_matrix, unit
from pixelgrain.operators.measure import Calibration
from pixelgrain.plans import arrays, engine
from pixelgrain.plans.arrays import Raster
from pixelgrain.plans.catalog import STEPS, State
from pixelgrain.plans.recipe import Measure, Recipe, Step
from pixelgrain.sources import samples
from pixelgrain.sources.samples import disk, ellipse, from_mask, rectangle


def one(mask, measure=None, calibration=None, **kw):
    state = State(from_mask(mask), from_mask(mask), mask, calibration or Calibration())
    return engine.analyze(state, measure or Measure(), **kw)


def test_distance_against_exhaustive_search():
    rng = np.random.default_rng(1)
    mask = rng.random((29, 37)) < 0.7
    bg = [(y, x) for y in range(-1, 30) for x in range(-1, 38) if not (0 <= y < 29 and 0 <= x < 37) or not mask[y, x]]
    fg = np.argwhere(mask)
    d, e = kernels.distance_to_background(mask), kernels.distance_to_foreground(mask)
    for y in range(29):
        for x in range(37):
            assert d[y, x] == pytest.approx(min(math.hypot(y - a, x - b) for a, b in bg) if mask[y, x] else 0)
            assert e[y, x] == pytest.approx(np.hypot(fg[:, 0] - y, fg[:, 1] - x).min())


def test_dilation_is_a_lattice_disc():
    point = np.zeros((31, 31), bool)
    point[15, 15] = True
    for r in (1, 1.5, 3, 7.2):
        assert kernels.morphology(point, "dilate", r).sum() == sum(x * x + y * y <= r * r for x in range(-10, 11) for y in range(-10, 11))
    assert kernels.morphology(np.zeros((5, 5), bool), "dilate", 2).sum() == 0
    full = np.ones((9, 9), bool)
    assert kernels.morphology(full, "erode", 1).sum() == 49 and kernels.morphology(full, "erode", 0) is full


def brute_labels(mask, eight):
    out, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (eight or a == 0 or b == 0)]
    for start in np.argwhere(mask):
        if out[tuple(start)]:
            continue
        n += 1
        todo = [tuple(start)]
        out[tuple(start)] = n
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                p = (y + a, x + b)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    todo.append(p)
    return out, n


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 1.0])
def test_labels(eight, share):
    mask = np.random.default_rng(2).random((23, 31)) < share
    want, n = brute_labels(mask, eight)
    got, m = kernels.label(mask, eight)
    assert n == m and (want == got).all()


def test_holes_border_and_sizes():
    ring = disk(60, 60, 30, 30, 20) & ~disk(60, 60, 30, 30, 10)
    assert kernels.fill_holes(ring).sum() == disk(60, 60, 30, 30, 20).sum()
    both = rectangle(40, 40, 0, 5, 10, 10) | rectangle(40, 40, 20, 20, 5, 5)
    assert kernels.clear_border(both).sum() == 25 and kernels.size_filter(both, 30).sum() == 100 and kernels.size_filter(both, 1, 30).sum() == 25


def test_watershed_splits_touching_discs_only():
    two = disk(120, 80, 40, 40, 20) | disk(120, 80, 74, 40, 20)
    cut = kernels.watershed(two, 1.0)
    assert kernels.label(cut)[1] == 2 and cut.sum() > 0.97 * two.sum()
    assert kernels.label(kernels.watershed(ellipse(120, 80, 60, 40, 40, 20, 30), 1.0))[1] == 1


def test_circle_square_ellipse():
    (p,), _ = one(disk(200, 200, 100, 100, 60))
    assert p["area"] == pytest.approx(math.pi * 3600, rel=0.01) and p["perimeter"] == pytest.approx(2 * math.pi * 60, rel=0.03) and p["circularity"] >= 0.95
    assert p["feret"] == pytest.approx(120, abs=2) and p["solidity"] > 0.97
    (p,), _ = one(rectangle(100, 100, 20, 30, 40, 40))
    assert (p["pixel_count"], p["bounds_x"], p["bounds_width"]) == (1600, 20, 40) and p["solidity"] == 1 and p["feret"] == pytest.approx(40 * math.sqrt(2))
    for angle in (0, 30, 120):
        (p,), _ = one(ellipse(300, 300, 150, 150, 90, 40, angle))
        assert p["major_axis"] == pytest.approx(180, rel=0.02) and p["minor_axis"] == pytest.approx(80, rel=0.02)
        assert min(abs(p["angle"] - angle), 180 - abs(p["angle"] - angle)) < 1


def test_single_pixel_and_line():
    m = np.zeros((9, 9), bool)
    m[4, 4] = True
    assert kernels.perimeter(m) == math.pi and one(m)[0][0]["std_intensity"] == 0
    m[4, 4:8] = True
    assert kernels.perimeter(m) == pytest.approx(6 * 0.98 - 0.091 * 2 + math.pi)


def test_filters_apply_in_order():
    m = rectangle(60, 60, 0, 10, 6, 6) | rectangle(60, 60, 20, 20, 3, 3) | rectangle(60, 60, 40, 40, 10, 10)
    found, s = one(m, Measure(min_area=10, exclude_edges=True), points=((44.5, 44.5), (1.0, 11.0)))
    assert not found and s["excluded_count"] == 1
    found, s = one(m, Measure(max_area=50, classify=True, positive_threshold=100))
    assert [p["id"] for p in found] == [1, 2] and s["positive_percent"] == 100
    found, s = one(m, calibration=Calibration(0.5, "µm"))
    assert s["total_area"] == 0.25 * m.sum() and s["area_unit"] == "µm²" and found[0]["feret"] == pytest.approx(3 * math.sqrt(2))
    region = rectangle(60, 60, 18, 18, 20, 20)
    found, s = one(m, Measure(exclude_edges=True), region=region)
    assert len(found) == 1 and s["area_fraction"] == pytest.approx(100 * 9 / 400)


def test_thresholds_separate_two_groups():
    rng = np.random.default_rng(3)
    img = Raster.of(np.where(rng.random((100, 100)) < 0.5, 60, 180) + rng.uniform(-10, 10, (100, 100)))
    for method in ("otsu", "isodata", "mean"):
        assert 70 <= arrays.find_threshold(img, method) <= 171
    dots = Raster.of(np.where(disk(200, 200, 50, 50, 6), 200, 20) + rng.normal(0, 2, (200, 200)))
    assert 25 < arrays.find_threshold(dots, "triangle") < 190


def test_blur_variants_agree_and_edges_hold():
    img = from_mask(disk(90, 80, 45, 40, 20))
    from pixelgrain.operators.filters import box_radii, gaussian_weights

    exact = kernels.line_filter(img.data[:, :, 0], gaussian_weights(5))
    boxes = img.data[:, :, 0]
    for r in box_radii(5):
        boxes = kernels.box_filter(boxes, r)
    assert np.abs(exact - boxes).max() < 4
    flat = Raster.of(np.full((20, 20), 77))
    assert np.allclose(arrays.blur(flat, 9).data, 77, atol=1e-3) and np.allclose(arrays.blur(flat, 1).data, 77, atol=1e-3)


def test_stains_are_recovered():
    od = np.array([[0.4, 0.3], [0.8, 0.0]]) @ np.array([unit(HEMATOXYLIN), unit(DAB)])
    img = Raster.of(255 * 10 ** -od[None])
    assert np.allclose(arrays.stain(img, 2).data[0, :, 0], [0.4, 0.8], atol=0.03) and np.allclose(arrays.stain(img, 3).data[0, :, 0], [0.3, 0], atol=0.04)
    m = stain_matrix(HEMATOXYLIN, DAB)
    assert np.allclose(np.array(m) @ np.array(inverse(m)), np.eye(3))
    with pytest.raises(ValueError):
        inverse([HEMATOXYLIN, HEMATOXYLIN, DAB])


def test_kmeans_is_repeatable_and_ordered():
    img = Raster.of(np.repeat([[200, 20, 110]], 30, axis=0).repeat(30, axis=1))
    a, centers, shown = arrays.kmeans(img, 3)
    assert (arrays.kmeans(img, 3)[0] == a).all() and centers[:, 0].tolist() == pytest.approx([20, 110, 200]) and a[0, [0, 40, 80]].tolist() == [2, 0, 1]
    assert np.allclose(shown.data, img.data)


def test_template_search():
    rng = np.random.default_rng(5)
    img = rng.uniform(40, 60, (300, 400))
    cross = np.full((40, 40), 50.0)
    cross[15:25], cross[:, 15:25] = 200, 200
    places = {(30, 40), (200, 100), (320, 220)}
    for x, y in places:
        img[y : y + 40, x : x + 40] = cross + rng.uniform(-5, 5, (40, 40))
    found = arrays.find_template(Raster.of(img), Raster.of(img[40:80, 30:70]))
    assert len(found) == 3 and all(min(math.hypot(f["x"] - x, f["y"] - y) for x, y in places) <= 1 and f["score"] > 0.95 for f in found)
    assert arrays.find_template(Raster.of(img), Raster.of(np.full((5, 5), 7.0))) == []


def test_resize_and_auto_crop():
    img = Raster.of(np.arange(48.0).reshape(6, 8))
    assert np.allclose(arrays.resize(img, 0.5).data[:, :, 0], img.data[:, :, 0].reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert arrays.resize(img, 1.5).size == (12, 9) and arrays.resize(img, 1).size == img.size
    m = from_mask(rectangle(50, 40, 10, 12, 20, 10))
    assert arrays.content_box(m, 100, True, 3) == (7, 9, 26, 16) and arrays.content_box(m, 250, True, 3) is None


@pytest.mark.parametrize("kind", sorted(STEPS))
@pytest.mark.parametrize("color", [False, True])
def test_every_step_runs_at_its_defaults(kind, color):
    data = np.random.default_rng(6).uniform(0, 255, (40, 50, 3 if color else 1))
    image = Raster.of(data)
    mask = disk(50, 40, 20, 20, 8)
    state = State(image, image, None if kind == "resize" else mask)
    step = Step.create(kind, image)
    if not color and kind in ("stain", "colorThreshold"):
        assert not engine.run_steps(image, (step,)).outcomes[0].applied
        return
    out = STEPS[kind].apply(state, step.get)
    assert out.image.data.dtype == np.float32 and np.isfinite(out.image.data).all()


def test_geometry_moves_original_image_and_mask():
    image = Raster.of(np.random.default_rng(7).uniform(0, 255, (12, 20, 3)))
    run = engine.run_steps(image, (Step("threshold", {"method": 3}), *(Step("rotate", {"rotation": 0}) for _ in range(4)), Step("flip", {}), Step("crop", {"x": 5, "y": 2, "width": 100, "height": 4})))
    turned, last = run.after(1), run.states[-1]
    assert turned.image.size == (12, 20) and (run.after(4).image.data == image.data).all() and last.image.size == (15, 4) == last.original.size and last.mask.shape == (4, 15)


def test_steps_that_do_not_apply_are_told():
    image = from_mask(disk(30, 30, 15, 15, 5))
    run = engine.run_steps(image, (Step("fillHoles"), Step("gaussian", {}, False), Step("threshold"), Step("resize")))
    assert [o.applied for o in run.outcomes] == [False, False, True, False] and run.outcomes[1].info == "off" and run.outcomes[3].warning
    again = engine.run_steps(image, (Step("fillHoles"), Step("gaussian", {}, False), Step("threshold"), Step("invertMask")), previous=run)
    assert again.states[3] is run.states[3] and again.states[4].mask.sum() == 900 - run.states[3].mask.sum()


def test_samples_against_their_layout():
    image, calibration, recipe = samples.create("ihc")
    found, s = engine.analyze(engine.run_steps(image, recipe.steps, calibration).states[-1], recipe.measure)
    truth = samples.ihc_layout()
    assert abs(s["count"] - len(truth)) <= 2 and abs(s["positive_count"] - sum(t[3] for t in truth)) <= 2
    for p in found:
        near = min(truth, key=lambda t: math.hypot(t[0] - p["centroid_x"], t[1] - p["centroid_y"]))
        assert near[3] == p["positive"]
    image, calibration, recipe = samples.create("nuclei")
    _, s = engine.analyze(engine.run_steps(image, recipe.steps, calibration).states[-1], recipe.measure)
    assert abs(s["count"] - len(samples.nuclei_layout())) <= 2
    image, calibration, recipe = samples.create("tissue")
    _, s = engine.analyze(engine.run_steps(image, recipe.steps, calibration).states[-1], recipe.measure)
    assert s["count"] > 100 and 2 < s["area_fraction"] < 20
    assert (samples.create("shapes")[0].data == samples.create("shapes")[0].data).all()
    with pytest.raises(ValueError):
        samples.create("none")


def test_recipe_round_trip_and_errors():
    r = Recipe("n", (Step.create("gaussian", sigma=2.0), Step("threshold", {"method": 1.0}, False)), Measure(min_area=3, channel="dab"), Calibration(0.5, "µm"))
    assert Recipe.from_json(r.to_json()) == r
    for bad in ("{}", "not json", '{"format": "pixelgrain-recipe", "version": 99}', '{"format": "pixelgrain-recipe", "version": 1, "steps": [{"kind": "nope"}]}', "[]"):
        with pytest.raises(ValueError):
            Recipe.from_json(bad)
    odd = Recipe.from_json('{"format": "pixelgrain-recipe", "version": 1, "name": " ", "steps": [{"kind": "gamma", "values": {"gamma": NaN}}], "calibration": {"unitsPerPixel": -1, "unit": "mm"}}')
    assert odd.name == "recipe" and odd.calibration is None and odd.steps[0].get("gamma") == 0.7
    assert [s.kind for s in r.duplicate(0).move(2, -1).steps] == ["gaussian", "threshold", "gaussian"] and r.remove(0).toggle(0).steps[0].enabled
    assert r.set_value(0, "sigma", 99).steps[0].get("sigma") == 30 and r.set_value(0, "sigma", 1.234).steps[0].get("sigma") == pytest.approx(1.2)


def test_parameters_follow_the_image():
    wide = Raster.of(np.linspace(-1000, 400, 100).reshape(10, 10), -1024, 3071)
    assert Step.create("threshold", wide).get("value") == pytest.approx(-300) and Step.create("windowLevel", wide).get("width") == pytest.approx(1400)
    assert Step("threshold").get("value") == 127.5 and len(STEPS) == 31


def test_calibration():
    assert Calibration.from_known_length(100, 50, "µm") == Calibration(0.5, "µm") and Calibration(0.5, "µm").scaled(0.5).units_per_pixel == 1.0
    for bad in ((0, "mm"), (1, " "), (float("nan"), "mm")):
        with pytest.raises(ValueError):
            Calibration(*bad)
