import numpy as np

from pixelgrain import model
from pixelgrain.operators import geometry, measure, refine, segment
from pixelgrain.plans import engine
from pixelgrain.plans.recipe import Recipe, Step
from pixelgrain.sources import samples, sinks


def test_region_box():
    assert geometry.region_box([(10.2, 5.5), (40.7, 30.5)], 35, 48) == (10, 5, 25, 26)
    assert geometry.region_box([(-9, -9), (-2, -1)], 35, 48) == (0, 0, 0, 0)


def test_exclusion_toggles_whole_objects(spark):
    mask = samples.rectangle(20, 20, 2, 2, 5, 5) | samples.rectangle(20, 20, 12, 12, 5, 5)
    images = samples.image_rows(spark, {"a": samples.from_mask(mask)})
    labels = refine.labels(segment.threshold(model.explode_pixels(images, 1), "otsu"))
    points = lambda *p: spark.createDataFrame([("a", float(x), float(y)) for x, y in p], "image_id string, px double, py double")
    now = points((3.5, 3.5), (5.2, 5.9), (0.0, 0.0))
    left = {(r.px, r.py) for r in measure.toggle_exclusion(labels, now, points((2.1, 2.1))).collect()}
    assert left == {(0.0, 0.0)}
    more = {(r.px, r.py) for r in measure.toggle_exclusion(labels, now, points((13.0, 13.0))).collect()}
    assert more == {(3.5, 3.5), (5.2, 5.9), (0.0, 0.0), (13.0, 13.0)}


def test_batch_outputs(spark, tmp_path):
    images = samples.image_rows(spark, {"a": samples.from_mask(np.eye(20) > 0)})
    recipe = Recipe(steps=(Step("threshold"),))
    sinks.write_batch(images, recipe, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/particles").count() == 1
    rows = spark.read.option("header", "true").option("lineSep", "\r\n").csv(f"{tmp_path}/particles_csv")
    assert rows.columns[:3] == ["ファイル", "番号", "面積 (px²)"] and [r[2] for r in rows.collect()] == ["20.0"]
    assert [r["数"] for r in spark.read.option("header", "true").option("lineSep", "\r\n").csv(f"{tmp_path}/summaries_csv").collect()] == ["1"]
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/recipe").collect())
    assert Recipe.from_json(text) == recipe
