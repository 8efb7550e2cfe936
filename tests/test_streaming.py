import numpy as np

from pixelgrain.plans.recipe import Recipe, Step
from pixelgrain.sources import codecs
from pixelgrain.streaming import watch


def test_folder_stream(spark, tmp_path):
    images = tmp_path / "in"
    images.mkdir()
    img = np.zeros((20, 20))
    img[5:9, 5:9] = 200
    (images / "a.png").write_bytes(codecs.encode_png(img))
    (images / "b.png").write_bytes(b"broken")
    query = watch.start(spark, str(images), Recipe(steps=(Step("threshold"),)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    got = {r.image_id.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a.png"]["count"] == 1 and got["b.png"].error
