"""Images tables, recipes on Spark, codecs, outputs, and every query against its SQL."""

import struct
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pixelgrain import model, queries
from pixelgrain.operators import adjust, measure, refine, segment, stats
from pixelgrain.plans import engine
from pixelgrain.plans.arrays import Raster
from pixelgrain.plans.recipe import Measure, Recipe, Step
from pixelgrain.sources import codecs, files, samples, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


#: One of each family here; the driver compares all of them.
CHECKED = ("gray", "stain_dab", "auto_contrast", "equalize", "clahe", "gaussian_exact", "gaussian_boxes", "median_r1", "sobel", "background_divide", "auto_crop", "rotate_cw", "resize_half", "resize_up", "line_profile", "pixel_histogram_wide", "histogram_quantile", "describe_by_type", "value_histogram_fd", "threshold_otsu_batch", "threshold_isodata", "threshold_triangle", "hsv_mask", "roi_polygon", "label8_batch", "close", "fill_holes", "particles_moments", "particles_feret", "exclude_points", "batch_summary", "lut_render", "compose")


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(duck.sql(queries.SQL[name]).df())


def test_entry_points(spark):
    assert set(queries.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_pixels_and_back(spark):
    color = Raster.of(np.random.default_rng(1).integers(0, 255, (5, 7, 3)))
    gray = Raster.of(np.arange(12.0).reshape(3, 4), -1, 20)
    images = samples.image_rows(spark, {"c": color, "g": gray})
    back = {r.image_id: r for ch in (1, 3) for r in model.implode_pixels(model.explode_pixels(images, ch)).collect()}
    assert back["c"].data == color.data.ravel().tolist() and back["g"].data == gray.data.ravel().tolist() and back["g"].nominal_min == -1


def test_relations_agree_with_kernels(spark):
    image, calibration, recipe = samples.create("shapes")
    images = samples.image_rows(spark, {"s": image})
    pixels = model.explode_pixels(images, 1).cache()
    mask = segment.threshold(pixels, "otsu")
    found = {r.id: r for r in measure.particles(refine.labels(mask), pixels).collect()}
    array, summary = engine.analyze(engine.run_steps(image, recipe.steps).states[-1], recipe.measure)
    assert len(found) == len(array) == summary["count"] == 8
    for p in array:
        for k, v in p.items():
            got = getattr(found[p["id"]], k)
            if isinstance(v, float) and not (k == "angle" and p["aspect_ratio"] < 1.01):
                assert got == pytest.approx(v, rel=1e-5, abs=1e-5), (k, p["id"])
            elif not isinstance(v, float):
                assert got == v, (k, p["id"])


def test_describe_literals(spark):
    d = spark.createDataFrame([(5.0,), (1.0,), (4.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    r = stats.describe(d, "v").first()
    assert (r.n, r.mean, r.vmin, r.q1, r["median"], r.q3, r.vmax) == (5, 3.0, 1.0, 2.0, 3.0, 4.0, 5.0) and r.sd == pytest.approx(2.5**0.5)
    assert stats.describe(d.limit(0), "v").first().n == 0 and stats.value_histogram(d.limit(0), "v").count() == 0
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.lower, r.upper, r.n) for r in stats.value_histogram(same, "v").collect()] == [(2.0, 2.0, 2)] and stats.otsu_values(same, "v").first().threshold == 2.0


def test_bad_use_is_refused(spark):
    gray = model.explode_pixels(samples.image_rows(spark, {"g": Raster.of(np.zeros((3, 3)))}), 1)
    for call in (lambda: adjust.stain(gray), lambda: adjust.gamma(gray, 0), lambda: adjust.window_level(gray, 0, 0), lambda: segment.color_threshold(gray), lambda: stats.find_threshold(gray, "manual")):
        with pytest.raises(ValueError):
            call()
    assert adjust.measured(gray, "dab")[1] and not adjust.measured(gray)[1]
    assert adjust.auto_contrast(gray).count() == 9 and {r.v for r in adjust.equalize(gray).collect()} == {0.0}


def test_recipe_over_images(spark):
    image, calibration, recipe = samples.create("nuclei")
    images = samples.image_rows(spark, {"a": image, "flat": Raster.of(np.full((20, 20), 5.0))})
    out = {r.image_id: r for r in engine.summaries(images, recipe).collect()}
    found = engine.particles(images, recipe).groupBy("image_id").count().collect()
    assert out["a"]["count"] == next(r["count"] for r in found if r.image_id == "a") > 60 and out["flat"].error is None
    told = engine.outcomes(images, Recipe(steps=(Step("fillHoles"),))).collect()
    assert all(not r.applied and r.warning for r in told)
    assert all(r.error for r in engine.summaries(images, Recipe()).collect())
    assert engine.transform(images, Recipe(steps=(Step("resize"),))).where("image_id = 'a'").first().width == 384
    assert engine.transform(images, recipe, mask=True).count() == 2
    assert engine.batch_totals(engine.summaries(images, recipe)).first().images == 2


def test_template_over_images(spark):
    image = samples.create("shapes")[0]
    part = Raster.of(image.data[30:90, 180:240, 0])
    hits = engine.template_matches(samples.image_rows(spark, {"s": image}), part).collect()
    assert (hits[0].x, hits[0].y, hits[0].score) == (180, 30, 1.0)


# ---------------------------------------------------------------- codecs and files


def png(rows, w, h, depth, color, extra=b"", interlaced=0):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    return codecs.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(img, kind, step):
    """Rows of a byte image with one PNG filter."""
    h, n = img.shape
    out, zero = bytearray(), np.zeros(n, int)
    for y in range(h):
        line, up = img[y].astype(int), img[y - 1].astype(int) if y else zero
        left, corner = np.concatenate((np.zeros(step, int), line[:-step])), np.concatenate((np.zeros(step, int), up[:-step]))
        guess = line + 0
        if kind == 4:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        else:
            guess = (zero, left, up, (left + up) // 2)[kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    return bytes(out)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    img = np.random.default_rng(kind).integers(0, 256, (9, 11 * 3))
    got = codecs.decode_png(png(filtered(img, kind, 3), 11, 9, 8, 2))
    assert (got.data.reshape(9, 33) == img).all()
    back = codecs.decode_png(codecs.encode_png(img.reshape(9, 11, 3)))
    assert (back.data == got.data).all()


def test_png_depths_palette_alpha():
    wide = (np.arange(12).reshape(3, 4) * 5000).astype(">u2")
    got = codecs.decode_png(png(b"".join(b"\0" + r.tobytes() for r in wide), 4, 3, 16, 0))
    assert (got.data[:, :, 0] == wide).all() and got.hi == 65535
    assert codecs.decode_png(png(b"\0\xb0", 4, 1, 1, 0)).data.ravel().tolist() == [255, 0, 255, 255]
    palette = struct.pack(">I", 6) + b"PLTE" + bytes([1, 2, 3, 9, 8, 7]) + b"\0\0\0\0"
    assert codecs.decode_png(png(b"\0\x40", 2, 1, 1, 3, palette)).data.ravel().tolist() == [1, 2, 3, 9, 8, 7]
    assert codecs.decode_png(png(b"\0\x05\x05\x05\x80", 1, 1, 8, 6)).data.ravel().tolist() == [5]
    assert codecs.decode_png(png(b"\0\x05", 1, 1, 8, 0, interlaced=1)) is None
    for bad in (codecs.PNG_MAGIC, png(b"\0", 4, 4, 8, 0), png(b"\0\x05", 1, 1, 8, 0)[:40]):
        with pytest.raises(ValueError):
            codecs.decode_png(bad)
    with pytest.raises(ValueError):
        codecs.decode_png(png(b"\0\x05", 1, 1, 8, 0), limit=0)


def tiff(body, w, h, depth, packing=1, predictor=1, photo=1, form=1, order="<", samples_=1):
    tags = [(256, 4, w), (257, 4, h), (258, 3, depth), (259, 3, packing), (262, 3, photo), (273, 4, 8), (277, 3, samples_), (278, 4, h), (279, 4, len(body)), (317, 3, predictor), (339, 3, form)]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body))
    cells = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in tags)
    return head + body + struct.pack(order + "H", len(tags)) + cells + b"\0\0\0\0"


def lzw_encode(data):
    codes, table, w = [256], {bytes([i]): i for i in range(256)}, b""
    size, out, bits, n = 9, bytearray(), 0, 0
    following = 258

    def emit(code):
        nonlocal bits, n
        bits, n = (bits << size) | code, n + size
        while n >= 8:
            n -= 8
            out.append((bits >> n) & 255)

    emit(codes[0])
    for b in data:
        c = bytes([b])
        if w + c in table:
            w += c
            continue
        emit(table[w])
        table[w + c] = following
        following += 1
        size = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        w = c
    emit(table[w])
    following += 1
    size = 9 if following < 512 else 10 if following < 1024 else 11
    emit(257)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(order):
    img = (np.arange(600).reshape(20, 30) * 97 % 65536).astype(order + "u2")
    plain = img.tobytes()
    diff = np.diff(img.astype(int), axis=1, prepend=0).astype(np.uint16).astype(order + "u2").tobytes()
    for body, packing, predictor in ((plain, 1, 1), (zlib.compress(plain), 8, 1), (zlib.compress(diff), 32946, 2), (lzw_encode(plain), 5, 1)):
        got = codecs.decode_tiff(tiff(body, 30, 20, 16, packing, predictor, order=order))
        assert (got.data[:, :, 0] == img).all() and got.hi == 65535
    assert codecs.decode_tiff(tiff(b"\xfe\x07\x01\x01\x02", 5, 1, 8, 32773, order=order)).data.ravel().tolist() == [7, 7, 7, 1, 2]
    assert codecs.decode_tiff(tiff(b"\x00\xff", 2, 1, 8, photo=0, order=order)).data.ravel().tolist() == [255, 0]
    real = np.array([1.5, np.nan, -2.0], order + "f4").tobytes()
    assert codecs.decode_tiff(tiff(real, 3, 1, 32, form=3, order=order)).data.ravel().tolist() == [1.5, -2, -2]
    with pytest.raises(codecs.Unsupported):
        codecs.decode_tiff(tiff(plain, 30, 20, 16, 7, order=order))


def dicom(photo=b"MONOCHROME2 ", spacing=b"0.7\\0.7 "):
    def el(group, element, kind, body):
        body += b"\0" * (len(body) % 2)
        head = struct.pack("<HH", group, element) + kind
        return head + (struct.pack("<HI", 0, len(body)) if kind in (b"OW", b"OB") else struct.pack("<H", len(body))) + body

    us = lambda v: struct.pack("<H", v)
    body = el(2, 0x10, b"UI", b"1.2.840.10008.1.2.1") + el(0x10, 0x10, b"PN", b"Somebody") + el(0x28, 2, b"US", us(1)) + el(0x28, 4, b"CS", photo) + el(0x28, 0x10, b"US", us(2)) + el(0x28, 0x11, b"US", us(2)) + el(0x28, 0x30, b"DS", spacing)
    body += el(0x28, 0x100, b"US", us(16)) + el(0x28, 0x101, b"US", us(12)) + el(0x28, 0x103, b"US", us(0)) + el(0x28, 0x1052, b"DS", b"-1024") + el(0x28, 0x1053, b"DS", b"1")
    return b"\0" * 128 + b"DICM" + body + el(0x7FE0, 0x10, b"OW", struct.pack("<4H", 0, 1024, 1064, 4095))


def test_dicom():
    image, calibration = codecs.decode_dicom(dicom())
    assert image.data.ravel().tolist() == [-1024, 0, 40, 3071] and (image.lo, image.hi) == (-1024, 3071) and (calibration.units_per_pixel, calibration.unit) == (0.7, "mm")
    assert codecs.decode_dicom(dicom(b"MONOCHROME1 "))[0].data.ravel().tolist() == [3071, 2047, 2007, -1024]
    assert codecs.decode_dicom(dicom(spacing=b"0.7\\0.9 "))[1] is None
    with pytest.raises(ValueError):
        codecs.decode_dicom(dicom()[:-4])


def test_folder_to_summary(spark, tmp_path):
    image = samples.create("shapes")[0]
    (tmp_path / "B.png").write_bytes(codecs.encode_png(np.rint(image.data[:, :, 0])))
    (tmp_path / "a.dcm").write_bytes(dicom())
    (tmp_path / "broken.png").write_bytes(codecs.PNG_MAGIC + b"xx")
    (tmp_path / "photo.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "notes.txt").write_text("no image")
    found = files.find_images(spark, str(tmp_path))
    assert sorted(p.path.rsplit("/", 1)[1] for p in found.collect()) == ["B.png", "a.dcm", "broken.png", "photo.jpg"]
    recipe = Recipe(steps=(Step("threshold"),))
    out = {r.image_id.rsplit("/", 1)[1]: r for r in engine.summaries(files.load_images(found), recipe).collect()}
    straight = {r.image_id.rsplit("/", 1)[1]: r for r in engine.summaries(found, recipe).collect()}
    assert straight == out
    (tmp_path / "scan").write_bytes(dicom())
    (tmp_path / "README").write_text("no image")
    assert files.find_images(spark, str(tmp_path)).count() == 5
    assert out["B.png"]["count"] == 8 and out["broken.png"].error and out["photo.jpg"].error and out["a.dcm"].length_unit == "mm"


# ---------------------------------------------------------------- outputs


def test_csv():
    assert [sinks.escape(c) for c in ("=1+1", "-5", "a,b", 'q"q', "@x", "plain", "")] == ["'=1+1", "-5", '"a,b"', '"q""q"', "'@x", "plain", ""]
    assert [sinks.number(v) for v in (1.0, 0.12345, -0.00001, float("nan"), 3, None)] == ["1", "0.1235", "0", "", "3", ""]
    image, calibration, recipe = samples.create("shapes")
    found, s = engine.analyze(engine.run_steps(image, recipe.steps).states[-1], Measure(classify=True))
    text = sinks.particles_csv([p | {"image_id": "=x.png"} for p in found])
    lines = text.split("\r\n")
    assert len(lines) == 10 and lines[0].split(",")[0] == "ファイル" and lines[0].split(",")[-1] == "陽性" and lines[1].startswith("'=x.png,1,") and len(lines[1].split(",")) == 26
    table = sinks.summaries_csv([{"image_id": "bad", "error": "why, so"}, s | {"image_id": "ok"}])
    assert table.split("\r\n")[1].endswith(',"why, so"') and "px²" in table


def test_csv_lines_match(spark):
    d = spark.createDataFrame([("=a", 1.5), ('x"y', None), ("-3", 2.0)], "k string, v double")
    assert [r.value for r in sinks.csv_lines(d, ["k", "v"]).collect()] == ["'=a,1.5", '"x""y",', "-3,2.0"]


def test_report_escapes_text():
    image, calibration, recipe = samples.create("shapes")
    run = engine.run_steps(image, recipe.steps)
    found, s = engine.analyze(run.states[-1], recipe.measure)
    page = sinks.build_html(sinks.Report("<script>", s, found * 50, recipe, [{"info": o.info, "warning": o.warning} for o in run.outcomes], {"overlay": codecs.encode_png(np.zeros((2, 2)))}, {"area": [(0.0, 1.0, 3)]}))
    assert "<script>" not in page and "&lt;script&gt;" in page and "data:image/png;base64," in page and "100 more objects" in page and page.count("<tr>") == 301
    assert sinks.param_text("threshold", "method", 1) == "otsu" and sinks.param_text("gaussian", "sigma", 1.5) == "1.5 px"
