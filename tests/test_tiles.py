"""Configuration, numerics, placement, coverage, files and sinks."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.config import FILE_NAME, TILE_CONFIG, VECTRA, OutputFormat, StitchConfig
from tessella.functions import numeric as N
from tessella.functions import text as X
from tessella.operators import coverage as C
from tessella.operators import placement as P
from tessella.plans import api
from tessella.plans.strategies import strategy
from tessella.sinks import store, zarr
from tessella.sources import catalog, tiff


def test_config_records():
    assert [f.name for f in OutputFormat] == ["OME_TIFF", "OME_ZARR"]
    args = ("filename", "/in", "/out", "zstd", 0.5, 1.0, "t", 1.0)
    assert StitchConfig(*args).output_format is OutputFormat.OME_TIFF
    assert StitchConfig(*args, output_format=OutputFormat.OME_ZARR).compression_type == "zstd"
    assert StitchConfig(*args, 1.05, 1.02, None).output_format is None
    assert StitchConfig(*args, 1.05, 1.02).x_fudge == pytest.approx(1.05, abs=1e-3)
    for codec in ("LZW", "JPEG", "JPEG-2000", "Uncompressed", "zstd", "lz4", "lz4hc", "blosclz", "zlib"):
        assert StitchConfig("f", "/i", "/o", codec, 0.5, 1.0, "", 1.0).compression_type == codec
    with pytest.raises(ValueError):
        strategy("no such")


def test_java_round_is_the_runtimes(spark):
    rng = random.Random(1)
    values = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 0.49999999999999994, -0.49999999999999994, 0.0, 1e9, *(rng.uniform(-1e6, 1e6) for _ in range(200)), *(rng.randint(-999, 999) / 2 for _ in range(100))]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(N.java_round(F.col("v"))).collect()]
    assert got == [int(spark._jvm.java.lang.Math.round(v)) for v in values]


def test_names_and_numbers(spark):
    rows = [("a[1,2]b[30,40].ome.tif",), ("a[1,2].TIF",), ("a[-1,2].tif",), ("a[1, 2].tif",), ("a[99999999999,2].tif",), ("a[1,2].tif.txt",)]
    ok, x, y = X.named_coordinates(F.col("n"))
    got = spark.createDataFrame(rows, "n string").select(ok, x, y).collect()
    assert [tuple(r) for r in got[:2]] == [(True, 30, 40), (False, None, None)] and [r[0] for r in got] == [True, False, False, False, True, False] and got[4][1] is None
    got = spark.createDataFrame([(" 1.5\t",), ("",), (None,), ("x",)], "s string").select(N.parse_default(F.col("s"), 7.2)).collect()
    assert [r[0] for r in got] == [1.5, 7.2, 7.2, 7.2]
    r = spark.createDataFrame([(1, 2), (1, 0), (-1, 0), (0, 0), (None, 1)], "a long, b long").select(P.rational(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == 0.5 and r[1][0] == float("inf") and r[2][0] == -float("inf") and np.isnan(r[3][0]) and r[4][0] == 0.0
    with pytest.raises(ValueError):
        P.place_by_name(spark.createDataFrame([], "subdir string, file_name string, w int, h int"), 0.0)


def test_config_lines(spark):
    lines = ["dim = 2", "# c", "", " #a; ; (1, 2)", "t1.tif; ; (10.0, -5.0, 3)", "t2.tif;;{1,}", "t3.tif; ; (x, 2)", "t1.tif; ; (4, 6)"]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(lines)], "config_dir string, line_no int, line string")
    parsed = P.parse_config(df, 0.5, 2.0)
    assert [(r.image_name, r.x, r.y) for r in parsed.orderBy("line_no").collect()] == [("#a", 1.0, 2.0), ("t1.tif", 10.0, -5.0), ("t3.tif", None, 2.0), ("t1.tif", 4.0, 6.0)]
    assert [r.image_name for r in P.keep_prefix(parsed).orderBy("line_no").collect()] == ["#a", "t1.tif"]
    assert {r.image_name: r.x for r in P.last_wins(parsed.where("x is not null")).collect()}["t1.tif"] == 4.0


@pytest.mark.parametrize("cell", [7, 64])
def test_intervals_equal_brute_force(spark, cell):
    rng = random.Random(cell)
    rows = [("g", f"t{i}", rng.randint(-60, 60), rng.randint(-60, 60), rng.randint(0, 40), rng.randint(1, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "subdir string, file_name string, x int, y int, w int, h int")
    want = set()
    for a in rows:
        for b in rows:
            w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
            if a[1] < b[1] and w > 0 and h > 0:
                want.add((a[1], b[1], w * h))
    got = C.overlap_pairs(df, cell).collect()
    assert {(r.fa, r.fb, r.area) for r in got} == want and len(got) == len(want)
    covered = {(x, y) for _, _, a, b, w, h in rows for x in range(a, a + w) for y in range(b, b + h)}
    assert [r.covered_px for r in C.coverage_area(df, cell).collect()] == [len(covered)]


def _tile(folder, name, pixels, **tags):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(tiff.encode(pixels, **tags))


@pytest.fixture
def slides(tmp_path):
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(1, 250, (6, 8, 3)).astype(np.uint8) for _ in range(3))
    for name, p in (("t[10,20].tif", a), ("t[14,20].tif", b), ("t[20,25].tif", c)):
        _tile(tmp_path / "in" / "g1", name, p)
    _tile(tmp_path / "in" / "other", "t[0,0].tif", a)
    (tmp_path / "in" / "g1" / "t[1,1].tif").write_bytes(b"no image")
    return tmp_path, a, b, c


def _expected(a, b, c):
    want = np.full((16, 28, 3), 255, np.uint8)
    want[0:6, 0:8], want[0:6, 8:16], want[10:16, 20:28] = a, b, c
    return want


def test_file_names_to_arrays(spark, slides):
    folder, a, b, c = slides
    cfg = StitchConfig(FILE_NAME, str(folder / "in"), str(folder), "zlib", 0.5, 1.0, "g", 1.0, output_format=OutputFormat.OME_ZARR)
    tiles = sorted((r.file_name, r.x, r.y, r.w, r.h) for r in api.place(spark, cfg).collect())
    assert tiles == [("t[10,20].tif", 20, 40, 8, 6), ("t[14,20].tif", 28, 40, 8, 6), ("t[20,25].tif", 40, 50, 8, 6)]
    out = api.run(spark, cfg, chunk=16).collect()
    assert [(r.subdir, r.n_tiles, r.status) for r in out] == [("g1", 3, "ok")]
    meta = json.loads((folder / "g1.ome.zarr/0/.zarray").read_text())
    got = np.zeros((16, 32, 3), np.uint8)
    for x in range(2):
        raw = zarr.decompress((folder / f"g1.ome.zarr/0/0.{x}.0").read_bytes(), "zlib")
        got[:, 16 * x : 16 * x + 16] = np.frombuffer(raw, np.uint8).reshape(16, 16, 3)
    assert meta["shape"] == [16, 28, 3] and (got[:, :28] == _expected(a, b, c)).all()
    level = np.frombuffer(zarr.decompress((folder / "g1.ome.zarr/1/0.0.0").read_bytes(), "zlib"), np.uint8).reshape(16, 16, 3)
    want = _expected(a, b, c).astype(int).reshape(8, 2, 14, 2, 3).sum((1, 3)) // 4
    assert (level[:8, :14] == want).all()
    assert [r.path for r in api.run(spark, cfg, chunk=16).collect()] == [f"{folder}/g1_2.ome.zarr"]


def test_config_to_tiff(spark, slides):
    folder, a, b, c = slides
    (folder / "in" / "g1" / catalog.CONFIG_NAME).write_text("dim = 2\nt[10,20].tif; ; (0, 0)\nt[14,20].tif; ; (4, 0)\r\nt[20,25].tif; ; (10.0, 5)\nmissing.tif; ; (9, 9)\n")
    cfg = StitchConfig(TILE_CONFIG, str(folder / "in"), str(folder), "ZLIB", 0.5, 1.0, "", 1.0)
    assert [(r.status, r.n_tiles) for r in api.run(spark, cfg, chunk=16, edge=16).collect()] == [("ok", 3)]
    raw = (folder / "g1.ome.tif").read_bytes()
    assert (tiff.decode(raw) == _expected(a, b, c)).all()
    bad = StitchConfig(TILE_CONFIG, str(folder / "in"), str(folder), "J2K", 0.5, 1.0, "", 1.0)
    assert [(r.status, r.path) for r in api.run(spark, bad, chunk=16, edge=16).collect()] == [("failed", None)]


def test_hot_names_are_numbered_in_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, f"n{i % 50}"])) for i in rng.sample(range(100_000), 4000)]
    got = P.unique_places(spark.createDataFrame(rows, "id long, base string"), ["base"], ["id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(base#" in plan and all("_range#" in x.split("ASC")[0] for x in plan.split("row_number() windowspecdefinition(")[1:])
    count, want = {}, set()
    for i, b in sorted(rows):
        count[b] = count.get(b, 0) + 1
        want.add((i, b, count[b]))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)


def test_lzw_round_trip():
    from tessella.functions.lzw import lzw_decode, lzw_encode

    rng = np.random.default_rng(1)
    steps = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (*range(250, 260), 765, 766, 767, 3900, 30000)]
    for raw in (b"", b"a", b"a" * 20000, bytes(range(256)) * 40, *steps, b"ab" * 5000 + steps[-1]):
        assert lzw_decode(lzw_encode(raw)) == raw
    assert len(lzw_encode(b"\xff" * 65536)) < 1000


def test_lzw_tiff_reads_elsewhere(spark, slides):
    folder, a, b, c = slides
    cfg = StitchConfig(FILE_NAME, str(folder / "in"), str(folder), "LZW", 0.5, 1.0, "g", 1.0)
    assert [(r.status, r.n_tiles) for r in api.run(spark, cfg, chunk=16, edge=16).collect()] == [("ok", 3)]
    path = str(folder / "g1.ome.tif")
    want = _expected(a, b, c)
    with open(path, "rb") as f:
        assert (tiff.decode(f.read()) == want).all()
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(path))
    for y, x in ((0, 0), (3, 9), (9, 3), (12, 22), (15, 27)):
        rgb = image.getRGB(x, y) & 0xFFFFFF
        assert [rgb >> 16, rgb >> 8 & 255, rgb & 255] == want[y, x].tolist()


def test_tags_and_scans(spark, tmp_path):
    p = np.zeros((4, 5), np.uint16)
    _tile(tmp_path / "in" / "v", "a.tif", p, x_res=(20000, 1), y_res=(20000, 2), x_pos=(1, 2), y_pos=(3, 1000))
    cfg = StitchConfig(VECTRA, str(tmp_path / "in"), str(tmp_path), "LZW", 0.5, 1.0, "v", 1.0, 1.1, 1.0)
    assert [(r.x, r.y, r.w, r.h) for r in api.place(spark, cfg).collect()] == [(11000, 30, 5, 4)]
    _tile(tmp_path / "deep" / "g" / "angle", "n.tif", p)
    _tile(tmp_path / "deep" / "h", "d.tif", p)
    _tile(tmp_path / "deep" / "h" / "angle", "no.tif", p)
    assert sorted((r.subdir, r.file_name) for r in catalog.group_files(spark, str(tmp_path / "deep")).collect()) == [("g", "n.tif"), ("h", "d.tif")]
    empty = StitchConfig(FILE_NAME, str(tmp_path / "nothing"), str(tmp_path), "LZW", 0.5, 1.0, "", 1.0)
    assert api.run(spark, empty).count() == 0
    assert store.unique_path(str(tmp_path), "x", "ome.tif").endswith("x.ome.tif") and tiff.read_tags(b"II*\0") is None
    assert (tiff.decode(tiff.encode(p)) == p[:, :, None]).all() and tiff.decode(b"") is None


def test_stream(spark, tmp_path):
    from tessella.streaming.ingest import stream_bounds

    spark.createDataFrame([("g", "a[1,2].tif", 3, 4), ("g", "b[5,5].tif", 3, 4)], "subdir string, file_name string, w int, h int").write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("subdir string, file_name string, w int, h int").parquet(str(tmp_path / "s"))
    q = stream_bounds(s, 0.5).writeStream.outputMode("complete").format("memory").queryName("bounds").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select subdir, n, x0, y0, width, height from bounds").collect()] == [("g", 2, 2, 4, 11, 10)]


def test_queries_equal_sql(spark, sf):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    assert set(Q.SQL) == set(Q.QUERIES)
    for name, sql in Q.SQL.items():
        rel = con.sql(sql)
        got = Q.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(rel.columns), name
        a = sorted(repr(tuple(plain(r[c]) for c in rel.columns)) for r in got.collect())
        assert a == sorted(repr(tuple(map(plain, r))) for r in rel.fetchall()), name


def test_white_fill_keeps_all_pixels(spark, tmp_path):
    rows = [(i, "a", [0.5] * 64) for i in (1, 2000, 2531)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.white_fill(spark, str(tmp_path))
    assert got.count() == 200 * (2531 // 25 + 1) * 8 and got.where("v <> 255").count() == 3 * 64


def test_plans_push_filters_and_prune_columns(spark, sf):
    plan = Q.filename_tiles(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(event_type,i)" in plan and "props" not in plan
    assert "PushedFilters: [IsNotNull(p_partkey), LessThan(p_partkey,200)" in plan.replace("p_partkey, ", "p_partkey,") or "LessThan(p_partkey" in plan


def test_entry_without_the_optional_part(spark, monkeypatch):
    import importlib

    import __spark_entry__ as E

    assert E.entry(spark).count() == 3
    assert set(E.oracle_sql()) <= set(E.queries())

    def gone(name):
        raise ModuleNotFoundError(name, name="corpus_pipeline" if name == "corpus_pipeline" else "tessella.llm")

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(E.queries()) == set(Q.QUERIES) and set(E.oracle_sql()) == set(Q.SQL)

    def broken(name):
        raise ModuleNotFoundError("a dependency", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        E.queries()


def _stitch(spark, folder, codec="zlib", base=1.0, kind=OutputFormat.OME_ZARR, match="", **options):
    cfg = StitchConfig(FILE_NAME, str(folder / "in"), str(folder / "out"), codec, 0.5, base, match, 1.0, output_format=kind)
    return {r.subdir: r for r in api.run(spark, cfg, chunk=32, edge=16, **options).collect()}


def _means(x, base):
    """Integer means of the pixels p with floor(p / base) = i, one output pixel at a time."""
    h, w, bands = x.shape
    of = [np.floor(np.arange(n) / base).astype(int) for n in (h, w)]
    out = np.zeros((of[0][-1] + 1, of[1][-1] + 1, bands), x.dtype)
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            part = x[of[0] == i][:, of[1] == j].astype(int)
            out[i, j] = part.sum((0, 1)) // (part.shape[0] * part.shape[1])
    return out


@pytest.mark.parametrize("base", [2.0, 2.5, 3.0, 5.0, 40.0])
def test_any_base_downsample(spark, tmp_path, base):
    rng = np.random.default_rng(3)
    whole = np.full((83, 96, 3), 255, np.uint8)
    for x, y in ((0, 0), (31, 7), (50, 43), (88, 75)):
        p = rng.integers(0, 256, (40, 46, 3)).astype(np.uint8)[: 83 - y, : 96 - x]
        _tile(tmp_path / "in" / "g", f"t{x:02}{y:02}[{x // 2},{y // 2}].tif", p) if x % 2 == 0 and y % 2 == 0 else None
        if x % 2 == 0 and y % 2 == 0:
            whole[y : y + p.shape[0], x : x + p.shape[1]] = p
    _tile(tmp_path / "in" / "g", "z[25,20].tif", rng.integers(0, 256, (43, 46, 3)).astype(np.uint8))
    whole[40:83, 50:96] = tiff.decode((tmp_path / "in" / "g" / "z[25,20].tif").read_bytes())
    steps = []
    r = _stitch(spark, tmp_path, base=base, progress=steps.append)["g"]
    assert r.status == "ok" and r.path.endswith(f"g_{int(base)}x_downsample.ome.zarr") and steps[-1] == 1.0 and steps == sorted(steps)
    want = _means(whole, base)
    assert (zarr.read_level(r.path, 0) == want).all() and (zarr.read_level(r.path, 1) == _means(want, 2)).all()
    scale = json.loads(open(f"{r.path}/.zattrs").read())["multiscales"][0]["datasets"]
    assert len(scale) == 4 and scale[1]["coordinateTransformations"][0]["scale"] == [base, base, 1]
    r = _stitch(spark, tmp_path, "LZW", base, OutputFormat.OME_TIFF)["g"]
    raw = open(r.path, "rb").read()
    assert (tiff.read_image(r.path) == want).all() and tiff.ratio(tiff.read_tags(raw), tiff.X_RES) == round(1e7 / (0.5 * base)) / 1000
    with pytest.raises(ValueError):
        _stitch(spark, tmp_path, base=0.5)


def test_groups_do_not_change_each_other(spark, tmp_path):
    """Grey beside colour, 8 beside 16 bits, a bright maximum, channels with names, and groups that fail."""
    rng = np.random.default_rng(5)
    small, wide = rng.integers(0, 200, (8, 8, 3)).astype(np.uint8), rng.integers(300, 4000, (8, 8, 3)).astype(np.uint16)
    for g, a, b, tags in (
        ("rgb", small, small, {}),
        ("grey", small[:, :, 0], small[:, :, 0], {}),
        ("mixed", small[:, :, 0], wide[:, :, 0], {}),
        ("deep", wide, wide, {"max_value": 4095}),
        ("glow", wide, wide, {"description": '<OME><Channel ID="0" Name="DAPI"/><Channel Name="FITC"/><Channel Name="x"/></OME>'}),
        ("bands", small, small[:, :, :2], {}),
    ):
        _tile(tmp_path / "in" / g, "a[0,0].tif", a, **tags)
        _tile(tmp_path / "in" / g, "b[6,0].tif", b, **tags)
    (tmp_path / "in" / "none").mkdir()
    (tmp_path / "in" / "none" / "a[0,0].tif").write_bytes(b"II*\0")
    _tile(tmp_path / "in" / "cut", "a[0,0].tif", small)
    raw = bytearray((tmp_path / "in" / "cut" / "a[0,0].tif").read_bytes())
    at = raw.index((8 * 8 * 3).to_bytes(4, "little"), 200)
    raw[at : at + 4] = (100).to_bytes(4, "little")
    (tmp_path / "in" / "cut" / "a[0,0].tif").write_bytes(raw)
    _tile(tmp_path / "in" / "far", "a[0,0].tif", small)
    _tile(tmp_path / "in" / "far", "b[900000000,900000000].tif", small)
    out = _stitch(spark, tmp_path)
    assert {g: r.status for g, r in out.items()} == {"rgb": "ok", "grey": "ok", "mixed": "ok", "deep": "ok", "glow": "ok", "bands": "failed", "cut": "failed", "far": "failed"}
    assert "bands" in out["bands"].error and "damaged" in out["cut"].error and "extent" in out["far"].error and out["cut"].path is None
    gap = {g: zarr.read_level(r.path, 0)[0, 10].tolist() for g, r in out.items() if r.path}
    assert gap == {"rgb": [255] * 3, "grey": [0], "mixed": [0], "deep": [4095] * 3, "glow": [0] * 3}
    found = zarr.read_level(out["mixed"].path, 0)
    assert found.dtype == np.uint16 and (found[:8, 12:20, 0] == wide[:, :, 0]).all() and (found[:8, :8, 0] == small[:, :, 0]).all()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{g}.ome.zarr" for g in gap)  # nothing half done
    assert {g: r.status for g, r in _stitch(spark, tmp_path, "LZW", kind=OutputFormat.OME_TIFF).items()}["bands"] == "failed"
    again = _stitch(spark, tmp_path, match="rgb")
    assert again["rgb"].path.endswith("/rgb_2.ome.zarr")
    without = _stitch(spark, tmp_path, match="rgb", fill_background=False)["rgb"]
    assert zarr.read_level(without.path, 0)[0, 10].tolist() == [0] * 3


def test_big_files_and_containers(spark, tmp_path):
    from tessella.functions.blosc import blosc_decode, blosc_encode
    from tessella.operators import raster
    from tessella.sinks import tiff as sink

    rng = np.random.default_rng(6)
    x = rng.integers(0, 60000, (50, 70, 1)).astype(np.uint16)
    rows = [("g", 0, cx, cy, *(p := x[cy * 32 : cy * 32 + 32, cx * 32 : cx * 32 + 32]).shape, "uint16", np.ascontiguousarray(p).tobytes(), None) for cy in range(2) for cx in range(3)]
    chunks = spark.createDataFrame(rows, raster.CHUNK)
    path = str(tmp_path / "new" / "folder" / "big.ome.tif")
    images = spark.createDataFrame([("g", path, [50], [70], 1, "uint16")], "subdir string, path string, heights array<bigint>, widths array<bigint>, bands int, dtype string")
    assert [tuple(r) for r in sink.write_files(sink.encode_tiles(chunks, 32, 16, "ZLIB"), images, 16, "ZLIB", 0.5, 4, classic=100).collect()] == [("g", None)]
    raw = open(path, "rb").read()
    assert raw[:4] == b"II+\0" and (tiff.decode(raw) == x).all() and (tiff.read_image(path) == x).all()
    for codec in ("lz4", "lz4hc", "zlib", "zstd", "blosclz"):
        for data, size in ((x.tobytes() * 200, 2), (b"", 1), (b"abc" * 9, 1), (rng.bytes(3000), 4), (b"\0" * (1 << 20), 8)):
            stored = blosc_encode(data, codec, 5, size)
            assert blosc_decode(stored) == data and int.from_bytes(stored[12:16], "little") == len(stored)
    for bad in (b"", b"\2\1\x20\1" + bytes(12), blosc_encode(b"x" * 50, "lz4")[:-1]):
        with pytest.raises(ValueError):
            blosc_decode(bad)


def test_regions_and_thumbnails(spark, slides):
    from tessella.operators import raster

    folder, a, b, c = slides
    chunks = api.level_zero(spark, StitchConfig(FILE_NAME, str(folder / "in"), "", "", 0.5, 1.0, "g", 1.0), chunk=16)
    want = _expected(a, b, c)
    for ds, x, y, w, h in ((1.0, 3, 2, 20, 10), (2.5, -4, 1, 40, 40), (3.0, 16, 0, 5, 5)):
        r = raster.read_region(chunks, 16, ds, x, y, w, h).collect()[0]
        part = want[max(0, y) : y + h, max(0, x) : x + w]
        assert (np.frombuffer(r.data, r.dtype).reshape(r.h, r.w, r.bands) == _means(part, ds)).all()
    assert raster.read_region(chunks, 16, 1.0, 500, 0, 5, 5).count() == 0
    dark = np.zeros((2, 2, 3), np.uint8)
    dark[0, 0] = 7
    df = spark.createDataFrame([("g", 2, 2, 3, "uint8", dark.tobytes())], "subdir string, h int, w int, bands int, dtype string, data binary")
    assert np.frombuffer(raster.thumbnail(df).collect()[0].data, np.uint8).reshape(2, 2, 3).tolist() == [[[7] * 3, [255] * 3], [[255] * 3, [255] * 3]]


def test_numbers_beyond_an_int(spark):
    values = [3e9, -3e9, 4294967295.5, 1e300, -1e300, float("inf"), -float("inf"), float("nan"), 9.3e18, 2147483647.5]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(N.java_round(F.col("v"))).collect()]

    def runtime(v):
        n = int(spark._jvm.java.lang.Math.round(v)) & 0xFFFFFFFF
        return n - (1 << 32) if n >> 31 else n

    assert got == [runtime(v) for v in values]
    files = spark.createDataFrame([("g", "a[2000000000,1].tif", 4, 4), ("g", "b[0,0].tif", 4, 4)], "subdir string, file_name string, w int, h int")
    placed = P.place_by_name(files, 0.5)
    assert {r.file_name: r.x for r in placed.collect()} == {"a[2000000000,1].tif": 4000000000 - (1 << 32), "b[0,0].tif": 0}
    assert P.translate_origin(placed).count() == 2 and C.overlap_pairs(placed).count() == 0


def test_no_two_outputs_share_a_name(spark):
    rng = random.Random(8)
    cases = [["a", "a", "a_2"], ["a_2", "a", "a", "a", "a_3", "a_4"], ["a_2", "a_2_2", "a_2", "a", "a_2"], ["a_02", "a", "a"], [rng.choice(["b", "b_2", "b_3", "b_7", "b_2_2", "c"]) for _ in range(60)]]
    for names in cases:
        got = {r.i: (r.base if r.number == 1 else f"{r.base}_{r.number}") for r in P.free_numbers(spark.createDataFrame(list(enumerate(names)), "i int, base string"), "base", ["i"]).collect()}
        assert len(set(got.values())) == len(names)
        bases, used = set(names), {}
        for i, n in enumerate(names):  # plain names first, then the least number that is free
            if n not in used:
                used[n] = 1
                assert got[i] == n
                continue
            used[n] += 1
            while f"{n}_{used[n]}" in bases:
                used[n] += 1
            assert got[i] == f"{n}_{used[n]}"


def test_a_crowded_cell_is_many_tasks(spark):
    rows = [("g", f"t{i:03}", i % 3, 0, 5, 5) for i in range(120)]
    df = spark.createDataFrame(rows, "subdir string, file_name string, x int, y int, w int, h int")
    assert C.overlap_pairs(df, 64, share=10).count() == 120 * 119 // 2


def test_shared_folder(spark, monkeypatch):
    from tessella import runtime

    class Elsewhere:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Elsewhere)
    kept = runtime.stash(spark.range(3), "kept")
    path = runtime._written[-1]
    assert kept.count() == 3
    with runtime.Scratch(spark) as s:
        held = runtime.stash(spark.range(2), "held").inputFiles()
        stays = s.keep(runtime.stash(spark.range(4), "stays"))
        with runtime.Scratch(spark):
            runtime.stash(spark.range(1), "inner")
        assert len(runtime._written) >= 3
    assert stays.count() == 4
    import os

    assert held and not any(os.path.exists(f[7:]) for f in held) and path in runtime._written
    runtime.release(spark)
    assert not runtime._written


def test_config_lines_have_numbers(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / catalog.CONFIG_NAME).write_text("a; ; (1, 2)\r\n\nb; ; (x, 1)\na; ; (3, 4)\rc; ; (5, 6)")
    lines = {(r.line_no, r.line) for r in catalog.config_lines(spark, str(tmp_path)).collect()}
    assert lines == {(0, "a; ; (1, 2)"), (1, ""), (2, "b; ; (x, 1)"), (3, "a; ; (3, 4)"), (4, "c; ; (5, 6)")}


def test_jpeg_tiff_reads_elsewhere(spark, tmp_path):
    y, x = np.mgrid[0:70, 0:90]
    smooth = np.stack([x * 2, y * 3, 255 - x - y], 2).astype(np.uint8)
    smooth[20:40, 30:60] = (250, 10, 40)
    noise = np.random.default_rng(1).integers(0, 256, (40, 40)).astype(np.uint8)
    _tile(tmp_path / "in" / "smooth", "a[0,0].tif", smooth)
    _tile(tmp_path / "in" / "noise", "a[0,0].tif", noise)
    _tile(tmp_path / "in" / "deep", "a[0,0].tif", noise.astype(np.uint16) * 200)
    out = _stitch(spark, tmp_path, "JPEG", kind=OutputFormat.OME_TIFF)
    assert {g: r.status for g, r in out.items()} == {"smooth": "ok", "noise": "ok", "deep": "failed"} and "8 bits" in out["deep"].error
    for name, want, most in (("smooth", smooth, 3), ("noise", noise[:, :, None], 20)):
        image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(out[name].path))
        raster = image.getData()
        got = np.array([[[raster.getSample(i, j, b) for b in range(want.shape[2])] for i in range(0, want.shape[1], 3)] for j in range(0, want.shape[0], 3)])
        if want.shape[2] == 3:
            got = np.array([[[(p := image.getRGB(i, j)) >> 16 & 255, p >> 8 & 255, p & 255] for i in range(0, want.shape[1], 3)] for j in range(0, want.shape[0], 3)])
        assert np.abs(got - want[::3, ::3].astype(int)).mean() < most


def test_huffman_lengths_are_bounded():
    from tessella.functions.jpeg import code_lengths

    for counts in (np.array([1 << i for i in range(30)] + [0] * 226, dtype=object), np.ones(256, int), np.eye(256, dtype=int)[7]):
        n = code_lengths(counts)
        assert n.max() <= 16 and ((n > 0) == (np.array(counts) > 0)).all() and sum(2.0 ** -x for x in n[n > 0]) < 1


def test_associated_images(tmp_path):
    """A file of four images: the first, a smaller one of it, a label, and one without a name."""
    pixels = [np.full((4, 6, 1), v, np.uint8) for v in (1, 2, 3, 4)]
    out, at = b"", 8
    for i, p in enumerate(pixels):
        body = p.tobytes()
        entries = [(tiff.SUBFILE, 4, (int(i == 1),)), (tiff.WIDTH, 4, (6,)), (tiff.HEIGHT, 4, (4,)), (tiff.BITS, 3, (8,)), (tiff.COMPRESSION, 3, (1,)), (tiff.OFFSETS, 4, (at,)), (tiff.SAMPLES, 3, (1,)), (tiff.ROWS, 4, (4,)), (tiff.COUNTS, 4, (24,))]
        entries += [(tiff.DESCRIPTION, 2, (b"label\nof a slide\0",))] if i == 2 else []
        place = at + 24
        size = tiff.directory_size(entries) + tiff.directory_size(entries) % 2
        out += body + tiff.directory(entries, place, 0 if i == 3 else place + size + 24).ljust(size, b"\0")
        at = place + size
    path = tmp_path / "a.tif"
    path.write_bytes(b"II*\0" + (32).to_bytes(4, "little") + out)
    assert tiff.associated_images(str(path)) == {"label": 2, "image 3": 3}
    assert [int(tiff.read_image(str(path), i).mean()) for i in range(4)] == [1, 2, 3, 4] and tiff.read_image(str(path), 9) is None
    assert len(list(tiff.directories(path.read_bytes()))) == 4 and list(tiff.directories(b"II*\0\xff\xff\xff\xff")) == []


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Tasks are as many as shuffle partitions, not as files; the files are those that Spark's readers find."""
    p = np.zeros((2, 3), np.uint8)
    for i in range(60):
        _tile(tmp_path / "in" / f"g{i % 2}", f"t[{i},0].tif", p)
    for name in (".h[1,0].tif", "_h[1,0].tif", "_k=1[1,0].tif", "u[1,0].TIF", "x [1,0]%20.ome.tif.bak", "b[2,0].tif._COPYING_"):
        _tile(tmp_path / "in" / "g0", name, p)
    (tmp_path / "in" / "g0" / "e[3,0].tif").write_bytes(b"")
    _tile(tmp_path / "in", "top[1,0].tif", p)
    spark.sparkContext.setJobGroup("few", "files of two folders")
    found = catalog.with_headers(catalog.tile_files(spark, str(tmp_path / "in"))).collect()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = [r.path for r in spark.read.format("binaryFile").load(f"{tmp_path}/in/*/*.tif*").select("path").collect()]
    assert sorted(r.path for r in found) == sorted(want) and len(want) == 62 and all((r.w, r.h) == (3, 2) for r in found)
    assert {r.subdir for r in found} == {"g0", "g1"} and max(s.numTasks for s in stages if s) <= 4


def test_region_of_many_small_files(spark, tmp_path):
    """A request over 48 tiles of one image: its pixels, by fewer tasks than tiles."""
    from tessella.operators import raster

    want = np.random.default_rng(3).integers(1, 250, (24, 32, 1)).astype(np.uint8)
    for i in range(48):
        y, x = i // 8 * 4, i % 8 * 4
        _tile(tmp_path / "in" / "g", f"t[{x // 2},{y // 2}].tif", want[y : y + 4, x : x + 4])
    spark.sparkContext.setJobGroup("region", "one image of 48 files")
    chunks = api.level_zero(spark, StitchConfig(FILE_NAME, str(tmp_path / "in"), "", "", 0.5, 1.0, "", 1.0), chunk=8)
    r = raster.read_region(chunks, 8, 3.0, 5, 2, 20, 17).collect()[0]
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("region") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (np.frombuffer(r.data, r.dtype).reshape(r.h, r.w, r.bands) == _means(want[2:19, 5:25], 3.0)).all()
    assert max(s.numTasks for s in stages if s) <= 8
