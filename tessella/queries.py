"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL that gives the same rows.

The tables hold no tiles; the relations below derive them, the same way in both engines: T1 tiles from events and part,
T2 configuration lines from customer, T3 tag rationals from lineitem, T4 pixels from embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FILE_NAME, TILE_CONFIG, VECTRA, OutputFormat, StitchConfig
from .functions import numeric as N
from .functions import text as X
from .operators import coverage as C
from .operators import mosaic as M
from .operators import placement as P
from .operators import pyramid as R
from .operators import raster
from .plans import api
from .runtime import new_folder, ship, spread
from .sinks import store, zarr
from .sources import catalog, tiff

PIXEL, MATCH = 0.5, "i"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# T1. The dimension table has 200 rows of part at every scale: that bound is what makes its side small.
def tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where(F.col("value").isNotNull() & F.col("user_id").isNotNull())
    ext = F.when(F.col("event_id") % 10 == 0, ".png").when(F.col("event_id") % 3 == 0, ".ome.tif").otherwise(".tif")
    micron = F.when(F.col("event_id") % 211 == 1, F.lit(2000000000) + F.col("event_id")).otherwise(F.floor(F.col("value") * 10)).cast("bigint")  # some lie beyond an int of pixels
    name = F.concat(F.lit("tile_"), F.col("event_id").cast("string"), F.lit("["), micron.cast("string"), F.lit(","), (F.col("user_id") * 13).cast("string"), F.lit("]"), ext)
    files = e.select("event_id", F.col("event_type").alias("subdir"), name.alias("file_name"), (F.col("event_id") % 200).alias("k"))
    dims = _table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("w"), F.col("p_size").alias("h"))
    return files.join(dims, "k", "left").drop("k")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.place_by_name(tile_files(spark, sf_dir), PIXEL, MATCH)


def _int(x: str) -> str:
    """The low 32 bits of a long."""
    return f"CAST(xor({x} & 4294967295, 2147483648) - 2147483648 AS INTEGER)"


def _round(x: str) -> str:
    """Half up, to a long that ends at its range and is 0 for NaN, then to its low 32 bits."""
    near = f"CAST(CASE WHEN {x} - floor({x}) >= 0.5 THEN ceil({x}) ELSE floor({x}) END AS BIGINT)"
    whole = f"CASE WHEN isnan({x}) THEN 0 WHEN {x} >= 9223372036854775807 THEN 9223372036854775807 WHEN {x} <= -9223372036854775808 THEN -9223372036854775808 ELSE {near} END"
    return f"({_int(f'({whole})')})"


FILES_SQL = """f AS (
  SELECT event_id, event_type AS subdir, 'tile_' || event_id || '[' || CASE WHEN event_id % 211 = 1 THEN 2000000000 + event_id ELSE CAST(floor(value * 10) AS BIGINT) END || ',' || (user_id * 13) || ']' ||
    CASE WHEN event_id % 10 = 0 THEN '.png' WHEN event_id % 3 = 0 THEN '.ome.tif' ELSE '.tif' END AS file_name, p_size AS w, p_size AS h
  FROM events LEFT JOIN (SELECT * FROM part WHERE p_partkey < 200) ON event_id % 200 = p_partkey WHERE value IS NOT NULL AND user_id IS NOT NULL
)"""
NAME_SQL = r"^.*\[(\d+),(\d+)\].*\.(tif|tiff|ome\.tif)$"
TILES_SQL = f"""{FILES_SQL}, n AS (
  SELECT *, TRY_CAST(regexp_extract(file_name, '{NAME_SQL}', 1) AS INTEGER) / 0.5::DOUBLE AS dx, TRY_CAST(regexp_extract(file_name, '{NAME_SQL}', 2) AS INTEGER) / 0.5::DOUBLE AS dy
  FROM f WHERE contains(subdir, 'i') AND regexp_matches(file_name, '{NAME_SQL}') AND w IS NOT NULL AND h IS NOT NULL
), t AS (
  SELECT file_name, subdir, {_round('dx')} AS x, {_round('dy')} AS y, w, h FROM n WHERE dx IS NOT NULL AND dy IS NOT NULL
), b AS (
  SELECT subdir, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x::BIGINT + w) - min(x) AS width, max(y::BIGINT + h) - min(y) AS height FROM t GROUP BY subdir
)"""


@query(f"WITH {TILES_SQL} SELECT subdir, file_name, x, y, w, h FROM t")
def filename_tiles(spark, sf_dir):
    """S2, F1 to F3, P1, P4, X1 to X5."""
    return tiles(spark, sf_dir).select("subdir", "file_name", "x", "y", "w", "h")


@query(f"WITH {TILES_SQL} SELECT * FROM b")
def group_bounds(spark, sf_dir):
    """A1 to A3, A5."""
    return M.group_bounds(tiles(spark, sf_dir))


@query(f"WITH {TILES_SQL} SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tiles FROM b")
def group_counts(spark, sf_dir):
    """A2, A6."""
    return M.group_counts(tiles(spark, sf_dir))


@query(f"WITH {TILES_SQL} SELECT t.subdir, file_name, {_int('(x::BIGINT - x0)')} AS x, {_int('(y::BIGINT - y0)')} AS y, w, h FROM t JOIN b ON t.subdir = b.subdir")
def origin_translate(spark, sf_dir):
    """P5, A3."""
    return P.translate_origin(tiles(spark, sf_dir)).select("subdir", "file_name", "x", "y", "w", "h")


@query(
    f"""WITH {TILES_SQL} SELECT a.subdir, a.file_name AS fa, b.file_name AS fb,
  (least(a.x::BIGINT + a.w, b.x::BIGINT + b.w) - greatest(a.x, b.x)) * (least(a.y::BIGINT + a.h, b.y::BIGINT + b.h) - greatest(a.y, b.y)) AS area
FROM t a JOIN t b ON a.subdir = b.subdir AND a.file_name < b.file_name AND a.x < b.x::BIGINT + b.w AND b.x < a.x::BIGINT + a.w AND a.y < b.y::BIGINT + b.h AND b.y < a.y::BIGINT + a.h"""
)
def overlap_pairs(spark, sf_dir):
    """J2, F11 between tiles."""
    return C.overlap_pairs(tiles(spark, sf_dir))


REQUEST = {"downsample": 2.5, "x": 100, "y": 1000, "w": 3000, "h": 20000}


def _edge_sql(e: str, begin: int, size: int) -> str:
    return f"greatest(0, least({int(size / 2.5)}, {_round(f'((greatest({begin}, least({begin + size}, {e})) - {begin}) / 2.5::DOUBLE)')}))"


@query(
    f"""WITH {TILES_SQL} SELECT subdir, file_name, {_edge_sql('x', 100, 3000)} AS px1, {_edge_sql('y', 1000, 20000)} AS py1, {_edge_sql('x::BIGINT + w', 100, 3000)} AS px2, {_edge_sql('y::BIGINT + h', 1000, 20000)} AS py2
FROM t WHERE x < 3100 AND x::BIGINT + w > 100 AND y < 21000 AND y::BIGINT + h > 1000"""
)
def region_read(spark, sf_dir):
    """S10, F11, P9."""
    return C.read_region(tiles(spark, sf_dir), **REQUEST).select("subdir", "file_name", "px1", "py1", "px2", "py2")


@query(
    f"""WITH {TILES_SQL}, r AS (SELECT DISTINCT subdir, x::BIGINT AS x, w, unnest(range(y::BIGINT, y::BIGINT + h)) AS py FROM t), s AS (
  SELECT subdir, py, x, x + w AS e, max(x + w) OVER (PARTITION BY subdir, py ORDER BY x, x + w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT subdir, CAST(sum(greatest(0, e - greatest(x, coalesce(before, x)))) AS BIGINT) AS covered_px FROM s GROUP BY subdir"""
)
def coverage_area(spark, sf_dir):
    """A9."""
    return C.coverage_area(tiles(spark, sf_dir))


LEVELS = [1.0, 2.0, 4.0, 8.0]


@query(
    f"""WITH {TILES_SQL}, l AS (SELECT unnest([0, 1, 2, 3]) AS level, unnest([1.0, 2.0, 4.0, 8.0])::DOUBLE AS ds)
SELECT subdir, CAST(level AS INTEGER) AS level, CAST(ceil(trunc(width / ds) / 1024) AS BIGINT) * CAST(ceil(trunc(height / ds) / 1024) AS BIGINT) * 3 AS tiles FROM b CROSS JOIN l"""
)
def level_tile_counts(spark, sf_dir):
    """A8, P11, X7."""
    return M.level_tile_counts(M.group_bounds(tiles(spark, sf_dir)), LEVELS, channels=3)


@query(f"WITH {TILES_SQL} SELECT subdir, n, x0, y0, width, height, 0.5::DOUBLE AS px_um, 1.0::DOUBLE AS z_um, CASE WHEN n % 2 = 0 THEN 'Sparse (white background)' ELSE 'Sparse' END AS type FROM b")
def metadata_override(spark, sf_dir):
    """P6, M10, P12."""
    return M.override_metadata(M.group_bounds(tiles(spark, sf_dir)), PIXEL, 1.0, X.server_type(F.lit("Sparse"), F.col("n") % 2 == 0, F.lit(1)))


@query(f"WITH {FILES_SQL}, d AS (SELECT *, (event_id % 7 = 0 AND subdir <> 'view') OR subdir = 'click' AS deep FROM f) SELECT subdir, file_name FROM d WHERE NOT deep UNION ALL SELECT subdir, file_name FROM d WHERE deep AND subdir NOT IN (SELECT subdir FROM d WHERE NOT deep)")
def nested_fallback(spark, sf_dir):
    """S4, U1, U2, D13."""
    d = tile_files(spark, sf_dir).withColumn("deep", ((F.col("event_id") % 7 == 0) & (F.col("subdir") != "view")) | (F.col("subdir") == "click")).select("subdir", "file_name", "deep")
    return P.nested_fallback(d.where(~F.col("deep")).drop("deep"), d.where("deep").drop("deep"))


@query(f"WITH {FILES_SQL} SELECT subdir, count(*) AS n FROM f WHERE contains(subdir, 'c') GROUP BY subdir")
def root_or_subdirs(spark, sf_dir):
    """S1, S3."""
    f = tile_files(spark, sf_dir).select("subdir", "file_name")
    return P.root_or_subdirs(f.limit(0), f, root_has_config=True, root_name="slide", match="c").groupBy("subdir").agg(F.count(F.lit(1)).alias("n"))


# T2. Lines for the first files of T1, with comments, blanks, short and malformed lines, and repeated names.
def config_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, bal = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    name = F.concat(F.lit("tile_"), (k % 500).cast("string"), F.lit(".tif"))
    line = (
        F.when(k % 11 == 0, F.lit("# a comment"))
        .when(k % 13 == 0, F.lit(" \t"))
        .when(k % 17 == 0, F.concat(name, F.lit("; ;")))
        .when(k % 397 == 300, F.concat(name, F.lit("; ; (1.2.3, 4)")))
        .when(k % 5 == 0, F.concat(F.lit(" "), name, F.lit(" ; ; ("), bal, F.lit(", "), k.cast("string"), F.lit(".5, 7.0)")))
        .otherwise(F.concat(name, F.lit(";;{"), bal, F.lit(","), k.cast("string"), F.lit("}")))
    )
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), (F.col("c_nationkey") % 4).cast("string")).alias("config_dir"), k.cast("int").alias("line_no"), line.alias("line"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_config(config_text(spark, sf_dir), PIXEL, 2.0)


LINES_SQL = r"""c AS (
  SELECT 'g' || (c_nationkey % 4) AS config_dir, CAST(c_custkey AS INTEGER) AS line_no, c_custkey AS k, 'tile_' || (c_custkey % 500) || '.tif' AS nm, c_acctbal AS bal FROM customer
), g AS (
  SELECT config_dir, line_no, nm AS image_name, CASE WHEN k % 397 = 300 THEN NULL ELSE bal / 1.0::DOUBLE END AS x,
    CASE WHEN k % 397 = 300 THEN 4 / 1.0::DOUBLE WHEN k % 5 = 0 THEN (k + 0.5::DOUBLE) / 1.0::DOUBLE ELSE k / 1.0::DOUBLE END AS y
  FROM c WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0
), kp AS (
  SELECT g.* FROM g LEFT JOIN (SELECT config_dir, min(line_no) AS bad FROM g WHERE x IS NULL OR y IS NULL GROUP BY config_dir) m ON g.config_dir = m.config_dir WHERE bad IS NULL OR line_no < bad
), lw AS (
  SELECT config_dir, image_name, arg_max({'x': x, 'y': y}, line_no) AS p FROM g WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY config_dir, image_name
), lp AS (SELECT config_dir, image_name, p.x AS x, p.y AS y FROM lw)"""


@query(f"WITH {LINES_SQL} SELECT config_dir, line_no, image_name, x, y FROM g")
def config_parse(spark, sf_dir):
    """S5, F6, F7, P2, X8, X9, X11."""
    return positions(spark, sf_dir)


@query(f"WITH {LINES_SQL} SELECT config_dir, line_no, image_name, x, y FROM kp")
def config_keep_prefix(spark, sf_dir):
    """D7."""
    return P.keep_prefix(positions(spark, sf_dir))


def last_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.last_wins(positions(spark, sf_dir).where("x is not null and y is not null"))


@query(f"WITH {LINES_SQL} SELECT config_dir, image_name, x, y FROM lp")
def config_last_wins(spark, sf_dir):
    """A12."""
    return last_positions(spark, sf_dir)


@query(f"WITH {LINES_SQL} SELECT config_dir, max(y) AS max_y FROM lp GROUP BY config_dir")
def config_max_y(spark, sf_dir):
    """A4."""
    return P.config_max_y(last_positions(spark, sf_dir))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("g"), (F.col("event_id") % 6).cast("string")).alias("subdir"), F.concat(F.lit("tile_"), (F.col("event_id") % 600).cast("string"), F.lit(".tif")).alias("file_name"), (F.col("event_id") % 200).alias("k"))
    dims = _table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("w"), F.col("p_size").alias("h"))
    return e.join(dims, "k", "left").drop("k")


CONFIG_FILES_SQL = "cf AS (SELECT 'g' || (event_id % 6) AS subdir, 'tile_' || (event_id % 600) || '.tif' AS file_name, p_size AS w, p_size AS h FROM events LEFT JOIN (SELECT * FROM part WHERE p_partkey < 200) ON event_id % 200 = p_partkey)"


@query(f"WITH {LINES_SQL}, {CONFIG_FILES_SQL} SELECT subdir, file_name, {_round('lp.x')} AS x, {_round('lp.y')} AS y, w, h FROM cf JOIN lp ON subdir = config_dir AND file_name = image_name WHERE w IS NOT NULL")
def config_join(spark, sf_dir):
    """J1, F4."""
    return P.place_by_config(config_files(spark, sf_dir), last_positions(spark, sf_dir)).select("subdir", "file_name", "x", "y", "w", "h")


@query(f"WITH {LINES_SQL}, {CONFIG_FILES_SQL} SELECT subdir, file_name FROM cf WHERE NOT EXISTS (SELECT 1 FROM lp WHERE subdir = config_dir AND file_name = image_name)")
def config_unmatched(spark, sf_dir):
    """J1's other side."""
    return P.unmatched(config_files(spark, sf_dir), last_positions(spark, sf_dir)).select("subdir", "file_name")


@query(f"WITH {LINES_SQL}, {CONFIG_FILES_SQL} SELECT DISTINCT subdir FROM cf WHERE subdir IN (SELECT config_dir FROM lp)")
def groups_with_config(spark, sf_dir):
    """J4, F8."""
    return P.groups_with_config(config_files(spark, sf_dir).select("subdir").distinct(), last_positions(spark, sf_dir))


@query(
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey WHEN c_custkey % 3 = 1 THEN '  ' ELSE ' ' || c_acctbal || ' ' END AS s,
  CASE WHEN c_custkey % 3 = 2 THEN c_acctbal ELSE 7.2::DOUBLE END AS d FROM customer"""
)
def parse_default(spark, sf_dir):
    """P13, X4."""
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" ")))
    return _table(spark, sf_dir, "customer").select(s.alias("s")).withColumn("d", N.parse_default(F.col("s"), 7.2))


# T3. Rationals of whole numbers from lineitem; some tags are missing.
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    res = P.rational(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity").cast("bigint") * 100), F.when(F.col("l_orderkey") % 23 == 0, 0).otherwise(7))
    pos = P.rational(F.col("l_partkey"), F.col("l_linenumber") + 1)
    return li.select(F.concat(F.lit("scan"), (F.col("l_suppkey") % 3).cast("string")).alias("subdir"), F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("file_name"), res.alias("x_res"), res.alias("y_res"), pos.alias("x_pos"), (pos / 2).alias("y_pos"), F.when(F.col("l_orderkey") % 9 != 0, F.lit(64)).alias("w"), F.lit(32).alias("h"))


def _tags_sql(fx: float, fy: float) -> str:
    return f"""WITH h AS (
  SELECT 'scan' || (l_suppkey % 3) AS subdir, l_orderkey || '_' || l_linenumber || '_' || l_partkey AS file_name,
    CASE WHEN l_orderkey % 5 = 0 THEN 0.0::DOUBLE WHEN l_orderkey % 23 <> 0 THEN CAST(l_quantity AS BIGINT) * 100 / 7::DOUBLE WHEN CAST(l_quantity AS BIGINT) = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS r, l_partkey / (l_linenumber + 1)::DOUBLE AS p FROM lineitem WHERE l_orderkey % 9 <> 0
), d AS (SELECT *, r * {fx}::DOUBLE * p AS dx, r * {fy}::DOUBLE * (p / 2) AS dy FROM h WHERE contains(subdir, 'scan'))
SELECT subdir, file_name, {_round('dx')} AS x, {_round('dy')} AS y, 64 AS w, 32 AS h FROM d"""


@query(_tags_sql(1.0, 1.0))
def tag_tiles(spark, sf_dir):
    """S7, S8, P3, F5."""
    return P.place_by_tags(headers(spark, sf_dir), match="scan").select("subdir", "file_name", "x", "y", "w", "h")


@query(_tags_sql(1.05, 1.02))
def tag_tiles_fudged(spark, sf_dir):
    """P3, F18."""
    return P.place_by_tags(headers(spark, sf_dir), 1.05, 1.02, match="scan").select("subdir", "file_name", "x", "y", "w", "h")


# T4. Blocks of 8 by 8 values; every seventh is missing.
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0")
    values = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))
    return R.explode_blocks(e, values, 8, (F.col("vec_id") % 25 * 8).cast("int"), (F.expr("vec_id div 25") * 8).cast("int"), ["label"])


PIXELS_SQL = """e AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 7 <> 0), px AS (
  SELECT label, CAST(vec_id % 25 * 8 + i % 8 AS INTEGER) AS px, CAST(vec_id // 25 * 8 + i // 8 AS INTEGER) AS py, CAST(floor((v::DOUBLE + 1) * 127.5::DOUBLE) AS INTEGER) AS v FROM e)"""


@query(f"WITH {PIXELS_SQL} SELECT label, px, py, v FROM px")
def pixel_values(spark, sf_dir):
    """M11, X18."""
    return pixels(spark, sf_dir)


@query(f"WITH {PIXELS_SQL} SELECT CAST(px // 4 AS INTEGER) AS gx, CAST(py // 4 AS INTEGER) AS gy, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM px GROUP BY ALL")
def pyramid_level(spark, sf_dir):
    """A11."""
    return R.downsample(pixels(spark, sf_dir), 4)


@query(f"WITH {PIXELS_SQL}, k AS (SELECT x, y FROM (SELECT CAST(unnest(range(200)) AS INTEGER) AS x) CROSS JOIN (SELECT CAST(unnest(range((max(vec_id) // 25 + 1) * 8)) AS INTEGER) AS y FROM embeddings)) SELECT k.x, k.y, coalesce(v, 255) AS v FROM k LEFT JOIN px ON k.x = px.px AND k.y = px.py")
def white_fill(spark, sf_dir):
    """J3, F16, P10. The canvas is as high as the pixels are."""
    high = _table(spark, sf_dir, "embeddings").agg(F.expr("cast((max(vec_id) div 25 + 1) * 8 as int)").alias("high"))
    rows = high.select(F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("y"))
    canvas = rows.crossJoin(spark.range(200).select(F.col("id").cast("int").alias("x"))).select("x", "y")
    return C.fill_white(canvas, pixels(spark, sf_dir).select(F.col("px").alias("x"), F.col("py").alias("y"), "v"), 255, ["x", "y"])


BANDS_SQL = f"{PIXELS_SQL}, bp AS (SELECT px, py, CASE WHEN (px + py) % 3 = 0 THEN [0, 0, 0] ELSE [v, v % 7, 0] END AS bands FROM px)"


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("px", "py", F.expr("if((px + py) % 3 = 0, array(0, 0, 0), array(v, v % 7, 0))").alias("bands"))


@query(f"WITH {BANDS_SQL} SELECT px, py, CAST(b[1] AS INTEGER) AS r, CAST(b[2] AS INTEGER) AS g, CAST(b[3] AS INTEGER) AS b FROM (SELECT px, py, CASE WHEN bands = [0, 0, 0] THEN [255, 255, 255] ELSE bands END AS b FROM bp)")
def black_fill(spark, sf_dir):
    """F13."""
    return C.fill_black(banded(spark, sf_dir), 255).select("px", "py", F.expr("bands[0]").alias("r"), F.expr("bands[1]").alias("g"), F.expr("bands[2]").alias("b"))


@query(
    f"""WITH {BANDS_SQL}, s AS (SELECT CAST(px // 8 AS INTEGER) AS gx, CAST(py // 8 AS INTEGER) AS gy, sum(bands[1]) // count(*) AS r, sum(bands[2]) // count(*) AS g FROM bp GROUP BY ALL)
SELECT gx, gy, CAST(CASE WHEN r = 0 AND g = 0 THEN 255 ELSE r END AS BIGINT) AS r, CAST(CASE WHEN r = 0 AND g = 0 THEN 255 ELSE g END AS BIGINT) AS g FROM s"""
)
def thumbnail_fill(spark, sf_dir):
    """The lowest level, then black pixels become white."""
    b = banded(spark, sf_dir)
    means = [R.downsample(b.select("px", "py", F.expr(f"bands[{i}]").alias("v")), 8).select("gx", "gy", F.expr("s div n").alias(c)) for i, c in enumerate("rg")]
    small = means[0].join(means[1], ["gx", "gy"]).select("gx", "gy", F.array("r", "g").alias("bands"))
    return C.fill_black(small, 255).select("gx", "gy", F.expr("cast(bands[0] as bigint)").alias("r"), F.expr("cast(bands[1] as bigint)").alias("g"))


CHANNELS = ["DAPI", "red", "Cy5", "brightfield", "Alexa 488", "green", "eGFP", "blue"]


@query(
    f"""WITH k AS (SELECT p_partkey AS id, {CHANNELS}[1 + p_partkey % 8] AS a, {CHANNELS}[1 + p_partkey // 8 % 8] AS b, p_partkey % 5 = 0 AS rgb, p_partkey % 4 AS n FROM part),
c AS (SELECT *, regexp_matches(lower(a), '{"|".join(X.FLUORESCENCE)}') OR regexp_matches(lower(b), '{"|".join(X.FLUORESCENCE)}') AS is_fluor FROM k)
SELECT id, is_fluor, rgb OR (n = 3 AND NOT is_fluor) AS is_colour, rgb OR n = 3 AS is_wrapped FROM c"""
)
def colour_class(spark, sf_dir):
    """F12, F14, D15."""
    names = F.array(*[F.lit(c) for c in CHANNELS])
    k = F.col("p_partkey")
    channels = F.array(F.struct(F.get(names, (k % 8).cast("int")).alias("name")), F.struct(F.get(names, (F.expr("p_partkey div 8") % 8).cast("int")).alias("name")))
    p = _table(spark, sf_dir, "part").select(k.alias("id"), channels.alias("c"), (k % 5 == 0).alias("rgb"), (k % 4).alias("n"))
    return p.select("id", X.is_fluorescence(F.col("c")).alias("is_fluor"), X.is_colour(F.col("rgb"), F.col("n"), F.col("c")).alias("is_colour"), X.is_wrapped(F.col("rgb"), F.col("n")).alias("is_wrapped"))


@query(
    """SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size * 81.0::DOUBLE END, CASE ['uint8', 'uint16', 'float32'][1 + p_size % 3] WHEN 'uint8' THEN 255.0 WHEN 'uint16' THEN 65535.0 END, 255.0)::DOUBLE AS max_value FROM part"""
)
def white_value(spark, sf_dir):
    """P10."""
    kind = F.get(F.array(F.lit("uint8"), F.lit("uint16"), F.lit("float32")), F.col("p_size") % 3)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.white_value(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * F.lit(81.0)), kind).alias("max_value"))


@query(
    f"""WITH {TILES_SQL}, d AS (SELECT unnest([1.0, 2.5, 4.0])::DOUBLE AS ds)
SELECT subdir, ds, CASE WHEN ds = 1 THEN 'run_' || subdir || '.ome.tif' ELSE 'run_' || subdir || '_' || CAST(trunc(ds) AS INTEGER) || 'x_downsample.ome.tif' END AS file FROM b CROSS JOIN d"""
)
def output_names(spark, sf_dir):
    """P7, P8, X14."""
    b = M.group_bounds(tiles(spark, sf_dir)).select("subdir", F.explode(F.array(*[F.lit(d) for d in (1.0, 2.5, 4.0)])).alias("ds"))
    return b.select("subdir", "ds", X.output_name(X.output_base(F.col("subdir"), "run"), F.col("ds"), "ome.tif").alias("file"))


@query(
    r"""WITH n AS (SELECT p_partkey AS id, regexp_replace(CASE p_partkey % 7 WHEN 0 THEN p_brand || '_2' WHEN 1 THEN p_brand || '_' || (p_partkey % 90) WHEN 2 THEN p_brand || '.ome.tif' ELSE p_brand END, '\.ome\.tif$', '') AS base FROM part),
r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS place FROM n), d AS (SELECT DISTINCT base FROM n),
t AS (SELECT regexp_extract(base, '^(.*)_([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(base, '^(.*)_([1-9][0-9]*)$', 2) AS BIGINT) AS t FROM d WHERE regexp_matches(base, '^(.*)_([1-9][0-9]*)$')),
u AS (SELECT base, t - row_number() OVER (PARTITION BY base ORDER BY t) + 1 AS at FROM t WHERE t >= 2 AND base IN (SELECT base FROM d)),
k AS (SELECT r.id, r.base, r.place, count(u.at) AS passed FROM r LEFT JOIN u ON r.base = u.base AND u.at <= r.place GROUP BY ALL)
SELECT id, CASE WHEN place = 1 THEN base ELSE base || '_' || (place + passed) END || '.ome.tif' AS file FROM k"""
)
def unique_names(spark, sf_dir):
    """Names in a folder, some of which read like numbered ones."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    name = F.when(k % 7 == 0, F.concat(brand, F.lit("_2"))).when(k % 7 == 1, F.concat(brand, F.lit("_"), (k % 90).cast("string"))).when(k % 7 == 2, F.concat(brand, F.lit(".ome.tif"))).otherwise(brand)
    n = _table(spark, sf_dir, "part").select(k.alias("id"), F.regexp_replace(name, "\\.ome\\.tif$", "").alias("base"))
    return P.free_numbers(n, "base", ["id"]).select("id", X.numbered_name(F.col("base"), F.col("number"), "ome.tif").alias("file"))


def _image_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """T4 as files: an 8 by 8 TIFF for each block, in a folder for each label, named by its place in microns of half a pixel."""
    e = _table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0").select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")).alias("v"))
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")  # a row is small, its file is not

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = r["vec_id"] % 25 * 4, r["vec_id"] // 25 * 4
                store.write(f"{folder}/in/{r['label']}/b[{x},{y}].tif", tiff.encode(np.array(r["v"], np.uint16).reshape(8, 8)))
            yield batch.select(["vec_id"])

    e.mapInArrow(run, "vec_id bigint").write.format("noop").mode("overwrite").save()


def _pixel_rows(label: str, pixels: np.ndarray):
    """(label, x, y, v) of an image's first band, some rows of it at a time."""
    h, w, _ = pixels.shape
    step = max(1, 100_000 // max(1, w))
    for top in range(0, h, step):
        v = pixels[top : top + step, :, 0].astype(np.int32)
        y, x = np.divmod(np.arange(v.size, dtype=np.int32), np.int32(w))
        yield pa.RecordBatch.from_arrays([pa.repeat(label, v.size), pa.array(x), pa.array(y + np.int32(top)), pa.array(v.ravel())], names=["label", "x", "y", "v"])


def _stitched(spark: SparkSession, sf_dir: str, kind: OutputFormat, codec: str, base: float, level: int) -> DataFrame:
    """The whole job over T4's files, and a level of each pyramid read back: (label, x, y, v)."""
    ship(spark)
    folder = new_folder(spark, "stitched")
    _image_files(spark, sf_dir, folder)
    out = api.run(spark, StitchConfig(FILE_NAME, f"{folder}/in", f"{folder}/out", codec, 0.5, base, "", 1.0, output_format=kind), chunk=128, edge=32)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _pixel_rows(r["subdir"], zarr.read_level(r["path"], level) if kind is OutputFormat.OME_ZARR else tiff.read_image(r["path"], level))

    return spread(out.where("status = 'ok'")).mapInArrow(run, "label string, x int, y int, v int")


def _stitched_sql(base: float, step: int, level: int) -> str:
    """Canvas of each label with gaps 0, then integer means of blocks, level by level."""
    sql = f"""WITH {PIXELS_SQL}, bb AS (SELECT label, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM px GROUP BY label),
l0 AS (SELECT k.label, CAST(floor(k.x / {base}::DOUBLE) AS INTEGER) AS x, CAST(floor(k.y / {base}::DOUBLE) AS INTEGER) AS y, CAST(sum(coalesce(v, 0)) // count(*) AS INTEGER) AS v
  FROM (SELECT label, x0, y0, x, unnest(range(y1 - y0 + 1)) AS y FROM (SELECT *, unnest(range(x1 - x0 + 1)) AS x FROM bb)) k LEFT JOIN px ON px.label = k.label AND px.px = k.x + x0 AND px.py = k.y + y0 GROUP BY ALL)"""
    for i in range(1, level + 1):
        sql += f", l{i} AS (SELECT label, CAST(x // {step} AS INTEGER) AS x, CAST(y // {step} AS INTEGER) AS y, CAST(sum(v) // count(*) AS INTEGER) AS v FROM l{i - 1} GROUP BY ALL)"
    return f"{sql} SELECT CAST(label AS VARCHAR) AS label, x, y, v FROM l{level}"


@query(_stitched_sql(2.5, 2, 1))
def stitched_arrays(spark, sf_dir):
    """Files to arrays and back, base 2.5."""
    return _stitched(spark, sf_dir, OutputFormat.OME_ZARR, "lz4", 2.5, 1)


@query(_stitched_sql(3, 4, 0))
def stitched_tiffs(spark, sf_dir):
    """Files to pyramidal TIFF and back, base 3."""
    return _stitched(spark, sf_dir, OutputFormat.OME_TIFF, "ZLIB", 3.0, 0)


@query(
    f"""WITH {PIXELS_SQL}, bb AS (SELECT label, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM px GROUP BY label),
k AS (SELECT label, x, unnest(range(y0, y1 + 1)) AS y, x0, y0 FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM bb))
SELECT CAST(k.label AS VARCHAR) AS label, CAST((k.x - x0 - 13) // 3 AS INTEGER) AS x, CAST((k.y - y0 - 20) // 3 AS INTEGER) AS y, CAST(sum(coalesce(v, 0)) // count(*) AS INTEGER) AS v
FROM k LEFT JOIN px ON px.label = k.label AND px.px = k.x AND px.py = k.y WHERE k.x - x0 BETWEEN 13 AND 92 AND k.y - y0 BETWEEN 20 AND 69 GROUP BY ALL"""
)
def region_pixels(spark, sf_dir):
    """A request at downsample 3 on each composed image, without writing it."""
    ship(spark)
    folder = new_folder(spark, "region")
    _image_files(spark, sf_dir, folder)
    chunks = api.level_zero(spark, StitchConfig(FILE_NAME, f"{folder}/in", folder, "zlib", 0.5, 1.0, "", 1.0), chunk=128)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _pixel_rows(r["subdir"], np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"]))

    return raster.read_region(chunks, 128, 3.0, 13, 20, 80, 50).mapInArrow(run, "label string, x int, y int, v int")


@query(
    f"""{_stitched_sql(8, 1, 0).rsplit(" SELECT CAST(label", 1)[0]} SELECT CAST(label AS VARCHAR) AS label, x, y, CASE WHEN v = 0 THEN 255 ELSE v END AS v FROM l0"""
)
def thumbnail_pixels(spark, sf_dir):
    """Composed images eight times smaller, black pixels white."""
    ship(spark)
    folder = new_folder(spark, "thumbnail")
    _image_files(spark, sf_dir, folder)
    chunks = api.level_zero(spark, StitchConfig(FILE_NAME, f"{folder}/in", folder, "zlib", 0.5, 1.0, "", 1.0), chunk=128)
    small = raster.thumbnail(raster.read_region(chunks, 128, 8.0, 0, 0, 1 << 30, 1 << 30))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _pixel_rows(r["subdir"], np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"]))

    return small.mapInArrow(run, "label string, x int, y int, v int")


@query(
    f"""WITH s AS (SELECT s_suppkey AS k, 'scan' || (s_nationkey % 3) AS subdir FROM supplier), h AS (
  SELECT *, 1000 * (k % 50) / (1 + k % 3)::DOUBLE AS xr, 500 * (k % 20)::DOUBLE AS yr, (k % 7) / 2::DOUBLE AS yp,
    CASE WHEN k % 4 > 0 THEN k / (k % 4)::DOUBLE WHEN k > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS xp FROM s
), d AS (SELECT *, xr * 1.05::DOUBLE * xp AS dx, yr * 1.02::DOUBLE * yp AS dy FROM h)
SELECT subdir, 's' || k || '.tif' AS file_name, {_round('dx')} AS x, {_round('dy')} AS y, CAST(4 + k % 5 AS INTEGER) AS w, 3 AS h, xr AS x_res, yp AS y_pos FROM d"""
)
def scanned_tags(spark, sf_dir):
    """Tags of real files, some with a zero denominator."""
    ship(spark)
    folder = new_folder(spark, "tags")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                k = r["k"]
                image = tiff.encode(np.zeros((3, 4 + k % 5), np.uint8), (1000 * (k % 50), 1 + k % 3), (500 * (k % 20), 1), (k, k % 4), (k % 7, 2))
                store.write(f"{folder}/{r['subdir']}/s{k}.tif", image)
            yield batch.select(["k"])

    named = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("scan"), (F.col("s_nationkey") % 3).cast("string")).alias("subdir"))
    named.mapInArrow(run, "k bigint").write.format("noop").mode("overwrite").save()
    cfg = StitchConfig(VECTRA, folder, folder, "LZW", PIXEL, 1.0, "scan", 1.0, 1.05, 1.02)
    placed = api.place(spark, cfg).select("subdir", "file_name", "x", "y", "w", "h", "path")
    found = catalog.with_headers(placed.select("path")).select("path", "x_res", "y_pos")
    return placed.join(found, "path").drop("path")


@query(
    f"""WITH {LINES_SQL}, last AS (SELECT config_dir, image_name, arg_max({{'x': x, 'y': y}}, line_no) AS p FROM kp GROUP BY config_dir, image_name),
f AS (SELECT DISTINCT 'g' || (c_custkey % 500 % 3) AS subdir, 'tile_' || (c_custkey % 500) || '.tif' AS file_name, CAST(1 + c_custkey % 500 % 9 AS INTEGER) AS w FROM customer)
SELECT subdir, file_name, {_round('p.x')} AS x, {_round('p.y')} AS y, w, w AS h FROM f JOIN last ON subdir = config_dir AND file_name = image_name"""
)
def scanned_configs(spark, sf_dir):
    """Configuration texts and tiles as real files; those of one group lie
    a folder deeper."""
    ship(spark)
    folder = new_folder(spark, "configs")

    def texts(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store.write(f"{folder}/{r['config_dir']}/{catalog.CONFIG_NAME}", "\n".join(x["line"] for x in r["lines"]).encode())
            yield batch.select(["config_dir"])

    def images(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                deeper = "angle/" if n % 3 == 1 else ""
                store.write(f"{folder}/g{n % 3}/{deeper}tile_{n}.tif", tiff.encode(np.zeros((1 + n % 9, 1 + n % 9), np.uint8)))
            yield batch.select(["n"])

    # A configuration is one file, and so one row.
    lines = config_text(spark, sf_dir).groupBy("config_dir").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    lines.mapInArrow(texts, "config_dir string").write.format("noop").mode("overwrite").save()
    numbers = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("n")).distinct()
    numbers.mapInArrow(images, "n bigint").write.format("noop").mode("overwrite").save()
    return api.place(spark, StitchConfig(TILE_CONFIG, folder, folder, "LZW", PIXEL, 2.0, "g", 1.0)).select("subdir", "file_name", "x", "y", "w", "h")


CODEC_NAMES = ["", "LZW", "deflate", "zlib", "Uncompressed", "none", "JPEG", "JPEG-2000", "jpeg-2000-lossy", "zstd", "LZ4", "lz4hc", "blosclz", "J2K", "ZIP"]
_CODECS_SQL = f"(SELECT unnest({CODEC_NAMES}) AS name UNION ALL SELECT NULL)"


def _codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in [*CODEC_NAMES, None]], "name string")


@query(
    f"""SELECT name, CASE WHEN name IS NULL OR name = '' THEN 'zstd' WHEN lower(name) IN ('uncompressed', 'none') THEN NULL WHEN lower(name) IN ('lzw', 'deflate', 'zlib') THEN 'zlib'
  WHEN lower(name) IN ('jpeg', 'jpeg-2000', 'jpeg-2000-lossy', 'j2k', 'j2k_lossy') THEN 'zstd' ELSE lower(name) END AS codec FROM {_CODECS_SQL}"""
)
def zarr_codec(spark, sf_dir):
    """K5, X17."""
    return _codecs(spark).select("name", X.zarr_codec(F.col("name")).alias("codec"))


@query(f"SELECT name, coalesce(name IN ('DEFAULT', 'UNCOMPRESSED', 'JPEG', 'J2K', 'J2K_LOSSY', 'LZW', 'ZLIB'), false) AS valid FROM {_CODECS_SQL}")
def tiff_codec_valid(spark, sf_dir):
    """K4, S13."""
    return _codecs(spark).select("name", X.tiff_codec_valid(F.col("name")).alias("valid"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.group_bounds(tiles(spark, sf_dir)).select("subdir", F.when(F.col("subdir") != "signup", F.concat(F.lit("/out/"), F.col("subdir"), F.lit(".ome.tif"))).alias("path"))


OUTPUTS_SQL = f"{TILES_SQL}, o AS (SELECT subdir, CASE WHEN subdir <> 'signup' THEN '/out/' || subdir || '.ome.tif' END AS path FROM b)"


@query(f"WITH {OUTPUTS_SQL} SELECT count(path) AS n_ok, count(*) - count(path) AS n_failed FROM o")
def run_status(spark, sf_dir):
    """A7."""
    return M.run_status(outputs(spark, sf_dir))


@query(f"WITH {OUTPUTS_SQL} SELECT arg_max(path, subdir) AS path FROM o WHERE path IS NOT NULL")
def last_output(spark, sf_dir):
    """A10, F15."""
    return M.last_output(outputs(spark, sf_dir))
