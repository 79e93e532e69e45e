"""From names, configuration lines and tags to tiles in a pixel plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import java_int, java_round, java_trim, try_double
from ..functions.text import matches_group, named_coordinates, split_dropping_trailing

TILE_COLUMNS = ("path", "file_name", "subdir", "x", "y", "w", "h", "z", "t", "bands", "bits", "rgb", "max_value", "channels")


def _check(pixel_size_um: float) -> None:
    if not pixel_size_um > 0:
        raise ValueError("the pixel size must be positive")


def _tiles(df: DataFrame) -> DataFrame:
    """The tile relation; planes are always 0 (M2). What headers say of pixels goes with it, where it is known."""
    found = df.withColumns({"z": F.lit(0), "t": F.lit(0)})
    return found.select(*[c for c in TILE_COLUMNS if c in found.columns])


def place_by_name(files: DataFrame, pixel_size_um: float, match: str = "") -> DataFrame:
    """Tiles from (subdir, file_name, w, h [, path]) whose names hold microns in brackets. The downsample plays no part.
    Names that do not match, coordinates beyond an int and files without dimensions are left out. Filters come first,
    so that they reach the scan."""
    _check(pixel_size_um)
    ok, x, y = named_coordinates(F.col("file_name"))
    found = files.where(matches_group(F.col("subdir"), match) & ok & F.col("w").isNotNull() & F.col("h").isNotNull())
    found = found.withColumns({"x": java_round(x / F.lit(float(pixel_size_um))), "y": java_round(y / F.lit(float(pixel_size_um)))})
    return _tiles(found.where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def parse_config(lines: DataFrame, pixel_size_um: float, base_downsample: float, text_col: str = "line") -> DataFrame:
    """(config_dir, line_no, image_name, x, y) of the data lines of configuration texts, in scaled doubles.

    Comments start with # in the first column; lines with fewer than three fields or two coordinates are passed over,
    further coordinates ignored. A malformed number gives null coordinates: see keep_prefix.
    """
    _check(pixel_size_um)
    scale = F.lit(float(pixel_size_um) * float(base_downsample))
    data = lines.where(~F.startswith(text_col, F.lit("#")) & (java_trim(F.col(text_col)) != ""))
    data = data.withColumn("_f", split_dropping_trailing(F.col(text_col), ";")).where("size(_f) >= 3")
    data = data.withColumn("_c", split_dropping_trailing(F.regexp_replace(F.get("_f", F.lit(2)), "[(){}]", ""), ",")).where("size(_c) >= 2")
    return data.select(
        "config_dir",
        "line_no",
        java_trim(F.get("_f", F.lit(0))).alias("image_name"),
        (try_double(F.get("_c", F.lit(0))) / scale).alias("x"),
        (try_double(F.get("_c", F.lit(1))) / scale).alias("y"),
    )


def keep_prefix(parsed: DataFrame) -> DataFrame:
    """Lines before the first malformed one of each configuration (D7). The first bad line is one row a configuration,
    counted before the shuffle; lines are not gathered."""
    bad = parsed.where("x is null or y is null").groupBy(F.col("config_dir").alias("_d")).agg(F.min("line_no").alias("_bad"))
    return parsed.join(bad, parsed["config_dir"].eqNullSafe(bad["_d"]), "left").where("_bad is null or line_no < _bad").drop("_d", "_bad")


def last_wins(parsed: DataFrame) -> DataFrame:
    """One position for each name of a configuration: the last line's."""
    return parsed.groupBy("config_dir", "image_name").agg(F.max_by(F.struct("x", "y"), "line_no").alias("_p")).select("config_dir", "image_name", "_p.x", "_p.y")


def place_by_config(files: DataFrame, positions: DataFrame) -> DataFrame:
    """Tiles of files (subdir, file_name, w, h) by the positions of their folder. The engine picks the join: positions
    may be as many as files."""
    found = files.join(positions.withColumnsRenamed({"config_dir": "subdir", "image_name": "file_name"}), ["subdir", "file_name"])
    return _tiles(found.where("w is not null and h is not null").withColumns({"x": java_round(F.col("x")), "y": java_round(F.col("y"))}))


def unmatched(files: DataFrame, positions: DataFrame) -> DataFrame:
    """Files without a position: what place_by_config warns of."""
    return files.join(positions.withColumnsRenamed({"config_dir": "subdir", "image_name": "file_name"}), ["subdir", "file_name"], "left_anti")


def groups_with_config(groups: DataFrame, configs: DataFrame) -> DataFrame:
    """Groups that have a configuration."""
    return groups.join(configs.select(F.col("config_dir").alias("subdir")), "subdir", "left_semi")


def config_max_y(positions: DataFrame) -> DataFrame:
    return positions.groupBy("config_dir").agg(F.max("y").alias("max_y"))


def rational(num, den):
    """A tag's value: 0 for a missing tag; a zero denominator gives infinities and NaN, not an error."""
    n, d = num.cast("double"), den.cast("double")
    special = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(num.isNull() | den.isNull(), F.lit(0.0)).when(d == 0, special).otherwise(F.try_divide(n, d))


def place_by_tags(headers: DataFrame, x_fudge: float = 1.0, y_fudge: float = 1.0, match: str = "") -> DataFrame:
    """Tiles from (subdir, file_name, x_res, y_res, x_pos, y_pos, w, h). Factors multiply resolutions; pixel size and
    downsample play no part. Headers without dimensions are left out."""
    found = headers.where(matches_group(F.col("subdir"), match) & F.col("w").isNotNull() & F.col("h").isNotNull())
    return _tiles(found.withColumns({"x": java_round(F.col("x_res") * F.lit(float(x_fudge)) * F.col("x_pos")), "y": java_round(F.col("y_res") * F.lit(float(y_fudge)) * F.col("y_pos"))}))


def nested_fallback(direct: DataFrame, nested: DataFrame) -> DataFrame:
    """Files of groups; those one folder deeper count, under the group's name, if it has none of its own."""
    alone = nested.join(direct.select("subdir").distinct(), "subdir", "left_anti")
    return direct.unionByName(alone)


def root_or_subdirs(in_root: DataFrame, in_groups: DataFrame, root_has_config: bool, root_name: str, match: str) -> DataFrame:
    """The root alone, if it holds a configuration and its name matches, else its groups (S3)."""
    if root_has_config and match in root_name:
        return in_root
    return in_groups.where(matches_group(F.col("subdir"), match))


def translate_origin(tiles: DataFrame) -> DataFrame:
    """Coordinates from each group's least ones (P5). Minima are counted before the shuffle and joined back: a group may
    be a third of all tiles, so that they are not gathered in a window. Differences beyond an int wrap, as the reference's."""
    least = tiles.groupBy("subdir").agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    moved = {c: java_int(F.col(c).cast("bigint") - F.col(f"_{c}")) for c in ("x", "y")}
    return tiles.join(least, "subdir").withColumns(moved).drop("_x", "_y")


def unique_places(names: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Numbers equal names from 1 (K6, K7, J7). A name's rows are numbered within ranges of the order columns, cut at as many
    drawn rows as there are shuffle partitions; counts of the ranges before are added, so that no name goes to one task."""
    key = F.struct(*order)
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = names.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(parts).agg(F.sort_array(F.collect_list("k")).alias("_cuts"))
    dealt = names.crossJoin(F.broadcast(drawn)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < key))).drop("_cuts")
    tally = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = tally.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_of"), (F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_before"))
    local = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same &= local[c].eqNullSafe(before[f"_{c}"])
    return local.join(before, same).select(*names.columns, (F.col("place") + F.col("_before")).cast("int").alias("place"))


def numbers_taken(names: DataFrame, base: str) -> DataFrame:
    """(prefix, numbers array<int>) of names that read prefix_n, n from 2 on: those that a numbered name must not have."""
    parts = [F.regexp_extract(base, "^(.*)_([1-9][0-9]*)$", i) for i in (1, 2)]
    found = names.select(parts[0].alias("prefix"), parts[1].try_cast("int").alias("n")).where("n >= 2")
    return found.groupBy("prefix").agg(F.sort_array(F.collect_set("n")).alias("numbers"))


def free_numbers(names: DataFrame, base: str, order: list[str]) -> DataFrame:
    """names and number: 1 for the first row of each base, which keeps its plain name, and for each further row the next
    number from 2 on whose name, base_number, is not itself a base here (K6, K7, J7). So no two rows share a name:
    existing files are rows that come first in the order.

    A base that reads prefix_n takes n from that prefix. The i-th least number taken, less i - 1, is the place from which
    it pushes others up, so that ranking places and these thresholds together counts the numbers to be passed over.
    """
    placed = unique_places(names, [base], order)
    bases = names.select(F.col(base).alias("_b")).distinct()
    taken = bases.select(F.regexp_extract("_b", "^(.*)_([1-9][0-9]*)$", 1).alias("_p"), F.regexp_extract("_b", "^(.*)_([1-9][0-9]*)$", 2).try_cast("bigint").alias("_n"))
    taken = taken.where("_n >= 2").join(bases.withColumnRenamed("_b", "_p"), "_p", "left_semi")
    steps = unique_places(taken, ["_p"], ["_n"]).select(F.col("_p").alias("_b"), (F.col("_n") - F.col("place") + 1).alias("_at"), F.lit(0).alias("_kind"), F.col("_n").alias("_tie"))
    held = taken.select(F.col("_p").alias("_b")).distinct()  # other bases have nothing to pass over
    places = placed.where("place > 1").select(F.col(base).alias("_b"), F.col("place").cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"))
    ranked = unique_places(steps.unionByName(places.join(held, "_b", "left_semi")), ["_b"], ["_at", "_kind", "_tie"])
    moved = ranked.where("_kind = 1").select("_b", F.col("_at").alias("_place"), (F.col("place") + 1).alias("number"))
    found = placed.join(moved, placed[base].eqNullSafe(moved["_b"]) & (placed["place"] == moved["_place"]), "left")
    return found.select(*names.columns, F.coalesce(F.col("number"), F.col("place")).cast("int").alias("number"))
