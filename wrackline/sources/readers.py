"""Sources and sinks: scene tables, tiles, catalogue pages, gauge files, time grids, the dataset index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.functions.expressions import iso_date

CATALOGUE_SCHEMA = (
    "features array<struct<id:string,properties:struct<title:string,datetime:string,`s2:product_type`:string,`eo:cloud_cover`:double>>>"
)


def scan_stack(scl: DataFrame, dates: list[str]) -> DataFrame:
    """All pixels of the dates asked for; raises if one is missing. The date filter prunes partitions."""
    wanted = scl.sparkSession.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("scene_date"))
    rows = scl.where(F.col("scene_date").isin([F.to_date(F.lit(d)) for d in dates]))
    missing = [str(r.scene_date) for r in wanted.join(rows.select("scene_date").distinct(), "scene_date", "left_anti").collect()]
    if missing:
        raise FileNotFoundError(f"scenes missing: {sorted(missing)}")
    return rows


def scan_scene(scenes: DataFrame, date: str, *columns: str) -> DataFrame:
    """One scene's pixels; no rows if there is no such scene."""
    rows = scenes.where(F.col("scene_date") == F.to_date(F.lit(date)))
    return rows.select("scene_date", "y", "x", *columns) if columns else rows


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    """tiles: scene_date, row0, col0, grid (array of rows). One row per pixel; a null pixel becomes class 0 (no data)."""
    rows = tiles.select("scene_date", "row0", "col0", F.posexplode("grid").alias("dy", "line"))
    cells = rows.select("scene_date", (F.col("row0") + F.col("dy")).alias("y"), "col0", F.posexplode("line").alias("dx", "scl"))
    return cells.select("scene_date", "y", (F.col("col0") + F.col("dx")).alias("x"), F.coalesce("scl", F.lit(0)).alias("scl"))


def pixels_to_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """The reverse: square tiles of `size`, absent pixels null."""
    cell = pixels.select("scene_date", F.expr(f"y div {size} * {size}").cast("int").alias("row0"), F.expr(f"x div {size} * {size}").cast("int").alias("col0"), (F.col("y") % size * size + F.col("x") % size).alias("k"), "scl")
    tile = cell.groupBy("scene_date", "row0", "col0").agg(F.map_from_entries(F.collect_list(F.struct("k", "scl"))).alias("at"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.try_element_at("at", r * size + c)))
    return tile.select("scene_date", "row0", "col0", grid.alias("grid"))


def read_gauge(spark: SparkSession, path: str, date_col: str = "fecha", height_col: str = "nivel_m", skiprows: int = 0) -> DataFrame:
    """datetime, height_m from CSV files; skiprows lines are left out at the top of each file. Rows without a time are dropped.

    Files are read in splits, line by line, each with its own header. A line's number counts from its file's first one,
    which only the file's first split needs; commas within quotes belong to their cell.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = lines.where("block = 0").groupBy("file").agg(F.min("id").alias("first"))
    comma = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.transform(F.split("value", comma), lambda c: F.regexp_replace(F.trim(c), r'^"|"$', ""))
    numbered = lines.join(first, "file").select("file", "value", F.when(F.col("block") == 0, F.col("id") - F.col("first")).otherwise(skiprows + 1).alias("n"))
    head = numbered.where(F.col("n") == skiprows).select("file", cells.alias("names"))
    body = numbered.where((F.col("n") > skiprows) & (F.trim("value") != "")).join(head, "file").select("names", cells.alias("cells"))
    cell = lambda name: F.try_element_at("cells", F.array_position("names", name).cast("int"))
    return body.select(cell(date_col).try_cast("timestamp_ntz").alias("datetime"), cell(height_col).try_cast("double").alias("height_m")).where("datetime IS NOT NULL")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """seq, title, datetime, product_type, cloud_cover of the features on harvested pages; seq follows file and position."""
    pages = spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    f = pages.select("page", F.posexplode("features").alias("pos", "f"))
    p = F.col("f.properties")
    return f.select(
        F.struct("page", "pos").alias("seq"),
        F.coalesce(F.nullif(p["title"], F.lit("")), F.col("f.id")).alias("title"),
        p["datetime"].alias("datetime"),
        p["s2:product_type"].alias("product_type"),
        p["eo:cloud_cover"].alias("cloud_cover"),
    )


def overpass_times(catalogue: DataFrame, earliest: bool = False) -> DataFrame:
    """catalogue: seq, title. scene_date and the time in the title of the day's first L2A product (in catalogue order, or the earliest)."""
    stamp = F.regexp_extract("title", r"_(\d{8}T\d{6})_", 1)
    rows = catalogue.where(F.contains("title", F.lit("MSIL2A")) & (stamp != "")).select("seq", F.to_timestamp_ntz(F.regexp_replace(stamp, "T", " "), F.lit("yyyyMMdd HHmmss")).alias("dt_utc"))
    return rows.groupBy(F.to_date("dt_utc").alias("scene_date")).agg(F.min("dt_utc").alias("dt_utc") if earliest else F.min_by("dt_utc", "seq").alias("dt_utc"))


def available_dates(catalogue: DataFrame, max_cloud: float = 100.0) -> DataFrame:
    """Distinct dates with an L2A product of at most max_cloud; an unknown cloud cover counts as 100."""
    ok = (F.col("product_type") == "S2MSI2A") & (F.coalesce("cloud_cover", F.lit(100.0)) <= max_cloud)
    return catalogue.where(ok).select("scene_date").distinct()


def normalised_dates(labels: DataFrame, column: str) -> DataFrame:
    return labels.select(iso_date(F.col(column)).alias("iso_date")).distinct()


def pending_dates(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Dates without an output yet."""
    return requested.select("scene_date").distinct().join(done.select("scene_date").distinct(), "scene_date", "left_anti")


def time_grid(spark: SparkSession, start: str, end: str, hours: int = 2) -> DataFrame:
    """Times from start to end, both included."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{end}', INTERVAL {hours} HOURS)) AS ts")


#: Side of the squares that are written together, and pixels in a file at most.
SQUARE, FILE_PIXELS = 64, 4_000_000


def _spread(v: Column) -> Column:
    """The low 16 bits, each followed by a 0 bit."""
    v = v.cast("bigint").bitwiseAND(F.lit(0xFFFF))
    for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
    return v


def z_order(y: Column, x: Column) -> Column:
    """Place of a square of pixels on a curve that keeps neighbours close: the bits of both places, interleaved."""
    at = lambda c: F.floor(c / SQUARE) + 0x8000  # noqa: E731  from 32,768 squares below 0
    return F.shiftleft(_spread(at(y)), 1).bitwiseOR(_spread(at(x)))


def write_scenes(pixels: DataFrame, path: str, file_pixels: int = FILE_PIXELS) -> None:
    """Pixels by scene date; dates that are written again replace their own partition only.

    A scene is dealt out along a curve over its squares, so that a large one is several tasks' work, and a file covers a
    compact area: a query for a box skips most files by their extremes of y and x.
    """
    missing = {"scene_date", "y", "x"} - set(pixels.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    rows = pixels.withColumn("_z", z_order(F.col("y"), F.col("x"))).repartitionByRange("scene_date", "_z").sortWithinPartitions("scene_date", "_z", "y", "x").drop("_z")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_pixels)
    writer.partitionBy("scene_date").parquet(path)


def write_index(index: DataFrame, path: str, kind: str = "csv") -> None:
    """The dataset index in order of date."""
    rows = index.orderBy("fecha")
    (rows.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else rows.write.mode("overwrite").parquet(path))


def frame_paths(dates: DataFrame, date_col: str = "scene_date") -> DataFrame:
    """PNG paths of each date and the former TIFF paths."""
    d = F.date_format(date_col, "yyyy-MM-dd")
    path = lambda kind, ext: F.concat(F.lit(f"{kind}_{ext}/{kind}_" if ext == "png" else f"{kind}/{kind}_"), d, F.lit(f".{ext}"))
    return dates.select(date_col, path("rgb", "png").alias("imagen_rgb"), path("scl", "png").alias("imagen_scl"), path("rgb", "tif").alias("imagen_rgb_tif"), path("scl", "tif").alias("imagen_scl_tif"))


def grid_frame(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Every pixel (y, x) of a raster."""
    return spark.range(height * width).select((F.expr(f"id div {width}")).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


