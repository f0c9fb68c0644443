"""Quality, mosaic, cube and sink queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.config import BAND_NAMES, BAND_WAVELENGTHS_NM, MASK_LEGEND, QC_FILL, REFLECTANCE_FILL, CubeConfig
from gridloom.functions import quality
from gridloom.operators import cube as ops
from gridloom.plans.ctes import USABILITY, clean, sql_over
from gridloom.plans.registry import query, r6
from gridloom.schemas import BANDS
from gridloom.sources import derived, tables, workspace

_C = CubeConfig(min_valid_fraction=0.75)
_RAW = CubeConfig(range_on="raw", valid_range=(0, 12000))
_KEY = ["tile", "date", "row", "col"]
_KEYS = ", ".join(_KEY)

_GOOD = " + ".join(f"CASE WHEN ((qc >> {2 + 4 * (b - 1)}) & 15) = 0 THEN 1 ELSE 0 END" for b in range(1, 8))
_QUALITY = f"SELECT tile, date, sum({_GOOD}) / (7e0 * count(*)) AS q FROM obs GROUP BY tile, date"
_DAYS = """SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS t FROM (
  SELECT date FROM quality GROUP BY date HAVING count(*) = 4 AND min(q) >= 0.75e0)"""
_CODES = f"SELECT tile, date, row, col, {USABILITY} AS usability FROM coarse"
_BAND_SQL = ", ".join(f"round({clean(b)}, 6) AS b0{b}" for b in range(1, 8))
_CUBE_SQL = """SELECT d.t, o.date, CAST((CAST(substr(o.tile, 5, 2) AS INT) - 3) * 2400 + o.row AS INT) AS y,
  CAST((CAST(substr(o.tile, 2, 2) AS INT) - 18) * 2400 + o.col AS INT) AS x, {bands},
  CAST(coalesce(usability, 255) AS SMALLINT) AS usability
  FROM obs o JOIN days d ON o.date = d.date LEFT JOIN codes c ON o.tile = c.tile AND o.date = c.date
  AND o.row // 2 = c.row AND o.col // 2 = c.col""".format(bands=_BAND_SQL)
_CUBE_WITH = {"quality": _QUALITY, "days": _DAYS, "codes": _CODES}


def _rounded():
    return [F.round(b, 6).alias(b) for b in BANDS]


def _built(spark, d):
    return ops.build_cube(derived.obs_500m(spark, d), derived.obs_1km(spark, d), _C)


@query(
    "o_b1_band_quality",
    sql_over(
        "obs",
        f"SELECT {_KEYS}, "
        + ", ".join(f"((qc >> {2 + 4 * (b - 1)}) & 15) = 0 AS good{b}" for b in range(1, 8))
        + " FROM obs",
    ),
)
def band_quality(spark, d):
    qc = F.col("qc")
    return derived.obs_500m(spark, d).select(
        *_KEY, *[quality.band_good(qc, b).alias(f"good{b}") for b in range(1, 8)]
    )


@query(
    "o_b2_state_fields",
    sql_over(
        "coarse",
        f"""SELECT {_KEYS}, state & 3 AS cloud, (state >> 2) & 1 AS shadow, (state >> 6) & 3 AS aerosol,
  (state >> 8) & 3 AS cirrus, (state >> 13) & 1 AS adjacent FROM coarse""",
    ),
)
def state_fields(spark, d):
    fields = quality.state_fields(F.col("state"))
    return derived.obs_1km(spark, d).select(*_KEY, *[v.alias(k) for k, v in fields.items()])


@query("o_b3_usability", sql_over("coarse", f"SELECT {_KEYS}, {USABILITY} AS usability FROM coarse"))
def usability(spark, d):
    return derived.obs_1km(spark, d).select(*_KEY, quality.usability(F.col("state")).alias("usability"))


@query(
    "o_b4_tile_gate",
    sql_over(
        "obs",
        "SELECT tile, date, round(q, 6) AS good_fraction FROM quality WHERE q >= 0.75e0",
        quality=_QUALITY,
    ),
)
def tile_gate(spark, d):
    gate = ops.tile_gate(derived.obs_500m(spark, d), _C)
    return gate.select("tile", "date", F.round("good_fraction", 6).alias("good_fraction"))


@query("o_b5_scale", sql_over("obs", f"SELECT {_KEYS}, round(r1 * 1e-4, 6) AS b01, round(r7 * 1e-4, 6) AS b07 FROM obs"))
def scale(spark, d):
    return derived.obs_500m(spark, d).select(
        *_KEY,
        F.round(quality.scaled(F.col("r1"), _C), 6).alias("b01"),
        F.round(quality.scaled(F.col("r7"), _C), 6).alias("b07"),
    )


@query(
    "o_b6_valid_range",
    sql_over(
        "obs",
        f"""SELECT {_KEYS}, round(CASE WHEN r1 * 1e-4 BETWEEN -100 AND 16000 THEN r1 * 1e-4 END, 6) AS on_scaled,
  round(CASE WHEN r1 BETWEEN 0 AND 12000 THEN r1 * 1e-4 END, 6) AS on_raw FROM obs""",
    ),
)
def valid_range(spark, d):
    r1 = F.col("r1")
    return derived.obs_500m(spark, d).select(
        *_KEY,
        F.round(F.when(quality.in_range(r1, _C), quality.scaled(r1, _C)), 6).alias("on_scaled"),
        F.round(F.when(quality.in_range(r1, _RAW), quality.scaled(r1, _RAW)), 6).alias("on_raw"),
    )


@query("o_b7_clean_bands", sql_over("obs", f"SELECT {_KEYS}, {_BAND_SQL} FROM obs"))
def clean_bands(spark, d):
    cleaned = ops.clean_bands(derived.obs_500m(spark, d).drop("h", "p", "state"), _C)
    return cleaned.select(*_KEY, *_rounded())


@query(
    "o_b8_upsample_mask",
    sql_over(
        "obs coarse",
        """SELECT o.tile, o.date, o.row, o.col, CAST(coalesce(usability, 255) AS SMALLINT) AS usability
  FROM obs o LEFT JOIN codes c ON o.tile = c.tile AND o.date = c.date AND o.row // 2 = c.row AND o.col // 2 = c.col""",
        codes=_CODES,
    ),
)
def upsample_mask(spark, d):
    fine = derived.obs_500m(spark, d).select(*_KEY)
    return ops.upsample_mask(fine, derived.obs_1km(spark, d), _C)


@query(
    "o_b9_band_stack",
    sql_over(
        "cube",
        "SELECT t, y, x, band, round(value, 6) AS value FROM ("
        + " UNION ALL ".join(f"SELECT t, y, x, 'b0{b}' AS band, b0{b} AS value FROM cube" for b in range(1, 8))
        + " UNION ALL SELECT t, y, x, 'usability', CAST(usability AS DOUBLE) FROM cube)",
    ),
)
def band_stack(spark, d):
    long = ops.to_long(derived.cube(spark, d), [*BANDS, "usability"], ["t", "y", "x"])
    return long.withColumn("value", F.round("value", 6))


@query(
    "o_b10_process_tiles",
    sql_over(
        "obs coarse",
        f"""SELECT o.tile, o.date, o.row, o.col, {_BAND_SQL},
  CAST(coalesce(usability, 255) AS SMALLINT) AS usability
  FROM obs o JOIN quality q ON o.tile = q.tile AND o.date = q.date AND q >= 0.75e0
  LEFT JOIN codes c ON o.tile = c.tile AND o.date = c.date AND o.row // 2 = c.row AND o.col // 2 = c.col""",
        quality=_QUALITY,
        codes=_CODES,
    ),
)
def process_tiles(spark, d):
    tiles = ops.process_tiles(derived.obs_500m(spark, d), derived.obs_1km(spark, d), _C)
    return tiles.select(*_KEY, *_rounded(), "usability")


@query("o_b11_mosaic_days", sql_over("obs", "SELECT date FROM days", quality=_QUALITY, days=_DAYS))
def mosaic_days(spark, d):
    return ops.mosaic_days(derived.obs_500m(spark, d), _C)


@query("o_b12_time_index", sql_over("obs", "SELECT t, date FROM days", quality=_QUALITY, days=_DAYS))
def time_index(spark, d):
    return ops.time_index(ops.mosaic_days(derived.obs_500m(spark, d), _C))


@query("o_b12_build_cube", sql_over("obs coarse", _CUBE_SQL, **_CUBE_WITH))
def build_cube(spark, d):
    return _built(spark, d).select("t", "date", "y", "x", *_rounded(), "usability")


@query(
    "o_b12_build_chunks",
    sql_over(
        "obs coarse",
        "SELECT *, CAST(y // 1024 AS INT) AS cy, CAST(x // 1024 AS INT) AS cx FROM (" + _CUBE_SQL + ")",
        **_CUBE_WITH,
    ),
)
def build_chunks(spark, d):
    """Built and written with one movement of the cells, then read back."""
    path = workspace.new_path(spark, "cube")
    built = ops.build_chunks(derived.obs_500m(spark, d), derived.obs_1km(spark, d), _C)
    tables.write_cube(built, path, patch=_C.patch, chunk=_C.chunk, placed=True)
    return tables.read_cube(spark, path).select("t", "date", "y", "x", *_rounded(), "usability", "cy", "cx")


@query(
    "o_b7_fill_words",
    sql_over(
        "obs",
        f"SELECT {_KEYS}, " + ", ".join(f"round(CASE WHEN r{b} <> -28672 AND qc <> 787410671 THEN {clean(b)} END, 6) AS b0{b}" for b in range(1, 8)) + " FROM obs",
    ),
)
def fill_words(spark, d):
    """Cleaned bands where the products' fill words are no observations."""
    c = replace(_C, reflectance_fill=REFLECTANCE_FILL, qc_fill=QC_FILL)
    cleaned = ops.clean_bands(derived.obs_500m(spark, d).drop("h", "p", "state"), c)
    return cleaned.select(*_KEY, *_rounded())


@query(
    "o_b13_densify",
    sql_over("dense", "SELECT t, y, x, round(b01, 6) AS b01, round(b06, 6) AS b06, usability FROM dense"),
)
def densify(spark, d):
    height, width = derived.grid_shape(spark, d)
    dense = ops.densify(derived.cube(spark, d), height, width, derived.FRAMES)
    return dense.select("t", "y", "x", F.round("b01", 6).alias("b01"), F.round("b06", 6).alias("b06"), "usability")


_FIXED_ATTRS = [
    ("global", "Conventions", "CF-1.11"),
    ("global", "usability_mask_key", MASK_LEGEND),
    ("time", "standard_name", "time"),
    ("y", "standard_name", "projection_y_coordinate"),
    ("y", "units", "m"),
    ("x", "standard_name", "projection_x_coordinate"),
    ("x", "units", "m"),
    ("band", "band_names", ", ".join([*BAND_NAMES, "Usability Mask"])),
    ("band", "band_wavelengths_nm", ", ".join([f"{w} nm" for w in BAND_WAVELENGTHS_NM] + ["N/A"])),
    ("reflectance_and_mask", "units", "1"),
    ("reflectance_and_mask", "grid_mapping", "sinusoidal"),
]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(
    "o_b14_attributes",
    sql_over(
        "obs",
        f"""SELECT 'global' AS scope, 'included_days' AS key, string_agg(strftime(date, '%Y%j'), ',' ORDER BY date) AS value FROM days
  UNION ALL SELECT 'global', 'total_days_processed', CAST(count(*) AS VARCHAR) FROM days
  UNION ALL SELECT 'global', 'source_tiles', string_agg(DISTINCT tile, ',' ORDER BY tile) FROM obs
  UNION ALL SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_text, row)) + ")" for row in _FIXED_ATTRS)})""",
        quality=_QUALITY,
        days=_DAYS,
    ),
)
def attributes(spark, d):
    obs = derived.obs_500m(spark, d)
    return ops.cube_attrs(ops.mosaic_days(obs, _C), obs, _C).select("scope", "key", "value")


@query(
    "o_b14_column_metadata",
    sql_over(
        "cube",
        " UNION ALL ".join(
            f"SELECT 'b0{b}' AS name, 'long_name=' || {_text(BAND_NAMES[b - 1])} || ';units=1;wavelength_nm=' || {_text(BAND_WAVELENGTHS_NM[b - 1])} AS metadata, count(b0{b}) AS n FROM cube"
            for b in range(1, 8)
        )
        + f" UNION ALL SELECT 'usability', 'usability_mask_key=' || {_text(MASK_LEGEND)}, count(usability) FROM cube",
    ),
)
def column_metadata(spark, d):
    """Metadata of the columns of a stored cube, beside the number of their values."""
    path = workspace.new_path(spark, "cube")
    tables.write_cube(ops.with_band_metadata(derived.cube(spark, d), _C), path, patch=8, chunk=32)
    stored = tables.read_cube(spark, path)
    columns = [*BANDS, "usability"]
    told = {b: ";".join(f"{k}={v}" for k, v in sorted(stored.schema[b].metadata.items())) for b in columns}
    counted = stored.agg(*[F.count(b).alias(b) for b in columns]).unpivot([], columns, "name", "n")
    known = F.create_map(*[F.lit(v) for pair in told.items() for v in pair])
    return counted.select("name", F.element_at(known, F.col("name")).alias("metadata"), "n")


@query(
    "o_b15_chunked_sink",
    sql_over(
        "cube",
        "SELECT t, y, x, y // 32 AS cy, x // 32 AS cx, round(b01, 6) AS b01, usability FROM cube",
    ),
)
def chunked_sink(spark, d):
    path = workspace.new_path(spark, "cube")
    tables.write_cube(derived.cube(spark, d), path, patch=8, chunk=32)
    return tables.read_cube(spark, path).select("t", "y", "x", "cy", "cx", F.round("b01", 6).alias("b01"), "usability")


@query(
    "o_b16_compressed_sink",
    sql_over("cube", "SELECT t, y, x, round(b02, 6) AS b02, usability FROM cube WHERE y >= 8 AND y < 30 AND x < 20"),
)
def compressed_sink(spark, d):
    path = workspace.new_path(spark, "cube-orc")
    tables.write_cube(derived.cube(spark, d), path, patch=8, chunk=32, fmt="orc", compression="zlib")
    boxed = tables.read_cube(spark, path, box=(8, 0, 30, 20), patch=8, chunk=32, fmt="orc")
    return boxed.select("t", "y", "x", F.round("b02", 6).alias("b02"), "usability")


@query(
    "o_b17_cube_stats",
    sql_over(
        "obs",
        "SELECT count(*) AS complete_mosaics, count(*) AS days_in_cube FROM days",
        quality=_QUALITY,
        days=_DAYS,
    ),
)
def cube_stats(spark, d):
    return ops.cube_stats(_built(spark, d))


@query(
    "o_a16_cube_scan",
    sql_over(
        "cube",
        """SELECT t, y // 8 * 8 AS y_coord, x // 8 * 8 AS x_coord, count(b03) AS n, round(avg(b03) + 1e-9, 6) AS b03
  FROM cube GROUP BY ALL""",
    ),
)
def cube_scan(spark, d):
    path = workspace.new_path(spark, "cube")
    tables.write_cube(derived.cube(spark, d), path, patch=8, chunk=32)
    cells = tables.read_cube(spark, path)
    return cells.groupBy(
        "t", (F.col("py") * 8).alias("y_coord"), (F.col("px") * 8).alias("x_coord")
    ).agg(F.count("b03").alias("n"), r6(F.avg("b03"), "b03"))


@query(
    "o_a18_reuse",
    sql_over("landcover", "SELECT y, x, lc FROM landcover"),
)
def reuse(spark, d):
    path = workspace.new_path(spark, "landcover-map")
    workspace.materialize(derived.landcover(spark, d), path)
    # the second call finds the finished result and does not compute it again
    return workspace.materialize(derived.landcover(spark, d).filter("false"), path)


@query("o_a18_stale_result", sql_over("landcover", "SELECT y, x, lc FROM landcover"))
def stale_result(spark, d):
    """A result whose input has changed since is made anew."""
    source, path = workspace.new_path(spark, "landcover-source"), workspace.new_path(spark, "landcover-map")
    whole = derived.landcover(spark, d)
    for rows in (whole.filter("lc <= 40"), whole):
        rows.write.mode("overwrite").parquet(source)
        found = workspace.reuse(spark.read.parquet(source), path, [source])
    return found
