"""Token preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import encoding
from gridloom.operators import tokens
from gridloom.plans import sample_queries as sq
from gridloom.plans.ctes import r6 as q6
from gridloom.plans.ctes import mixed, sql_over
from gridloom.plans.registry import query, r6
from gridloom.sources import derived

_K = ["y_coord", "x_coord", "t_start"]
_KS = ", ".join(_K)
_SIZE, _TOKEN, _BANDS, _LENGTH = (4, 8, 8), (2, 4, 4), ["b01", "b02"], 8

_BLOCKS = """SELECT CAST(y // 8 * 8 AS INT) AS y_coord, CAST(x // 8 * 8 AS INT) AS x_coord, CAST(t // 4 * 4 AS INT) AS t_start,
  t % 4 AS lt, y % 8 AS ly, x % 8 AS lx, coalesce(b01, 0) AS b01, coalesce(b02, 0) AS b02 FROM dense"""
_FLAT = " UNION ALL ".join(
    f"""SELECT {_KS}, CAST((lt // 2 * 2 + ly // 4) * 2 + lx // 4 AS INT) AS token,
  CAST(((lt % 2 * 4 + ly % 4) * 4 + lx % 4) * 2 + {i} AS INT) AS pos, {b} AS v FROM blocks"""
    for i, b in enumerate(_BANDS)
)
_NOISE = mixed("mask", "y_coord, x_coord, t_start, token")
_MASKED = f"""SELECT {_KS}, token, row_number() OVER (PARTITION BY {_KS} ORDER BY {_NOISE}, token) - 1 AS place
  FROM (SELECT DISTINCT {_KS}, token FROM flat)"""
_W = {"blocks": _BLOCKS, "flat": _FLAT}


def blocks(spark, d):
    return sq.dense(spark, d).select(
        F.expr("CAST(y div 8 * 8 AS INT)").alias("y_coord"),
        F.expr("CAST(x div 8 * 8 AS INT)").alias("x_coord"),
        F.expr("CAST(t div 4 * 4 AS INT)").alias("t_start"),
        F.expr("t % 4").alias("lt"),
        F.expr("y % 8").alias("ly"),
        F.expr("x % 8").alias("lx"),
        *[F.coalesce(b, F.lit(0.0)).alias(b) for b in _BANDS],
    )


def token_table(spark, d):
    return tokens.patchify(blocks(spark, d), _K, _BANDS, _SIZE, _TOKEN)


def masked(spark, d):
    noise = tokens.seeded_noise(["y_coord", "x_coord", "t_start", "token"])
    return tokens.random_mask(token_table(spark, d), _K, _LENGTH, 0.75, noise)


def _flat(df, column="values"):
    return df.select(*_K, "token", F.posexplode(column).alias("pos", "v"))


@query("o_g1_patchify", sql_over("dense", f"SELECT {_KS}, token, pos, round(v, 6) AS v FROM flat", **_W))
def patchify(spark, d):
    return _flat(token_table(spark, d)).withColumn("v", F.round("v", 6))


@query(
    "o_g2_unpatchify",
    sql_over("dense", f"SELECT {_KS}, lt, ly, lx, round(b01, 6) AS b01, round(b02, 6) AS b02 FROM blocks", blocks=_BLOCKS),
)
def unpatchify(spark, d):
    back = tokens.unpatchify(token_table(spark, d), _K, _BANDS, _SIZE, _TOKEN)
    return back.select(*_K, "lt", "ly", "lx", F.round("b01", 6).alias("b01"), F.round("b02", 6).alias("b02"))


@query(
    "o_g3_random_mask",
    sql_over(
        "dense",
        f"SELECT {_KS}, token, CAST(place AS INT) AS shuffled_at, CASE WHEN place >= 2 THEN 1 ELSE 0 END AS mask FROM masked",
        **_W,
        masked=_MASKED,
    ),
)
def random_mask(spark, d):
    return masked(spark, d).select(*_K, "token", "shuffled_at", "mask")


@query(
    "o_g3b_restore",
    sql_over(
        "dense",
        f"""SELECT f.y_coord, f.x_coord, f.t_start, f.token, f.pos, round(CASE WHEN place >= 2 THEN -1 ELSE v END, 6) AS v
  FROM flat f JOIN masked m ON f.y_coord = m.y_coord AND f.x_coord = m.x_coord AND f.t_start = m.t_start AND f.token = m.token""",
        **_W,
        masked=_MASKED,
    ),
)
def restore(spark, d):
    table = masked(spark, d)
    whole = tokens.restore(table, table.filter("mask = 0"), _K, [-1.0] * 64)
    return _flat(whole).withColumn("v", F.round("v", 6))


@query(
    "o_g4_standardise",
    sql_over(
        "dense",
        f"""SELECT {_KS}, token, pos, {q6(f"(v - avg(v) OVER w) / sqrt(var_samp(v) OVER w + 1e-6)")} AS v FROM flat
  WINDOW w AS (PARTITION BY {_KS}, token)""",
        **_W,
    ),
)
def standardise(spark, d):
    return _flat(tokens.standardise(token_table(spark, d))).withColumn("v", r6("v"))


_LOSS = f"""SELECT f.y_coord, f.x_coord, f.t_start, f.token, avg((v * 9e-1 + 1e-2 - v) ** 2) AS loss,
  any_value(CASE WHEN place >= 2 THEN 1 ELSE 0 END) AS mask
  FROM flat f JOIN masked m ON f.y_coord = m.y_coord AND f.x_coord = m.x_coord AND f.t_start = m.t_start AND f.token = m.token
  GROUP BY 1, 2, 3, 4"""


@query(
    "o_g5_reconstruction_loss",
    sql_over(
        "dense",
        f"SELECT {_KS}, round(sum(loss * mask) / sum(mask) + 1e-9, 6) AS loss FROM tl GROUP BY {_KS}",
        **_W,
        masked=_MASKED,
        tl=_LOSS,
    ),
)
def reconstruction_loss(spark, d):
    pred = F.transform("values", lambda v: v * 0.9 + 0.01)
    losses = tokens.reconstruction_loss(masked(spark, d).withColumn("pred", pred), by=_K)
    return losses.withColumn("loss", r6("loss"))


@query(
    "o_g6_sincos",
    """SELECT o_orderkey, CAST(i AS INT) AS pos, round(CASE WHEN i < 4 THEN sin(p / 10000e0 ** (i / 4e0))
    ELSE cos(p / 10000e0 ** ((i - 4) / 4e0)) END, 6) + 0e0 AS v
  FROM (SELECT o_orderkey, CAST(o_custkey % 512 AS DOUBLE) AS p FROM orders), (SELECT unnest(range(8)) AS i)""",
)
def sincos(spark, d):
    codes = derived.table(spark, d, "orders").select(
        "o_orderkey", encoding.sincos(F.col("o_custkey") % 512, 8).alias("code")
    )
    flat = codes.select("o_orderkey", F.posexplode("code").alias("pos", "v"))
    return flat.withColumn("v", F.round("v", 6) + F.lit(0.0))


_POSITION = """SELECT {k}, token, CAST(i AS INT) AS pos, round(CASE
    WHEN i < 6 THEN CASE WHEN i < 3 THEN sin(w / 10000e0 ** (i / 3e0)) ELSE cos(w / 10000e0 ** ((i - 3) / 3e0)) END
    WHEN i < 12 THEN CASE WHEN i < 9 THEN sin(h / 10000e0 ** ((i - 6) / 3e0)) ELSE cos(h / 10000e0 ** ((i - 9) / 3e0)) END
    ELSE CASE WHEN i < 14 THEN sin(t / 10000e0 ** ((i - 12) / 2e0)) ELSE cos(t / 10000e0 ** ((i - 14) / 2e0)) END END, 6) + 0e0 AS v
  FROM (SELECT DISTINCT {k}, token, token // 4 AS t, token // 2 % 2 AS h, token % 2 AS w FROM flat), (SELECT unnest(range(16)) AS i)"""


@query("o_g7_position_code", sql_over("dense", _POSITION.format(k=_KS), **_W))
def position_code(spark, d):
    placed = tokens.with_position_code(token_table(spark, d), (2, 2, 2), 16)
    return _flat(placed, "position").withColumn("v", F.round("v", 6) + F.lit(0.0))


def _code_sql(first, second, name):
    return f"""SELECT c_custkey, '{name}' AS code, CAST(i AS INT) AS pos, round(CASE WHEN i % 4 < 2
    THEN sin(p / 10000e0 ** (i % 2 / 2e0)) ELSE cos(p / 10000e0 ** (i % 2 / 2e0)) END, 6) + 0e0 AS v
  FROM (SELECT c_custkey, i, CASE WHEN i < 4 THEN {first} ELSE {second} END AS p FROM spots, (SELECT unnest(range(8)) AS i))"""


@query(
    "o_g8_date_location_code",
    sql_over(
        "",
        _code_sql("CAST(year(date) AS DOUBLE)", "CAST(dayofyear(date) AS DOUBLE)", "date")
        + " UNION ALL "
        + _code_sql("lat", "lon", "location"),
        spots="""SELECT c_custkey, DATE '2000-01-01' + CAST(c_custkey % 3000 AS INT) AS date,
  40e0 + (c_custkey % 200) / 1e1 AS lat, c_nationkey * 15e-1 AS lon FROM customer""",
    ),
)
def date_location_code(spark, d):
    spots = derived.table(spark, d, "customer").select(
        "c_custkey",
        F.expr("date_add(DATE'2000-01-01', CAST(c_custkey % 3000 AS INT))").alias("date"),
        (F.lit(40.0) + (F.col("c_custkey") % 200) / F.lit(10.0)).alias("lat"),
        (F.col("c_nationkey") * F.lit(1.5)).alias("lon"),
    )
    coded = tokens.with_date_location_code(spots, 8)
    both = F.create_map(F.lit("date"), F.col("date_code"), F.lit("location"), F.col("location_code"))
    long = coded.select("c_custkey", F.explode(both).alias("code", "values"))
    flat = long.select("c_custkey", "code", F.posexplode("values").alias("pos", "v"))
    return flat.withColumn("v", F.round("v", 6) + F.lit(0.0))
