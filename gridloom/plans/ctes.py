"""The derived tables once more, as SQL common table expressions for the checks."""

from __future__ import annotations

_HASH = "((l_partkey % 1000003) * 2654435761 + l_orderkey * 40503 + l_linenumber * 97) % 2147483647"
_Y = "CAST((l_orderkey // 2048) * 8 + l_partkey % 8 AS INT)"
_X = "CAST((l_suppkey * 7 + l_orderkey) % 64 AS INT)"
_BANDS = [
    (1, 997, 400, 97),
    (2, 1994, 700, 89),
    (3, 2991, 500, 83),
    (4, 3988, 600, 79),
    (5, 4985, 800, 73),
    (6, 5982, 900, 71),
    (7, 6979, 1000, 67),
]
_WORDS = (
    """CAST(CASE WHEN h % 100 < 75 THEN 0 WHEN h % 100 < 85 THEN 1
    WHEN h % 100 = 99 THEN 65535 ELSE (h >> 8) % 16384 END AS INT) AS state,
  CAST(CASE WHEN h % 10 < 8 THEN 0 ELSE h % 1073741824 END AS BIGINT) AS qc,
  """
    + ",\n  ".join(
        f"CAST(CASE WHEN h % {fill} = 0 THEN -28672 ELSE (p + {off} + h % {per}) % 16001 - 100 END AS INT) AS r{b}"
        for b, off, per, fill in _BANDS
    )
)
USABILITY = """CAST(CASE WHEN state = 65535 THEN 255
    WHEN (state & 3) IN (1, 2) THEN 4
    WHEN ((state >> 13) & 1) = 1 OR ((state >> 8) & 3) <> 0 THEN 3
    WHEN ((state >> 6) & 3) = 3 THEN 2
    WHEN ((state >> 2) & 1) = 1 THEN 1 ELSE 0 END AS SMALLINT)"""


def mixed(purpose: str, cols: str, epoch: str = "0", seed: int = 42) -> str:
    """Seeded digest of columns, as ``ranking.digest`` makes it."""
    values = ", ".join(f"coalesce(CAST({c.strip()} AS VARCHAR), '')" for c in cols.split(","))
    return f"md5(concat_ws('|', '{purpose}', '{seed}', CAST({epoch} AS VARCHAR), {values}))"


def drawn(digest: str, part: int, n: int) -> str:
    return f"(CAST('0x' || substr({digest}, {1 + 7 * part}, 7) AS BIGINT) % {n})"


def r6(expr: str) -> str:
    """Six decimals; the nudge keeps short decimal fractions off the rounding edge."""
    return f"round({expr} + 1e-9, 6)"


def clean(b: int) -> str:
    return (
        f"CASE WHEN r{b} * 1e-4 BETWEEN -100 AND 16000 AND ((qc >> {2 + 4 * (b - 1)}) & 15) = 0 "
        f"THEN r{b} * 1e-4 END"
    )


_MODELS = "(SELECT 'a' AS model, 1 AS k UNION ALL SELECT 'b', 5)"

CTES: dict[str, tuple[list[str], str]] = {
    "pix": (
        [],
        f"""SELECT t, y, x, h, p, {_WORDS} FROM (
  SELECT CAST(month(l_shipdate) - 1 AS INT) AS t, {_Y} AS y, {_X} AS x, max({_HASH}) AS h,
    max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS p FROM lineitem GROUP BY 1, 2, 3)""",
    ),
    "cube": (
        ["pix"],
        "SELECT t, y, x, "
        + ", ".join(f"{clean(b)} AS b0{b}" for b in range(1, 8))
        + f", {USABILITY} AS usability FROM pix",
    ),
    "shape": ([], "SELECT CAST((max(l_orderkey) // 2048 + 1) * 8 AS INT) AS h, 64 AS w FROM lineitem"),
    "slots": (
        ["shape"],
        """SELECT CAST(t AS INT) AS t, CAST(y AS INT) AS y, CAST(x AS INT) AS x
  FROM (SELECT unnest(range(h)) AS y FROM shape), (SELECT unnest(range(64)) AS x), (SELECT unnest(range(12)) AS t)""",
    ),
    "dense": (
        ["slots", "cube"],
        "SELECT s.t, s.y, s.x, "
        + ", ".join(f"b0{b}" for b in range(1, 8))
        + """, CAST(coalesce(usability, 255) AS SMALLINT) AS usability
  FROM slots s LEFT JOIN cube c ON s.t = c.t AND s.y = c.y AND s.x = c.x""",
    ),
    "landcover": (
        ["pix"],
        """SELECT DISTINCT y, x,
  CAST(10 * (1 + ((y >> 2) * 7 + (x >> 2) * 3 + (x % 5) % 2) % 8) AS SMALLINT) AS lc FROM pix""",
    ),
    "granules": (
        [],
        """SELECT pos, size, CASE WHEN pos % 97 = 0 THEN 'README_' || CAST(pos AS VARCHAR) ELSE
  'MOD09GA.A' || CAST(year(d) AS VARCHAR) || lpad(CAST(dayofyear(d) AS VARCHAR), 3, '0') || '.h' ||
  CAST(18 + pos % 2 AS VARCHAR) || 'v0' || CAST(3 + cust % 2 AS VARCHAR) || '.061.' ||
  lpad(CAST(pos AS VARCHAR), 13, '0') || '.hdf' END AS name
  FROM (SELECT o_orderkey AS pos, o_custkey AS cust, o_orderkey % 50 AS size,
    DATE '1995-01-01' + CAST((o_orderkey // 5) % 20000 AS INT) AS d FROM orders)""",
    ),
    "parsed": (
        ["granules"],
        """SELECT pos, name, size, split_part(name, '.', 1) AS product,
  CAST(substr(split_part(name, '.', 2), 2, 4) AS INT) AS year,
  CAST(substr(split_part(name, '.', 2), 6, 3) AS INT) AS doy, split_part(name, '.', 3) AS tile,
  make_date(CAST(substr(split_part(name, '.', 2), 2, 4) AS INT), 1, 1)
    + CAST(substr(split_part(name, '.', 2), 6, 3) AS INT) - 1 AS date
  FROM granules WHERE name LIKE '%.%.%'""",
    ),
    "obs": (
        [],
        f"""SELECT tile, date, row, col, h, p, {_WORDS} FROM (
  SELECT 'h' || CAST(18 + l_orderkey % 2 AS VARCHAR) || 'v0' || CAST(3 + l_partkey % 2 AS VARCHAR) AS tile,
    CAST(l_shipdate AS DATE) AS date, CAST(l_orderkey % 2400 AS INT) AS row,
    CAST(l_partkey % 2400 AS INT) AS col, max({_HASH}) AS h,
    max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS p FROM lineitem GROUP BY 1, 2, 3, 4)""",
    ),
    "coarse": (
        ["obs"],
        """SELECT * FROM (SELECT tile, date, row // 2 AS row, col // 2 AS col, max(state) AS state
  FROM obs GROUP BY 1, 2, 3, 4) WHERE row % 11 <> 0""",
    ),
    "lctiles": (
        [],
        """SELECT CAST(o_orderkey % 3 AS INT) AS tile_order,
  CAST(39 + 3 * ((o_orderkey // 12) % 8) AS INT) AS tile_lat, CAST(3 * (o_custkey % 20) AS INT) AS tile_lon,
  CAST(o_orderkey % 6 AS INT) AS src_row, CAST((o_custkey // 20) % 6 AS INT) AS src_col,
  max(CAST(10 * ((o_orderkey + o_custkey) % 9) AS INT)) AS lc FROM orders GROUP BY 1, 2, 3, 4, 5""",
    ),
    "pmetrics": (
        [],
        """SELECT model, y_coord, x_coord, t_start, 1e-2 + (a % 500) / 5e3 AS rmse,
  20e0 * log10(1e0 / (1e-2 + (a % 500) / 5e3)) AS psnr, 1e0 - (b % 300) / 1e3 AS ssim, (c % 700) / 2e3 AS sam
  FROM (SELECT 'm' || CAST(l_linenumber % 3 AS VARCHAR) AS model, CAST(8 * (l_orderkey // 2048) AS INT) AS y_coord,
    CAST(8 * (((l_suppkey * 7 + l_orderkey) % 64) // 8) AS INT) AS x_coord,
    CAST(4 * (l_suppkey % 3) AS INT) AS t_start, CAST(sum(l_partkey) AS BIGINT) AS a,
    CAST(sum(l_suppkey + l_linenumber) AS BIGINT) AS b, CAST(sum(l_linenumber * 31 + l_partkey) AS BIGINT) AS c
    FROM lineitem GROUP BY 1, 2, 3, 4)""",
    ),
    "pdiff": (
        [],
        """SELECT y_coord, x_coord, heterogeneity, phenology_variability, cloud_persistence,
  heterogeneity * 0.165e0 + phenology_variability * 5.5e0 + cloud_persistence * 0.66e0 AS difficulty_index
  FROM (SELECT y_coord, x_coord, (a % 20) / 1e1 AS heterogeneity, (b % 7) / 1e2 AS phenology_variability,
    CASE WHEN n % 3 = 0 THEN 0e0 ELSE (n % 40) / 8e1 END AS cloud_persistence
    FROM (SELECT CAST(8 * (l_orderkey // 2048) AS INT) AS y_coord,
      CAST(8 * (((l_suppkey * 7 + l_orderkey) % 64) // 8) AS INT) AS x_coord, CAST(sum(l_partkey) AS BIGINT) AS a,
      CAST(sum(l_suppkey) AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2))""",
    ),
    "runs": (
        [],
        """SELECT event_type AS model, CAST(8 * power(2, user_id % 5) AS INT) AS gpus,
  CAST(event_id % 5 AS INT) AS repeat_id, 1 + event_id % 60 AS samples, abs(value) + 1e-1 AS elapsed FROM events""",
    ),
    "preds": (
        ["pix"],
        "SELECT model, CAST(y // 8 * 8 AS INT) AS y_coord, CAST(x // 8 * 8 AS INT) AS x_coord, t, y, x, "
        + ", ".join(
            f"CASE WHEN r{b} > -28672 THEN (r{b} + 100) / 161e2 ELSE 0e0 END AS t{b}, "
            f"CASE WHEN r{b} > -28672 THEN (r{b} + 100) / 161e2 + ((h * k + {b}) % 21 - 10) / 1e3 ELSE 0e0 END AS p{b}, "
            f"(state = 0 AND r{b} > -28672) AS v{b}"
            for b in range(1, 7)
        )
        + f" FROM pix CROSS JOIN {_MODELS} m",
    ),
}


def sql_over(names: str, body: str, once: str = "", **extra: str) -> str:
    """``body`` behind the named derived tables (space separated) and their inputs.

    ``extra`` adds further expressions, in the order given; those named in ``once`` are computed once.
    """
    order: list[str] = []

    def visit(name: str):
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in names.split():
        visit(name)
    kept = {n: "MATERIALIZED " for n in once.split()}
    whole = [(n, CTES[n][1]) for n in order] + list(extra.items())
    parts = [f"{n} AS {kept.get(n, '')}({q})" for n, q in whole]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
