"""Token-level preparation: patchify, random masking, standardisation, position codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.encoding import date_encoding, location_encoding, sincos_3d
from gridloom.operators.ranking import digest


def patchify(
    cells: DataFrame, keys: list[str], bands: list[str], size: tuple[int, int, int],
    token: tuple[int, int, int],
) -> DataFrame:
    """One row per sample and token: values in (frame, row, column, band) order.

    ``cells`` carry local coordinates ``lt``, ``ly``, ``lx`` inside a block of
    ``size`` (frames, rows, columns), dense; ``token`` is the token's shape. A
    group is one token, so it holds frames x rows x columns of the token.
    """
    (_, height, width), (s, p, q) = size, token
    at_token = f"(lt div {s} * {height // p} + ly div {p}) * {width // q} + lx div {q}"
    at_cell = f"(lt % {s} * {p} + ly % {p}) * {q} + lx % {q}"
    whole = cells.filter(
        (F.col("lt") < size[0] // s * s)
        & (F.col("ly") < height // p * p)
        & (F.col("lx") < width // q * q)
    )
    entry = F.struct(
        F.expr(at_cell).cast("int").alias("pos"),
        F.array(*[F.col(b).cast("double") for b in bands]).alias("v"),
    )
    grouped = whole.groupBy(*keys, F.expr(at_token).cast("int").alias("token")).agg(
        F.array_sort(F.collect_list(entry)).alias("_c")
    )
    values = F.flatten(F.transform("_c", lambda e: e["v"]))
    return grouped.select(*keys, "token", values.alias("values"))


def unpatchify(
    tokens: DataFrame, keys: list[str], bands: list[str], size: tuple[int, int, int],
    token: tuple[int, int, int], column: str = "values",
) -> DataFrame:
    """Cells with local coordinates and bands as columns: the inverse of ``patchify``."""
    (_, height, width), (s, p, q) = size, token
    n, nh, nw = len(bands), height // p, width // q
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(s * p * q - 1)),
        lambda i: F.slice(F.col(column), i * n + 1, F.lit(n)),
    )
    flat = tokens.select(*keys, "token", F.posexplode(cells).alias("pos", "v"))
    return flat.select(
        *keys,
        F.expr(f"token div {nh * nw} * {s} + pos div {p * q}").cast("int").alias("lt"),
        F.expr(f"token div {nw} % {nh} * {p} + pos div {q} % {p}").cast("int").alias("ly"),
        F.expr(f"token % {nw} * {q} + pos % {q}").cast("int").alias("lx"),
        *[F.col("v")[i].alias(b) for i, b in enumerate(bands)],
    )


def random_mask(
    tokens: DataFrame, keys: list[str], length: int, ratio: float = 0.75, noise: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mark tokens kept (0) or removed (1); the ``int(length * (1 - ratio))`` least noisy stay.

    ``shuffled_at`` is a token's place in noise order. A group is one sample of
    ``length`` tokens. Without a noise column a seeded hash is used.
    """
    if noise is None:
        noise = seeded_noise([*keys, "token"], seed)
    keep = int(length * (1 - ratio))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_noise", "token")) - 1
    ranked = tokens.withColumn("_noise", noise).withColumn("shuffled_at", place)
    return ranked.withColumn("mask", (F.col("shuffled_at") >= keep).cast("int")).drop("_noise")


def seeded_noise(columns: list[str], seed: int = 42) -> Column:
    """Reproducible noise from any columns, for ``random_mask``."""
    return digest("mask", columns, seed)


def restore(
    positions: DataFrame, kept: DataFrame, keys: list[str], mask_token: list[float],
    column: str = "values",
) -> DataFrame:
    """Every position in its place again, the removed ones filled with the mask token.

    ``positions`` is the masked table (or its key columns), ``kept`` the tokens
    that went through a model.
    """
    fill = F.array(*[F.lit(float(v)) for v in mask_token])
    at = [*keys, "token"]
    joined = positions.select(*at).join(kept.select(*at, column), at, "left")
    return joined.withColumn(column, F.coalesce(column, fill))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def standardise(tokens: DataFrame, column: str = "values", epsilon: float = 1e-6) -> DataFrame:
    """Each token to zero mean and unit sample variance, inside the row.

    Sum and squared deviations are lambda variables of the finishing steps, so
    each is computed once per token and not again for every element.
    """
    values, n = F.col(column), F.size(column)

    def with_sum(total: Column) -> Column:
        mean = total / n

        def with_squares(squares: Column) -> Column:
            spread = F.sqrt(F.try_divide(squares, n - 1) + F.lit(epsilon))
            return F.transform(values, lambda v: (v - mean) / spread)

        return F.aggregate(
            values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean), with_squares
        )

    scaled = F.aggregate(values, F.lit(0.0), lambda a, v: a + v, with_sum)
    return tokens.withColumn(column, scaled)


def token_loss(df: DataFrame, target: str = "values", pred: str = "pred") -> DataFrame:
    """Mean squared error of each token."""
    squares = F.zip_with(pred, target, lambda a, b: (a - b) * (a - b))
    return df.withColumn("loss", _sum(squares) / F.size(target))


def reconstruction_loss(
    df: DataFrame, target: str = "values", pred: str = "pred", by: list[str] = ()
) -> DataFrame:
    """Mean token error over the removed tokens; NULL when none is removed."""
    per_token = token_loss(df, target, pred)
    weighted = F.try_divide(F.sum(F.col("loss") * F.col("mask")), F.sum("mask"))
    return per_token.groupBy(*by).agg(weighted.alias("loss"))


def with_position_code(
    tokens: DataFrame, grid: tuple[int, int, int], dim: int, class_token: bool = False,
    column: str = "token",
) -> DataFrame:
    """Sine/cosine code of each token's place on a (frames, rows, columns) grid.

    With ``class_token`` the numbering is shifted by one and place 0 has zeros.
    """
    _, h, w = grid
    place = F.col(column) - int(class_token)
    code = sincos_3d(
        F.floor(place / F.lit(h * w)), F.floor(place / F.lit(w)) % h, F.pmod(place, F.lit(w)), dim
    )
    if class_token:
        code = F.when(place < 0, F.array_repeat(F.lit(0.0), dim)).otherwise(code)
    return tokens.withColumn("position", code)


def with_date_location_code(df: DataFrame, dim: int, scale: float = 1.0) -> DataFrame:
    """Codes of the columns ``date`` and ``lat``/``lon``, half the dimensions each part."""
    return df.withColumns(
        {
            "date_code": date_encoding(F.col("date"), dim, scale),
            "location_code": location_encoding(F.col("lat"), F.col("lon"), dim, scale),
        }
    )
