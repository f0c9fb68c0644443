import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import encoding
from gridloom.operators import tokens

SIZE, TOKEN, BANDS = (4, 6, 8), (2, 3, 4), ["b01", "b02"]


@pytest.fixture(scope="module")
def block():
    return np.random.default_rng(0).random((2, *SIZE))


def _cells(spark, block):
    rows = [(7, t, y, x, *map(float, block[:, t, y, x])) for t, y, x in np.ndindex(*SIZE)]
    return spark.createDataFrame(rows, "s INT, lt INT, ly INT, lx INT, b01 DOUBLE, b02 DOUBLE")


def _tokens(block):
    """Axis order (t h w) by (s p q c)."""
    v = block.reshape(2, 2, 2, 2, 3, 2, 4)  # c, t, s, h, p, w, q
    return v.transpose(1, 3, 5, 2, 4, 6, 0).reshape(8, 48)


def test_patchify_and_back(spark, block):
    table = tokens.patchify(_cells(spark, block), ["s"], BANDS, SIZE, TOKEN)
    got = np.array([r["values"] for r in table.orderBy("token").collect()])
    np.testing.assert_allclose(got, _tokens(block))
    back = np.full(block.shape, np.nan)
    for r in tokens.unpatchify(table, ["s"], BANDS, SIZE, TOKEN).collect():
        back[:, r["lt"], r["ly"], r["lx"]] = r["b01"], r["b02"]
    np.testing.assert_allclose(back, block)


def test_masking_keeps_the_least_noise_and_restore_puts_the_rest_back(spark):
    noise = [0.5, 0.1, 0.9, 0.3, 0.7, 0.2]
    rows = [(s, i, n, [float(i)]) for s in (0, 1) for i, n in enumerate(noise)]
    df = spark.createDataFrame(rows, "s INT, token INT, noise DOUBLE, values ARRAY<DOUBLE>")
    masked = tokens.random_mask(df, ["s"], 6, 0.6, F.col("noise"))
    got = {r.token: (r.shuffled_at, r.mask) for r in masked.filter("s = 1").collect()}
    order = list(np.argsort(noise))
    keep = int(6 * (1 - 0.6))
    assert got == {i: (order.index(i), int(order.index(i) >= keep)) for i in range(6)}
    whole = tokens.restore(masked, masked.filter("mask = 0"), ["s"], [-1.0]).filter("s = 0").orderBy("token")
    assert [r["values"] for r in whole.collect()] == [[-1.0], [1.0], [-1.0], [-1.0], [-1.0], [5.0]]
    assert masked.groupBy("s").agg(F.sum("mask").alias("m")).select("m").distinct().collect()[0].m == 6 - keep


def test_seeded_mask_does_not_depend_on_partitions(spark):
    df = spark.range(600).select((F.col("id") % 5).alias("s"), F.col("id").cast("int").alias("token"))
    a, b = (sorted(map(tuple, tokens.random_mask(df.repartition(n), ["s"], 120).collect())) for n in (1, 6))
    assert a == b and sum(r[-1] == 0 for r in a) == 5 * 30


def test_standardise(spark, block):
    table = tokens.standardise(tokens.patchify(_cells(spark, block), ["s"], BANDS, SIZE, TOKEN))
    got = np.array([r["values"] for r in table.orderBy("token").collect()])
    v = _tokens(block)
    want = (v - v.mean(1, keepdims=True)) / np.sqrt(v.var(1, ddof=1, keepdims=True) + 1e-6)
    np.testing.assert_allclose(got, want)


def test_reconstruction_loss_counts_removed_tokens_only(spark):
    rows = [(0, [1.0, 1.0], [2.0, 1.0], 1), (1, [0.0, 0.0], [3.0, 3.0], 0), (2, [0.0, 0.0], [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "token INT, values ARRAY<DOUBLE>, pred ARRAY<DOUBLE>, mask INT")
    assert tokens.reconstruction_loss(df).first().loss == pytest.approx((0.5 + 4.0) / 2)
    assert tokens.reconstruction_loss(df.withColumn("mask", F.lit(0))).first().loss is None


def _sincos(dim, pos):
    omega = 1 / 10000 ** (np.arange(dim // 2) / (dim / 2))
    out = np.outer(pos, omega)
    return np.concatenate([np.sin(out), np.cos(out)], axis=1)


def test_position_codes(spark):
    t, h, w, dim = 2, 3, 4, 32
    df = spark.range(t * h * w + 1).select(F.col("id").cast("int").alias("token"))
    got = [r.position for r in tokens.with_position_code(df, (t, h, w), dim, class_token=True).orderBy("token").collect()]
    want = [np.zeros(dim)]
    for a, b, c in np.ndindex(t, h, w):
        want.append(np.concatenate([_sincos(12, [c])[0], _sincos(12, [b])[0], _sincos(8, [a])[0]]))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_date_and_location_codes(spark):
    df = spark.sql("SELECT DATE'2024-06-23' AS date, 46.1D AS lat, 11.2D AS lon")
    row = tokens.with_date_location_code(df, 8, scale=0.1).first()
    np.testing.assert_allclose(row.date_code, 0.1 * np.r_[_sincos(4, [2024])[0], _sincos(4, [175])[0]], atol=1e-12)
    np.testing.assert_allclose(row.location_code, 0.1 * np.r_[_sincos(4, [46.1])[0], _sincos(4, [11.2])[0]], atol=1e-12)


def test_dimensions_are_checked():
    with pytest.raises(ValueError):
        encoding.sincos(F.lit(1), 3)
    with pytest.raises(ValueError):
        encoding.sincos_3d(F.lit(1), F.lit(1), F.lit(1), 24)
