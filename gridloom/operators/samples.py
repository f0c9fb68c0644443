"""Spatio-temporal samples: splits, windows, gates, gaps, masks, chips, batches.

A sample is (split, y_coord, x_coord, t_start). Gates work on one row per patch
and frame, so rejected samples never reach the cells. A sample cell is one row
with one array of T values per band: each cube row is shuffled once, by patch,
and the overlapping train windows are cut from the cell's series afterwards,
where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.config import DEFAULT_LEGEND, SampleConfig
from gridloom.functions.spectral import normalise, sanitise
from gridloom.operators.patches import patch_grid, with_patch
from gridloom.operators.ranking import digest, draw, hash_rank
from gridloom.schemas import SAMPLE_KEY

_PATCH = ["y_coord", "x_coord"]
_CELL = [*SAMPLE_KEY, "y", "x"]
#: Rows of a patch that lie together; a wider patch spreads over several tasks.
BLOCK_ROWS = 16


def block_count(patch: int) -> int:
    return -(-patch // BLOCK_ROWS)


def place_keys(cells: DataFrame) -> list[str]:
    """The columns by which the cells of ``series`` are placed: patch, and block of rows where patches have several."""
    return [*_PATCH, *(["_block"] if "_block" in cells.columns else [])]


def per_block(rows: DataFrame, cells: DataFrame, patch: int) -> DataFrame:
    """Rows of a small table by patch, repeated for each block so that they meet the ``cells`` where these lie."""
    if "_block" not in cells.columns:
        return rows
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(block_count(patch) - 1))))


def _label(rank: Column, n: Column, c: SampleConfig) -> Column:
    """First ``int(n * train)`` ranks, then ``int(n * val)``, then the rest."""
    train = F.floor(n * F.lit(c.train_split))
    val = train + F.floor(n * F.lit(c.val_split))
    return F.when(rank <= train, "train").when(rank <= val, "val").otherwise("test")


def spatial_split(patches: DataFrame, c: SampleConfig) -> DataFrame:
    """Patches in seeded order, cut into train, val and test: no patch is in two splits."""
    ranked = hash_rank(patches, _PATCH, c.seed, total="n", purpose="split")
    return ranked.select(_label(F.col("rank"), F.col("n"), c).alias("split"), *_PATCH)


def temporal_starts(split: DataFrame, times: int, c: SampleConfig) -> DataFrame:
    """Window starts per patch: every frame for train, every window length otherwise."""
    last = times - c.window
    if last < 0:
        return split.withColumn("t_start", F.lit(0)).filter("false")
    stride = F.when(F.col("split") == "train", 1).otherwise(c.window)
    return split.withColumn("t_start", F.explode(F.sequence(F.lit(0), F.lit(last), stride)))


def sample_split(patches: DataFrame, times: int, c: SampleConfig) -> DataFrame:
    """The older split on (patch, start) samples, offered for comparison.

    Each split enumerates with its own stride and takes its own part of its own
    list, so patches repeat across splits.
    """
    parts = []
    for name, stride in (("train", 1), ("val", c.window), ("test", c.window)):
        starts = F.explode(F.sequence(F.lit(0), F.lit(times - c.window), F.lit(stride)))
        ranked = hash_rank(
            patches.withColumn("t_start", starts), [*_PATCH, "t_start"], c.seed, total="n", purpose="split"
        )
        labelled = ranked.withColumn("split", _label(F.col("rank"), F.col("n"), c))
        parts.append(labelled.filter(F.col("split") == name).select(*SAMPLE_KEY))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shuffle_order(samples: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Loader order ``seq`` from 0 within each split; only train depends on the epoch."""
    keys = [*_PATCH, "t_start"]
    fixed = hash_rank(samples, keys, seed, by=["split"], name="seq")
    if epoch:
        train = hash_rank(samples.filter("split = 'train'"), keys, seed, epoch, by=["split"], name="seq")
        fixed = fixed.filter("split <> 'train'").unionByName(train)
    return fixed.withColumn("seq", F.col("seq") - 1)


def plan_samples(spark, height: int, width: int, times: int, c: SampleConfig) -> DataFrame:
    """All samples of a grid with their loader order."""
    split = spatial_split(patch_grid(spark, height, width, c.patch), c)
    return shuffle_order(temporal_starts(split, times, c), c.seed)


def parse_legend(legend: Column) -> Column:
    """Name to code map of a legend like ``0=Pristine, 1=Shadow``."""
    codes = F.str_to_map(legend, F.lit(", "), F.lit("="))
    return F.map_from_entries(
        F.transform(
            F.map_entries(codes),
            lambda e: F.struct(F.trim(e["value"]).alias("name"), F.trim(e["key"]).cast("int").alias("code")),
        )
    )


def bad_codes(legend: str = DEFAULT_LEGEND) -> tuple[int, ...]:
    """Codes of a legend text other than Pristine."""
    pairs = [part.split("=") for part in legend.split(", ")]
    return tuple(int(code) for code, name in pairs if name.strip() != "Pristine")


def frames(cube: DataFrame, c: SampleConfig) -> DataFrame:
    """Share of bad and of pristine cells per patch and frame, over all patch cells.

    One partial aggregate over the cube; absent cells are neither bad nor pristine.
    """
    area = F.lit(float(c.patch * c.patch))
    code = F.col("usability")
    return (
        with_patch(cube, c.patch)
        .groupBy(*_PATCH, "t")
        .agg(
            (F.sum(code.isin(list(c.bad_codes)).cast("int")) / area).alias("bad"),
            (F.sum((code == c.pristine_code).cast("int")) / area).alias("pristine"),
        )
    )


def window_frames(samples: DataFrame, c: SampleConfig) -> DataFrame:
    """One row per sample and frame of its window."""
    last = F.col("t_start") + c.window - 1
    return samples.withColumn("t", F.explode(F.sequence(F.col("t_start"), last)))


def target_frame(samples: DataFrame, frame_table: DataFrame, c: SampleConfig) -> DataFrame:
    """Frame of least bad share per sample, the earliest on ties, with its pristine share."""
    seen = window_frames(samples, c).join(frame_table, [*_PATCH, "t"], "left")
    best = F.min(
        F.struct(
            F.coalesce("bad", F.lit(0.0)).alias("bad"),
            F.col("t"),
            F.coalesce("pristine", F.lit(0.0)).alias("pristine"),
        )
    )
    return seen.groupBy(*samples.columns).agg(best.alias("_b")).select(
        *samples.columns,
        F.col("_b.t").alias("t_target"),
        F.col("_b.bad").alias("bad_fraction"),
        F.col("_b.pristine").alias("pristine_fraction"),
    )


def pristine_gate(targets: DataFrame, c: SampleConfig) -> DataFrame:
    return targets.filter(F.col("pristine_fraction") >= c.min_pristine)


def donor_frame(targets: DataFrame, c: SampleConfig) -> DataFrame:
    """Seeded choice of one of the other frames; NULL where the window has one frame."""
    if c.window < 2:
        return targets.withColumn("t_donor", F.lit(None).cast("int"))
    pick = F.col("t_start") + draw(digest("donor", [*_PATCH, "t_start"], c.seed), 0, c.window - 1)
    return targets.withColumn(
        "t_donor", (pick + (pick >= F.col("t_target")).cast("int")).cast("int")
    )


def frame_cells(cube: DataFrame, samples: DataFrame, c: SampleConfig) -> DataFrame:
    """Long form: one row per sample, window frame and observed cell.

    An equi-join on (patch, frame): the sample side has one row per frame and
    is smaller than the cells by the patch area.
    """
    keyed = with_patch(cube, c.patch).select(*_PATCH, "t", "y", "x", *c.bands, "usability")
    return keyed.join(window_frames(samples, c), [*_PATCH, "t"])


def series(
    cube: DataFrame, times: int, c: SampleConfig, shape: tuple[int, int] | None = None,
    placed: bool = False,
) -> DataFrame:
    """One row per cell: per band, and for the mask, an array over the frames 0 .. times-1.

    Absent frames have missing bands and the fill code. (t, y, x) is the cube's
    key, so a frame occurs once.

    With a grid shape, cells never observed occur as well. A group is one cell,
    at most ``times`` rows; rows are placed by patch and, where a patch has more than
    ``BLOCK_ROWS`` rows, by block of its rows (column ``_block``), so the join with
    the samples needs no second exchange and a patch is spread over several
    tasks. A dense cube table bucketed by patch (``placed``, without ``shape``) needs
    not even the first.
    """
    rows = with_patch(cube, c.patch).select(*_PATCH, "y", "x", "t", "usability", *c.bands)
    if shape is not None:
        height, width = shape
        cells = cube.sparkSession.range(height * width).select(
            F.expr(f"CAST(id div {width} AS INT)").alias("y"),
            F.expr(f"CAST(id % {width} AS INT)").alias("x"),
        )
        rows = rows.unionByName(with_patch(cells, c.patch), allowMissingColumns=True)
    code = F.coalesce("usability", F.lit(c.mask_fill)).cast("smallint").alias("usability")
    entry = F.when(F.col("t").isNotNull(), F.struct("t", code, *c.bands))
    if not placed and block_count(c.patch) > 1:
        rows = rows.withColumn("_block", F.floor((F.col("y") - F.col("y_coord")) / BLOCK_ROWS).cast("int"))
    keys = place_keys(rows)
    grouped = (rows if placed else rows.repartition(*keys)).groupBy(*keys, "y", "x").agg(
        F.collect_list(entry).alias("_seen")
    )
    every = F.sequence(F.lit(0), F.lit(times - 1))
    missing = F.transform(
        F.array_except(every, F.col("_seen.t")),
        lambda t: F.struct(
            t.alias("t"),
            F.lit(c.mask_fill).cast("smallint").alias("usability"),
            *[F.lit(None).cast("double").alias(b) for b in c.bands],
        ),
    )
    ordered = grouped.select(*keys, "y", "x", F.sort_array(F.concat("_seen", missing)).alias("_s"))
    return ordered.select(
        *keys, "y", "x", *[F.col(f"_s.{name}").alias(name) for name in ("usability", *c.bands)]
    )


def sample_cells(cells: DataFrame, samples: DataFrame, c: SampleConfig) -> DataFrame:
    """One row per sample and cell of ``series``: per band the window's T values.

    The sample side of a task is smaller than its cells by the patch area, so
    it is the hashed side and the cells need not be sorted.
    """
    keys = place_keys(cells)
    joined = cells.join(per_block(samples, cells, c.patch).hint("shuffle_hash"), keys)
    start = F.col("t_start") + 1
    return joined.select(
        *samples.columns,
        *keys[2:],
        "y",
        "x",
        *[F.slice(name, start, F.lit(c.window)).alias(name) for name in ("usability", *c.bands)],
    )


def normalised_inputs(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Bands on the physical scale; missing stays NULL for the mask, 0 comes later."""
    return cells.withColumns({b: normalise(F.col(b)) for b in c.bands})


def sanitised_inputs(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """The older form: missing becomes 0, values are clipped to [0, 1]."""
    return cells.withColumns({b: sanitise(F.col(b)) for b in c.bands})


def synthetic_gaps(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Inputs, truth and validity of sample cells.

    Expects normalised bands and the columns ``t_target`` and ``t_donor``. Per
    band: ``in_*`` the T inputs with missing as 0, ``target_*`` the truth,
    ``valid_*`` whether it counts. Where the donor frame is not pristine the
    target frame's input is 0 (``gap``). All of it is local to the row.
    """
    at = F.col("t_target") - F.col("t_start")
    donor = F.get("usability", F.col("t_donor") - F.col("t_start"))
    pristine = F.get("usability", at) == c.pristine_code

    def inputs(b: str) -> Column:
        values = [
            F.when(F.col("gap") & (at == k), F.lit(0.0)).otherwise(F.coalesce(F.get(b, F.lit(k)), F.lit(0.0)))
            for k in range(c.window)
        ]
        return F.array(*values).alias(f"in_{b}")

    marked = cells.withColumn("gap", F.coalesce(donor != c.pristine_code, F.lit(False)))
    return marked.select(
        *_CELL,
        *place_keys(cells)[2:],
        "t_target",
        "gap",
        *[inputs(b) for b in c.bands],
        *[F.coalesce(F.get(b, at), F.lit(0.0)).alias(f"target_{b}") for b in c.bands],
        *[(pristine & F.get(b, at).isNotNull()).alias(f"valid_{b}") for b in c.bands],
    )


def input_frames(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Long form of the inputs: one row per sample cell and frame."""
    values = [
        F.struct(
            (F.col("t_start") + k).alias("t"),
            *[F.get(f"in_{b}", F.lit(k)).alias(f"in_{b}") for b in c.bands],
        )
        for k in range(c.window)
    ]
    return cells.select(*_CELL, F.explode(F.array(*values)).alias("f")).select(*_CELL, "f.*")


def valid_mask(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Per band: the cell is pristine and has a value."""
    pristine = F.col("usability") == c.pristine_code
    return cells.withColumns({f"valid_{b}": pristine & F.col(b).isNotNull() for b in c.bands})


def valid_pixels(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """The older mask: the cell is pristine."""
    return cells.withColumn("valid", F.col("usability") == c.pristine_code)


def build_samples(
    cube: DataFrame, samples: DataFrame, times: int, c: SampleConfig,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """From cube and planned samples to sample cells with realistic gaps.

    The cube is read twice: its keys and mask for the gates, then its bands.
    """
    targets = pristine_gate(target_frame(samples, frames(cube, c), c), c)
    cells = series(normalised_inputs(cube, c), times, c, shape)
    return synthetic_gaps(sample_cells(cells, donor_frame(targets, c), c), c)


def augment(
    cells: DataFrame, c: SampleConfig, seed: int = 42, epoch: int = 0,
    params: tuple[Column, Column, Column] | None = None,
) -> DataFrame:
    """Flip and turn train samples by remapping cell coordinates inside the patch.

    Horizontal flip, vertical flip (each half of the time) and 0 to 3 quarter
    turns are independent draws of the sample, seed and epoch, or come from ``params``.
    """
    p = c.patch
    drawn = digest("augment", [*_PATCH, "t_start"], seed, epoch)
    flip_h, flip_v, turns = params or (
        draw(drawn, 0, 2) == 1,
        draw(drawn, 1, 2) == 1,
        draw(drawn, 2, 4),
    )
    ly, lx = F.col("y") - F.col("y_coord"), F.col("x") - F.col("x_coord")
    far = F.lit(p - 1)
    y1 = F.when(flip_v, far - F.col("_ly")).otherwise(F.col("_ly"))
    x1 = F.when(flip_h, far - F.col("_lx")).otherwise(F.col("_lx"))
    k = F.col("_k")
    y2 = F.when(k == 1, far - F.col("_x1")).when(k == 2, far - F.col("_y1")).when(k == 3, F.col("_x1"))
    x2 = F.when(k == 1, F.col("_y1")).when(k == 2, far - F.col("_x1")).when(k == 3, far - F.col("_y1"))
    train = F.col("split") == "train"
    moved = (
        cells.withColumns({"_ly": ly, "_lx": lx, "_k": turns})
        .withColumns({"_y1": y1, "_x1": x1})
        .withColumns(
            {
                "y": F.when(
                    train, F.col("y_coord") + F.coalesce(y2, F.col("_y1"))
                ).otherwise(F.col("y")).cast("int"),
                "x": F.when(
                    train, F.col("x_coord") + F.coalesce(x2, F.col("_x1"))
                ).otherwise(F.col("x")).cast("int"),
            }
        )
    )
    return moved.drop("_ly", "_lx", "_k", "_y1", "_x1", "_block")


def to_chips(cells: DataFrame, bands: list[str], patch: int, keys: list[str]) -> DataFrame:
    """One row-major float array per (key, band); absent and missing cells are 0.

    A group is one patch and frame: at most ``patch`` squared cells.
    """
    area = patch * patch
    pos = ((F.col("y") - F.col("y_coord")) * patch + (F.col("x") - F.col("x_coord"))).cast("int")
    values = F.array(*[F.coalesce(F.col(b), F.lit(0.0)).cast("float") for b in bands])
    zeros = F.array(*[F.lit(0.0).cast("float") for _ in bands])
    grouped = cells.groupBy(*keys).agg(
        F.collect_list(F.struct(pos.alias("pos"), values.alias("v"))).alias("present")
    )
    gaps = F.transform(
        F.array_except(F.sequence(F.lit(0), F.lit(area - 1)), F.col("present.pos")),
        lambda i: F.struct(i.alias("pos"), zeros.alias("v")),
    )
    whole = grouped.withColumn("cells", F.array_sort(F.concat("present", gaps)))

    def plane(i: int) -> Column:
        return F.transform("cells", lambda e: e["v"][i])

    chips = [
        F.struct(F.lit(b).alias("band"), plane(i).alias("pixels")) for i, b in enumerate(bands)
    ]
    return whole.select(*keys, F.explode(F.array(*chips)).alias("c")).select(*keys, "c.band", "c.pixels")


def attach_stratum(samples: DataFrame, strata: DataFrame) -> DataFrame:
    """Stratum of each sample's patch, ``Unknown`` where it has none."""
    labels = strata.select(*_PATCH, F.col("stratum").alias("difficulty_stratum"))
    return samples.join(labels, _PATCH, "left").withColumn(
        "difficulty_stratum", F.coalesce("difficulty_stratum", F.lit("Unknown"))
    )


def batches(samples: DataFrame, batch_size: int, world: int = 1) -> DataFrame:
    """Batch number and place of each kept sample, in loader order per split and shard.

    A batch is cut from the loader's list before rejected samples drop out of
    it, so ``seq`` alone gives both numbers and nothing has to be sorted.
    """
    local = F.floor(F.col("seq") / F.lit(world)).cast("bigint")
    return shard(samples, world).withColumns(
        {
            "batch": F.floor(local / F.lit(batch_size)).cast("bigint"),
            "slot": (local % F.lit(batch_size)).cast("int"),
        }
    )


def shard(samples: DataFrame, world: int) -> DataFrame:
    """Round-robin over ``world`` workers by loader order."""
    return samples.withColumn("rank", F.pmod(F.col("seq"), F.lit(world)).cast("int"))


def padded_shards(samples: DataFrame, world: int) -> DataFrame:
    """Round-robin shards of equal length: the head of the list repeats at its end.

    A list shorter than the padding repeats as often as needed.
    """
    sizes = samples.groupBy("split").agg(F.count("*").alias("_n"))
    # three splits at most
    sized = samples.join(F.broadcast(sizes), "split")
    total = F.ceil(F.col("_n") / F.lit(world)) * world
    places = F.sequence(F.col("seq"), total - 1, F.col("_n"))
    return shard(sized.withColumn("seq", F.explode(places)), world).drop("_n")


def pad_batches(df: DataFrame, batch: list[str], slot: str, size: int) -> DataFrame:
    """Batches of exactly ``size`` rows: longer ones are cut, shorter ones cycle their rows.

    ``slot`` numbers the rows of a batch from 0 without holes. Each row emits
    the places it fills, so no join is needed.
    """
    counted = df.withColumn("_n", F.count("*").over(W.partitionBy(*batch)))
    return (
        counted.filter(F.col(slot) < size)
        .withColumn("place", F.explode(F.sequence(F.col(slot).cast("bigint"), F.lit(size - 1).cast("bigint"), F.col("_n"))))
        .drop("_n")
    )


def compact_slots(df: DataFrame, batch: list[str], slot: str) -> DataFrame:
    """Renumber the rows kept of each batch from 0; a batch is small."""
    rank = F.row_number().over(W.partitionBy(*batch).orderBy(slot)) - 1
    return df.withColumn(slot, rank.cast("int"))


def last_frame_target(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Fallback target: the window's last frame."""
    last = F.lit(c.window - 1)
    return cells.select(*_CELL, *[F.get(f"in_{b}", last).alias(f"target_{b}") for b in c.bands])


def split_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count("*").alias("samples"))
