"""Column layouts of the tables the operators exchange (Spark DDL)."""

GRANULES = "name STRING, size BIGINT"
OBS_1KM = "tile STRING, date DATE, row INT, col INT, state INT"
OBS_500M = (
    "tile STRING, date DATE, row INT, col INT, "
    + ", ".join(f"r{b} INT" for b in range(1, 8))
    + ", qc BIGINT"
)
CUBE = (
    "t INT, date DATE, y INT, x INT, "
    + ", ".join(f"b0{b} DOUBLE" for b in range(1, 8))
    + ", usability SMALLINT"
)
CUBE_ATTRS = "scope STRING, key STRING, value STRING"
LANDCOVER = "y INT, x INT, lc SMALLINT"
LC_DIM = "lc INT, name STRING, color STRING"
MASK_DIM = "code INT, name STRING"
DIFFICULTY = (
    "geo_y DOUBLE, geo_x DOUBLE, y_coord INT, x_coord INT, heterogeneity DOUBLE, "
    "phenology_variability DOUBLE, cloud_persistence DOUBLE, difficulty_index DOUBLE"
)
SPLITS = "split STRING, y_coord INT, x_coord INT, t_start INT, seq BIGINT"
PATCH_METRICS = (
    "model STRING, y_coord INT, x_coord INT, rmse DOUBLE, psnr DOUBLE, ssim DOUBLE, sam DOUBLE"
)
RUNS = "model STRING, gpus INT, repeat_id INT, samples BIGINT, elapsed DOUBLE"
WEAK_SCALING = "worker_count INT, days INT, data_size_mb DOUBLE, throughput_mbs DOUBLE"

BANDS = [f"b0{b}" for b in range(1, 8)]
FEATURE_BANDS = BANDS[:6]
METRICS = ["rmse", "psnr", "ssim", "sam"]
SAMPLE_KEY = ["split", "y_coord", "x_coord", "t_start"]
