"""Parameters of the cube build and of the analyses, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the sensor product: fill words, scale and valid range.
REFLECTANCE_FILL = -28672
QC_FILL = 787410671
STATE_FILL = 65535
MASK_FILL = 255

# Usability codes and their names.
MASK_CODES = {
    0: "Pristine",
    1: "Shadow",
    2: "Hazy",
    3: "Contaminated",
    4: "Cloudy",
    255: "Fill",
}

# The legend text stored with a cube, and the one assumed when a
# cube carries none.
MASK_LEGEND = (
    "0=Pristine, 1=Shadow, 2=Hazy (from aerosol), "
    "3=Contaminated (from cirrus or cloud adjacency), 4=Cloudy, 255=Fill"
)
DEFAULT_LEGEND = "0=Pristine, 1=Shadow, 2=Hazy, 3=Contaminated, 4=Cloud"

# Names and centre ranges of the seven bands.
BAND_NAMES = ["Red", "NIR", "Blue", "Green", "SWIR 1", "SWIR 2", "SWIR 3"]
BAND_WAVELENGTHS_NM = [
    "620-670",
    "841-876",
    "459-479",
    "545-565",
    "1230-1250",
    "1628-1652",
    "2105-2155",
]

# Land-cover class ids, names and colours.
LAND_COVER = [
    (10, "Tree cover", "#006400"),
    (20, "Shrubland", "#ffbb22"),
    (30, "Grassland", "#ffff4c"),
    (40, "Cropland", "#f096ff"),
    (50, "Built-up", "#fa0000"),
    (60, "Bare / sparse vegetation", "#b4b4b4"),
    (70, "Snow and ice", "#f0f0f0"),
    (80, "Permanent water bodies", "#0064c8"),
    (90, "Herbaceous wetland", "#0096a0"),
    (95, "Mangroves", "#00cf75"),
    (100, "Moss and lichen", "#fae6a0"),
]

# Classes whose reflectance should not move through time.
STABLE_CLASSES = [50, 60, 80]

# Tiles of the default region.
DEFAULT_TILES = ["h18v03", "h18v04", "h19v03", "h19v04"]

# Reflectance bounds of the sample normaliser.
PHYSICAL_MIN = -0.01
PHYSICAL_MAX = 1.6


@dataclass(frozen=True)
class CubeConfig:
    """Cube build parameters.

    ``range_on`` says whether ``valid_range`` is compared with the scaled
    reflectance (the compatible reading, which rejects nothing for 16-bit
    input) or with the raw digital number. Where ``reflectance_fill`` or
    ``qc_fill`` is given, that raw word or quality word is no observation.
    """

    bands: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    scale_factor: float = 0.0001
    valid_range: tuple[float, float] = (-100, 16000)
    range_on: str = "scaled"
    reflectance_fill: int | None = None
    qc_fill: int | None = None
    state_fill: int = STATE_FILL
    mask_fill: int = MASK_FILL
    upsampling: int = 2
    min_valid_fraction: float = 0.5
    tiles_per_day: int = 4
    expected_days: int | None = None
    tile_rows: int = 2400
    tile_cols: int = 2400
    origin_h: int = 18
    origin_v: int = 3
    patch: int = 224
    chunk: int = 1024
    attrs: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.bands or any(b < 1 or b > 7 for b in self.bands):
            raise ValueError("bands must be a non-empty subset of 1..7")
        if self.range_on not in ("scaled", "raw"):
            raise ValueError("range_on must be 'scaled' or 'raw'")
        if self.tiles_per_day < 1:
            raise ValueError("tiles_per_day must be positive")
        if not 0.0 <= self.min_valid_fraction <= 1.0:
            raise ValueError("min_valid_fraction must lie in [0, 1]")
        if self.upsampling < 1 or self.patch < 1 or self.chunk < 1:
            raise ValueError("upsampling, patch and chunk must be positive")


@dataclass(frozen=True)
class DifficultyConfig:
    """Parameters of the patch difficulty index."""

    patch: int = 224
    red: str = "b01"
    nir: str = "b02"
    cloudy_code: int = 4
    weights: tuple[float, float, float] = (0.33, 0.33, 0.33)


@dataclass(frozen=True)
class SampleConfig:
    """Parameters of the spatio-temporal samples."""

    patch: int = 224
    window: int = 4
    train_split: float = 0.7
    val_split: float = 0.15
    seed: int = 42
    min_pristine: float = 0.85
    pristine_code: int = 0
    mask_fill: int = MASK_FILL
    bad_codes: tuple[int, ...] = (1, 2, 3, 4)
    bands: tuple[str, ...] = ("b01", "b02", "b03", "b04", "b05", "b06")

    def __post_init__(self):
        if self.patch < 1 or self.window < 1:
            raise ValueError("patch and window must be positive")
        if self.train_split < 0 or self.val_split < 0 or self.train_split + self.val_split > 1:
            raise ValueError("split shares must be non-negative and sum to at most 1")
