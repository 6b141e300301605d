"""Frame features on stored luma grids (row-major ARRAY<DOUBLE>) and on raw images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------
LUMA_WEIGHTS = (299, 587, 114)  # red, green, blue, in thousandths
BLANK_GRID, HASH_GRID, CHANGE_GRID = 48, 8, 64
BLANK_STD_MAX = 9.0
DARK_MEAN_MAX, DARK_STD_MAX = 22.0, 11.0
DUPLICATE_BITS_MAX = 10
CELL_CHANGE_MIN = 12.0
ROI_X, ROI_Y = (0.08, 0.92), (0.12, 0.88)
DEFAULT_CHANGE_THRESHOLD, DEFAULT_COOLDOWN = 0.15, 2.0
# -----------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grid_mean(grid: Column | str) -> Column:
    grid = _col(grid)
    total = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(grid) > 0, total / F.size(grid)).when(grid.isNotNull(), F.lit(0.0))


def grid_std(grid: Column | str) -> Column:
    """Population standard deviation; 0 for an empty grid, NULL for a missing one."""
    grid = _col(grid)
    mean = grid_mean(grid)
    squares = F.aggregate(
        F.transform(grid, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x
    )
    return F.when(F.size(grid) > 0, F.sqrt(squares / F.size(grid))).when(grid.isNotNull(), F.lit(0.0))


def is_blank(mean: Column, std: Column) -> Column:
    return (std <= BLANK_STD_MAX) | ((mean <= DARK_MEAN_MAX) & (std <= DARK_STD_MAX))


def average_hash(grid: Column | str, mean: Column | None = None) -> Column:
    """64-bit average hash of an 8x8 grid, most significant bit first."""
    grid = _col(grid)
    mean = grid_mean(grid) if mean is None else mean
    return F.aggregate(
        F.transform(grid, lambda x: F.when(x >= mean, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda a, b: F.shiftleft(a, 1).bitwiseOR(b),
    )


def hash_text(value: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(_col(value))), 16, "0")


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def change_ratio(current: Column | str, before: Column | str) -> Column:
    """Share of cells whose luma moved by at least 12; no common cells counts as 1."""
    current, before = _col(current), _col(before)
    n = F.least(F.size(current), F.size(before))
    moved = F.aggregate(
        F.zip_with(
            F.slice(current, F.lit(1), n),
            F.slice(before, F.lit(1), n),
            lambda x, y: (F.abs(x - y) >= CELL_CHANGE_MIN).cast("int"),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(moved / n)


def frame_index(path: Column | str) -> Column:
    digits = F.regexp_extract(_col(path), r"(\d+)\.png$", 1)
    return F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999999999999")).cast("bigint")


def frame_seconds(path: Column | str, interval: Column | float = 1.0, mode: str = "sample_index") -> Column:
    """`sample_index`: sample number; `timeline`: sample number times the interval."""
    idx = F.coalesce(frame_index(path), F.lit(1))
    base = F.greatest(idx - 1, F.lit(0)).cast("double")
    if mode == "sample_index":
        return base
    return base * (interval if isinstance(interval, Column) else F.lit(float(interval)))


FEATURES = T.StructType(
    [
        T.StructField("blank", T.BooleanType()),
        T.StructField("phash", T.LongType()),
        T.StructField("roi", T.ArrayType(T.IntegerType())),
    ]
)


def _sample(luma: np.ndarray, n: int, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Nearest samples of an n x n grid over [x0, x1) x [y0, y1)."""
    height, width = luma.shape
    step = np.arange(n)
    xs = np.minimum(width - 1, x0 + (step * max(1, x1 - x0)) // n)
    ys = np.minimum(height - 1, y0 + (step * max(1, y1 - y0)) // n)
    return luma[np.ix_(ys, xs)].ravel()


def _features(height: int, width: int, channels: int, data: bytes):
    if width <= 0 or height <= 0:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int32)
    if channels >= 3:  # stored blue, green, red (, alpha)
        red, green, blue = LUMA_WEIGHTS
        luma = red * pixels[..., 2] + green * pixels[..., 1] + blue * pixels[..., 0]
    else:
        luma = 1000 * pixels[..., 0]
    cells = _sample(luma, BLANK_GRID, 0, width, 0, height) / 1000.0
    mean, std = cells.mean(), cells.std()
    blank = bool(std <= BLANK_STD_MAX or (mean <= DARK_MEAN_MAX and std <= DARK_STD_MAX))
    if blank:
        return {"blank": True, "phash": None, "roi": None}
    small = _sample(luma, HASH_GRID, 0, width, 0, height)
    # Whole milli-luma keeps `cell >= mean` free of rounding: compare n*cell with the sum.
    bits = small.size * small.astype(np.int64) >= int(small.sum(dtype=np.int64))
    phash = int(np.packbits(bits).view(">i8")[0])
    x0, y0 = int(width * ROI_X[0]), int(height * ROI_Y[0])
    x1, y1 = max(x0 + 1, int(width * ROI_X[1])), max(y0 + 1, int(height * ROI_Y[1]))
    return {"blank": False, "phash": phash, "roi": _sample(luma, CHANGE_GRID, x0, x1, y0, y1)}


@F.pandas_udf(FEATURES)
def image_features(image: pd.DataFrame) -> pd.DataFrame:
    """Blank flag, average hash and centre grid (milli-luma) of decoded images. An image
    that could not be decoded gives NULL in all three."""
    rows = [
        _features(h, w, c, d) or {"blank": None, "phash": None, "roi": None}
        for h, w, c, d in zip(image["height"], image["width"], image["nChannels"], image["data"])
    ]
    return pd.DataFrame(
        {
            "blank": pd.array([r["blank"] for r in rows], dtype="boolean"),
            "phash": pd.array([r["phash"] for r in rows], dtype="Int64"),
            "roi": pd.Series([r["roi"] for r in rows], dtype="object"),
        }
    )
