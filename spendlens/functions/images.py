"""Perceptual statistics of decoded images.

Input rows follow the struct of Spark's image source (height, width, nChannels,
data in BGR order). Pictures are read in Arrow batches; each becomes one array
and leaves as seven numbers, so pixels never become rows and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.session import ship

IMAGE_FEATURES = (
    "aspect_ratio",
    "brightness",
    "saturation",
    "contrast",
    "colorfulness",
    "edge_density",
    "dark_ratio",
)
# Luminance weights of red, green and blue.
LUMA = (0.2126, 0.7152, 0.0722)
MAX_SIDE = 320


def pixels(height: int, width: int, channels: int, data: bytes, max_side: int = MAX_SIDE) -> np.ndarray:
    """Red, green and blue of a picture in [0, 1], as height x width x 3.

    A picture with a side over ``max_side`` is averaged over squares of k x k
    pixels (smaller at the right and lower edge), k being the least that fits, so
    that every pixel counts. A gray picture repeats its only channel.
    """
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = raw[:, :, 2::-1] if channels >= 3 else np.repeat(raw[:, :, :1], 3, axis=2)
    step = max(1, -(-max(height, width) // max_side))
    if step == 1:
        return rgb / 255.0
    rows, columns = np.arange(0, height, step), np.arange(0, width, step)
    sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.int64), rows, axis=0), columns, axis=1)
    size = np.diff(np.append(rows, height))[:, None] * np.diff(np.append(columns, width))[None, :]
    return sums / (255.0 * size[:, :, None])


def luminance(rgb: np.ndarray) -> np.ndarray:
    return LUMA[0] * rgb[:, :, 0] + LUMA[1] * rgb[:, :, 1] + LUMA[2] * rgb[:, :, 2]


def _slope(values: np.ndarray, axis: int) -> np.ndarray:
    """Central difference inside, one-sided at both ends, 0 on a single line."""
    return np.gradient(values, axis=axis) if values.shape[axis] > 1 else np.zeros_like(values)


def statistics(rgb: np.ndarray, ratio: float) -> tuple[float, ...]:
    """The seven features of one picture, in the order of ``IMAGE_FEATURES``."""
    r, g, b = rgb[:, :, 0], rgb[:, :, 1], rgb[:, :, 2]
    lum, high, low = luminance(rgb), rgb.max(axis=2), rgb.min(axis=2)
    saturation = np.divide(high - low, high, out=np.zeros_like(high), where=high > 0)
    rg, yb = r - g, 0.5 * (r + g) - b
    colorfulness = np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())
    edges = np.hypot(_slope(lum, 0), _slope(lum, 1))
    return ratio, lum.mean(), saturation.mean(), lum.std(), colorfulness, edges.mean(), (lum < 0.25).mean()


def _pictures(batch: pa.RecordBatch, max_side: int) -> Iterator[tuple]:
    """(ad_id, width, height, pixels) of the readable pictures of a batch."""
    images = batch.column(1)
    height, width, channels = (images.field(f).to_pylist() for f in ("height", "width", "nChannels"))
    for i, ad in enumerate(batch.column(0).to_pylist()):
        if images[i].is_valid and (height[i] or 0) > 0 and (width[i] or 0) > 0:
            yield ad, width[i], height[i], pixels(height[i], width[i], channels[i], images.field("data")[i].as_py(), max_side)


def decoded(images: DataFrame, max_side: int = MAX_SIDE) -> DataFrame:
    """Image structs to (ad_id, width, height, w, h, r, g, b) with one array per channel."""

    def run(batches):
        for batch in batches:
            for ad, width, height, rgb in _pictures(batch, max_side):
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "ad_id": ad, "width": width, "height": height, "w": rgb.shape[1], "h": rgb.shape[0],
                            "r": rgb[:, :, 0].ravel(), "g": rgb[:, :, 1].ravel(), "b": rgb[:, :, 2].ravel(),
                        }
                    ],
                    schema=out,
                )

    ship(images.sparkSession)
    channel = pa.list_(pa.float64())
    out = pa.schema(
        [("ad_id", pa.string()), *[(c, pa.int32()) for c in ("width", "height", "w", "h")], *[(c, channel) for c in "rgb"]]
    )
    return images.select("ad_id", "image").mapInArrow(
        run, "ad_id string, width int, height int, w int, h int, r array<double>, g array<double>, b array<double>"
    )


def image_features(images: DataFrame, max_side: int = MAX_SIDE) -> DataFrame:
    """The seven features per picture; unreadable ones give no row."""

    def run(batches):
        for batch in batches:
            rows = [(ad, *statistics(rgb, width / height)) for ad, width, height, rgb in _pictures(batch, max_side)]
            columns = list(zip(*rows)) if rows else [()] * (1 + len(IMAGE_FEATURES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *[pa.array([float(x) for x in c], pa.float64()) for c in columns[1:]]],
                names=["ad_id", *IMAGE_FEATURES],
            )

    ship(images.sparkSession)
    return images.select("ad_id", "image").mapInArrow(run, "ad_id string, " + ", ".join(f"{f} double" for f in IMAGE_FEATURES))
