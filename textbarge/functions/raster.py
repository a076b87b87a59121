"""Raster size of a page rendered at 150 DPI and the pixel gate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..profiles import MAX_IMAGE_PIXELS, POINTS_PER_INCH, RENDER_DPI
from .text import col

# Double literal on purpose: 150.0/72.0 in Spark SQL would be a decimal.
def _scale() -> Column:
    return F.lit(RENDER_DPI).cast("double") / F.lit(POINTS_PER_INCH).cast("double")


def raster_px(points) -> Column:
    """``Int(points * 150/72)``: truncation toward zero."""
    return (col(points).cast("double") * _scale()).cast("int")


def pixels(width_px, height_px) -> Column:
    return col(width_px).cast("bigint") * col(height_px).cast("bigint")


def too_many_pixels(width_px, height_px, limit: int = MAX_IMAGE_PIXELS) -> Column:
    return pixels(width_px, height_px) > F.lit(limit)
