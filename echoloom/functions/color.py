"""Cluster colours and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The golden-ratio step of hues, the colour of an empty cell, cells of a page's grid, saturation.
GOLDEN, EMPTY, GRID, SATURATION = 0.6180339887, (34, 34, 42, 255), 20, 1.0


def hue(cluster: Column) -> Column:
    return F.pmod(cluster.cast("double") * GOLDEN, F.lit(1.0))


def value(similarity: Column, gamma: float) -> Column:
    return F.pow(F.greatest(similarity.cast("double"), F.lit(0.0)), F.lit(gamma))


def hsv(h: Column, s: float, v: Column) -> tuple[Column, Column, Column]:
    """Linear red, green and blue."""
    h6 = F.pmod(h, F.lit(1.0)) * 6
    c = v * s
    x = c * (1 - F.abs(F.pmod(h6, F.lit(2.0)) - 1))
    m = v - c
    zero = F.lit(0.0)
    pick = lambda a, b, d, e, f, g: F.when(h6 < 1, a).when(h6 < 2, b).when(h6 < 3, d).when(h6 < 4, e).when(h6 < 5, f).otherwise(g) + m
    return pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x)


def srgb_byte(linear: Column) -> Column:
    c = F.greatest(F.least(linear, F.lit(1.0)), F.lit(0.0))
    s = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return F.floor(s * 255 + 0.5).cast("int")


def linear_cell(offset: Column, chars: Column) -> Column:
    """Cell 0 to 399 of a code point of a page; 0 on an empty page."""
    n = GRID * GRID
    return F.when(chars > 0, F.greatest(F.least(F.floor(offset.cast("double") / chars * n), F.lit(n - 1)), F.lit(0))).otherwise(0).cast("int")


def cell_span(start: Column, end: Column, chars: Column) -> tuple[Column, Column]:
    return linear_cell(start, chars), linear_cell(F.greatest(end - 1, start), chars)


def midpoint_cell(start: Column, end: Column, chars: Column) -> tuple[Column, Column]:
    c = linear_cell(F.floor((start + end) / 2), chars)
    return F.floor(c / GRID).cast("smallint"), (c % GRID).cast("smallint")


#: Rendered size in pixels from which a cell shows its clusters one by one instead of their blend.
DITHER_WIDTH, DITHER_HEIGHT = 100, 200


def dithers(width: Column, height: Column) -> Column:
    return (width >= DITHER_WIDTH) & (height >= DITHER_HEIGHT)


def dither_index(row: Column, col: Column, clusters: Column) -> Column:
    """Which of a cell's clusters (from 0, in order of similarity) a pixel shows: a checkerboard for two, thirds, quadrants,
    and a scatter for more. Fixed values: the patterns' factors."""
    scatter = F.when(clusters == 3, (row * 3 + col * 7) % 3).when(clusters == 4, (row % 2) * 2 + col % 2).otherwise((row * 11 + col * 7) % clusters)
    return F.when(clusters <= 1, F.lit(0)).when(clusters == 2, (row + col) % 2).otherwise(scatter).cast("int")
