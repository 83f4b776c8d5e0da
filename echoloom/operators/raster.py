"""Pages as 20 by 20 grids: painted cells, blended colours, canvases, drill-down."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoloom.functions import color as C
from echoloom.operators.intervals import as_of
from echoloom.operators.report import highlight_hue

DEEPEST = 8


def painted_cells(windows: DataFrame, pages: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``job_id, page, cell, rank, cluster_id, sim, window_index``: a window paints every cell it spans; the best
    ``deepest`` per cell stay (ties in window order). Noise and windows of unknown pages paint nothing."""
    real = windows.where("cluster_id is not null and cluster_id <> -1").join(pages.select("job_id", "page", "char_count"), ["job_id", "page"])
    first, last = C.cell_span(F.col("char_start"), F.col("char_end"), F.col("char_count"))
    each = real.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, last))))
    w = Window.partitionBy("job_id", "page", "cell").orderBy(F.desc("sim"), "window_index")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= deepest).select("job_id", "page", "cell", "rank", "cluster_id", "sim", "window_index")


def blended_cells(cells: DataFrame, gamma: float = 1.5, threshold: float = 0.75, hidden: tuple[int, ...] = ()) -> DataFrame:
    """``job_id, page, cell, r, g, b``: visible clusters' colours weighted by ``sim ** gamma``; cells without are absent."""
    shown = cells.where((F.col("sim") >= threshold) & ~F.col("cluster_id").isin(list(hidden)))
    w = Window.partitionBy("job_id", "page", "cell").orderBy("rank")
    shown = shown.withColumn("n", F.row_number().over(w)).where(F.col("n") <= DEEPEST)
    v = C.value(F.col("sim"), gamma)
    r, g, b = C.hsv(C.hue(F.col("cluster_id")), C.SATURATION, v)
    total = F.sum(v)
    sums = shown.groupBy("job_id", "page", "cell").agg(total.alias("t"), F.sum(v * r).alias("r"), F.sum(v * g).alias("g"), F.sum(v * b).alias("b")).where("t > 0")
    return sums.select("job_id", "page", "cell", *[C.srgb_byte(F.col(c) / F.col("t")).alias(c) for c in "rgb"])


def canvases(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """``job_id, page, rgba``: 1600 bytes, row by row; empty cells are dark."""

    def draw(parts):
        blank = bytes(C.EMPTY) * (C.GRID * C.GRID)
        for f in parts:
            out = []
            for rows in f["cells"]:
                canvas = bytearray(blank)
                for x in rows if rows is not None else ():
                    canvas[4 * x["cell"] : 4 * x["cell"] + 4] = bytes((x["r"], x["g"], x["b"], 255))
                out.append(bytes(canvas))
            yield pd.DataFrame({"job_id": f["job_id"], "page": f["page"], "rgba": out})

    packed = cells.groupBy("job_id", "page").agg(F.collect_list(F.struct("cell", "r", "g", "b")).alias("cells"))
    every = pages.select("job_id", "page").distinct().join(packed, ["job_id", "page"], "left")
    return every.mapInPandas(draw, "job_id string, page int, rgba binary")


def encoded(canvas: DataFrame) -> DataFrame:
    # Spark's encoder breaks lines, the payload's format has none
    return canvas.select("job_id", "page", F.translate(F.base64("rgba"), "\r\n", "").alias("rgba_base64"))


def selected(frame: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of chosen ``job_id, page`` only; put before the raster so that nothing else is drawn."""
    return frame.join(pages.select("job_id", "page").distinct(), ["job_id", "page"], "left_semi")


def tolerance_mask(cells: DataFrame, tolerance: float) -> DataFrame:
    """``job_id, page, cell, shown``: the best similarity exceeds the tolerance, which is kept within [0.75, 1]."""
    t = min(max(tolerance, 0.75), 1.0)
    return cells.groupBy("job_id", "page", "cell").agg((F.max("sim") > t).alias("shown"))


def page_tooltips(cells: DataFrame, most: int = 3) -> DataFrame:
    """Each page's clusters with the highest similarity (ties to the lower id)."""
    best = cells.groupBy("job_id", "page", "cluster_id").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("job_id", "page").orderBy(F.desc("sim"), "cluster_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def cell_detail(cells: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``job_id, page, cell, cluster_id, sim, other_page, other_cell``: each cell's top cluster and where else it is:
    on every other page, the first cell at or above the threshold."""
    shown = cells.where(F.col("sim") >= threshold)
    top = shown.where(F.col("rank") == 1).select("job_id", "page", "cell", "cluster_id", "sim")
    first = shown.groupBy("job_id", "cluster_id", F.col("page").alias("other_page")).agg(F.min("cell").alias("other_cell"))
    return top.join(first, ["job_id", "cluster_id"]).where("page <> other_page")


def dithered_cells(cells: DataFrame, width: int, height: int, threshold: float = 0.75) -> DataFrame:
    """``job_id, page, cell, clusters, pixels``: the clusters shown at or above the threshold, best first, and the cluster of
    each of ``width`` times ``height`` pixels, row by row."""
    shown = cells.where(F.col("sim") >= threshold).groupBy("job_id", "page", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cluster_id"))), lambda x: x["cluster_id"]).alias("clusters"))
    pixel = lambda i: F.get("clusters", C.dither_index(F.floor(i / width).cast("int"), i % width, F.size("clusters")))
    return shown.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel))


def cell_windows(cells: DataFrame, windows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``job_id, page, cell, cluster_id, sim, n_clusters, text``: each cell's top cluster at or above the threshold and the longest
    text among that cluster's windows on the page (ties to the first window)."""
    shown = cells.where(F.col("sim") >= threshold)
    top = shown.groupBy("job_id", "page", "cell").agg(F.min_by(F.struct("cluster_id", "sim"), "rank").alias("t"), F.count_distinct("cluster_id").alias("n_clusters"))
    longest = windows.where("text is not null").groupBy("job_id", "page", "cluster_id").agg(F.max_by("text", F.struct(F.octet_length("text"), -F.col("window_index"))).alias("text"))
    return top.select("job_id", "page", "cell", "t.cluster_id", "t.sim", "n_clusters").join(longest, ["job_id", "page", "cluster_id"], "left")


def highlights(spans: DataFrame, pages: DataFrame, hues: DataFrame, key: str = "job_id") -> DataFrame:
    """``*key, page, start, end, cluster_id, instance_id, role, hue, similarity, text`` of every span of a report.

    The first instance of a cluster is ``canonical``, the others are duplicates. ``hues(*key, cluster_id, reg)`` is the registry's;
    clusters it doesn't know get one of twelve hues. Reports of several kinds are highlighted together by their union.
    """
    on = as_of(spans.select(key, "cluster_id", "instance_id", "start", "end", "similarity", "text"), pages.select(key, "doc_char_start", "page"), [key], "start", "doc_char_start", "page")
    role = F.when(F.col("instance_id") == 0, "canonical").otherwise("duplicate")
    return on.join(hues, [key, "cluster_id"], "left").withColumn("role", role).withColumn("hue", highlight_hue(F.col("cluster_id"), F.col("reg"))).drop("reg")
