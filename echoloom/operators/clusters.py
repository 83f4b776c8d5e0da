"""Clusters of windows: centroids, registry, similarities, and the clustering algorithms of a job.

Frames hold ``job_id, window_index, embedding`` and, where clusters are known, ``cluster_id`` with -1 for noise.
Null and empty vectors are in no centroid and no cluster.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.config import AnalysisParams, min_cluster_size
from echoloom.functions.text import trimmed
from echoloom.functions.vectors import cosine
from echoloom.operators.graph import connected_components
from echoloom.operators.intervals import merged

#: Cosine floors of leader clustering and sub-phrase links; restarts' seed, rounds and tolerance.
LEADER_FLOOR, SUBPHRASE_FLOOR, SEED, ROUNDS, TOLERANCE = 0.82, 0.85, 42, 300, 1e-4
#: Bytes of a cluster's rows in memory, beyond which they go to a temporary file; centroids that are compared with as many others at once.
HELD, SQUARE = 64 << 20, 4096
#: Distances of a job's vectors in memory at once.
CELLS = 1 << 22


def usable(windows: DataFrame, embedding: str = "embedding") -> DataFrame:
    return windows.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0))


def _grid(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of an Arrow column of lists as doubles, 0 where there is nothing; which places hold a number; the rows' lengths."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    known = np.arange(sizes.max(initial=0)) < sizes[:, None]
    x = np.zeros(known.shape)
    x[known] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        known[known] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, known, sizes


class _Cluster:
    """Sums over the rows of one cluster and the rows themselves; beyond ``HELD`` bytes these wait in a temporary file."""

    def __init__(self, key: str | None = None) -> None:
        self.key, self.sums, self.counts, self.rows, self.bytes = key, np.zeros(0), np.zeros(0, np.int64), 0, 0
        self.blocks: list[pa.RecordBatch] = []
        self.file = self.writer = None

    def add(self, block: pa.RecordBatch, x: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> None:
        more = max(0, int(sizes.max(initial=0)) - len(self.sums))
        self.sums, self.counts = np.pad(self.sums, (0, more)), np.pad(self.counts, (0, more))
        n = min(x.shape[1], len(self.sums))
        self.sums[:n] += x[:, :n].sum(0)
        self.counts[:n] += known[:, :n].sum(0)
        self.rows += int((sizes > 0).sum())
        self.blocks.append(block)
        self.bytes += block.nbytes
        if self.bytes > HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
                self.writer = pa.ipc.new_stream(self.file, block.schema)
            for b in self.blocks:
                self.writer.write_batch(b)
            self.blocks, self.bytes = [], 0

    def mean(self) -> np.ndarray:
        """0 where no row holds a number."""
        return self.sums / np.maximum(self.counts, 1)

    def parts(self) -> Iterator[pa.RecordBatch]:
        if self.file is not None:
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
            self.file.close()
        yield from self.blocks


def _clustered(batches: Iterator[pa.RecordBatch], within: Callable, over: Callable) -> Iterator[pa.RecordBatch]:
    """``within(rows, borders, x, known, sizes)`` of the clusters that lie inside a batch, ``over(cluster)`` of the others.

    The rows are sorted by ``__k``, which tells clusters apart; ``__v`` are their vectors.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        k, grid = b.column("__k").to_numpy(zero_copy_only=False), _grid(b.column("__v"))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        first = int(held is not None and held.key == k[0])
        if first:
            held.add(b.slice(0, cuts[1]), *[g[: cuts[1]] for g in grid])
        if first == len(cuts) - 1:
            continue
        if held is not None:
            yield from over(held)
        a, z = cuts[first], cuts[-2]
        if z > a:
            yield within(b.slice(a, z - a), np.array(cuts[first:-1]) - a, *[g[a:z] for g in grid])
        held = _Cluster(k[z])
        held.add(b.slice(z), *[g[z:] for g in grid])
    if held is not None:
        yield from over(held)


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _together(windows: DataFrame, key: list[str], embedding: Column) -> DataFrame:
    """Adds a cluster's key and the vectors as ``__k, __v``; a cluster's rows follow each other."""
    return windows.withColumn("__k", F.to_json(F.struct(*key))).withColumn("__v", embedding).drop("embedding").repartition("__k").sortWithinPartitions("__k")


def centroids(windows: DataFrame, key: list[str], embedding: str = "embedding") -> DataFrame:
    """``*key, centroid, member_count``: element-wise means. Vectors are shuffled once, whole, and a cluster's are added up batch by batch."""
    real = usable(windows, embedding).where("cluster_id is not null and cluster_id <> -1").select(*key, F.col(embedding).alias("__e"))

    def made(rows: pa.RecordBatch, sums: list[np.ndarray], counts: list[np.ndarray], n: list[int]) -> pa.RecordBatch:
        each, of = np.concatenate(sums), np.concatenate(counts)
        ends = np.cumsum([0, *map(len, sums)]).astype(np.int32)
        mean = pa.ListArray.from_arrays(pa.array(ends), pa.array(each / np.maximum(of, 1), mask=of == 0))
        return pa.RecordBatch.from_arrays([*[rows.column(k) for k in key], mean, pa.array(n, pa.int64())], names=[*key, "centroid", "member_count"])

    def within(rows: pa.RecordBatch, cuts: np.ndarray, x: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        runs = list(zip(cuts[:-1], cuts[1:], np.maximum.reduceat(sizes, cuts[:-1])))
        return made(rows.take(pa.array(cuts[:-1])), [x[i:j, :d].sum(0) for i, j, d in runs], [known[i:j, :d].sum(0) for i, j, d in runs], [int(j - i) for i, j, _ in runs])

    def over(c: _Cluster) -> Iterator[pa.RecordBatch]:
        yield made(next(c.parts()).slice(0, 1), [c.sums], [c.counts], [c.rows])

    rows = _together(real, key, F.col("__e")).drop("__e")
    return rows.mapInArrow(lambda batches: _clustered(batches, within, over), f"{_kinds(real, key)}, centroid array<double>, member_count bigint")


def similarities(windows: DataFrame, key: list[str], norms: bool = False) -> DataFrame:
    """The windows without their vectors, with ``sim``: cosine to the own cluster's centroid; 0 for noise and for windows without a vector.

    With ``norms`` the centroid's length as well (``centroid_norm``), null where there is none.
    """
    real = F.lit(True)
    for k in {*key, "cluster_id"}:
        real = real & F.col(k).isNotNull()
    rest = [c for c in windows.columns if c != "embedding"]
    names = [*rest, "sim", *(["centroid_norm"] if norms else [])]

    def cosines(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        d = min(x.shape[1], len(mean))
        with np.errstate(invalid="ignore", divide="ignore"):
            length = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(mean @ mean)
            sim = (x[:, :d] @ mean[:d]) / length
        return np.where(length == 0, 0.0, np.where(np.isnan(sim), 1.0, np.clip(sim, -1, 1)))

    def made(rows: pa.RecordBatch, sim: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        extra = [pa.array(sim, pa.float64()), *([pa.array(length, pa.float64(), mask=length < 0)] if norms else [])]
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in rest], *extra], names=names)

    def within(rows: pa.RecordBatch, cuts: np.ndarray, x: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        sim, length = np.zeros(len(x)), np.full(len(x), -1.0)
        for i, j in zip(cuts[:-1], cuts[1:]):
            if sizes[i:j].any():
                mean = x[i:j].sum(0) / np.maximum(known[i:j].sum(0), 1)
                sim[i:j], length[i:j] = cosines(x[i:j], mean), np.sqrt(mean @ mean)
        return made(rows, sim, length)

    def over(c: _Cluster) -> Iterator[pa.RecordBatch]:
        mean = c.mean()
        for rows in c.parts():
            sim = cosines(_grid(rows.column("__v"))[0], mean) if c.rows else np.zeros(rows.num_rows)
            yield made(rows, sim, np.full(rows.num_rows, np.sqrt(mean @ mean) if c.rows else -1.0))

    rows = _together(windows, key, F.when(real & (F.col("cluster_id") != -1), F.col("embedding")))
    kinds = f"{_kinds(windows, rest)}, sim double" + ", centroid_norm double" * norms
    return rows.mapInArrow(lambda batches: _clustered(batches, within, over), kinds)


def registry(windows: DataFrame, key: tuple[str, ...] = ("job_id", "cluster_id")) -> DataFrame:
    """Per cluster: members, most central window (ties to the lowest index), its pages, and merged instances.

    Clusters whose centroid is the zero vector are dropped. Needs ``page, window_index, doc_char_start, doc_char_end``.
    """
    key, real = list(key), windows.where("cluster_id is not null and cluster_id <> -1")
    sims = similarities(real.select(*key, "window_index", "page", "embedding"), key, norms=True).where("centroid_norm > 0")
    base = sims.groupBy(*key).agg(F.count("*").alias("member_count"), F.max_by("window_index", F.struct("sim", -F.col("window_index"))).alias("central_window"), F.array_sort(F.collect_set("page")).alias("pages"))
    inst = merged(real.where("doc_char_start is not null").select(*key, F.col("doc_char_start").alias("start"), F.col("doc_char_end").alias("end")), key).groupBy(*key).agg(F.count("*").alias("instance_count"))
    hue = F.pmod(F.col("cluster_id").cast("double") * 0.6180339887, F.lit(1.0))
    return base.join(inst, key, "left").withColumn("instance_count", F.coalesce("instance_count", F.lit(0))).withColumn("hue", hue)


def centroid_pairs(cents: DataFrame, job: str, floor: float = SUBPHRASE_FLOOR) -> DataFrame:
    """Pairs of a job's clusters whose centroids are at least ``floor`` alike.

    A job of more than ``SQUARE`` clusters is cut into blocks, and every two of them meet once, so that neither its
    pairs nor its centroids have to be in one task.
    """
    own = cents.select(job, "cluster_id", F.col("centroid").alias("__c"))
    parts = F.ceil(F.count("*") / SQUARE).cast("int")
    blocks = cents.groupBy(job).agg(parts.alias("__n"), F.count("*").alias("__size")).where("__size > 1").drop("__size")
    placed = own.join(blocks, job).withColumn("__b", F.pmod(F.xxhash64("cluster_id"), F.col("__n")).cast("int"))
    met = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    met = met.withColumn("__k", F.to_json(F.struct(job, F.least("__b", "__o").alias("x"), F.greatest("__b", "__o").alias("y")))).withColumn("__side", F.col("__b") > F.col("__o"))
    rows = met.select(job, "cluster_id", "__c", "__side", "__k", (F.col("__b") == F.col("__o")).alias("__same")).repartition("__k").sortWithinPartitions("__k")

    def alike(of: pa.Array, ids: np.ndarray, x: np.ndarray, side: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        left, right = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
        for a in range(0, len(left), 512):
            i = left[a : a + 512]
            with np.errstate(invalid="ignore", divide="ignore"):
                n = length[i][:, None] * length[right]
                s = (x[i] @ x[right].T) / n
            s = np.where(n == 0, 0.0, np.where(np.isnan(s), 1.0, np.clip(s, -1, 1)))
            p, q = np.nonzero((s >= floor) & ((ids[i][:, None] < ids[right]) if same else True))
            u, v = ids[i[p]], ids[right[q]]
            yield pa.RecordBatch.from_arrays([of.take(pa.array(np.zeros(len(p), np.int64))), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(s[p, q])], names=[job, "a", "b", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of one pair of blocks, 2 * SQUARE rows at most on average

        def over() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept).combine_chunks()
            yield from alike(t.column(job).chunk(0).slice(0, 1), t.column("cluster_id").to_numpy(), _grid(t.column("__c").chunk(0))[0], t.column("__side").to_numpy(), t.column("__same")[0].as_py())

        last = None
        for b in batches:
            if b.num_rows:
                k = b.column("__k").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
                for i, j in zip(cuts[:-1], cuts[1:]):
                    if kept and k[i] != last:
                        yield from over()
                        kept.clear()
                    kept.append(b.slice(i, j - i))
                    last = k[i]
        if kept:
            yield from over()

    return rows.mapInArrow(run, f"{_kinds(cents, [job])}, a {cents.schema['cluster_id'].dataType.simpleString()}, b {cents.schema['cluster_id'].dataType.simpleString()}, sim double")


def nearest_centroid(windows: DataFrame, cents: DataFrame, job: str, least: float) -> DataFrame:
    """Each window's most similar cluster of its job at or above ``least`` (ties to the lowest id), else -1."""
    met = windows.select(job, "window_index", "embedding").join(cents.select(job, F.col("cluster_id").alias("c"), "centroid"), job, "left")
    sim = cosine(F.col("embedding"), F.col("centroid"))
    best = met.withColumn("sim", sim).groupBy(job, "window_index").agg(F.max(F.when(F.col("sim") >= least, F.struct("sim", (-F.col("c")).alias("n")))).alias("best"))
    return best.select(job, "window_index", F.coalesce(-F.col("best.n"), F.lit(-1)).cast("int").alias("cluster_id"))


# --- one job's vectors in memory: the reference's algorithms are sequential within a job


def leader_labels(x: np.ndarray, smallest: int, floor: float = LEADER_FLOOR) -> np.ndarray:
    """Each vector joins the most similar running mean at or above ``floor`` (ties to the later cluster) or founds one."""
    sums, norms, counts, label = np.zeros((16, x.shape[1])), np.zeros(16), [], np.full(len(x), -1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for i, v in enumerate(x):
        k = len(counts)
        sim = (sums[:k] @ unit[i]) / np.maximum(norms[:k], 1e-12)
        best = k - 1 - int(np.argmax(sim[::-1])) if k else -1
        if best < 0 or sim[best] < floor:
            if k == len(sums):
                sums, norms = np.vstack([sums, np.zeros_like(sums)]), np.r_[norms, np.zeros_like(norms)]
            best = k
            counts.append(0)
        sums[best] += v
        norms[best] = np.linalg.norm(sums[best])
        counts[best] += 1
        label[i] = best
    keep = {c: n for n, c in enumerate(c for c in range(len(counts)) if counts[c] >= smallest)}
    return np.array([keep.get(c, -1) for c in label], np.int64)


def hdbscan_labels(x: np.ndarray, smallest: int, samples: int) -> np.ndarray:
    """Density clusters: mutual reachability, minimum spanning tree, condensed tree, excess of mass.

    Distances are computed ``CELLS`` at a time, so memory beside the vectors doesn't grow with their number squared or by
    blocks of them. Equal distances are taken in index order.
    """
    n = len(x)
    if n <= samples or n < 2:
        return np.full(n, -1, np.int64)
    x = np.asarray(x, np.float64)
    sq, kth, block = np.einsum("ij,ij->i", x, x), min(samples, n - 1), max(1, CELLS // n)
    core = np.empty(n)
    for a in range(0, n, block):
        d = x[a : a + block] @ x.T
        d *= -2
        d += sq[a : a + block, None] + sq
        d.partition(kth, axis=1)
        core[a : a + block] = np.sqrt(np.maximum(d[:, kth], 0))
    best, by, inside, edges, at = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool), [], 0
    for _ in range(n - 1):
        inside[at] = True
        least = np.maximum(core, core[at])
        rows = np.flatnonzero(~inside & (least < best))  # no other row can come nearer
        dots = x[rows] @ x[at] if 3 * len(rows) < n else (x @ x[at])[rows]
        d = np.maximum(np.sqrt(np.maximum(sq[at] + sq[rows] - 2 * dots, 0)), least[rows])
        better = d < best[rows]
        best[rows[better]], by[rows[better]] = d[better], at
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[nxt], int(by[nxt]), nxt))
        at = nxt
    # single-linkage tree
    parent, size, tree = list(range(2 * n - 1)), [1] * n, []
    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for d, a, b in sorted(edges):
        ra, rb = root(a), root(b)
        new = n + len(tree)
        tree.append((ra, rb, d))
        size.append(size[ra] + size[rb])
        parent[ra] = parent[rb] = new
    # condensed tree, from the top: children smaller than the least size fall out of their cluster
    birth, stability, kids, fell, split = {0: 0.0}, {0: 0.0}, {0: []}, [], 1
    todo = [(2 * n - 2, 0)]
    members: dict[int, list[int]] = {0: []}
    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += tree[k - n][:2]
        return out
    while todo:
        node, cluster = todo.pop()
        if node < n:
            members[cluster].append(node)
            continue
        a, b, d = tree[node - n]
        lam = 1 / d if d > 0 else 1e12
        big = [c for c in (a, b) if size[c] >= smallest]
        for c in (a, b):
            if len(big) == 2:
                birth[split], stability[split], kids[split], members[split] = lam, 0.0, [], []
                kids[cluster].append(split)
                stability[cluster] += (lam - birth[cluster]) * size[c]
                todo.append((c, split))
                split += 1
            elif c in big:
                todo.append((c, cluster))
            else:
                gone = leaves(c)
                stability[cluster] += (lam - birth[cluster]) * len(gone)
                members[cluster] += gone
    chosen: set[int] = set()
    score = dict(stability)
    for c in sorted(kids, reverse=True):
        below = sum(score[k] for k in kids[c])
        if c and (not kids[c] or stability[c] >= below):
            stack = list(kids[c])
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += kids[k]
            chosen.add(c)
        elif kids[c]:
            score[c] = below
    label = np.full(n, -1, np.int64)
    for no, c in enumerate(sorted(chosen)):
        stack = [c]
        while stack:
            k = stack.pop()
            label[members[k]] = no
            stack += kids[k]
    return label


def _means(x: np.ndarray, rows: np.ndarray, near: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Mean of the ``rows`` of each centre; a centre without any stays."""
    order, out = np.argsort(near, kind="stable"), centre.copy()
    ends = np.searchsorted(near[order], np.arange(len(centre) + 1))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            out[k] = x[rows[order[a:b]]].mean(0)
    return out


def stabilised(x: np.ndarray, label: np.ndarray, least: int = 3) -> np.ndarray:
    """k-means over the members of clusters of at least ``least``, with as many centres; all others are noise.

    With no such cluster the labels pass through.
    """
    known, counts = np.unique(label[label >= 0], return_counts=True)
    known = known[counts >= least]
    if not len(known):
        return label
    rows = np.flatnonzero(np.isin(label, known))
    near, block = np.searchsorted(known, label[rows]), max(1, CELLS // len(known))
    centre = _means(x, rows, near, np.zeros((len(known), x.shape[1])))
    for _ in range(ROUNDS):
        near, size = np.empty(len(rows), np.int64), (centre * centre).sum(1)
        for a in range(0, len(rows), block):
            part = x[rows[a : a + block]]
            near[a : a + block] = np.argmin((part * part).sum(1)[:, None] - 2 * part @ centre.T + size, axis=1)
        moved = _means(x, rows, near, centre)
        shift, centre = np.abs(moved - centre).max(), moved
        if shift < TOLERANCE:
            break
    out = np.full(len(x), -1, np.int64)
    out[rows] = near
    return out


def cluster_jobs(windows: DataFrame, params: AnalysisParams) -> DataFrame:
    """``job_id, window_index, hdbscan_label, cluster_id`` of every window; windows without a vector are noise.

    Density or leader clusters are stabilised by k-means into ``cluster_id``; ``hdbscan_label`` holds the density
    clusters and is -1 throughout where leader clustering runs. A job without any cluster is noise throughout.
    """
    smallest = min_cluster_size(params.min_repetitions, params.window_size, params.stride)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("window_index", ignore_index=True)
        ok = f["embedding"].map(lambda e: e is not None and len(e) > 0).to_numpy(bool)
        first = np.full(len(f), -1, np.int64)
        second = first.copy()
        if ok.any():
            vectors = f.pop("embedding")[ok]
            x = np.empty((len(vectors), len(vectors.iloc[0])))
            for i, v in enumerate(vectors):
                x[i] = v
            del vectors
            if params.enable_hdbscan:
                first[ok] = hdbscan_labels(x, smallest, params.min_samples)
                second[ok] = stabilised(x, first[ok])
            else:
                second[ok] = stabilised(x, leader_labels(x, smallest))
        return pd.DataFrame({"job_id": f["job_id"], "window_index": f["window_index"], "hdbscan_label": first, "cluster_id": second})

    kind = windows.schema["job_id"].dataType.simpleString()
    return windows.select("job_id", "window_index", "embedding").groupBy("job_id").applyInPandas(run, f"job_id {kind}, window_index int, hdbscan_label int, cluster_id int")


def subphrase_links(windows: DataFrame, floor: float = SUBPHRASE_FLOOR) -> DataFrame:
    """Renumbered ``job_id, window_index, cluster_id`` after clusters that are phrases of others are joined to them.

    A cluster goes into one with a similar centroid and longer text when at least half of its windows' texts stand,
    whatever their case and surrounding white space, in a text of the other on the same page; blank texts stand in
    none. Of two equally long clusters the earlier one takes in the later. Ids then follow the first window's order.
    """
    windows = windows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))  # windows without a label are noise
    cents = centroids(windows, ["job_id", "cluster_id"])
    pairs = centroid_pairs(cents, "job_id", floor)
    length = windows.where("cluster_id <> -1").groupBy("job_id", "cluster_id").agg(F.avg(F.octet_length("text")).alias("len"))
    both = pairs.join(length.select("job_id", F.col("cluster_id").alias("a"), F.col("len").alias("la")), ["job_id", "a"]).join(length.select("job_id", F.col("cluster_id").alias("b"), F.col("len").alias("lb")), ["job_id", "b"])
    sides = both.select("job_id", F.when(F.col("la") < F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("child"), F.when(F.col("la") < F.col("lb"), F.col("b")).otherwise(F.col("a")).alias("parent"))
    low = windows.select("job_id", "window_index", "cluster_id", "page", F.lower("text").alias("t"))
    kid = sides.join(low.withColumnRenamed("cluster_id", "child"), ["job_id", "child"]).withColumn("t", trimmed(F.col("t")))
    inside = kid.join(low.select("job_id", F.col("cluster_id").alias("parent"), "page", F.col("t").alias("pt")), ["job_id", "parent", "page"], "left").groupBy("job_id", "child", "parent", "window_index").agg(F.max(F.coalesce((F.col("t") != "") & F.col("pt").contains(F.col("t")), F.lit(False))).alias("hit"))
    sub = inside.groupBy("job_id", "child", "parent").agg(F.avg(F.col("hit").cast("int")).alias("share")).where("share >= 0.5")
    comp = connected_components(sub.select(F.struct("job_id", F.col("child").alias("c")).alias("a"), F.struct("job_id", F.col("parent").alias("c")).alias("b")))
    moved = windows.join(comp.select(F.col("node.job_id").alias("job_id"), F.col("node.c").alias("cluster_id"), F.col("component.c").alias("root")), ["job_id", "cluster_id"], "left")
    root = F.when(F.col("cluster_id") == -1, -1).otherwise(F.coalesce("root", "cluster_id"))
    first = F.min("window_index").over(Window.partitionBy("job_id", "__r"))
    rows = moved.withColumn("__r", root).withColumn("__f", F.when(F.col("__r") != -1, first))
    rank = F.dense_rank().over(Window.partitionBy("job_id").orderBy(F.col("__f").asc_nulls_last()))
    return rows.withColumn("cluster_id", F.when(F.col("__r") == -1, -1).otherwise(rank - 1)).select("job_id", "window_index", "cluster_id")


