"""Problem 2: the most similar vectors of every vector, by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random directions; each projection is one hash array. Two
vectors collide in an array when their values lie within the query-centred window of half-width
``radius``; a pair that collides in at least a threshold share of the arrays is a candidate and is
verified, first by the projections' squared distance, then by its exact cosine. Windows are centred on the
query, so no pair is lost at a window's edge.

To distribute the arrays, each of ``TABLES`` tables (more where keys are longer, see ``n_tables``) takes ``depth`` of the arrays at their coarsest level
(below or above the centre: one virtual-rehashing level that holds half of the array) as the partition
key; inside a partition the arrays are expanded from a narrow window over a first batch of arrays to the
full count over all of them. Partitions hold ``BLOCK / 2`` members on average; one with more than ``CROWD * BLOCK``
(a dense cluster) is cut into blocks whose pairs are counted as separate tasks, so that dense data lose no
pair that others would find. Nothing is capped.

Only 8-bit projections are shuffled; the vectors themselves are read again for the candidates alone.
Equal vectors form one class and are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.runtime import cut, table

PROJECTIONS, FIRST, TABLES, SEED = 64, 16, 16, 7
#: Twice the members of an average partition, how often that makes a block of a crowded one, and key bits a table has.
BLOCK, CROWD, DEEPEST = 1024, 4, 24
#: Share of the pairs at the limit of similarity that meet in a table at least.
MEET = 0.99
#: 8-bit steps per unit of projected value (unit vectors, directions of unit variance per coordinate).
STEPS = 32.0
#: Candidate ids up to which the second read of the vectors is filtered by a broadcast set.
BROADCAST_IDS = 2_000_000
#: Crowded partitions up to which their list is broadcast; bytes of codes a task counts.
BROADCAST_BUCKETS, TASK = 100_000, 16 << 20


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS)).astype(np.float32)


def key_bits(n: int) -> int:
    """Key bits of a collection of ``n`` vectors."""
    return int(np.clip(np.ceil(np.log2(max(n, 1) / (BLOCK / 2))), 0, DEEPEST))


def n_tables(bits: int, min_cosine: float) -> int:
    """Tables in which ``MEET`` of the pairs at the limit agree on all key bits at least once."""
    one = (1 - np.arccos(np.clip(min_cosine, -1, 1)) / np.pi) ** bits
    return TABLES if one >= 1 else max(TABLES, int(np.ceil(np.log(1 - MEET) / np.log1p(-one))))


def table_arrays(tables: int = TABLES) -> np.ndarray:
    """Which array gives bit ``k`` of table ``t``."""
    rng = np.random.default_rng(SEED + 1)
    return np.stack([rng.permutation(PROJECTIONS)[:DEEPEST] for _ in range(tables)])


def usable(embedding: str, dim: int | None) -> F.Column:
    c = F.col(embedding)
    ok = c.isNotNull() & (F.size(c) > 0)
    return ok if dim is None else ok & (F.size(c) == dim)


def unit_rows(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Stacked vectors scaled to unit length, and which rows have a finite non-zero one."""
    x = np.stack(column.to_numpy()).astype(np.float32)
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(n) & (n > 0)
    with np.errstate(all="ignore"):
        return x / n[:, None].astype(np.float32), ok


def thresholds(min_cosine: float) -> tuple[int, int, int, float]:
    """Window half-width in steps, collisions required over the first batch and over all arrays, and the
    largest sum of squared differences.

    The difference of two unit vectors at the limit has projected deviation ``sqrt(2 - 2 cos)``; with the
    half-width at 1.2 deviations an array collides with chance 0.77. The counts lie 3.5 and 2.5 deviations
    below their means, the sum of squares 2.5 above its own.
    """
    spread = np.sqrt(2 - 2 * min_cosine)
    p = 0.77
    least = lambda n, by: int(np.floor(n * p - by * np.sqrt(n * p * (1 - p))))
    most = PROJECTIONS * (1 + 2.5 * np.sqrt(2 / PROJECTIONS)) * (spread * STEPS) ** 2
    return max(1, round(1.2 * spread * STEPS)), least(FIRST, 3.5), least(PROJECTIONS, 2.5), most


def count_collisions(codes: np.ndarray, own: np.ndarray | None, radius: int, first: int, every: int, most: float, square: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``i < j`` that collide often enough; with ``own``, sorted, only pairs of different blocks."""
    n, out = len(codes), []
    cols = np.ascontiguousarray(codes.T)
    two = np.uint8(2 * radius)
    for a in range(0, n, square):
        for b in range(a, n, square):
            if own is not None and own[a] == own[min(b + square, n) - 1]:
                continue
            left, right = cols[:, a : a + square], cols[:, b : b + square]
            hits = np.zeros((left.shape[1], right.shape[1]), np.uint8)
            for k in range(FIRST):
                # a difference that wraps around counts as a collision too; the later arrays and the verification drop it
                hits += (left[k][:, None] - right[k][None, :] + np.uint8(radius)) <= two
            i, j = np.nonzero(hits >= first)
            i, j = i + a, j + b
            ok = i < j
            if own is not None:
                ok &= own[i] != own[j]
            i, j = i[ok], j[ok]
            if len(i):
                for x in range(0, len(i), 100_000):
                    p, q = i[x : x + 100_000], j[x : x + 100_000]
                    far = codes[p].view(np.int8).astype(np.float32) - codes[q].view(np.int8).astype(np.float32)
                    ok = ((np.abs(far) <= radius).sum(1) >= every) & (np.einsum("ij,ij->i", far, far) <= most)
                    out.append((p[ok], q[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def sketches(vectors: DataFrame, dim: int, tables: int = TABLES) -> DataFrame:
    """``vectors(cid, embedding)`` -> ``cid, codes binary, keys array<int>``: 8-bit projections and each table's key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, arrays = directions(dim), table_arrays(tables)
        weight = (1 << np.arange(DEEPEST - 1, -1, -1)).astype(np.int64)
        for f in frames:
            if not len(f):
                continue
            x, ok = unit_rows(f["embedding"])
            p = x[ok] @ d
            codes = np.clip(np.rint(p * STEPS), -127, 127).astype(np.int8)
            keys = (p > 0)[:, arrays].astype(np.int64) @ weight
            yield pd.DataFrame({"cid": f["cid"].to_numpy()[ok], "codes": [r.tobytes() for r in codes], "keys": list(keys.astype(np.int32))})

    return vectors.mapInPandas(run, "cid bigint, codes binary, keys array<int>")


def candidate_pairs(known: DataFrame, min_cosine: float) -> DataFrame:
    """``known(cid, codes, keys)``, distinct ``cid`` -> candidate pairs ``a < b``."""
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("keys")), F.lit(0)).alias("tables")).first()
    at = F.shiftright("key", DEEPEST - key_bits(size["n"]))
    rows = known.select(F.posexplode("keys").alias("t", "key"), "cid", "codes").withColumn("at", at)
    crowd = rows.groupBy("t", "at").agg(F.count("*").alias("n")).where(F.col("n") > CROWD * BLOCK)
    crowd = cut(crowd.select("t", "at", F.ceil(F.col("n") / (CROWD * BLOCK)).cast("int").alias("blocks")))
    few = F.broadcast(crowd) if crowd.count() <= BROADCAST_BUCKETS else crowd
    placed = rows.join(few, ["t", "at"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    node = F.xxhash64("t", "at", F.least("own", "other"), F.greatest("own", "other"))
    keyed = placed.select(node.alias("node"), "own", (F.col("own") != F.col("other")).alias("cross"), "cid", "codes")
    limits = thresholds(min_cosine)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(f) < 2:
                return
            node = f["node"].to_numpy()
            codes = np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), PROJECTIONS).copy()
            ids, own, cross = f["cid"].to_numpy(copy=True), f["own"].to_numpy(copy=True), f["cross"].to_numpy()
            edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    if cross[a]:
                        order = a + np.argsort(own[a:b], kind="stable")
                        codes[a:b], ids[a:b], own[a:b] = codes[order], ids[order], own[order]
                    i, j = count_collisions(codes[a:b], own[a:b] if cross[a] else None, *limits)
                    if len(i):
                        found.append((ids[a:b][i], ids[a:b][j]))
            if found:
                x, y = (np.concatenate(c) for c in zip(*found))
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

        kept = None
        for f in frames:
            f = f if kept is None else pd.concat([kept, f], ignore_index=True)
            before = np.flatnonzero(f["node"].to_numpy() != f["node"].iloc[-1]) if len(f) else []
            if len(f) < 20_000 or not len(before):
                kept = f
                continue
            yield from flush(f.iloc[: before[-1] + 1])
            kept = f.iloc[before[-1] + 1 :]
        if kept is not None:
            yield from flush(kept)

    # tasks of a fixed size, whatever the session's number of partitions
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] * size["tables"] * (PROJECTIONS + 32) // TASK))
    return keyed.repartition(parts, "node").sortWithinPartitions("node").mapInPandas(walk, "a bigint, b bigint").distinct()


def exact_cosines(src: DataFrame, pairs: DataFrame, min_cosine: float) -> DataFrame:
    """``a, b, cosine`` of the pairs of ``cid`` at or above ``min_cosine``, from the vectors of ``src(cid, embedding)``."""
    wanted = cut(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, ok = unit_rows(f["embedding"])
                yield pd.DataFrame({"cid": f["cid"].to_numpy()[ok], "v": [r.tobytes() for r in x[ok]]})

    vectors = cut(src.join(few, "cid", "left_semi").select("cid", "embedding").dropDuplicates(["cid"]).mapInPandas(scale, "cid bigint, v binary"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.float32).reshape(len(f), -1).astype(np.float64) for c in ("va", "vb"))
                s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                ok = s >= min_cosine
                yield pd.DataFrame({"a": f["a"].to_numpy()[ok], "b": f["b"].to_numpy()[ok], "cosine": np.minimum(s[ok], 1.0)})

    both = pairs.join(vectors.select(F.col("cid").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b")
    return both.mapInPandas(verify, "a bigint, b bigint, cosine double")


def nearest_vectors(df: DataFrame, key: str, embedding: str, dim: int, k: int = 10, min_cosine: float = 0.93) -> DataFrame:
    """``id, neighbour, cosine, rank``: the up to ``k`` most similar other ids at or above ``min_cosine``.

    Null, empty, wrongly sized, non-finite and zero vectors have no neighbours; repeated rows of one key with
    the same vector count once; a key with several vectors takes part with each, its best cosine counts.
    Ties go to the smaller id. Recall against brute force is measured by the tests (0.97 and more).
    """
    src = df.select(F.col(key).alias("id"), F.col(embedding).alias("embedding")).where(F.col("id").isNotNull() & usable("embedding", dim))
    src = src.withColumn("cid", F.xxhash64("embedding"))
    members = cut(src.select("id", "cid").distinct())
    tables = n_tables(key_bits(members.select("cid").distinct().count()), min_cosine)
    known = cut(sketches(src.select("cid", "embedding"), dim, tables).dropDuplicates(["cid"]))
    pairs = cut(candidate_pairs(known, min_cosine))
    close = cut(exact_cosines(src, pairs, min_cosine))
    usable_cids = known.select("cid")
    shared = members.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid")
    copies = shared.join(usable_cids, "cid", "left_semi").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("cosine"))
    links = close.union(close.select("b", "a", "cosine")).union(copies)
    return _ranked(links, members, members.join(usable_cids, "cid", "left_semi"), k)


def _ranked(links: DataFrame, members: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """``id, neighbour, cosine, rank`` from ``links(a, b, cosine)`` between classes of equal vectors: ``members`` of ``a`` get the
    ``k`` most similar of ``others`` in ``b``, ties to the smaller id."""
    # of a class of equal vectors, k + 1 members are enough for anyone's k nearest under the tie rule
    place = Window.partitionBy("cid").orderBy("id")
    top = others.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).select("cid", F.col("id").alias("neighbour"))
    met = links.join(members.withColumnRenamed("cid", "a"), "a").join(top.withColumnRenamed("cid", "b"), "b").where("id <> neighbour")
    best = met.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Query vectors held at once by every task (25 MB at 384 values), and vectors compared with them at once.
HELD, STRIP = 16_384, 512


def nearest_of_queries(df: DataFrame, key: str, embedding: str, dim: int, k: int = 10, every: int = 20) -> DataFrame:
    """``id, neighbour, cosine, rank``: the ``k`` most similar other ids of a stated query set, however dissimilar, without loss.

    The query set is every id whose hash is divisible by ``every``. Queries are compared with all vectors in blocks of
    ``HELD``; each task keeps the ``k`` best of each query. Nulls, repeated rows and ties are handled as by ``nearest_vectors``;
    an id has fewer than ``k`` rows only where there are no more vectors.
    """
    src = df.select(F.col(key).alias("id"), F.col(embedding).alias("embedding")).where(F.col("id").isNotNull() & usable("embedding", dim)).withColumn("cid", F.xxhash64("embedding"))

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, ok = unit_rows(f["embedding"])
                yield pd.DataFrame({"id": f["id"][ok], "cid": f["cid"][ok], "v": [r.tobytes() for r in x[ok]]})

    kind = src.schema["id"].dataType.simpleString()
    asked = cut(src.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInPandas(scale, f"id {kind}, cid bigint, v binary"))
    blocks = max(1, -(-asked.select("cid").distinct().count() // HELD))
    own = asked.dropDuplicates(["cid"]).select("cid", "v").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(blocks)))
    own, spark, found = cut(own), df.sparkSession, None
    for b in range(blocks):
        held = own.where(F.col("block") == b).select("cid", "v").collect()
        shared = spark.sparkContext.broadcast((np.array([r["cid"] for r in held], np.int64), b"".join(r["v"] for r in held)))
        del held

        def compare(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            queries, v = shared.value
            q = np.frombuffer(v, np.float32).reshape(-1, dim)
            best, who = np.full((len(q), k), -2.0, np.float32), np.zeros((len(q), k), np.int64)
            for f in frames:
                f = f[~f["cid"].duplicated().to_numpy()]
                if not len(f) or not len(q):
                    continue
                x, ok = unit_rows(f["embedding"])
                x, cid = x[ok], f["cid"].to_numpy()[ok]
                for a in range(0, len(x), STRIP):
                    s, theirs = q @ x[a : a + STRIP].T, cid[a : a + STRIP]
                    i, j = np.nonzero(s > best[:, -1:])
                    if not len(i):
                        continue
                    fresh = (queries[i] != theirs[j]) & ~(who[i] == theirs[j][:, None]).any(1)  # copies across batches count once
                    i, j = i[fresh], j[fresh]
                    order = np.lexsort((-s[i, j], i))
                    i, j = i[order], j[order]
                    at = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, at = i[at < k], j[at < k], at[at < k]
                    rows, place = np.unique(i, return_inverse=True)
                    more, names = np.full((len(rows), k), -2.0, np.float32), np.zeros((len(rows), k), np.int64)
                    more[place, at], names[place, at] = s[i, j], theirs[j]
                    both, ids = np.concatenate([best[rows], more], 1), np.concatenate([who[rows], names], 1)
                    top = np.argsort(-both, 1, kind="stable")[:, :k]
                    best[rows], who[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
            i, j = np.nonzero(best > -2)
            yield pd.DataFrame({"a": queries[i], "b": who[i, j], "cosine": np.minimum(best[i, j].astype(float), 1.0)})

        one = src.select("cid", "embedding").mapInPandas(compare, "a bigint, b bigint, cosine double")
        order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
        one = cut(one.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("a", "b", "cosine"))
        shared.destroy()
        found = one if found is None else found.union(one)
    asking, all_ = cut(asked.select("id", "cid").distinct()), cut(src.select("id", "cid").distinct())
    same = asking.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("cosine")).distinct()
    return _ranked(found.union(same), asking, all_, k)


DIM, K, MIN_COSINE = 384, 10, 0.93


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p2_neighbours(spark, sf_dir)
    return near.select(F.least("window_id", "neighbour").alias("window_a"), F.greatest("window_id", "neighbour").alias("window_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's most similar windows at or above 0.93, with their cosine and rank."""
    near = nearest_vectors(table(spark, sf_dir, "windows"), "window_id", "embedding", DIM, K, MIN_COSINE)
    return near.select(F.col("id").alias("window_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar windows of one window in twenty, however dissimilar: the exact answer to measure the others by."""
    near = nearest_of_queries(table(spark, sf_dir, "windows"), "window_id", "embedding", DIM, K)
    return near.select(F.col("id").alias("window_id"), "neighbour", F.round("cosine", 4).alias("cosine"), "rank")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_nearest": p2_nearest}
#: Every usable vector against every other, by window; a window with several vectors counts by its best.
SQL_VECTORS = "v AS (SELECT DISTINCT window_id, CAST(embedding AS FLOAT[384]) AS e FROM windows WHERE window_id IS NOT NULL AND len(embedding) = 384 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0)"
ORACLE = {
    "p2_found": f"""WITH {SQL_VECTORS}, s AS (SELECT a.window_id AS x, b.window_id AS y, max(array_cosine_similarity(a.e, b.e)) AS c FROM v a JOIN v b ON a.window_id <> b.window_id WHERE array_cosine_similarity(a.e, b.e) >= 0.93 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM s) SELECT DISTINCT least(x, y) AS window_a, greatest(x, y) AS window_b FROM r WHERE r <= 10""",
}
