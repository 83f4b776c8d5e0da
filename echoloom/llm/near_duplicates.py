"""Problem 6: groups of records that are the same but for small edits.

Every record's set of 5-token shingles becomes a 128-bit sketch (one bit of each of 128 minhashes),
whose Hamming distance estimates the Jaccard similarity. The sketches are joined with themselves by
walking a binary trie: pairs of trie nodes are traversed together, differing bits are accumulated, and
a node pair is dropped as soon as its differences exceed the error budget. To distribute it, the trie's
top levels are the minhash bands: each band value roots an independent sub-trie. A root with more
members than ``block_rows`` is cut into blocks, and pairs of blocks are walked as separate sub-tries.
Survivors are verified by the exact Jaccard similarity of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.operators.graph import connected_components
from echoloom.plans.catalogue import SQL_TOKENS
from echoloom.runtime import cut, table

WORD = regex.compile(r"[\p{Alphabetic}\p{N}']+")
BITS, BANDS, ROWS = 128, 20, 3
#: Differing bits allowed: at similarity 0.72 a bit differs with chance 0.14; mean + 4.2 deviations of 128 bits.
SLACK = 4.2
BASE = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(tokens: list[str], size: int, cache: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the token runs; a text shorter than ``size`` is one shingle."""
    import xxhash

    if not tokens:
        return np.zeros(0, np.uint64)
    ids = []
    for t in tokens:
        h = cache.get(t)
        if h is None:
            h = cache[t] = xxhash.xxh64_intdigest(t)
        ids.append(h)
    h = np.array(ids, np.uint64)
    n = max(1, len(h) - size + 1)
    acc = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        acc = acc * BASE + h[k : k + n]
    return np.unique(mix(acc + np.uint64(min(size, len(h)))))


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):  # long texts in blocks
        h = shingles[i : i + 4096, None] * a + b
        out = np.minimum(out, (h ^ (h >> np.uint64(29))).min(0))
    return out


def error_budget(threshold: float) -> int:
    p = (1 - threshold) / 2
    return int(np.ceil(BITS * p + SLACK * np.sqrt(BITS * p * (1 - p))))


def trie_pairs(roots: np.ndarray, sketches: np.ndarray, budget: int, leaf: int = 64, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i, j`` with one root and at most ``budget`` differing bits.

    ``roots``: uint64 per row; ``sketches``: uint64[n, 2]. Node pairs whose product of sizes is at most
    ``leaf`` are compared directly; all others descend one bit at a time, whole levels at once.
    """
    order = np.lexsort((sketches[:, 1], sketches[:, 0], roots))
    roots, sk = roots[order], sketches[order]
    starts = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]) if len(roots) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(roots)]
    keep = ends - starts > 1
    al, ah = starts[keep], ends[keep]
    bl, bh, diff = al.copy(), ah.copy(), np.zeros(len(al), np.int64)

    def direct(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = (ah - al) * (bh - bl)
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + chunk, chunk), side="right")
        for x, y in zip(cuts, np.r_[cuts[1:], len(size)]):
            if x == y:
                continue
            s = size[x:y]
            node = np.repeat(np.arange(x, y), s)
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            w = (bh - bl)[node]
            i, j = al[node] + k // w, bl[node] + k % w
            ok = i < j
            i, j = i[ok], j[ok]
            ham = np.bitwise_count(sk[i] ^ sk[j]).sum(1)
            ok = ham <= budget
            yield order[i[ok]], order[j[ok]]

    for bit in range(BITS + 1):
        if not len(al):
            return
        small = ((ah - al) * (bh - bl) <= leaf) | (bit == BITS)
        if small.any():
            yield from direct(al[small], ah[small], bl[small], bh[small])
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if bit == BITS or not len(al):
            return
        ones = np.r_[0, np.cumsum((sk[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1))].astype(np.int64)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        kids = [(al, am, bl, bm, diff, None), (am, ah, bm, bh, diff, None), (al, am, bm, bh, diff + 1, None), (am, ah, bl, bm, diff + 1, ~same)]
        parts = []
        for ka, kb, kc, kd, kf, only in kids:
            ok = (ka < kb) & (kc < kd) & (kf <= budget)
            if only is not None:
                ok &= only
            parts.append([x[ok] for x in (ka, kb, kc, kd, kf)])
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").distinct()


def _set_id(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def sketch_sets(df: DataFrame, key: str, text: str, size: int, keep: bool = True) -> DataFrame:
    """``id, cid, hi, lo bigint, bands array<bigint>``, one row per distinct ``(id, text)`` with a token, and with ``keep`` the
    set itself, ``sh array<bigint>``. ``cid`` is the set's hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(BITS)
        cache: dict[str, int] = {}
        for f in frames:
            rows = []
            for i, t in zip(f["id"], f["t"]):
                s = shingle_hashes(WORD.findall(t.lower()), size, cache)
                if not len(s):
                    continue
                m = minhashes(s, a, b)
                bits = np.packbits((m >> np.uint64(17)).astype(np.uint8) & 1).tobytes()
                hi, lo = np.frombuffer(bits, ">i8").astype(np.int64).tolist()
                band = np.zeros(BANDS, np.uint64)
                for r in range(ROWS):
                    band = mix(band * BASE + m[r * BANDS : (r + 1) * BANDS])
                band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64))
                rows.append((i, _set_id(s), hi, lo, band.view(np.int64), *((s.view(np.int64),) if keep else ())))
            if len(cache) > 1_000_000:
                cache.clear()
            yield pd.DataFrame(rows, columns=["id", "cid", "hi", "lo", "bands", *(("sh",) if keep else ())])

    src = _texts(df, key, text)
    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, cid bigint, hi bigint, lo bigint, bands array<bigint>" + (", sh array<bigint>" if keep else ""))


def shingle_sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``cid, sh array<bigint>`` of every distinct set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for f in frames:
            sets = [shingle_hashes(WORD.findall(t.lower()), size, cache) for t in f["t"]]
            sets = [s for s in sets if len(s)]
            if len(cache) > 1_000_000:
                cache.clear()
            yield pd.DataFrame({"cid": [_set_id(s) for s in sets], "sh": [s.view(np.int64) for s in sets]})

    return _texts(df, key, text).mapInPandas(run, "cid bigint, sh array<bigint>").dropDuplicates(["cid"])


def trie_links(sets: DataFrame, threshold: float, block_rows: int = 4096) -> DataFrame:
    """``a, b`` of the sets (``id, hi, lo, bands``) that share a root and differ by no more bits than the budget allows, ``a < b``."""
    rows = sets.select(F.explode("bands").alias("root"), "id", "hi", "lo")
    crowd = rows.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    placed = rows.join(crowd.select("root", "blocks"), "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "own", (F.col("own") != F.col("other")).alias("cross"), "id", "hi", "lo")
    budget = error_budget(threshold)
    kind = sets.schema["id"].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            sk = f[["hi", "lo"]].to_numpy(np.int64).view(np.uint64)
            ids, own, cross = f["id"].to_numpy(), f["own"].to_numpy(), f["cross"].to_numpy()
            for i, j in trie_pairs(f["node"].to_numpy(np.int64).view(np.uint64), sk, budget):
                ok = ~cross[i] | (own[i] != own[j])  # a pair of blocks only yields pairs across
                i, j = i[ok], j[ok]
                x, y = ids[i], ids[j]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

        kept = None
        for f in frames:
            f = f if kept is None else pd.concat([kept, f], ignore_index=True)
            last = np.flatnonzero(f["node"].to_numpy() != f["node"].iloc[-1]) if len(f) else []
            if len(f) < 20_000 or not len(last):
                kept = f
                continue
            yield from flush(f.iloc[: last[-1] + 1])
            kept = f.iloc[last[-1] + 1 :]
        if kept is not None and len(kept):
            yield from flush(kept)

    return keyed.repartition("node").sortWithinPartitions("node").mapInPandas(walk, f"a {kind}, b {kind}").where("a < b").distinct()


def verified(links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the links whose sets (``id, sh``) have at least ``threshold`` in common."""
    both = links.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    sim = common / (F.size("sa") + F.size("sb") - common)
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def near_pairs(sets: DataFrame, threshold: float, block_rows: int = 4096) -> DataFrame:
    """``a, b, similarity`` of distinct sets (``id, sh, hi, lo, bands``) at or above ``threshold``, ``a < b``."""
    return verified(trie_links(sets, threshold, block_rows), sets, threshold)


#: Linked records up to which the second read of the texts is filtered by a broadcast set.
BROADCAST_IDS = 2_000_000


def near_duplicates(df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of equal shingle sets, and the classes.

    Returns ``links(a, b, similarity)`` between classes and ``members(id, cid, class_id)``; ``a``, ``b`` and
    ``cid`` are hashes of the set, ``class_id`` is the smallest id that has it. Null or token-free texts are in no class; a key with
    several texts is in several classes; repeated rows count once; other columns are ignored. Only sketches are kept of all
    records; the sets of those that link are built again from their texts.
    """
    sketched = cut(sketch_sets(df, key, text, size, keep=False))
    own = sketched.groupBy("cid").agg(F.min("id").alias("class_id"), F.min_by(F.struct("hi", "lo", "bands"), "id").alias("k"))
    members = sketched.select("id", "cid").join(own.select("cid", "class_id"), "cid").select("id", "cid", "class_id").distinct()
    links = cut(trie_links(own.select(F.col("cid").alias("id"), "k.*"), threshold))
    ends = links.select(F.col("a").alias("cid")).union(links.select("b")).distinct()
    wanted = cut(own.join(ends, "cid", "left_semi").select(F.col("class_id").alias(key)).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = cut(shingle_sets(df.select(key, text).join(few, key, "left_semi"), key, text, size).withColumnRenamed("cid", "id"))
    return verified(links, sets, threshold), members


THRESHOLD, SHINGLE = 0.72, 5


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_duplicates(table(spark, sf_dir, "drafts"), "draft_id", "text", SHINGLE, THRESHOLD)
    members = cut(members)
    left, right = members.select(F.col("id").alias("x"), F.col("cid").alias("a")), members.select(F.col("id").alias("y"), F.col("cid").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right, left["a"] == right["b"]).where("x < y").select("x", "y")
    pairs = across.union(within).where("x <> y")
    return pairs.select(F.least("x", "y").alias("draft_a"), F.greatest("x", "y").alias("draft_b")).distinct()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per draft that has a near-duplicate: its group, its class and the links of that class."""
    links, members = near_duplicates(table(spark, sf_dir, "drafts"), "draft_id", "text", SHINGLE, THRESHOLD)
    links, members = cut(links), cut(members)
    ends = links.select(F.col("a").alias("cid")).union(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("cid").agg(F.count("*").alias("n_copies"))
    groups = connected_components(links.select("a", "b")).withColumnRenamed("node", "cid")
    known = members.join(copies, "cid").join(ends, "cid", "left").join(groups, "cid", "left").where("n_copies > 1 or n_links is not null").withColumn("group", F.coalesce("component", "cid"))
    least = known.groupBy("group").agg(F.min("id").alias("group_id"))
    return known.join(least, "group").select(F.col("id").alias("draft_id"), "group_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")).distinct()


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
ORACLE = {
    "p6_found": f"""WITH d AS (SELECT DISTINCT draft_id, text FROM drafts WHERE draft_id IS NOT NULL AND text IS NOT NULL), t AS (SELECT row_number() OVER () AS u, draft_id, {SQL_TOKENS} AS k FROM d), w AS (SELECT * FROM t WHERE len(k) > 0),
sh AS (SELECT DISTINCT u, draft_id, array_to_string(k[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(k) - {SHINGLE - 1}, 1) + 1)) AS i FROM w)), n AS (SELECT u, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT x.u AS a, y.u AS b, x.draft_id AS p, y.draft_id AS q, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.draft_id < y.draft_id GROUP BY 1, 2, 3, 4)
SELECT DISTINCT p AS draft_a, q AS draft_b FROM c JOIN n na ON na.u = a JOIN n nb ON nb.u = b WHERE c / (na.n + nb.n - c) >= {THRESHOLD}""",
}
