"""Problem 5: long exact spans shared between records.

A shared run need not fill a paragraph and may cross several, so signatures of paragraphs can't find it. The unit that
is min-hashed is every stretch of ``length`` consecutive code points instead: its minhash under one hash function of
``GRAM``-code-point grams is kept with its place. Equal stretches have equal minhashes, so one band of one row has
recall 1; sliding the stretch makes the minima repeat, which leaves about two fingerprints per ``length - GRAM`` code
points. Records that collide in a fingerprint are joined on the shift between its places; along each shift the texts
themselves are compared, code point by code point, for runs of ``length``. Groups are the connected components of the
verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.operators.graph import connected_components
from echoloom.runtime import cut, table

GRAM = 100
BASE = np.uint64(0x100000001B3)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """64-bit polynomial hashes of all runs of ``gram`` codes, built by doubling."""
    base = [int(BASE)]
    h, width = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    h ^= h >> np.uint64(32)
    unit, power = h, {1: int(BASE)}
    for bit in bin(gram)[3:]:
        h = h[: len(h) - width] * np.uint64(power[width]) + h[width:]
        power[2 * width] = power[width] * power[width] % 2**64
        width *= 2
        if bit == "1":
            h = h[: len(h) - 1] * np.uint64(base[0]) + unit[width : width + len(h) - 1]
            power[width + 1] = power[width] * base[0] % 2**64
            width += 1
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(text: str, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the minima of all stretches of ``length`` code points."""
    codes = code_points(text)
    if len(codes) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = gram_hashes(codes, gram)
    width = length - gram + 1
    low = sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    reach = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero(reach == h)
    return h[at], at


def runs_along(x: np.ndarray, y: np.ndarray, shift: int, length: int) -> list[tuple[int, int]]:
    """``start, end`` in ``x`` of the runs of at least ``length`` equal code points where ``x[i]`` meets ``y[i - shift]``."""
    a, b = max(0, shift), min(len(x), len(y) + shift)
    if b - a < length:
        return []
    broken = np.flatnonzero(x[a:b] != y[a - shift : b - shift])
    edge = np.r_[-1, broken, b - a]
    k = np.flatnonzero(np.diff(edge) > length)
    return list(zip((a + edge[k] + 1).tolist(), (a + edge[k + 1]).tolist()))


def common_stretches(x: str, y: str, length: int) -> tuple[list[dict], list[dict]]:
    """Where two texts hold stretches of ``length`` code points of the other, whatever the shift: merged ``s, e`` of either."""
    codes = [code_points(t) for t in (x, y)]
    if min(map(len, codes)) < length:
        return [], []
    hx, hy = (gram_hashes(c, length) for c in codes)
    sides = []
    for own, other in ((hx, hy), (hy, hx)):
        at = np.flatnonzero(np.isin(own, other))
        first = np.flatnonzero(np.r_[True, np.diff(at) > length]) if len(at) else at
        sides.append([{"s": int(at[p]), "e": int(at[q - 1]) + length} for p, q in zip(first, np.r_[first[1:], len(at)])])
    return sides[0], sides[1]


#: Places of one fingerprint in one text up to which each gives a shift; texts that repeat themselves more are compared at all shifts.
PLACES = 8


def shared_runs(texts: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``texts(cid, text)`` with distinct ``cid`` -> ``a, b, a_runs, b_runs``, ``a < b``.

    ``a_runs`` and ``b_runs`` (``array<struct<s, e>>``) cover every stretch of at least ``length`` code points
    that stands in both texts, side by side. A fingerprint of many texts is spread over tasks by a salt;
    none is capped.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [pd.DataFrame({"fp": [], "cid": [], "at": []}, dtype=np.int64)]
            for c, t in zip(f["cid"], f["text"]):
                h, at = fingerprints(t, length, gram)
                if len(h):
                    known, first, n = np.unique(h, return_index=True, return_counts=True)
                    if n.max() > PLACES:  # -1 stands for too many places
                        many = np.isin(h, known[n > PLACES])
                        h, at = np.r_[h[~many], known[n > PLACES]], np.r_[at[~many], np.full((n > PLACES).sum(), -1)]
                    out.append(pd.DataFrame({"fp": h.view(np.int64), "cid": np.full(len(h), c, np.int64), "at": at}))
            yield pd.concat(out)

    marks = cut(texts.where(F.char_length("text") >= length).mapInPandas(mark, "fp bigint, cid bigint, at bigint"))
    crowd = marks.groupBy("fp").agg(F.count("*").alias("n"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    met = marks.join(crowd.select("fp", F.ceil(F.col("n") / 1000).cast("bigint").alias("parts")), "fp")
    left = met.select("fp", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"), F.col("cid").alias("a"), F.col("at").alias("p"))
    right = met.select("fp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("cid").alias("b"), F.col("at").alias("q"))
    shift = F.when((F.col("p") >= 0) & (F.col("q") >= 0), F.col("p") - F.col("q")).cast("int")
    # null shifts are dropped from the set, but seen in the flag
    pairs = left.join(right, ["fp", "part"]).where("a < b").groupBy("a", "b").agg(F.collect_set(shift).alias("shifts"), F.max(shift.isNull()).alias("every"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def codes(cid: int, text: str) -> np.ndarray:
            x = known.get(cid)
            if x is None:
                if len(known) > 256:
                    known.clear()
                x = known[cid] = code_points(text)
            return x

        for f in frames:
            out: list[list] = [[], [], [], []]
            for a, b, x, y, shifts, every in zip(f["a"], f["b"], f["xa"], f["xb"], f["shifts"], f["every"]):
                if every:
                    p, q = common_stretches(x, y, length)
                else:
                    x, y = codes(a, x), codes(b, y)
                    each = {(s, e, d) for d in shifts.tolist() for s, e in runs_along(x, y, d, length)}
                    p = [{"s": s, "e": e} for s, e in sorted({(s, e) for s, e, _ in each})]
                    q = [{"s": s, "e": e} for s, e in sorted({(s - d, e - d) for s, e, d in each})]
                if p:
                    for column, value in zip(out, (a, b, p, q)):
                        column.append(value)
            yield pd.DataFrame(dict(zip(("a", "b", "a_runs", "b_runs"), out)))

    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("xa")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("xb")), "b")
    return both.mapInPandas(verify, "a bigint, b bigint, a_runs array<struct<s int, e int>>, b_runs array<struct<s int, e int>>")


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records(kind, id, owner, text)`` -> ``members(kind, id, owner, cid)`` and ``texts(cid, text)``, one per distinct text."""
    known = records.where("text is not null and id is not null").withColumn("cid", F.xxhash64("text", F.char_length("text")))
    members = cut(known.select("kind", "id", "owner", "cid").distinct())
    texts = cut(known.groupBy("cid").agg(F.first("text").alias("text")))
    return members, texts


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "drafts").select(F.lit("draft").alias("kind"), F.col("draft_id").alias("id"), F.lit(None).cast("bigint").alias("owner"), "text")
    spans = table(spark, sf_dir, "spans").select(F.lit("span").alias("kind"), F.col("span_id").alias("id"), F.col("draft_id").alias("owner"), "text")
    return drafts.union(spans)


LENGTH = 200


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, texts = classes(_records(spark, sf_dir))
    runs = shared_runs(texts, LENGTH).select("a", "b")
    # copies of one text share all of it, when it is long enough
    same = texts.where(F.char_length("text") >= LENGTH).select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    links = runs.union(runs.select("b", "a")).union(same)
    drafts = members.where("kind = 'draft'").select(F.col("id").alias("draft_id"), F.col("cid").alias("a"))
    other = members.select(F.col("cid").alias("b"), F.col("kind").alias("other_kind"), F.col("id").alias("other_id"), "owner")
    met = links.join(drafts, "a").join(other, "b")
    case = F.when(F.col("other_kind") == "draft", F.col("draft_id") < F.col("other_id")).otherwise(F.col("owner").isNull() | (F.col("owner") != F.col("draft_id")))
    return met.where(case).select("draft_id", "other_kind", "other_id").distinct()


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record with a shared run: its group and the share of its code points that stands in another record."""
    members, texts = classes(_records(spark, sf_dir))
    runs = cut(shared_runs(texts, LENGTH))
    ends = runs.select(F.col("a").alias("cid"), F.inline("a_runs")).union(runs.select("b", F.inline("b_runs")))
    copies = members.groupBy("cid").agg(F.count("*").alias("n_copies"))
    sizes = texts.select("cid", F.char_length("text").alias("n_chars"))
    whole = copies.where("n_copies > 1").join(sizes, "cid").where(F.col("n_chars") >= LENGTH).select("cid", F.lit(0).alias("s"), F.col("n_chars").alias("e"))
    w = Window.partitionBy("cid").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = ends.union(whole).distinct().withColumn("from", F.greatest("s", F.coalesce(reach, F.lit(0)))).where("e > from")
    covered = spans.groupBy("cid").agg(F.sum(F.col("e") - F.col("from")).alias("n_shared"))
    groups = connected_components(runs.select("a", "b").union(whole.select("cid", "cid"))).withColumnRenamed("node", "cid")
    return (
        members.join(covered, "cid").join(sizes, "cid").join(groups, "cid")
        .select(F.col("kind"), "id", F.col("component").alias("group_key"), F.col("n_shared").cast("bigint").alias("n_shared"), F.col("n_chars").cast("bigint").alias("n_chars"), F.round(F.col("n_shared") / F.col("n_chars"), 6).alias("share")).distinct()
    )


QUERIES = {"p5_found": p5_found, "p5_share": p5_share}
ORACLE = {
    "p5_found": f"""WITH r AS (SELECT 'draft' AS kind, draft_id AS id, NULL AS owner, text FROM drafts UNION SELECT 'span', span_id, draft_id, text FROM spans), t AS (SELECT DISTINCT kind, id, owner, text FROM r WHERE id IS NOT NULL AND length(text) >= {LENGTH}),
g AS (SELECT DISTINCT kind, id, owner, hash(substr(text, i, {LENGTH})) AS h FROM (SELECT *, unnest(range(1, length(text) - {LENGTH} + 2)) AS i FROM t))
SELECT DISTINCT a.id AS draft_id, b.kind AS other_kind, b.id AS other_id FROM g a JOIN g b ON a.h = b.h WHERE a.kind = 'draft' AND CASE WHEN b.kind = 'draft' THEN a.id < b.id ELSE b.owner IS NULL OR b.owner <> a.id END""",
}
