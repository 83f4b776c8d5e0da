"""Lexical repetition: candidate units, shingle index, scored pairs, blocks, instances and clusters.

Everything is keyed by ``doc_key`` (one text, e.g. a chapter), so one hash partitioning serves all joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from echoloom.config import LexicalConfig
from echoloom.functions import text as T
from echoloom.operators.graph import connected_components
from echoloom.operators.intervals import islands, overlaps
from echoloom.runtime import cut, settled

SENTENCE, PARAGRAPH, PHRASE = "sentence", "paragraph", "phrase"
#: The weights of shingles, order and frequency in the similarity, and the tolerance at a threshold.
WEIGHTS, EPSILON = (0.70, 0.20, 0.10), 1.1920929e-07
#: Shingles of a text up to which its pairs are counted in one task's memory; units in pairs up to which their hashes are broadcast.
WITHIN, PAIRED = 2_000_000, 1_000_000


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """``doc_key, para (from 0), start, text`` of the trimmed paragraphs between two or more line breaks."""
    seps = F.transform(F.regexp_extract_all("text", F.lit(r"\n{2,}"), F.lit(0)), lambda s: F.char_length(s))
    pieces = docs.where("text is not null").select("doc_key", F.posexplode(F.arrays_zip(F.split("text", r"\n{2,}").alias("piece"), seps.alias("sep"))).alias("pos", "z"))
    w = Window.partitionBy("doc_key").orderBy("pos")
    at = F.coalesce(F.sum(F.char_length("z.piece") + F.coalesce("z.sep", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.char_length("z.piece") - F.char_length(F.regexp_replace("z.piece", r"^(?U)\s+", ""))
    rows = pieces.select("doc_key", "pos", (at + lead).cast("int").alias("start"), F.regexp_replace("z.piece", r"^(?U)\s+|(?U)\s+$", "").alias("text")).where("text <> ''")
    return rows.select("doc_key", (F.row_number().over(w) - 1).alias("para"), "start", "text")


def candidates(docs: DataFrame, cfg: LexicalConfig = LexicalConfig()) -> DataFrame:
    """``doc_key, id, kind, para, start, end, tokens, shingles``; ids from 0: sentences first, then paragraphs with their phrases.

    Units below their token gate are left out; empty or null texts have none.
    """
    paras = paragraph_rows(docs).withColumn("s", T.spans(F.col("text"), T.LEXICAL_TOKEN))
    marked = F.regexp_replace("text", r"([.!?])([\s\"'])", "$1" + T.MARK + "$2")
    # a mark in the text itself would shift offsets, so it is blanked first
    raw = paras.withColumn("text", F.translate("text", T.MARK, " ")).select("doc_key", "para", "start", "s", F.split(marked, T.MARK).alias("parts"))
    ends = F.transform("parts", lambda x, i: F.aggregate(F.slice(F.col("parts"), 1, i + 1), F.lit(0), lambda a, y: a + F.char_length(y)))
    bounds = F.transform(ends, lambda e, i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("a"), e.alias("b")))
    sent = raw.select("doc_key", "para", "start", "s", F.posexplode(bounds).alias("no", "r"))
    sent = sent.select("doc_key", "para", "start", "no", F.filter("s", lambda t: (t["start"] >= F.col("r.a")) & (t["end"] <= F.col("r.b"))).alias("s"), F.lit(SENTENCE).alias("kind"), F.lit(0).alias("group")).where(F.size("s") >= cfg.sentence_min_tokens)
    whole = paras.select("doc_key", "para", "start", F.lit(0).alias("no"), "s", F.lit(PARAGRAPH).alias("kind"), F.lit(1).alias("group")).where(F.size("s") >= cfg.paragraph_min_tokens)
    n = F.floor((F.size("s") - cfg.phrase_tokens) / cfg.phrase_stride).cast("int")
    phrase = paras.where(F.size("s") >= cfg.phrase_tokens).select("doc_key", "para", "start", "s", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    phrase = phrase.select("doc_key", "para", "start", (F.col("i") + 1).alias("no"), F.slice("s", F.col("i") * cfg.phrase_stride + 1, cfg.phrase_tokens).alias("s"), F.lit(PHRASE).alias("kind"), F.lit(1).alias("group"))
    every = sent.unionByName(whole).unionByName(phrase)
    tokens = F.transform("s", lambda t: F.lower(t["token"]))
    rows = every.select(
        "doc_key", "kind", "group", "para", "no", (F.col("start") + F.element_at("s", 1)["start"]).alias("start"), (F.col("start") + F.element_at("s", -1)["end"]).alias("end"), tokens.alias("tokens"))
    order = Window.partitionBy("doc_key").orderBy("group", "para", "no")
    sized = rows.withColumn("id", F.row_number().over(order) - 1)
    shingles = F.when(F.col("kind") == PARAGRAPH, T.shingles(F.col("tokens"), cfg.paragraph_shingle_size)).otherwise(T.shingles(F.col("tokens"), cfg.sentence_shingle_size))
    return sized.select("doc_key", "id", "kind", "para", "start", "end", "tokens", shingles.alias("shingles"))


def shingle_index(units: DataFrame, max_df_fraction: float) -> DataFrame:
    """``doc_key, shingle, id, df`` of the shingles that are neither too common in their text nor alone; ``df`` units have it."""
    n = units.groupBy("doc_key").agg(F.count("*").alias("n"))
    each = units.select("doc_key", "id", F.explode("shingles").alias("shingle"))
    df = each.groupBy("doc_key", "shingle").agg(F.count("*").alias("df")).where("df > 1")
    keep = df.join(n, "doc_key").where(F.col("df") <= F.greatest(F.lit(2), F.ceil(F.col("n") * max_df_fraction))).select("doc_key", "shingle", "df")
    return each.join(keep, ["doc_key", "shingle"])


def exact_classes(units: DataFrame) -> DataFrame:
    """``doc_key, id, first, n``: sentences and paragraphs that stand more than once, with the first of their class and its
    size; common shingles don't matter here. A class of any size costs its rows, not its pairs."""
    u = units.where((F.col("kind") != PHRASE) & (F.size("tokens") > 0)).select("doc_key", "id", F.xxhash64(F.array_join("tokens", " ")).alias("k"))
    own = u.groupBy("doc_key", "k").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return u.join(own, ["doc_key", "k"]).select("doc_key", "id", "first", "n")


def exact_pairs(units: DataFrame) -> DataFrame:
    """``doc_key, a, b`` of sentences and paragraphs with equal tokens, for chains along diagonals, which need every pair."""
    u = units.where(F.col("kind") != PHRASE).select("doc_key", "id", F.array_join("tokens", " ").alias("k"))
    return u.withColumnRenamed("id", "a").join(u.withColumnRenamed("id", "b"), ["doc_key", "k"]).where("a < b").select("doc_key", "a", "b")


def near_pairs(index: DataFrame, fanout: int, share: int = 256) -> DataFrame:
    """``doc_key, a, b, hits``: each unit's later neighbours with the most shared shingles, at most ``fanout``.

    A shingle of more than ``share`` units is met in several parts, so that no task holds a common shingle's pairs.
    """
    # the join and the count run on longs; the text's key comes back for the few pairs that stay
    parts = F.ceil(F.col("df") / share).cast("int")
    own = index.select(F.xxhash64("doc_key", "shingle").alias("k"), F.xxhash64("doc_key").alias("d"), "id", parts.alias("parts"))
    left = own.select("k", "d", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("a"))
    right = own.select("k", "d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"))
    hits = left.join(right, ["k", "d", "part"]).where("a < b").groupBy("d", "a", "b").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("d", "a").orderBy(F.desc("hits"), "b")
    best = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fanout)
    return best.join(index.select("doc_key").distinct().withColumn("d", F.xxhash64("doc_key")), "d").select("doc_key", "a", "b", "hits")


def _text_pairs(units: dict[str, np.ndarray], shingles: np.ndarray, sizes: np.ndarray, cfg: LexicalConfig) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``a, b`` of one text's units, sorted by id: the pairs of ``near_pairs`` that may still reach their threshold."""
    n = len(sizes)
    of = np.repeat(np.arange(n), sizes)
    _, kind, df = np.unique(shingles, return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    post, ends = of[order], np.cumsum(df)
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))  # an entry's place in the postings; those behind it are of later units
    rare = df <= max(2, math.ceil(n * cfg.max_df_fraction))
    to, at = ends[kind], np.cumsum([0, *sizes])
    long = units["kind"] == PARAGRAPH
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def counted(entries: np.ndarray) -> np.ndarray:
        lists = [post[p + 1 : t] for p, t in zip(place[entries].tolist(), to[entries].tolist()) if t > p + 1]
        return np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)

    for i in range(n):
        own = np.arange(at[i], at[i + 1])
        few = rare[kind[own]]
        hits = counted(own[few])
        b = np.flatnonzero(hits)
        if not len(b):
            continue
        if len(b) > cfg.max_candidate_fanout:
            b = b[np.lexsort((b, -hits[b]))[: cfg.max_candidate_fanout]]
        common = hits[b] if few.all() else hits[b] + counted(own[~few])[b]
        j = common / (sizes[i] + sizes[b] - common)
        limit = np.where(long[i] | long[b], cfg.paragraph_jaccard_threshold, cfg.sentence_jaccard_threshold)
        apart = ~((units["start"][i] < units["end"][b]) & (units["start"][b] < units["end"][i]))
        b = b[apart & ((WEIGHTS[0] * j + WEIGHTS[1] + WEIGHTS[2] + 2 * EPSILON >= limit) | (units["hash"][i] == units["hash"][b]))]
        found.append((np.full(len(b), i), b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def open_pairs(units: DataFrame, cfg: LexicalConfig) -> DataFrame:
    """``doc_key, a, b``: the pairs of ``near_pairs`` without those whose shingles alone rule a match out.

    A text's units meet in memory, where its pairs cost no disk; texts of more than ``WITHIN`` shingles go by the joins.
    """
    big = cut(units.groupBy("doc_key").agg(F.sum(F.size("shingles")).alias("m")).where(F.col("m") > WITHIN).select("doc_key"))
    cols = ["doc_key", "id", "kind", "start", "end", "shingles"]
    own, joined = units, None
    if not big.isEmpty():
        own = units.join(F.broadcast(big), "doc_key", "left_anti")
        joined = near_pairs(shingle_index(units.join(F.broadcast(big), "doc_key", "left_semi"), cfg.max_df_fraction), cfg.max_candidate_fanout).select("doc_key", "a", "b")
    rows = own.select(*cols, F.xxhash64("tokens").alias("hash"), F.to_json(F.struct("doc_key")).alias("__k")).repartition("__k").sortWithinPartitions("__k")

    def one(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(blocks).sort_by("id").combine_chunks()
        lists = t.column("shingles").chunk(0)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = _text_pairs({c: t.column(c).to_numpy() for c in ("kind", "start", "end", "hash")}, lists.flatten().to_numpy(zero_copy_only=False), sizes, cfg)
        ids = t.column("id").chunk(0)
        return pa.RecordBatch.from_arrays([blocks[0].column("doc_key").take(pa.array(np.zeros(len(a), np.int64))), ids.take(pa.array(a)), ids.take(pa.array(b))], names=["doc_key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("__k").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if kept and k[i] != last:
                    yield one(kept)
                    kept = []
                kept.append(batch.select([*cols, "hash"]).slice(i, j - i))
                last = k[i]
        if kept:
            yield one(kept)

    kinds = {c: units.schema[c].dataType.simpleString() for c in ("doc_key", "id")}
    met = rows.mapInArrow(run, f"doc_key {kinds['doc_key']}, a {kinds['id']}, b {kinds['id']}")
    return met if joined is None else met.unionByName(joined)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


@F.pandas_udf(DoubleType())
def order_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence over the longer length, by bit-parallel rows."""

    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        where: dict[str, int] = {}
        for i, t in enumerate(x):
            where[t] = where.get(t, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for t in y:
            m = row & where.get(t, 0)
            row = ((row + m) | (row - m)) & full
        return (len(x) - row.bit_count()) / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def frequency_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Smaller over larger token counts, summed over all tokens."""
    from collections import Counter

    def one(x, y) -> float:
        p, q = Counter(x), Counter(y)
        large = sum((p | q).values())
        return sum((p & q).values()) / large if large else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def _hashed(units: DataFrame) -> DataFrame:
    return units.withColumn("shingles", F.transform("shingles", lambda s: F.xxhash64(s)))


def scored_pairs(units: DataFrame, cfg: LexicalConfig = LexicalConfig()) -> DataFrame:
    """``doc_key, a, b, score`` of units that match: exact ones at 1, others at or above their kind's threshold."""
    # hashed shingles: the joins and intersections below run on longs
    u = units if units.schema["shingles"].dataType.elementType.simpleString() == "bigint" else cut(_hashed(units))
    exact = exact_pairs(u).withColumn("exact", F.lit(True))
    near = open_pairs(u, cfg).select("doc_key", "a", "b", F.lit(False).alias("exact"))
    pairs = cut(exact.union(near).groupBy("doc_key", "a", "b").agg(F.max("exact").alias("exact")))
    # only units that stand in a pair are shuffled with their tokens
    unit = lambda c: F.xxhash64("doc_key", c).alias("h")
    some = cut(pairs.select(unit("a")).union(pairs.select(unit("b"))).distinct())
    if some.count() <= PAIRED:
        u = u.withColumn("h", unit("id")).join(F.broadcast(some), "h", "left_semi").drop("h")
    cols = ["kind", "start", "end", "tokens", "shingles"]
    left = u.select("doc_key", F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = u.select("doc_key", F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    met = pairs.join(left, ["doc_key", "a"]).join(right, ["doc_key", "b"]).where(~overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    same = F.col("exact") | (F.col("a_tokens") == F.col("b_tokens"))
    threshold = F.when((F.col("a_kind") == PARAGRAPH) | (F.col("b_kind") == PARAGRAPH), cfg.paragraph_jaccard_threshold).otherwise(cfg.sentence_jaccard_threshold)
    jac = met.withColumn("same", same).withColumn("threshold", threshold).withColumn("j", jaccard(F.col("a_shingles"), F.col("b_shingles")))
    # order and frequency add at most 0.3, which settles most pairs before Python is asked
    open_ = jac.where(F.col("same") | (WEIGHTS[0] * F.col("j") + WEIGHTS[1] + WEIGHTS[2] + EPSILON >= F.col("threshold")))
    score = F.when(F.col("same"), F.lit(1.0)).otherwise(WEIGHTS[0] * F.col("j") + WEIGHTS[1] * order_score("a_tokens", "b_tokens") + WEIGHTS[2] * frequency_score("a_tokens", "b_tokens"))
    return open_.withColumn("score", score).where(F.col("same") | (F.col("score") + EPSILON >= F.col("threshold"))).select("doc_key", "a", "b", "score")


def block_chains(units: DataFrame, pairs: DataFrame, cfg: LexicalConfig = LexicalConfig()) -> DataFrame:
    """Runs of matched paragraphs along a diagonal: ``doc_key, a_start, a_end, b_start, b_end, score, run``.

    A run begins at any matched pair and goes on while the next pair matches too and the left part stays before
    the right part's begin; it counts from ``block_min_paragraphs`` paragraphs or ``block_min_words`` words.
    """
    p = units.where(F.col("kind") == PARAGRAPH).select("doc_key", "id", "para", "start", "end", F.size("tokens").alias("words"))
    m = pairs.join(p.select("doc_key", F.col("id").alias("a"), F.col("para").alias("pa"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), "words"), ["doc_key", "a"])
    m = m.join(p.select("doc_key", F.col("id").alias("b"), F.col("para").alias("pb"), F.col("start").alias("b_start"), F.col("end").alias("b_end")), ["doc_key", "b"])
    m = m.withColumn("d", F.col("pb") - F.col("pa"))
    diagonal = Window.partitionBy("doc_key", "d").orderBy("pa")
    m = m.withColumn("isle", F.col("pa") - F.row_number().over(diagonal))
    isle = Window.partitionBy("doc_key", "d", "isle").orderBy("pa")
    last = F.max("pa").over(Window.partitionBy("doc_key", "d", "isle"))
    m = m.withColumn("run", F.least(last - F.col("pa") + 1, F.col("d"))).withColumn("words_to", F.sum("words").over(isle)).withColumn("score_to", F.sum("score").over(isle))
    # the run's last pair, by its place on the island
    tail = m.select("doc_key", "d", "isle", F.col("pa").alias("end_pa"), F.col("a_end").alias("run_a_end"), F.col("b_end").alias("run_b_end"), F.col("words_to").alias("w1"), F.col("score_to").alias("s1"))
    chain = m.withColumn("end_pa", F.col("pa") + F.col("run") - 1).join(tail, ["doc_key", "d", "isle", "end_pa"])
    words = F.col("w1") - F.col("words_to") + F.col("words")
    score = (F.col("s1") - F.col("score_to") + F.col("score")) / F.col("run")
    ok = (F.col("run") >= cfg.block_min_paragraphs) | (words >= cfg.block_min_words)
    return chain.where(ok).select("doc_key", "pa", "pb", "a_start", F.col("run_a_end").alias("a_end"), "b_start", F.col("run_b_end").alias("b_end"), score.alias("score"), F.col("run").cast("int").alias("run"))


def repetition_instances(docs: DataFrame, cfg: LexicalConfig = LexicalConfig()) -> DataFrame:
    """``doc_key, cluster_id, instance_id, start, end, score, text, word_count``: the lexical report's spans.

    Matched units and blocks that overlap are one instance; instances tied by a match are one cluster; clusters
    need ``max(2, min_repetitions)`` instances and are numbered by their first one's place. The first instance
    (``instance_id`` 0) is the canonical one. The order in which matches are met doesn't matter.
    """
    units = cut(_hashed(candidates(docs, cfg)))
    pairs = settled(docs.sparkSession, lambda: scored_pairs(units, cfg))
    at = units.select("doc_key", "id", "start", "end")
    unit_links = pairs.join(at.select("doc_key", F.col("id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end")), ["doc_key", "a"])
    unit_links = unit_links.join(at.select("doc_key", F.col("id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end")), ["doc_key", "b"])
    sides = ["doc_key", "a_start", "a_end", "b_start", "b_end", "score"]
    links = cut(unit_links.select(*sides).union(block_chains(units, pairs, cfg).select(*sides)))
    spans = links.select("doc_key", F.col("a_start").alias("start"), F.col("a_end").alias("end"), "score").union(links.select("doc_key", "b_start", "b_end", "score"))
    placed = cut(islands(spans.groupBy("doc_key", "start", "end").agg(F.max("score").alias("score")), ["doc_key"]))
    inst = placed.groupBy("doc_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    node = lambda side: placed.select("doc_key", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.struct("doc_key", "island").alias(side))
    tied = links.join(node("a"), ["doc_key", "a_start", "a_end"]).join(node("b"), ["doc_key", "b_start", "b_end"]).select("a", "b").distinct()
    comp = connected_components(tied)
    grouped = inst.join(comp.select(F.col("node.doc_key").alias("doc_key"), F.col("node.island").alias("island"), F.col("component.island").alias("root")), ["doc_key", "island"])
    size = F.count("*").over(Window.partitionBy("doc_key", "root"))
    first = F.min("start").over(Window.partitionBy("doc_key", "root"))
    kept = grouped.withColumn("n", size).withColumn("first", first).where(F.col("n") >= max(2, cfg.min_repetitions))
    kept = kept.withColumn("cluster_id", F.dense_rank().over(Window.partitionBy("doc_key").orderBy("first")) - 1)
    kept = kept.withColumn("instance_id", F.row_number().over(Window.partitionBy("doc_key", "cluster_id").orderBy("start")) - 1)
    text = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return kept.join(docs.select("doc_key", "text"), "doc_key").select("doc_key", "cluster_id", "instance_id", "start", "end", F.round("score", 6).alias("score"), text.alias("text"), T.word_count(text).alias("word_count"))
