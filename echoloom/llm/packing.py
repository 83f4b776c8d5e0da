"""Problem 7: fill containers of fixed capacity with documents, neighbours together.

Every document gets its length in tokens of a public tokenizer and a hashed vector (the mean of random
directions of its tokens) projected to three dimensions. The points are put in the order of a Hilbert
curve, and each stretch of the curve is packed best-fit, so that a container holds documents from one
neighbourhood. Stretches are ranges of the curve's cells, drawn from the number of documents in each cell, so
they and the containers' numbers depend on the documents alone and not on how Spark lays them out. A document is divided only when it alone exceeds the capacity;
its full parts are containers of their own and its remainder is packed like any document.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.runtime import cut, table

TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMS, BITS = 3, 10
#: Documents on one stretch of the curve, packed together; bits a dimension of the curve's cells (32,768 of them, whatever the input).
STRETCH, COARSE = 2048, 5


def encoder(folder: str, vocabulary: str):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_directions(encoding) -> np.ndarray:
    """A random direction for every token that holds a letter, nothing for digits, marks and white space."""
    out = np.random.default_rng(5).uniform(-1, 1, (encoding.n_vocab, DIMS)).astype(np.float32)
    for no in range(encoding.n_vocab):
        try:
            word = encoding.decode_single_token_bytes(no)
        except KeyError:
            word = b""
        if not any(c > 127 or chr(c).isalpha() for c in word):
            out[no] = 0
    return out


def measure(texts: list[str], encoding, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token count and mean direction of each text."""
    n, points = np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMS))
    for i, t in enumerate(texts):
        ids = encoding.encode_to_numpy(t, disallowed_special=())
        n[i] = len(ids)
        if len(ids):
            points[i] = directions[ids].mean(0)
    return n, points


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points ``[n, dims]`` below ``2**bits``."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the coarsest bit down
        low = q - 1
        for d in range(dims):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: largest first, into the open container it fills best; ties by order."""
    out = np.zeros(len(sizes), np.int64)
    free: list[tuple[int, int]] = []
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(free, (n, -1))
        if k < len(free):
            room, no = free.pop(k)
        else:
            room, no, used = capacity, used, used + 1
        out[i] = no
        if room > n:
            insort(free, (room - n, no))
    return out


def stretches(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For every cell of the curve the first cell of its stretch, and in how many parts a stretch of one crowded cell is cut."""
    first, parts = np.arange(1 << DIMS * COARSE), np.ones(1 << DIMS * COARSE, np.int64)
    begin, held = 0, 0
    for c in sorted(counts):
        if held and (held + counts[c] > STRETCH):
            begin, held = c, 0
        first[c] = begin if held else c
        begin = first[c]
        held += counts[c]
        parts[c] = max(1, -(-counts[c] // STRETCH))
    return first, parts


def pack(df: DataFrame, key: str, text: str, capacity: int, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, part, container, token_start, n_tokens``: every token of every document in exactly one container.

    ``part`` counts a divided document's parts from 0. Empty texts have one part of no tokens; null texts and
    null ids have none. Repeated rows of one id and text are packed once; an id with several texts is packed
    with each. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    kind = src.schema["id"].dataType.simpleString()
    src.sparkSession.sparkContext.addFile(os.path.join(folder, vocabulary))  # the driver's copy goes to every executor

    def size(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        encoding = encoder(os.path.dirname(SparkFiles.get(vocabulary)), vocabulary)
        directions = token_directions(encoding)
        for f in frames:
            for a in range(0, len(f), 512):  # long texts in small batches
                g = f.iloc[a : a + 512]
                n, p = measure(g["t"].tolist(), encoding, directions)
                yield pd.DataFrame({"id": g["id"], "h": g["h"], "n": n, **{f"p{d}": p[:, d] for d in range(DIMS)}})

    shape = f"id {kind}, h bigint, n bigint, " + ", ".join(f"p{d} double" for d in range(DIMS))
    sized = cut(src.withColumn("h", F.xxhash64("t")).select("id", "h", "t").mapInPandas(size, shape).dropDuplicates(["id", "h"]))
    names = [f"p{d}" for d in range(DIMS)]
    # rounded, so that the order of a sum doesn't move a document to another cell
    stats = sized.agg(*[F.round(F.avg(c), 6).alias(f"m_{c}") for c in names], *[F.round(F.stddev_pop(c), 6).alias(f"s_{c}") for c in names]).first()
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in names])
    wide = np.array([stats[f"s_{c}"] or 1.0 for c in names])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = np.clip((f[names].to_numpy() - mean) / (3 * np.maximum(wide, 1e-12)), -1, 1)
            cells = np.minimum(((z + 1) / 2 * 2**BITS).astype(np.int64), 2**BITS - 1)
            yield pd.DataFrame({"id": f["id"], "h": f["h"], "n": f["n"], "curve": hilbert_key(cells, BITS)})

    # the hash of id and text breaks ties and spreads a pile of equal texts
    placed = cut(sized.mapInPandas(place, f"id {kind}, h bigint, n bigint, curve bigint").withColumn("tie", F.xxhash64("id", "h")))
    cell = F.shiftright("curve", DIMS * (BITS - COARSE))
    counts = {r["c"]: r["k"] for r in placed.groupBy(cell.alias("c")).agg(F.count("*").alias("k")).collect()}  # at most 32,768 rows
    first, parts = stretches(counts)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c = f["curve"].to_numpy() >> (DIMS * (BITS - COARSE))
            part = ((f["tie"].to_numpy().view(np.uint64) >> np.uint64(33)).astype(np.int64) * parts[c]) >> 31
            yield f.assign(stretch=first[c] * 2**16 + part)

    ordered = placed.mapInPandas(assign, f"id {kind}, h bigint, n bigint, curve bigint, tie bigint, stretch bigint")

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["curve", "tie", "h"], ignore_index=True)
        n = f["n"].to_numpy()
        whole, rest = n // capacity, n % capacity
        whole, rest = np.where((rest == 0) & (whole > 0), whole - 1, whole), np.where((rest == 0) & (whole > 0), capacity, rest)
        bins = best_fit(rest, capacity)
        base = int(bins.max()) + 1
        parts = whole + 1
        doc = np.repeat(np.arange(len(f)), parts)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        last = part == whole[doc]
        own = np.cumsum(~last) - 1 + base
        return pd.DataFrame({
            "id": f["id"].to_numpy()[doc], "part": part, "container": np.int64(f["stretch"].iloc[0]) * 2**32 + np.where(last, bins[doc], own),
            "token_start": part * capacity, "n_tokens": np.where(last, rest[doc], capacity),
        })

    # a stretch has about STRETCH documents, twice that at most but for chance
    return ordered.groupBy("stretch").applyInPandas(fill, f"id {kind}, part int, container bigint, token_start bigint, n_tokens bigint")


CAPACITY = 4096


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, by tenths of the capacity."""
    per = p7_packed(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    return per.groupBy(F.floor(F.col("used") * 10 / CAPACITY).cast("int").alias("tenth")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("parts").alias("parts"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
