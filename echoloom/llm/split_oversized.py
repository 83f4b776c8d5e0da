"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

A dynamic program over boundary positions minimises, for each text, the summed cut penalties plus
the squared deviation of every piece from the even size, subject to a maximum length and an exact
overlap. Sizes are measured in the JVM; only texts over the limit reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.runtime import table

#: Code points with the Unicode property White_Space.
SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = re.compile(f"[^{SPACE}]+")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n|\r[^\S\r\n]*\r|\u2029")
SENTENCE_END = re.compile(r"[.!?…。！？؟۔।:;][\"'”’»」』)\]]*$")
CLAUSE_END = re.compile(r"[,，、،—–-][\"'”’»」』)\]]*$")
UNSPACED_STOP = re.compile(r"[。！？」』][」』）]*")

#: Price of cutting at a paragraph break, sentence end, line break, clause end, between words, inside a word.
PENALTY = {"paragraph": 0.0, "sentence": 0.15, "line": 0.3, "clause": 0.5, "word": 1.0, "inside": 4.0}
#: What one more piece costs, and the weight of a piece's squared relative deviation from the even size.
PIECE_COST, BALANCE = 1.0, 1.0


def _gap_penalty(before: str, gap: str) -> float:
    if BLANK_LINE.search(gap):
        return PENALTY["paragraph"]
    if SENTENCE_END.search(before):
        return PENALTY["sentence"]
    if "\n" in gap or "\r" in gap:
        return PENALTY["line"]
    return PENALTY["clause"] if CLAUSE_END.search(before) else PENALTY["word"]


def boundaries(text: str, unit: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Possible cuts: size before each, its code-point offset and its penalty; the first is 0, the last the end."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if unit == "token":
        size = np.arange(len(spans) + 1)
        at = np.array([0, *(s for s, _ in spans[1:]), len(text)])
        cost = [0.0, *(_gap_penalty(text[max(p[0], p[1] - 4) : p[1]], text[p[1] : n[0]]) for p, n in zip(spans, spans[1:])), 0.0]
        return size, at, np.array(cost)
    cuts = {0: 0.0, len(text): 0.0}
    for p, n in zip(spans, spans[1:]):
        cuts[n[0]] = _gap_penalty(text[max(p[0], p[1] - 4) : p[1]], text[p[1] : n[0]])
    for m in UNSPACED_STOP.finditer(text):
        cuts[m.end()] = min(cuts.get(m.end(), 9.0), PENALTY["sentence"])
    # where boundaries lie too far apart to hold the limit, every code point may be cut
    known = sorted(cuts)
    for a, b in zip(known, known[1:]):
        if b - a > (limit - overlap) // 2:
            for x in range(a + 1, b):
                cuts.setdefault(x, PENALTY["inside"])
    at = np.array(sorted(cuts))
    return at, at, np.array([cuts[x] for x in at.tolist()])


def split_text(text: str, unit: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, size)`` in code points; consecutive ones share exactly ``overlap`` units.

    A text within the limit is one piece, an empty one is one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    size, at, cost = boundaries(text, unit, limit, overlap)
    total = int(size[-1])
    if total <= limit:
        return [(0, len(text), total)]
    room = limit - overlap
    even = total / np.ceil((total - overlap) / room) + overlap
    best = np.full(len(size), np.inf)
    best[0], back = 0.0, np.zeros(len(size), dtype=np.int64)
    first = np.searchsorted(size, size - room, side="left")
    from_start = size <= limit
    for j in range(1, len(size)):
        lo = first[j]
        prev = best[lo:j] + BALANCE * ((size[j] - size[lo:j] + overlap - even) / limit) ** 2
        k = int(np.argmin(prev)) if len(prev) else -1
        value, where = (prev[k], lo + k) if k >= 0 else (np.inf, 0)
        if from_start[j]:  # the first piece has no overlap before it
            alone = BALANCE * ((size[j] - even) / limit) ** 2
            if alone < value or where == 0:
                value, where = alone, 0
        best[j], back[j] = value + cost[j] + PIECE_COST, where
    cuts, j = [len(size) - 1], len(size) - 1
    while j:
        j = int(back[j])
        cuts.append(j)
    cuts.reverse()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        begin = max(0, int(size[a]) - overlap) if a else 0
        start = int(at[begin]) if unit == "token" else begin
        out.append((start, int(at[b]), int(size[b]) - begin))
    return out


def split_oversized(df: DataFrame, key: list[str], text: str, unit: str, limit: int, overlap: int) -> DataFrame:
    """One row per piece: ``*key, piece_no, n_pieces, piece_start, piece_end, piece_size, piece_text``.

    ``unit`` is ``token`` (runs without Unicode white space) or ``char`` (code points). Offsets are code
    points, end exclusive. Null text gives no piece; empty text one empty piece; identical repeated rows
    one result. Columns beyond ``key`` and ``text`` are dropped, so their names can't clash.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit must be token or char")
    own = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(text).alias("__t")).where("__t is not null")
    sized = own.withColumn("__n", F.regexp_count("__t", F.lit(r"(?U)\S+")) if unit == "token" else F.char_length("__t"))
    names = [f"__k{i}" for i in range(len(key))]
    kinds = ", ".join(f"{n} {sized.schema[n].dataType.simpleString()}" for n in names)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (*k, no, len(pieces), s, e, n, t[s:e])
                for *k, t in f[[*names, "__t"]].itertuples(index=False, name=None)
                for pieces in [split_text(t, unit, limit, overlap)]
                for no, (s, e, n) in enumerate(pieces)
            ]
            yield pd.DataFrame(rows, columns=[*names, "piece_no", "n_pieces", "piece_start", "piece_end", "piece_size", "piece_text"])

    # few bytes but much work a row: spread over all tasks instead of as many as the bytes ask for
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    over = sized.where(F.col("__n") > limit).drop("__n").distinct().repartition(parts, *names)
    shape = f"{kinds}, piece_no int, n_pieces int, piece_start int, piece_end int, piece_size int, piece_text string"
    cutup = over.mapInPandas(cut, shape)
    whole = sized.where(F.col("__n") <= limit).distinct().select(
        *names, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), F.char_length("__t").alias("piece_end"), F.col("__n").cast("int").alias("piece_size"), F.col("__t").alias("piece_text")
    )
    both = cutup.unionByName(whole)
    return both.select(*[F.col(n).alias(k) for n, k in zip(names, key)], "piece_no", "n_pieces", "piece_start", "piece_end", "piece_size", "piece_text")


PAGE_LIMIT, PAGE_OVERLAP, WINDOW_LIMIT, WINDOW_OVERLAP = 400, 40, 1500, 150


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = split_oversized(table(spark, sf_dir, "pages").withColumnRenamed("page", "item_no"), ["job_id", "item_no"], "text", "token", PAGE_LIMIT, PAGE_OVERLAP)
    windows = split_oversized(table(spark, sf_dir, "windows").withColumnRenamed("window_index", "item_no"), ["job_id", "item_no"], "text", "char", WINDOW_LIMIT, WINDOW_OVERLAP)
    return pages.withColumn("item_kind", F.lit("page")).unionByName(windows.withColumn("item_kind", F.lit("window")))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and window as pieces within its limit."""
    return _pieces(spark, sf_dir).select("item_kind", "job_id", "item_no", "piece_no", "piece_start", "piece_end", "piece_size", "piece_text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut: those of which the operator made a second piece."""
    return _pieces(spark, sf_dir).where("piece_no = 1").select("item_kind", "job_id", "item_no").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLE = {
    "p1_found": r"""
        SELECT DISTINCT 'page' AS item_kind, job_id, page AS item_no FROM pages
        WHERE len(regexp_extract_all(text, '[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) > 400
        UNION
        SELECT DISTINCT 'window', job_id, window_index FROM windows WHERE length(text) > 1500""",
}
