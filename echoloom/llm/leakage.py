"""Problem 8: evaluation passages that leaked into training documents.

The test items, a fixed and small table whose size is checked, form a BM25 inverted index over their
words; documents are cut into overlapping passages and every passage is a query. The index is walked
with block-max WAND's bounds: a passage's upper bound is the sum of its terms' largest impacts, then the same per
block of items; passages and blocks that can't reach an item's threshold are dropped before any item is scored,
and all items above the threshold are returned. As the bounds are sums over whole passages at once, no pivot has to
move along the lists. Each is verified by aligning the item's words, in order,
with the document around the passage.

Words are folded before they are compared: wrong encodings are undone where possible, case, accents,
cue numbers, timing lines and markup are dropped, and characters that recognition confuses share one form.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.runtime import cut, table

#: Timing lines of either cue format, cue numbers on a line of their own, the format's header, markup.
NOISE = re.compile(r"^[ \t]*(?:[0-9:.,]+[ \t]*-+>[^\n]*|[0-9]+|WEBVTT[^\n]*)[ \t\r]*$|<[^<>\n]{0,60}>|\{[^{}\n]{0,60}\}|&[a-z]{2,6};", re.M)
#: The same with markup of any length, which is told by its first character.
PUT_IN = re.compile(NOISE.pattern + r"|</?[A-Za-z!][^<>\n]*>|\{\\[^{}\n]*\}", re.M)
WORD = re.compile(r"[^\W_]+")
#: Characters that recognition takes for each other, by the form they share.
LOOKALIKE = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "8": "b", "9": "g", "6": "b", "3": "e", "4": "a", "7": "t"})
#: Words of a passage and the step between passages; BM25 constants.
PASSAGE, STEP, K1, B = 72, 36, 1.2, 0.3
#: Share of the items beyond which a word tells too little to be indexed (at least 3 items).
MOST_ITEMS = 0.0125
#: Share of the item's own score a passage must reach at most to be aligned, and of its words that must be found.
LEAST_SCORE, LEAST_WORDS, BLOCK = 0.2, 0.5, 16
#: Items up to which blocks aren't asked for their bounds first.
SHORT_LISTS = 1024
#: Share of a half's score that damage may take before its passage isn't aligned any more.
DAMAGED = 0.2
#: Items up to which the index is broadcast; beyond it documents are queried against one block of items after the other.
INDEX_ITEMS = 20_000
#: What a document word between two matched words (cues put in between) and a missing item word cost, against
#: 1 for a match; the share of its matches a passage must keep after these costs.
SKIP, MISS, SOLID = 0.3, 0.1, 0.4
#: Cues put in between: what a run of them costs at most, whatever its length, between two pieces of the item; words and
#: rare words each piece must match, and the share of its matches it must keep by itself; gap inside a piece.
JUMP, PIECE, PIECE_RARE, PIECE_SOLID, PIECE_GAP = 3.0, 8, 2, 0.75, 10


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte code page, line by line, where that gives valid text, and Cyrillic
    of its own code page that was read as Western: words of accented letters alone, several on a line."""
    if CYRILLIC_READ.search(text):
        text = "".join(CYRILLIC_READ.sub(lambda m: m[0].encode("latin-1").decode("cp1251"), x) if len(CYRILLIC_READ.findall(x)) > 1 else x for x in text.splitlines(keepends=True))
    if not MOJIBAKE.search(text):
        return text
    return "".join(_repair_line(x) if MOJIBAKE.search(x) else x for x in text.splitlines(keepends=True))


CYRILLIC_READ = re.compile("(?<![A-Za-z\u0080-ÿ])[À-ÿ¸¨]{3,}(?![A-Za-z\u0080-ÿ])")
MOJIBAKE = re.compile("[Â-ôΒ-ωА-я][\u0080-¿Œ-ƒˆ˜–-›€™]")
#: Bytes 0x80 to 0x9F by the characters the Windows code page shows for them.
ONE_BYTE = {ord(bytes([b]).decode("cp1252")): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _repair_line(line: str) -> str:
    try:
        return line.translate(ONE_BYTE).encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        pass
    out = []
    for part in re.split("([^\u0000-ÿŒ-ƒˆ˜–-›€™]+)", line):
        try:
            out.append(part.translate(ONE_BYTE).encode("latin-1").decode("utf-8", "ignore") or part)
        except UnicodeEncodeError:
            out.append(part)
    return "".join(out)


#: Letters of other scripts and accents, by the plain form they share; filled as characters are met.
class _Folds(dict):
    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        if unicodedata.category(c) == "Cf":  # zero-width and formatting characters
            self[code] = ""
            return ""
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) or (c if not unicodedata.combining(c) else "")
        self[code] = out = plain.lower().translate(LOOKALIKE)
        return out


FOLDS = _Folds()


def fold(text: str) -> str:
    return repair(text).lower().translate(FOLDS)


def words(text: str) -> list[str]:
    """Folded words of a text without cue numbers, timing lines and markup."""
    return WORD.findall(fold(PUT_IN.sub(" ", text)))


class Collection(NamedTuple):
    """What BM25 needs to know of all items, however they are cut into groups: their number, mean length in words, and in how
    many of them each word stands."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, listed: list[list[str]]) -> Collection:
        df: Counter = Counter()
        for w in listed:
            df.update(set(w))
        return cls(len(listed), sum(map(len, listed)) / max(len(listed), 1), dict(df))


class Postings:
    """Lists of ``(place, value)`` by term, one after the other; the largest value per term and run of ``width`` places with ``blocks``."""

    def __init__(self, term: np.ndarray, place: np.ndarray, value: np.ndarray, terms: int) -> None:
        order = np.lexsort((place, term))
        self.place, self.value = place[order], value[order]
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))

    def blocks(self, width: int) -> Postings:
        terms = len(self.begin) - 1
        term, block = np.repeat(np.arange(terms), np.diff(self.begin)), self.place // width
        new = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)]) if len(term) else np.zeros(0, np.int64)
        return Postings(term[new], block[new], np.maximum.reduceat(self.value, new) if len(new) else self.value, terms)

    def sums(self, terms: np.ndarray, places: int, keep: np.ndarray | None = None, width: int = 1) -> np.ndarray:
        """Sum of the values of ``terms`` at every place, of those whose block ``keep`` holds."""
        first, last = self.begin[terms], self.begin[terms + 1]
        n = last - first
        till = n.cumsum()
        at = (first - till + n).repeat(n) + np.arange(till[-1])
        place, value = self.place[at], self.value[at]
        if keep is not None:
            ok = keep[place // width]
            place, value = place[ok], value[ok]
        return np.bincount(place, value, places)


class ItemIndex:
    """BM25 inverted index of the items, sorted by length: postings with block maxima over runs of ``BLOCK`` items."""

    def __init__(self, items: list[tuple[int, str]], collection: Collection | None = None) -> None:
        listed = [(i, w) for i, t in items if t for w in [words(t)] if w]
        listed.sort(key=lambda x: (len(x[1]), x[0]))
        self.ids, self.words = [i for i, _ in listed], [w for _, w in listed]
        known = collection or Collection.of(self.words)
        rare = lambda t: known.df[t] <= max(3, MOST_ITEMS * known.n)
        # an item of common words alone keeps them all
        kept = [{t: c for t, c in own.items() if rare(t)} or own for own in map(Counter, self.words)]
        self.term = {t: k for k, t in enumerate(sorted({t for own in kept for t in own}))}
        rows = [(self.term[t], j, c, known.df[t]) for j, own in enumerate(kept) for t, c in own.items()]
        term, item, count, df = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        length = np.array([len(w) for w in self.words], float)
        norm = K1 * (1 - B + B * length / max(known.mean, 1.0))
        value = np.log(1 + (known.n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + norm[item])
        n = len(listed)
        self.postings = Postings(term, item, value, len(self.term))
        self.maxima = self.postings.blocks(BLOCK)
        self.items = [Item(w, own) for w, own in zip(self.words, kept)]
        each: list[dict[str, float]] = [{} for _ in listed]
        for t, (_, j, c, _), v in zip((t for own in kept for t in own), rows, value.tolist()):
            each[j][t] = v / c  # an occurrence's part
        self.need = np.array([self._least(w, own) for w, own in zip(self.words, each)])
        self.block_need = np.minimum.reduceat(self.need, np.arange(0, n, BLOCK)) if n else np.zeros(0)
        self.least = self.block_need.min() if n else 0.0
        self.term_max = np.maximum.reduceat(self.postings.value, self.postings.begin[:-1]) if rows else np.zeros(0)

    @staticmethod
    def _least(item: list[str], value: dict[str, float]) -> float:
        """Score from which a passage is aligned: a share of the item's own, and no more than the poorest half of its words (or
        stretch that surely lies in one passage) has when a part of them is damaged."""
        gain = np.cumsum(np.r_[0.0, [value.get(w, 0.0) for w in item]])
        half = min(-(-len(item) // 2), STEP)
        return min(LEAST_SCORE * gain[-1], (1 - DAMAGED) * (gain[half:] - gain[:-half]).min())

    def search(self, terms: np.ndarray) -> np.ndarray:
        """Items whose score over the distinct ``terms`` reaches their need; blocks are skipped by their bounds."""
        keep = None
        if len(self.ids) > SHORT_LISTS:  # else scoring costs no more than its bounds
            keep = self.maxima.sums(terms, len(self.block_need)) >= self.block_need
            if not keep.any():
                return np.zeros(0, np.int64)
        score = self.postings.sums(terms, len(self.ids), keep, BLOCK)
        return np.flatnonzero((score >= self.need) & (score > 0))


@lru_cache(1 << 16)
def close(a: str, b: str) -> bool:
    """Equal, or one edit apart for each five characters."""
    if a == b:
        return True
    n, m = len(a), len(b)
    most = max(n, m) // 5
    if abs(n - m) > most or not most:
        return False
    row = list(range(m + 1))
    for i in range(1, n + 1):
        last, row[0] = row[0], i
        for j in range(1, m + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a[i - 1] != b[j - 1]))
    return row[m] <= most


def _chain(hits: list[tuple[int, list[tuple[int, int]]]], rare: list[bool]) -> tuple[int, dict]:
    """Most words matched by one chain, and the pieces that are strong by themselves: ``(score, path)`` by their start,
    the path being ``(earlier path, text position, item position)``.

    What a chain is worth to a later hit differs between chains by its score plus the costs saved by its end, and it can
    only be followed by a later word of the item. So only chains are kept that are worth more than all that end earlier
    in the item: ``ends`` and ``worth`` rise together, and the best predecessor is the last one before the hit's word.
    """
    ends: list[int] = []
    worth: list[float] = []
    # score, text position, words matched, rare words matched, start, path
    kept: list[tuple[float, int, int, int, tuple[int, int], tuple]] = []
    best, pieces = 0, {}
    for t, tries in hits:
        new = []
        for start, p in tries:
            k = bisect_left(ends, p) - 1
            while k >= 0 and kept[k][1] >= start:
                k -= 1
            if k >= 0 and (score := 1 + worth[k] - SKIP * (start - 1) - MISS * (p - 1)) > 1.0:
                _, _, matched, known, begin, path = kept[k]
                matched += 1
                known += rare[p]
                path = (path, t, p)
                if matched > best and score >= SOLID * matched:
                    best = matched
                if matched >= PIECE and known >= PIECE_RARE and score >= PIECE_SOLID * matched and score > pieces.get(begin, NOTHING)[0]:
                    pieces[begin] = score, path
            else:
                score, matched, known, begin, path = 1.0, 1, int(rare[p]), (start, p), (None, t, p)
                best = best or 1
            new.append((p, score + SKIP * t + MISS * p, (score, t, matched, known, begin, path)))
        for p, value, chain in new:
            k = bisect_right(ends, p)
            if k and worth[k - 1] >= value:
                continue
            if k and ends[k - 1] == p:
                k -= 1
            last, n = k, len(ends)
            while last < n and worth[last] <= value:
                last += 1
            if last == k + 1:
                ends[k], worth[k], kept[k] = p, value, chain
            else:
                ends[k:last], worth[k:last], kept[k:last] = [p], [value], [chain]
    return best, pieces


NOTHING = (0.0,)


def _narrow_pieces(hits: list[tuple[int, list[tuple[int, int]]]], rare: list[bool], widest: int = PIECE_GAP) -> dict:
    """The strong pieces, as ``_chain`` gives them, whose gaps have at most ``widest`` words."""
    chains: list[tuple[float, int, int, int, int, tuple[int, int], tuple]] = []
    pieces: dict = {}
    for t, tries in hits:
        if chains:
            chains = [c for c in chains if t - c[1] - 2 <= widest and c[0] > SKIP * (t - c[1] - 1)]
        new = []
        for start, p in tries:
            score, chosen = 1.0, None
            for c in chains:
                if c[2] < p and c[1] < start and start - c[1] - 1 <= widest:
                    s = c[0] + 1 - SKIP * (start - c[1] - 1) - MISS * (p - c[2] - 1)
                    if s > score:
                        score, chosen = s, c
            if chosen is None:
                new.append((1.0, t, p, 1, int(rare[p]), (start, p), (None, t, p)))
                continue
            matched, known, begin = chosen[3] + 1, chosen[4] + rare[p], chosen[5]
            new.append((score, t, p, matched, known, begin, (chosen[6], t, p)))
            if matched >= PIECE and known >= PIECE_RARE and score >= PIECE_SOLID * matched and score > pieces.get(begin, NOTHING)[0]:
                pieces[begin] = score, new[-1][-1]
        if not chains and len(new) == 1:
            chains = new
            continue
        kept: dict[int, tuple] = {}
        for c in chains + new:
            k = kept.get(c[2])
            if k is None or c[0] - SKIP * (t - c[1]) >= k[0] - SKIP * (t - k[1]):
                kept[c[2]] = c
        chains = list(kept.values())
    return pieces


class Item:
    """An item's words, ready to be aligned with texts; what each text word can stand for is kept from text to text."""

    def __init__(self, item: list[str], rare: Container[str]) -> None:
        self.n, self.tells = len(item), [w in rare for w in item]
        self.where: dict[str, list[int]] = defaultdict(list)
        for p, w in enumerate(item):
            self.where[w].append(p)
        self.ends: dict[str, set[str]] = defaultdict(set)
        for w in self.where:
            if len(w) > 4:
                self.ends["<" + w[:2]].add(w)
                self.ends[">" + w[-2:]].add(w)
        self.spots = _Spots(self)

    def hits(self, text: list[str]) -> list[tuple[int, list[tuple[int, int]]]]:
        """``text position, [(where the word begins, item position)]`` of every text word that can stand for an item's."""
        spots, where, ends, out = self.spots, self.where, self.ends, []
        own = [spots[w] for w in text]
        last = None
        for t, (w, found) in enumerate(zip(text, own)):
            tries = [(t, p) for p in found]
            if last is not None and w not in where and last not in where:  # a word that damage has cut in two
                whole = last + w
                if whole in where or "<" + whole[:2] in ends or ">" + whole[-2:] in ends:
                    tries += [(t - 1, p) for p in spots[whole]]
            if tries:
                out.append((t, tries))
            last = w
        return out

    def share(self, text: list[str]) -> float:
        """Largest share of the item's words that stands in ``text`` in the item's order, as one passage.

        Words put in between cost, so scattered common words make no passage; damaged words count by ``close``. Between
        two pieces that are strong by themselves, with rare words in both, a gap of any length costs ``JUMP``.
        Shares below ``LEAST_WORDS`` may come out as 0.
        """
        n, tells, hits = self.n, self.tells, self.hits(text)
        met = {p for _, tries in hits for _, p in tries}
        if len(met) < LEAST_WORDS * n:  # whatever their order, it is no leak
            return 0.0
        best, wide = _chain(hits, tells)
        if best < n and sum(tells[p] for p in met) >= 2 * PIECE_RARE:  # else there can't be two pieces
            best = max(best, _joined(wide, _narrow_pieces(hits, tells), tells))
        return best / n


class _Spots(dict):
    """Item positions each text word can stand for."""

    def __init__(self, item: Item) -> None:
        super().__init__()
        self.item = item

    def __missing__(self, w: str) -> list[int]:
        item = self.item
        found = item.where.get(w)
        if found is None:
            like = (item.ends.get("<" + w[:2], set()) | item.ends.get(">" + w[-2:], set())) if len(w) > 4 else ()
            found = [p for x in like if close(x, w) for p in item.where[x]]
        if len(self) > 20_000:
            self.clear()
        self[w] = found
        return found


def _joined(wide: dict, narrow: dict, tells: list[bool]) -> int:
    """Most words matched by strong pieces one after the other, each further one at the cost of ``JUMP``."""
    # a piece that only goes on across a wide gap starts anew as well, so that it counts by itself
    both = []
    for score, path in [*wide.values(), *narrow.values()]:
        points = []
        while path:
            path, t, p = path
            points.append((t, p))
        both.append((points[0], score, points[::-1]))
    both.sort()
    strong = lambda x: len(x) >= PIECE and sum(tells[p] for _, p in x) >= PIECE_RARE
    best, joined = 0, []
    for k, ((t1, p1), score, own) in enumerate(both):
        top = score, len(own)
        for ((u1, q1), _, before), (total, m) in zip(both[:k], joined):
            if u1 >= t1 or before[0][1] >= p1:
                continue
            # words of both pieces count once: the later one loses its first or the earlier one its last
            late = [(t, p) for t, p in own if t > u1 and p > q1]
            early = [(t, p) for t, p in before if t < own[0][0] and p < own[0][1]]
            for kept, lost in ((late, len(own) - len(late)), (early, len(before) - len(early))):
                if strong(kept):
                    top = max(top, (total + score - lost - JUMP, m + len(own) - lost))
        joined.append(top)
        if top[0] >= SOLID * top[1]:
            best = max(best, top[1])
    return best


def scan(texts: list[str], index: ItemIndex) -> list[tuple[int, int, float]]:
    """``(text number, item number, share)`` of every leak."""
    if not index.ids:
        return []
    get = index.term.get
    out = []
    for no, text in enumerate(texts):
        own = words(text)
        ids = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            continue
        # upper bounds of all passages at once: each term counts with its largest impact
        gain = np.zeros(len(own) + 1)
        gain[at + 1] = index.term_max[ids[at]]
        total = np.cumsum(gain)
        begin = np.arange(0, max(1, len(own) - STEP), STEP)
        end = np.minimum(begin + PASSAGE, len(own))
        found: set[int] = set()
        for k in np.flatnonzero(total[end] - total[begin] >= index.least).tolist():
            terms = np.unique(ids[begin[k] : end[k]])
            terms = terms[terms >= 0]
            found.update(index.search(terms).tolist())
        for j in sorted(found):
            share = index.items[j].share(own)
            if share >= LEAST_WORDS:
                out.append((no, j, share))
    return out


def leaked(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str) -> DataFrame:
    """``doc, item, share``: documents that hold at least half of an item's words as one passage in order.

    Null and empty texts leak nothing. Repeated rows count once; an item with several texts leaks by any.
    Other columns are ignored. The items are broadcast in groups of at most ``INDEX_ITEMS``; there is one
    pass over the documents per group.
    """
    listed = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    src = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("t")).where("doc is not null and t is not null")
    kinds = src.schema["doc"].dataType.simpleString(), listed.schema["i"].dataType.simpleString()

    def distinct_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each = [(i, words(t)) for i, t in zip(f["i"], f["t"])]
            rows = [(i, w, len(own)) for i, own in each if own for w in set(own)]
            yield pd.DataFrame(rows, columns=["i", "w", "n"])

    # counted once over all items, so that groups don't change a score
    held = cut(listed.withColumn("g", F.xxhash64("i", "t")).select(F.col("g").alias("i"), "t").mapInPandas(distinct_words, "i bigint, w string, n int"))
    df = cut(held.groupBy("w").agg(F.count("*").alias("df")))
    size = held.select("i", "n").distinct().agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    groups = max(1, -(-size["n"] // INDEX_ITEMS))
    own = lambda g, c: F.pmod(c, F.lit(groups)) == g
    spark, result = docs.sparkSession, None
    for g in range(groups):
        part = sorted(tuple(r) for r in listed.where(own(g, F.xxhash64("i", "t"))).collect())
        counts = {r["w"]: r["df"] for r in held.where(own(g, F.col("i"))).select("w").distinct().join(df, "w").collect()}
        shared = spark.sparkContext.broadcast((part, Collection(size["n"], size["mean"] or 0.0, counts)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = ItemIndex(*shared.value)
            for f in frames:
                f = f.reset_index(drop=True)
                hits = scan(f["t"].tolist(), index)
                yield pd.DataFrame({"doc": f["doc"].to_numpy()[[h[0] for h in hits]], "item": [index.ids[h[1]] for h in hits], "share": [h[2] for h in hits]})

        one = src.mapInPandas(run, f"doc {kinds[0]}, item {kinds[1]}, share double")
        result = one if result is None else result.union(one)
    return result.groupBy("doc", "item").agg(F.max("share").alias("share"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item by document, with the share of its words found."""
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 4).alias("share"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
ORACLE: dict[str, str] = {}
