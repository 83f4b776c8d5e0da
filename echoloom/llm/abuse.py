"""Problem 9: abusive, hateful and sexual language, by a factorization machine over hashed terms.

The unit that is scored is the cue, longer ones in overlapping runs of ``RUN`` words, so that words around an
outburst don't water it down. Folded words and word pairs are hashed; a factorization machine adds to the terms'
weights the interactions of all term pairs, so that a group's name or an insult counts by its company ("the Xs are
vermin" against "the Xs won again"), which additive weights can't tell. One set of factors serves the three
categories, each of which has its own weights and its own mix of the factors.

Reviewers label documents, not cues, and some label wrongly. So the machine is trained by alternation: in a
document labelled with a category the best-scoring units are its witnesses, all units of documents without the label
are counterexamples. The scores that choose the witnesses come from machines fitted on other documents (``FOLDS``
parts); a document in which these find nothing is taken for a mistake and isn't learnt by heart. The same scores set
each category's limit, which the reported scores have at one half. At most ``SAMPLE`` labelled documents are used;
everything else covers every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.llm.leakage import NOISE, WORD, fold
from echoloom.runtime import table

CATEGORIES = ("abusive", "hateful", "sexual")
#: Hash buckets, factors, labelled documents used at most, and the least score of a hit.
BUCKETS, FACTORS, SAMPLE, LEAST = 1 << 17, 8, 20_000, 0.5
FOLDS, EPOCHS, RATE, DECAY, DOUBT, EASY, WITNESS, SEED = 4, 3, 0.15, 1e-5, -2.5, -4.5, 1.5, 3
#: Words of a unit and the step between units; probabilities tried as a category's limit.
RUN, STEP, LIMITS = 8, 4, (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8)
CUE_BREAK = re.compile(r"\n[ \t\r]*\n")
REPEAT = re.compile(r"(\w)\1+")
#: A word with letters of two scripts; fixed values: letters that look like a Latin one.
MIXED = re.compile(r"\w*(?:[a-z][\u0370-\u052f]|[\u0370-\u052f][a-z])\w*")
ALIKE = str.maketrans("авсеһіјкмпоршѕтухԁԛԝаеорсухіѕјανοερτυικηχ", "abcehljkmnopwstyxdqwaeopcyxlsjavoeptulknx")
UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")
SPELLED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w){3,}(?!\w)")


def _joined(m: re.Match) -> str:
    return re.sub(r"[ .*_-]", "", m[0])


def cue_words(text: str) -> list[list[str]]:
    """Folded words of every cue; repeated letters count once, letters spelled out singly are joined,
    look-alikes from another script inside a word are replaced."""
    out = []
    plain = REPEAT.sub(r"\1", fold(CUE_BREAK.sub("\n\x1e", NOISE.sub(" ", text))))
    foreign = not plain.isascii()
    for cue in plain.split("\x1e"):
        if foreign and MIXED.search(cue):
            cue = REPEAT.sub(r"\1", MIXED.sub(lambda m: m[0].translate(ALIKE), cue))
        words = WORD.findall(cue)
        if sum(len(w) == 1 for w in words) > 3:
            words = WORD.findall(REPEAT.sub(r"\1", SPELLED.sub(_joined, cue)))
        if words and UNSPACED.search(cue):
            words = _pairs(words)
        if words:
            out.append(words)
    return out


def _pairs(words: list[str]) -> list[str]:
    """Character pairs of words in scripts without spaces; other words as they are."""
    out = []
    for w in words:
        if UNSPACED.search(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def units(cues: list[list[str]]) -> list[list[str]]:
    """Cues of up to ``RUN + 2`` words as they are, longer ones in runs that overlap by half."""
    out = []
    for c in cues:
        if len(c) <= RUN + 2:
            out.append(c)
        else:
            out += [c[i : i + RUN] for i in [*range(0, len(c) - RUN, STEP), len(c) - RUN]]
    return out


class Terms(dict):
    """64-bit hash of each word."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w) & 0x7FFFFFFFFFFFFFFF
        if len(self) < 500_000:
            self[w] = h
        return h


def features(cues: list[list[str]], terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all cues' words and adjacent word pairs, and where each cue begins (one more at the end)."""
    size = np.array([len(c) for c in cues], np.int64)
    h = np.array([terms[w] for c in cues for w in c], np.uint64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(cues) + 1, np.int64)
    begin = np.cumsum(size) - size
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(31)
    within = np.ones(len(h), bool)
    within[begin + size - 1] = False  # the last word of a cue has no pair
    own = (h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)
    two = np.full(len(h), -1, np.int64)
    two[:-1] = (pair % np.uint64(BUCKETS)).astype(np.int64)
    two[~within] = -1
    both = np.stack([own.astype(np.int64), two], 1).ravel()
    keep = both >= 0
    at = np.r_[0, np.cumsum(2 * size - 1)]
    return both[keep], at


class Machine:
    """Weights ``w[bucket, category]``, factors ``v[bucket, factor]``, mix ``u[category, factor]``, offsets ``b``."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        n = len(CATEGORIES)
        self.w = np.zeros((BUCKETS, n), np.float32)
        self.v = rng.normal(0, 0.05, (BUCKETS, FACTORS)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (n, FACTORS)).astype(np.float32)
        self.b = np.full(n, -3.0, np.float32)
        self.limits = np.full(n, 0.5)
        self.slow = [np.full_like(x, 1e-4) for x in (self.w, self.v, self.u, self.b)]

    def _sums(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scale = 1 / np.sqrt(np.diff(at))[:, None].astype(np.float32)
        v = self.v[ids]
        s = np.add.reduceat(v, at[:-1], axis=0)
        pairs = 0.5 * (s * s - np.add.reduceat(v * v, at[:-1], axis=0)) * scale
        return np.add.reduceat(self.w[ids], at[:-1], axis=0), s, pairs

    def frozen(self) -> np.ndarray:
        """Per bucket: weights, half the mixed squares of its factors, factors; what ``score`` sums up."""
        return np.concatenate([self.w, 0.5 * (self.v * self.v) @ self.u.T, self.v], 1)

    def score(self, ids: np.ndarray, at: np.ndarray, frozen: np.ndarray | None = None, block: int = 16_384) -> np.ndarray:
        n, known = len(CATEGORIES), self.frozen() if frozen is None else frozen
        out = np.zeros((len(at) - 1, n), np.float32)
        for a in range(0, len(out), block):
            cut = at[a : a + block + 1]
            total = np.add.reduceat(known[ids[cut[0] : cut[-1]]], cut[:-1] - cut[0], axis=0)
            mixed = 0.5 * np.square(total[:, 2 * n :]) @ self.u.T - total[:, n : 2 * n]
            out[a : a + block] = total[:, :n] + mixed / np.sqrt(np.diff(cut))[:, None].astype(np.float32) + self.b
        return out

    def step(self, ids: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One adaptive gradient step on the weighted logistic loss of a batch of cues."""
        n = np.diff(at)
        scale = 1 / np.sqrt(n)[:, None].astype(np.float32)
        linear, s, pairs = self._sums(ids, at)
        z = linear + pairs @ self.u.T + self.b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        cue = np.repeat(np.arange(len(n)), n)
        gp = (g @ self.u) * scale
        gv = gp[cue] * (s[cue] - self.v[ids])
        gw = g[cue]
        used, where = np.unique(ids, return_inverse=True)
        order = np.argsort(where, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0])
        for x, slow, grad in ((self.w, self.slow[0], gw), (self.v, self.slow[1], gv)):
            t = np.add.reduceat(grad[order], starts, axis=0) + DECAY * len(n) * x[used]
            slow[used] += t * t
            x[used] -= RATE * t / np.sqrt(slow[used])
        for x, slow, t in ((self.u, self.slow[2], g.T @ pairs), (self.b, self.slow[3], g.sum(0))):
            slow += t * t
            x -= 0.3 * RATE * t / np.sqrt(slow)


def _take(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (at[1:] - at[:-1])[rows]
    begin = np.r_[0, np.cumsum(n)]
    return ids[np.repeat(at[rows] - begin[:-1], n) + np.arange(begin[-1])], begin


def _first_guess(ids: np.ndarray, at: np.ndarray, owner: np.ndarray, labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How far each unit's terms stand in labelled documents rather than others, by category; counted over ``seen`` documents."""
    use = np.repeat(seen[owner], np.diff(at))
    pair = np.unique(np.repeat(owner, np.diff(at))[use] * np.int64(BUCKETS) + ids[use])
    doc, term = pair // BUCKETS, pair % BUCKETS
    every, share = np.bincount(term, minlength=BUCKETS), labels[seen].mean(0)
    odds = np.zeros((BUCKETS, len(CATEGORIES)), np.float32)
    for c in range(len(CATEGORIES)):
        with_ = np.bincount(term, labels[doc, c], BUCKETS)
        odds[:, c] = np.log((with_ + 4 * share[c] + 1e-3) / (every + 4)) - np.log(share[c] + 1e-3)
    return np.add.reduceat(np.maximum(odds[ids], 0), at[:-1], axis=0) / np.sqrt(np.diff(at))[:, None]


def _fit(ids: np.ndarray, at: np.ndarray, owner: np.ndarray, labels: np.ndarray, guess: np.ndarray, rows: np.ndarray, scored: bool, epochs: int) -> Machine:
    """A machine fitted on the units ``rows``, whose witnesses are chosen by ``guess``, a machine's scores if ``scored``."""
    machine, rng, lab = Machine(), np.random.default_rng(SEED), labels[owner]
    y, weight = np.zeros(lab.shape, np.float32), np.ones(lab.shape, np.float32)
    for c in range(len(CATEGORIES)):
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, owner, guess[:, c])
        top, pos = guess[:, c] >= best[owner] - 1e-6, lab[:, c] > 0.3
        y[pos & top, c] = 1.0
        weight[pos & top, c] = WITNESS * lab[pos & top, c]
        likely = guess[:, c] > (0.0 if scored else 0.5 * best[owner])
        weight[pos & ~top, c] = np.where(likely[pos & ~top], 0.0, 0.3)
        if scored:
            y[pos & ~top & likely, c] = weight[pos & ~top & likely, c] = 1.0
            weight[pos & (best[owner] < DOUBT), c] = 0.0
    # once there are scores, only a part of the units that are clearly harmless is seen
    clear = (y[rows].max(1) <= 0) & (guess[rows].max(1) <= EASY) if scored else np.zeros(len(rows), bool)
    hard, easy = rows[~clear], rows[clear]
    for _ in range(epochs):
        order = rng.permutation(np.r_[hard, rng.choice(easy, len(easy) // 4, replace=False)])
        for a in range(0, len(order), 2048):
            part = order[a : a + 2048]
            machine.step(*_take(ids, at, part), y[part], weight[part])
    return machine


def _limit(labels: np.ndarray, score: np.ndarray, slack: float = 0.01) -> float:
    """The middle of the probabilities above which documents agree with their labels as well as can be (F1 within
    ``slack`` of the best); one half where nothing tells."""
    f1 = np.array([2 * (labels & (score >= x)).sum() / max(1, labels.sum() + (score >= x).sum()) for x in LIMITS])
    return float(np.median(np.array(LIMITS)[f1 >= f1.max() - slack])) if f1.max() > 0 else 0.5


def train(texts: list[str], labels: np.ndarray) -> Machine:
    """``labels[document, category]``: share of the reviewers that chose the category. Sets the machine's ``limits``."""
    terms, found, owner = Terms(), [], []
    for d, t in enumerate(texts):
        own = {tuple(c) for c in units(cue_words(t))}
        found += sorted(own)
        owner += [d] * len(own)
    if not found:
        return Machine()
    owner = np.array(owner)
    ids, at = features(found, terms)
    fold = np.random.default_rng(SEED).integers(0, FOLDS, len(texts))
    guess = np.zeros((len(owner), len(CATEGORIES)), np.float32)
    for scored in (False, True):  # first by counts, then by machines, of the other documents
        new = np.zeros_like(guess)
        for f in range(FOLDS):
            own, rest = np.flatnonzero(fold[owner] == f), np.flatnonzero(fold[owner] != f)
            if not len(own):
                continue
            if not scored:
                new[own] = _first_guess(ids, at, owner, labels, fold != f)[own] if len(rest) else 0.0
            elif len(rest):
                new[own] = _fit(ids, at, owner, labels, guess, rest, False, EPOCHS).score(*_take(ids, at, own))
        guess = new
    machine = _fit(ids, at, owner, labels, guess, np.arange(len(owner)), True, 2 * EPOCHS)
    for c in range(len(CATEGORIES)):
        best = np.full(len(texts), -30.0)
        np.maximum.at(best, owner, guess[:, c])
        machine.limits[c] = _limit(labels[:, c] > 0.3, 1 / (1 + np.exp(-np.clip(best, -30, 30))))
    return machine


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and shares of verdicts of at most ``SAMPLE`` labelled documents, chosen by their id's hash."""
    votes = labels.where("doc_id is not null and verdict is not null").select("doc_id", "reviewer", "verdict").distinct()
    per = votes.groupBy("doc_id").agg(*[F.avg((F.col("verdict") == c).cast("double")).alias(c) for c in CATEGORIES])
    per = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(per), "doc_id").distinct().orderBy("doc_id", "text").toPandas()
    return rows["text"].tolist(), rows[list(CATEGORIES)].to_numpy(np.float64)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, abusive, hateful, sexual``: the highest score of any of the document's units, the category's
    limit being at one half.

    Null texts and texts without words score 0; repeated rows of a document count once, with their highest
    score; with no labels at all every score is the machine's prior. Other columns are ignored.
    """
    texts, shares = labelled(docs, labels)
    machine = train(texts, shares)
    shift = np.log(machine.limits / (1 - machine.limits)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((machine.frozen(), machine.u, machine.b - shift))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, terms = Machine.__new__(Machine), Terms()
        frozen, m.u, m.b = shared.value
        for f in frames:
            f = f.reset_index(drop=True)
            best = np.zeros((len(f), len(CATEGORIES)), np.float32)
            for a in range(0, len(f), 256):
                cues, owner = [], []
                for d, t in enumerate(f["text"].iloc[a : a + 256]):
                    if t:
                        own = units(cue_words(t))
                        cues += own
                        owner += [a + d] * len(own)
                if cues:
                    np.maximum.at(best, np.array(owner), 1 / (1 + np.exp(-np.clip(m.score(*features(cues, terms), frozen), -30, 30))))
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], **{c: best[:, k].astype(float) for k, c in enumerate(CATEGORIES)}})

    shape = "doc_id bigint, source string, " + ", ".join(f"{c} double" for c in CATEGORIES)
    scored = docs.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(run, shape)
    return scored.groupBy("doc_id").agg(F.min("source").alias("source"), *[F.max(c).alias(c) for c in CATEGORIES])


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("p")) for c in CATEGORIES])).alias("e")
    return p9_scores(spark, sf_dir).select("doc_id", each).where(F.col("e.p") >= LEAST).select("doc_id", "e.category")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's documents that has a hit, by category."""
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), *[F.round(F.avg((F.col(c) >= LEAST).cast("double")), 6).alias(f"rate_{c}") for c in CATEGORIES])


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLE: dict[str, str] = {}
