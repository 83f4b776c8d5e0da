"""Problem 4: sentence units in any language or script.

Periods are disambiguated from the document itself first: a word that stands with a period before a small letter,
a digit or a comma elsewhere in the document, and never plainly, is an abbreviation there; one that stands plainly is
none, whatever a list says of it. A capitalised word that stands inside a sentence elsewhere is a name, one that also
occurs in small letters an ordinary word that must have begun a sentence. What the document doesn't tell is taken
from counts over the whole collection, and failing those from a short fixed list. Each script has its own terminators.
"""

from __future__ import annotations

import re as stdlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.runtime import cut, table

BLANK = re.compile(r"(?:\r\n|[\n\r \x85])[^\S\n\r]*(?:\r\n|[\n\r \x85])\s*| \s*")
STOP = re.compile(r"[.．](?:\s?[.．])+|[.．]|[!?…。！？؟۔।॥｡։።]|;|;")
CLOSERS = "\"'”’“»«›‹」』】）)]｣〉》"
OPENING = {"„": "“”", "“": "”", "«": "»", "»": "«", "「": "」", "『": "』", "‹": "›", '"': '"', "‘": "’", "'": "'", "｢": "｣"}
OPENERS = re.compile("[" + "".join(map(re.escape, OPENING)) + "]")
DASHES = "-–—―"
ALNUM = re.compile(r"[\p{L}\p{N}]")
THAI, GREEK, DEVANAGARI, CJK = (re.compile(f"[{x}]") for x in (r"\p{Thai}", r"\p{Greek}", r"\p{Devanagari}", r"\p{Han}\p{Hiragana}\p{Katakana}"))
APART = frozenset("\"'“”„«»‹›()[]（）「」『』¿¡—–,;:!?…，、。！？：；")
WORD_AFTER = re.compile(r"[\p{L}\p{M}'’-]+")
#: Fixed values. Abbreviations that go before a name or a number and end nothing; ones that may end a sentence;
#: conjunctions, by which scripts without capitals show that a pause was none; reporting verbs of unspaced quotations.
BEFORE_NAME = set("mr mrs ms dr prof st capt sgt lt col gen rev hon messrs mme mlle mm m hr hrn fr frl sr sra srta dra don д-р им ул г гг п т проф тов αρ δρ κ κα σελ डॉ श्री د م أ ص ст".split())
BEFORE_NUMBER = set("no nr nos vol vols fig figs ch chap p pp pag pág cap núm num art bd abb kap s approx ca env aprox approx ed sec стр с рис гл прибл ок т п αρ σελ εικ पृ सं".split())
MAY_END = set("etc a.m p.m jr sr ltd bros inc co corp usw vorm nachm u.s.w κ.λπ π.μ μ.μ т.д т.п др н.э n.chr v.chr j.-c d.c a.c रु कि.मी".split())
NEVER_END = set("av v n e.g i.e vs cf viz d.h z.b u.a bzw evtl ggf p.ej p.ex c.-à-d т.е т.к напр δηλ π.χ".split()) | BEFORE_NUMBER
JOINING = ("because", "but", "and", "until", "لأن", "لكن", "ثم", "و", "حتى", "क्योंकि", "और", "लेकिन", "जब तक", "मगर", "因为", "但是", "而且", "直到", "所以", "だから", "しかし", "そして", "から", "แต่", "และ", "เพราะ", "จน")
JOINS = re.compile("|".join(x if CJK.match(x) else x + r"(?!\p{L})" for x in JOINING))
JOINS_UNSPACED = re.compile("|".join(x for x in JOINING if len(x) > 1 and not x.isascii()))
REPORTS = re.compile(r"[^。！？!?\n“「『：:]{1,14}?(?:说|說|道|问|問|喊|答|叫|想|念|と)(?=[。，,：:！？\s]|$)|と")


#: Words of a reporting clause after a quotation at most.
CLAUSE = 4
GOES_ON = re.compile(r"\.(?=\s+[\p{Ll}\d]|[,;:])")
INNER = re.compile(r"(?<=[\p{Ll},] )\p{Lu}[\p{L}\p{M}'’-]*")
PLAIN = stdlib.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*(?![\w.])")
SMALL = stdlib.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def _token_before(text: str, start: int, at: int) -> str:
    """What stands right before ``at``, back to white space, a mark or ``start``."""
    i = at
    while i > start and text[i - 1] not in APART and not text[i - 1].isspace():
        i -= 1
    return text[i:at]


class Document:
    """What a document says about its own words; ``short`` and ``ordinary`` are what the collection says of them: its
    abbreviations, and words that stand in small letters unless they begin a sentence. Each index is built once, when first asked for."""

    def __init__(self, text: str, short: frozenset[str] = frozenset(), ordinary: frozenset[str] = frozenset()) -> None:
        self.text, self.short, self.ordinary = text, short, ordinary
        self.titles: dict[str, int] = {}

    @cached_property
    def dotted(self) -> dict[str, int]:
        """Times each word stands with a period after which its sentence goes on."""
        out: dict[str, int] = {}
        for m in GOES_ON.finditer(self.text):
            w = _token_before(self.text, max(0, m.start() - 24), m.start())
            if w:
                w = w.lower().lstrip("(¿¡-–—")
                out[w] = out.get(w, 0) + 1
        return out

    @cached_property
    def plain(self) -> Counter:
        """Times each word stands without a period."""
        return Counter(PLAIN.findall(self.text.lower()))

    @cached_property
    def small(self) -> set[str]:
        return set(SMALL.findall(self.text))

    @cached_property
    def inner(self) -> set[str]:
        """Words that stand capitalised inside a sentence."""
        return set(INNER.findall(self.text))

    def stands_plain(self, w: str) -> int:
        """``plain``, but a title without its period before a name counts as none."""
        n = self.plain.get(w, 0)
        if not n or w not in BEFORE_NAME:
            return n
        if w not in self.titles:
            self.titles[w] = len(stdlib.findall(rf"(?<![\w.]){stdlib.escape(w)}(?![\w.])(?!\s+[^\W\d_])", self.text.lower())) + sum(1 for m in stdlib.finditer(rf"(?i:(?<![\w.]){stdlib.escape(w)})\s+([^\W\d_])", self.text) if m[1].islower())
        return self.titles[w]

    def begins(self, w: str) -> bool:
        """The capitalised ``w`` is an ordinary word, so it begins a sentence."""
        if not w or not w[0].isupper() or w in self.inner:
            return False
        return w.lower() in self.small or w.lower() in self.ordinary


def quotes(par: str) -> list[tuple[int, int]]:
    """Stretches between an opening mark and its closing mark."""
    out, i = [], 0
    while m := OPENERS.search(par, i):
        i = m.start()
        ends = OPENING[par[i]]
        c, before, after = par[i], par[i - 1 : i], par[i + 1 : i + 2]
        if c in "\"'‘»" and (before.isalnum() or after.isspace() or not after or (c != '"' and before and before in ".!?…,")):
            i += 1
            continue
        j = i + 1
        while True:
            j = min((k for k in (par.find(e, j) for e in ends) if k >= 0), default=-1)
            if j < 0 or _opened_again(par, i, j):
                j = -1
                break
            # an apostrophe inside a word closes nothing
            if par[j] in "'’" and par[j - 1 : j].isalnum() and par[j + 1 : j + 2].isalpha():
                j += 1
                continue
            if par[j] in "'’" and par[j - 1 : j] not in ".!?…,":
                j += 1
                continue
            break
        if j < 0:
            i += 1
        else:
            out.append((i, j))
            i = j + 1
    return out


def _opened_again(par: str, i: int, j: int) -> bool:
    """Between the opening mark at ``i`` and the closing one at ``j`` the same mark opens anew: the first has lost its end."""
    k = par.find(par[i], i + 1, j)
    while k >= 0:
        if par[i] not in OPENING[par[i]] or (par[k - 1].isspace() and not par[k + 1 : k + 2].isspace()):
            return True
        k = par.find(par[i], k + 1, j)
    return par[i] in OPENING[par[i]] and par[j] == par[i] and par[j - 1].isspace() and par[j + 1 : j + 2].isalnum()


def _ends(doc: Document, par: str, m: re.Match, start: int, end: int) -> bool:
    """Whether the stop ``m`` of the paragraph, with its closing marks up to ``end``, ends the sentence begun at ``start``."""
    stop, at = m[0], m.start()
    rest = par[end:]
    tail = rest.lstrip()
    if not tail:
        return True
    gap, nxt = rest[: len(rest) - len(tail)], tail[0]
    closed = par[m.end() : end].strip()
    period = stop[0] in ".．"
    dots = stop == "…" or (period and len(stop) > 1)
    if stop in (";", ";") and not GREEK.search(par[max(0, at - 3) : at]):
        return False
    if nxt in ",;:،、，；：)" or (nxt in STOP_CHARS and not closed):
        return False
    if nxt in DASHES:
        said = tail.lstrip(DASHES + "  ")
        if gap == "" and not closed and period and not dots:
            return False
        return not said or not said[0].islower()
    if nxt.islower():
        return False
    if (dots or closed) and JOINS.match(tail):
        return False
    if dots and JOINS_UNSPACED.match(tail):
        return False
    if closed and CJK.search(nxt):
        opened = par[start:at].lstrip()[:1]
        if tail.startswith("と") or (opened in "“「『" and REPORTS.match(tail)):
            return False
    if closed and par[start:at].lstrip()[:1] in OPENING and _reports(doc, tail):
        return False
    if not period or dots:
        if stop in "!?" and not closed and gap == "" and nxt.isalnum() and nxt.isascii() and not nxt.isupper():
            return False
        return True
    # a single period
    before = par[at - 1 : at]
    if gap == "" and not closed:
        if before.isdigit() and nxt.isdigit():
            return False
        if not (nxt.isupper() and before.islower() and par[max(0, at - 2) : at].isalpha()) and not CJK.match(nxt) and nxt not in "\"“«„‘'¿¡(":
            return False
    token = _token_before(par, start, at)
    if token.isascii() is False and token[-1:].isascii():  # a short form written onto unspaced script
        token = CJK.split(token)[-1]
    if closed and closed[0] not in "'’":
        return True
    if DEVANAGARI.search(before) or THAI.search(before):
        return False
    if token.isdigit():
        if following_month(tail):
            return False
        line = par.rfind("\n", 0, at) + 1
        return par[max(start, line) : at].strip() != token
    w = token.lower().lstrip("(¿¡-–—")
    flat = w.replace("\u00a0", "")
    letters = [x for x in w if x.isalpha()]
    following = WORD_AFTER.match(tail)
    following = following[0] if following else ""
    if not letters:
        return True
    if len(w) == 1:  # an initial
        return w not in BEFORE_NAME and not (len(following) == 1 and tail[1:2] == ".") and doc.begins(following)
    if "." in flat.strip("."):  # several initials or short forms
        if len(letters) <= 4 and flat not in MAY_END and not flat.endswith(("a.m", "p.m")):
            return doc.begins(following)
    listed = flat in MAY_END or flat in NEVER_END or flat in BEFORE_NAME or flat.endswith(("a.m", "p.m"))
    goes_on = doc.dotted.get(flat, 0)
    if not listed and flat not in doc.short and (not goes_on or flat in doc.ordinary):
        return True  # a small letter after a common word's period is a slip
    if nxt.isdigit() and (flat in BEFORE_NUMBER or goes_on or flat in doc.short):
        return False
    plain = doc.stands_plain(flat)
    if plain and plain >= goes_on:  # the document uses it as a word
        return True
    if flat in MAY_END or flat.endswith(("a.m", "p.m")):
        return not nxt.isdigit()
    if (goes_on and len(flat) <= LONGEST) or flat in doc.short:
        return doc.begins(following)
    return not listed


#: Letters of an abbreviation that a document alone can make known.
LONGEST = 9


def _reports(doc: Document, tail: str) -> bool:
    """After a quotation that begins its sentence: a clause of few words up to the next stop, without a quotation of its own, which
    begins with a name or in a script without capitals."""
    stop = STOP.search(tail)
    clause = tail[: stop.start()] if stop else tail
    words = clause.split()
    if not 0 < len(words) <= CLAUSE or any(c in OPENING or c in ",;:،؛" or c in DASHES for c in clause) or CJK.search(clause):
        return False
    first = WORD_AFTER.match(words[0])
    if first is None or first[0] != words[0]:
        return False
    if first[0][0].isupper():  # a name and, in small letters, what it did
        return len(words) > 1 and words[-1][0].islower() and not doc.begins(first[0])
    return not first[0][0].islower() and len(words) > 1


def following_month(tail: str) -> bool:
    word = WORD_AFTER.match(tail)
    return word is not None and word[0] in MONTHS


#: Months that follow an ordinal number with a period.
MONTHS = set("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
STOP_CHARS = ".．!?…。！？؟۔।॥"
def _thai_space(par: str, m: re.Match) -> bool:
    a, b = par[m.start() - 1 : m.start()], par[m.end() : m.end() + 1]
    if "\n" in m[0] or "\r" in m[0] or not a or not b:
        return False
    return not (a.isdigit() or b.isdigit()) and bool(THAI.match(a) or THAI.match(b)) and a not in ",:;"


SPACE = re.compile(r"\s+")


def sentences(text: str, short: frozenset[str] = frozenset(), ordinary: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Code-point spans of the sentences of a text, in order; ``short`` and ``ordinary`` are the collection's abbreviations and
    ordinary words among the text's own."""
    doc, out = Document(text, short, ordinary), []
    begin = 0
    for end, after in [*((m.start(), m.end()) for m in BLANK.finditer(text)), (len(text), len(text))]:
        par, offset = text[begin:end], begin
        begin = after
        if not ALNUM.search(par):
            continue
        quoted = quotes(par)
        inside = lambda i: any(a < i < b for a, b in quoted)
        cuts, start, q = [], len(par) - len(par.lstrip()), 0
        thai = THAI.search(par) is not None
        stops = sorted([*STOP.finditer(par), *(SPACE.finditer(par) if thai else ())], key=lambda m: m.start())
        for m in stops:
            if m.start() < start:
                continue
            if m[0].isspace():
                if _thai_space(par, m) and not inside(m.start()):
                    cuts.append((start, m.start()))
                    start = m.end()
                continue
            end_ = m.end()
            while end_ < len(par) and (par[end_] in STOP_CHARS or (par[end_] in CLOSERS and _closes(par, end_, quoted)) or (par[end_].isspace() and any(b == end_ + 1 for _, b in quoted))):
                end_ += 1
            held = [b for a, b in quoted if a < m.start() < b]
            if held and end_ <= held[0]:
                continue  # the quotation goes on
            if _ends(doc, par, m, start, end_):
                cuts.append((start, end_))
                start = end_ + len(par[end_:]) - len(par[end_:].lstrip())
        cuts.append((start, len(par)))
        for a, b in cuts:
            piece = par[a:b]
            lead = len(piece) - len(piece.lstrip())
            a, b = a + lead, a + len(piece.rstrip())
            if a < b:
                if ALNUM.search(par, a, b) or not out or out[-1][1] <= offset:
                    out.append((offset + a, offset + b))
                else:  # stray marks belong to the sentence before them
                    out[-1] = (out[-1][0], offset + b)
    return out


def _closes(par: str, i: int, quoted: list[tuple[int, int]]) -> bool:
    """The mark at ``i`` closes something, rather than opening the next quotation."""
    if par[i] in ")]）】":
        return True
    if any(b == i for _, b in quoted):
        return True
    return not any(a == i for a, _ in quoted) and not par[i + 1 : i + 2].isalnum()


#: How a word counts in the collection: times with a period at least before it can be an abbreviation, share of these after which
#: the sentence goes on, times as many as it stands plainly; times in small letters before a word is ordinary, and times as
#: many as it stands capitalised inside a sentence.
DOTTED, GOING_ON, RATHER, IN_SMALL, RATHER_SMALL = 5, 0.25, 6, 5, 4
#: Letters of an abbreviation that the collection makes known, and words up to which its knowledge is broadcast (some 10 MB).
SHORT, BROADCAST_WORDS = 12, 500_000


def collection_words(texts: DataFrame) -> DataFrame:
    """``w, short, ordinary`` of the words of distinct ``texts(t)`` that the collection knows as abbreviations or as ordinary words.

    Words are counted by built-in expressions over all texts; marks put into the text tell a period after which the
    sentence goes on and a capital inside a sentence.
    """
    marked = F.regexp_replace(F.translate("t", "\u0001\u0002", ""), r"\.(?=\s+[\p{Ll}\d]|[,;:])", "\u0001")
    marked = F.regexp_replace(marked, r"([\p{Ll},] )(?=\p{Lu})", "$1\u0002")
    each = texts.select(F.explode(F.regexp_extract_all(marked, F.lit("\u0002?\\p{L}(?:[\\p{L}\\p{M}’-]|[.\u0001](?=\\p{L}))*+[.\u0001]?"), F.lit(0))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    bare = F.regexp_replace(F.translate("k", "\u0001\u0002", "."), r"\.$", "")
    w = F.lower(bare)
    dotted = F.col("k").rlike("[.\u0001]$") | w.contains(".")
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    words = each.groupBy(w.alias("w")).agg(count(dotted, "dotted"), count(~dotted, "plain"), count(F.col("k").endswith("\u0001"), "going"), count(~dotted & (bare == w), "small"), count(F.col("k").startswith("\u0002"), "inner"))
    short = (F.char_length("w") <= SHORT) & (F.col("dotted") >= DOTTED) & (F.col("going") >= GOING_ON * F.col("dotted")) & (F.col("dotted") >= RATHER * F.col("plain"))
    ordinary = (F.col("small") >= IN_SMALL) & (F.col("small") >= RATHER_SMALL * F.col("inner"))
    return words.select("w", short.alias("short"), ordinary.alias("ordinary")).where("short or ordinary")


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, sentence_index, sent_start, sent_end`` in code points, ``sentence_index`` from 0.

    Null, empty and blank texts have no sentences; repeated rows count once, a key with several texts has the
    sentences of each. Other columns are ignored. What the collection knows of its words is broadcast while these are at
    most ``BROADCAST_WORDS``; beyond that each text is joined with what is known of the words it can ask for.
    """
    src = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").distinct()
    known = cut(collection_words(src.select("t").distinct()))
    none = frozenset()
    if known.count() <= BROADCAST_WORDS:
        rows = known.collect()
        shared = src.sparkSession.sparkContext.broadcast((frozenset(r["w"] for r in rows if r["short"]), frozenset(r["w"] for r in rows if r["ordinary"])))
        facts = lambda f: ((*shared.value,) for _ in range(len(f)))
        whole = src
    else:
        # words before a period, words after one, and words after a quotation are all that is ever asked for
        before = F.regexp_extract_all("t", F.lit(rf"(?<![\p{{L}}\p{{M}}.’-])(\p{{L}}[\p{{L}}\p{{M}}.’-]{{0,{SHORT - 1}}})\.(?=\s)"), F.lit(1))
        after = F.regexp_extract_all("t", F.lit(r"[.．!?…\"'”’“»«›‹」』)\]]\s*(\p{L}[\p{L}\p{M}'’-]*)"), F.lit(1))
        asked = src.select(F.xxhash64("t").alias("h"), F.explode(F.array_distinct(F.transform(F.concat(before, after), F.lower))).alias("w"))
        found = asked.join(known, "w").groupBy("h").agg(F.collect_set(F.when(F.col("short"), F.col("w"))).alias("short"), F.collect_set(F.when(F.col("ordinary"), F.col("w"))).alias("ordinary"))
        whole = src.withColumn("h", F.xxhash64("t")).join(found, "h", "left").select("id", "t", "short", "ordinary")
        facts = lambda f: ((none if s is None else frozenset(s), none if o is None else frozenset(o)) for s, o in zip(f["short"], f["ordinary"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, a, b) for i, t, (s, o) in zip(f["id"], f["t"], facts(f)) for k, (a, b) in enumerate(sentences(t, s, o))]
            yield pd.DataFrame(rows, columns=["id", "sentence_index", "sent_start", "sent_end"])

    return whole.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, sentence_index int, sent_start int, sent_end int")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "drafts"), "draft_id", "text").select(F.col("id").alias("draft_id"), "sent_start", "sent_end").distinct()


def p4_span_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span's first sentence, stated again where its text stands in its draft: the last sentence begun by its start.

    A span whose draft or text isn't known, or whose text doesn't stand there, has no row.
    """
    drafts = table(spark, sf_dir, "drafts").select("draft_id", F.col("text").alias("draft")).where("draft is not null").distinct()
    spans = table(spark, sf_dir, "spans").select("span_id", "draft_id", "text").where("text is not null and draft_id is not null and length(text) > 0").distinct()
    at = spans.join(drafts, "draft_id").select("span_id", "draft_id", (F.expr("instr(draft, text)") - 1).alias("start")).where("start >= 0")
    sent = split_sentences(table(spark, sf_dir, "drafts"), "draft_id", "text").select(F.col("id").alias("draft_id"), "sentence_index", "sent_start")
    met = at.join(sent, "draft_id").where("sent_start <= start")
    return met.groupBy("span_id", "draft_id").agg(F.max("sentence_index").alias("sentence_index"))


QUERIES = {"p4_found": p4_found, "p4_span_sentences": p4_span_sentences}
ORACLE: dict[str, str] = {}
