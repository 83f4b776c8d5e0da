"""From instances to a report: addresses, sentence borders, verdicts, merged passes, statistics."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from echoloom.functions import text as T
from echoloom.operators.intervals import containing

#: Words up to which a duplicate is deleted, words of a paragraph, similarity that counts as high.
DELETE_WORDS, PARAGRAPH_WORDS, HIGH = 15, 40, 0.95
TERMINATOR, SPACE = re.compile(r"[.!?](?=\s|$)"), re.compile(r"\s*")


def span_locations(spans: DataFrame, acts: DataFrame, paragraphs: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``location``: chapter, act, paragraph, segment id, sentence, offsets in the act and in the document.

    The paragraph is the one that holds the span's start, else its act's first (sentence 1); a span in no act is given to
    the first act. ``spans`` need ``start, end``; ``acts`` ``chapter, act, start, end``; ``paragraphs`` as ``segment.assembled``
    gives them. Without any act all is 1 and offsets count from 0.
    """
    a = acts.select(*key, F.col("act").alias("in_act"), F.col("start").alias("act_start"), F.col("end").alias("act_end"))
    p = paragraphs.select(*key, F.col("paragraph_index").alias("p_no"), F.col("segment_id").alias("p_id"), F.col("doc_char_start").alias("p_start"), F.col("doc_char_end").alias("p_end"), F.col("text").alias("p_text"))
    met = containing(containing(spans, a, key, "start", "act_start", "act_end"), p, key, "start", "p_start", "p_end")
    met = met.join(acts.groupBy(*key).agg(F.min_by(F.struct("chapter", "act", "start"), "start").alias("lead")), key, "left")
    known = F.col("in_act").isNotNull() & F.col("p_no").isNotNull()
    act, base = F.coalesce("in_act", "lead.act", F.lit(1)), F.coalesce("act_start", "lead.start", F.lit(0))
    chapter, no = F.coalesce("lead.chapter", F.lit(1)), F.when(known, F.col("p_no")).otherwise(1)
    location = F.struct(
        chapter.alias("chapter"), act.alias("act"), no.alias("paragraph_index"), F.when(known, F.col("p_id")).otherwise(T.segment_id(chapter, act, F.lit(1))).alias("segment_id"),
        F.when(known, sentence_index("p_text", F.col("start") - F.col("p_start"))).otherwise(1).alias("sentence_index"),
        F.greatest(F.col("start") - base, F.lit(0)).alias("scope_char_start"), F.greatest(F.col("end") - base, F.lit(0)).alias("scope_char_end"), F.col("start").alias("doc_char_start"), F.col("end").alias("doc_char_end"))
    return met.withColumn("location", location).select(*spans.columns, "location")


@F.pandas_udf(IntegerType())
def sentence_index(text: pd.Series, offset: pd.Series) -> pd.Series:
    """Number, from 1, of the sentence at a code-point offset; a sentence reaches up to and including its end."""

    def one(t, o) -> int | None:
        if t is None or o is None or o != o:
            return None
        ends = [m.end() for m in TERMINATOR.finditer(t)]
        k = bisect.bisect_left(ends, min(int(o), len(t)))
        return max(1, k + 1 if k < len(ends) or not ends or t[ends[-1] :].strip() else k)

    return pd.Series([one(t, o) for t, o in zip(text, offset)])


class Borders:
    """Where the sentences and paragraphs of a text end, for any number of its spans."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.breaks = [m.start() for m in re.finditer(r"(?=\n\n)", text)]
        self.stops = [m.start() for m in re.finditer(r"[.!?]", text)]
        self.ends = [m.end() for m in TERMINATOR.finditer(text)]

    def expand(self, start: int, end: int) -> tuple[int, int]:
        """Span widened to sentence borders. A paragraph break anywhere before goes before nearer sentence ends."""
        text, n = self.text, len(self.text)
        if not n:
            return 0, 0
        start = min(start, n)
        end = max(start, min(end, n))
        skip = lambda i: SPACE.match(text, i).end()
        begin = 0
        if start:
            para, stop = bisect.bisect_right(self.breaks, start - 2) - 1, bisect.bisect_left(self.stops, start) - 1
            if para >= 0 and self.breaks[para] + 2 < start:
                begin = skip(self.breaks[para] + 2)
            elif stop >= 0:
                begin = min(skip(self.stops[stop] + 1), start)
        if end >= n:
            return begin, n
        anchor = end - 1 if end > start else end
        if anchor > 0 and text[anchor] in ".!?":
            return begin, anchor + 1
        para = bisect.bisect_left(self.breaks, end)
        if para < len(self.breaks):
            return begin, self.breaks[para]
        at = bisect.bisect_right(self.ends, anchor)
        return begin, self.ends[at] if at < len(self.ends) else n


def expand(text: str, start: int, end: int) -> tuple[int, int]:
    return Borders(text).expand(start, end)


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def expand_to_sentences(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([expand(t or "", int(a), int(b)) for t, a, b in zip(text, start, end)], columns=["start", "end"])


def widened(spans: DataFrame, docs: DataFrame, key: list[str], acts: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """Spans cut to the act that holds their start and widened to sentences of that act alone, with their ``text``; empty ones
    are dropped. ``docs(*key, text)``. A span in no act is widened over the whole text.

    A text meets all of its spans at once, so that it isn't copied for each of them.
    """
    if acts is not None:
        a = acts.select(*key, F.col("start").alias("act_start"), F.col("end").alias("act_end"))
        met = containing(spans, a, key, "start", "act_start", "act_end")
    else:
        met = spans.withColumn("act_start", F.lit(None).cast("int")).withColumn("act_end", F.lit(None).cast("int"))
    rest = [c for c in spans.columns if c not in (*key, "start", "end")]

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def placed(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def one(text: str, rows) -> list[dict]:
            known: dict = {}  # borders of the whole text or of an act
            out = []
            for r in rows:
                a, b, c, d = r["start"], r["end"], r["act_start"], r["act_end"]
                if a is None or b is None:
                    out.append(None)
                    continue
                if d is not None:
                    b = min(b, d)
                if expand:
                    if (c, d) not in known:
                        known[c, d] = Borders(text if c is None else text[c:d])
                    a, b = ((c or 0) + x for x in known[c, d].expand(a - (c or 0), b - (c or 0)))
                out.append({"start": a, "end": b, "text": text[a:b]})
            return out

        return pd.Series([one(t or "", rows) for t, rows in zip(texts, lists)])

    listed = met.groupBy(*key).agg(F.collect_list(F.struct("start", "end", "act_start", "act_end", *rest)).alias("__s"))
    own = F.transform("__s", lambda s: F.struct(s["start"], s["end"], s["act_start"], s["act_end"]))
    full = docs.select(*key, F.col("text").alias("__doc")).join(listed, key).withColumn("__p", placed("__doc", own))
    each = full.select(*key, F.explode(F.arrays_zip("__s", "__p")).alias("__z"))
    cols = {"start": "__p.start", "end": "__p.end"}
    return each.select(*key, "__z.*").select(*[F.col(cols[c] if c in cols else c if c in key else f"__s.{c}").alias(c) for c in spans.columns if c != "text"], F.col("__p.text").alias("text")).where("end > start")


def verdicts(spans: DataFrame, key: list[str], order: list[str], act: str = "act", similarity: str = "similarity", text: str = "text") -> DataFrame:
    """``*key, instance_count, cross_act, blast_words, needs_bridge, suggested_op`` of each cluster.

    The first instance by ``order`` is the canonical one, the others are its duplicates.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = spans.withColumn("__n", F.row_number().over(w)).withColumn("__words", F.coalesce(T.word_count(F.col(text)), F.lit(0)))
    dup = F.col("__n") > 1
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("instance_count"), (F.count_distinct(act) > 1).alias("cross_act"),
        F.coalesce(F.max(F.when(dup, F.col("__words"))), F.lit(0)).cast("bigint").alias("blast_words"),
        F.coalesce(F.min(F.when(dup, (F.coalesce(F.col(similarity), F.lit(0.0)) >= HIGH).cast("int"))), F.lit(1)).alias("__high"),
    )
    big = F.col("blast_words") > PARAGRAPH_WORDS
    op = F.when(~F.col("cross_act") & (F.col("__high") == 1) & (F.col("blast_words") <= DELETE_WORDS), "delete_span").when(big, "replace_paragraph").otherwise("rewrite_span")
    return agg.withColumn("needs_bridge", ~F.col("cross_act") & big).withColumn("suggested_op", op).drop("__high")


def report_stats(spans: DataFrame, job: str, cluster: str = "cluster_id", order: str = "start", text: str = "text") -> DataFrame:
    """Per job: clusters, duplicate instances, and duplicate words."""
    w = Window.partitionBy(job, cluster).orderBy(order)
    rows = spans.withColumn("__n", F.row_number().over(w)).withColumn("__words", F.coalesce(T.word_count(F.col(text)), F.lit(0)))
    return rows.groupBy(job).agg(F.count_distinct(cluster).alias("cluster_count"), F.sum((F.col("__n") > 1).cast("bigint")).alias("total_duplicate_instances"), F.sum(F.when(F.col("__n") > 1, F.col("__words")).otherwise(0)).cast("bigint").alias("total_duplicate_words"))


def best_similarity(spans: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``similarity``: the best one of the cluster's windows that overlap the span, 0 if none does.

    Spans and windows meet by buckets of the text, so a long job isn't compared all with all.
    """
    size = 4096
    bucket = lambda s, e: F.explode(F.sequence(F.floor(s / size), F.floor(F.greatest(e - 1, s) / size)))
    a = spans.withColumn("__id", F.struct(*key, "start", "end")).withColumn("__b", bucket(F.col("start"), F.col("end")))
    b = windows.select(*key, F.col("start").alias("ws"), F.col("end").alias("we"), "sim").withColumn("__b", bucket(F.col("ws"), F.col("we")))
    met = a.join(b, [*key, "__b"]).where("ws < end and start < we").groupBy("__id").agg(F.max("sim").alias("similarity"))
    keyed = spans.withColumn("__id", F.struct(*key, "start", "end"))
    return keyed.join(met, "__id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).drop("__id")


def merge_passes(spans: DataFrame, doc: str) -> DataFrame:
    """Clusters of several passes as one list per document: ``doc, cluster_id, n_spans, n_passes, representative, spans``.

    ``spans(doc, pass_no, cluster_id, start, end, text)`` and, where known, ``similarity, members``, which the result's
    ``spans`` keep. In pass order, a cluster goes into the first earlier one of which any span overlaps one of its own by
    half of the shorter; spans that one already covers by half are left out, the longer text represents both. The fold
    depends on the order, so it runs per document; only clusters that share a part of the text are compared.
    """

    def half(a, b) -> bool:
        common = min(a[1], b[1]) - max(a[0], b[0])
        return common > 0 and common * 100 // max(min(a[1] - a[0], b[1] - b[0]), 1) >= 50

    cell = 1024
    cells = lambda s: range(s[0] // cell, max(s[1] - 1, s[0]) // cell + 1)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["pass_no", "cluster_id", "start", "end"])
        alone = f["pass_no"].nunique() == 1
        out: list[dict] = []
        near: dict[int, list[tuple[int, tuple]]] = {}  # spans of the list by the stretch of text they touch
        for (p, _), g in f.groupby(["pass_no", "cluster_id"], sort=True):
            own = [tuple(r) for r in g[["start", "end", "text", "similarity", "members"]].itertuples(index=False)]
            met = {} if alone else {id(b): {k for c in cells(b) for k, a in near.get(c, ()) if half(a, b)} for b in own}
            target = min(set().union(*met.values()), default=None) if met else None
            if target is None:
                target, new = len(out), own
                out.append({"spans": [], "text": own[0][2] or "", "passes": set()})
            else:
                new = [b for b in own if target not in met[id(b)]]
                text = own[0][2] or ""
                if len(text.encode()) > len(out[target]["text"].encode()):
                    out[target]["text"] = text
            out[target]["spans"] += new
            out[target]["passes"].add(p)
            for b in new:
                for c in cells(b):
                    near.setdefault(c, []).append((target, b))
        for c in out:
            c["spans"].sort(key=lambda s: (s[0], s[1]))
        out.sort(key=lambda c: c["spans"][0][0])
        doc_key, names = f[doc].iloc[0], ("start", "end", "text", "similarity", "members")
        return pd.DataFrame(
            [(doc_key, i, len(c["spans"]), len(c["passes"]), c["text"], [dict(zip(names, s)) for s in c["spans"]]) for i, c in enumerate(out)],
            columns=[doc, "cluster_id", "n_spans", "n_passes", "representative", "spans"])

    kind = spans.schema[doc].dataType.simpleString()
    known = lambda c, t: F.col(c).cast(t).alias(c) if c in spans.columns else F.lit(None).cast(t).alias(c)
    rows = spans.select(doc, "pass_no", "cluster_id", "start", "end", "text", known("similarity", "double"), known("members", "double"))
    return rows.groupBy(doc).applyInPandas(fold, f"{doc} {kind}, cluster_id int, n_spans int, n_passes int, representative string, spans array<struct<start:int,end:int,text:string,similarity:double,members:double>>")


def canonical_first(spans: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds ``instance_id`` from 0 in document order."""
    return spans.withColumn("instance_id", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def highlight_hue(cluster: Column, registry_hue: Column) -> Column:
    """The registry's hue, else one of twelve, both as parts of the circle."""
    return F.coalesce(registry_hue, F.pmod(cluster, F.lit(12)) / 12)
