"""Pages, windows and the act/paragraph index of documents, keyed by ``doc_key``.

All functions take frames with ``doc_key`` and ``text``; other columns are ignored. Null texts have no rows
unless stated, empty texts one empty page. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.functions import text as T


def token_pages(docs: DataFrame, tokens_per_page: int = 400) -> DataFrame:
    """Pages of N Unicode-space tokens with the white space behind them; concatenated they are the text.

    ``doc_key, page (from 1), doc_char_start, doc_char_end, char_count, token_count, text``.
    """
    # a page is a run of up to N words with the space behind each; possessive, so that no text makes it backtrack
    runs = F.regexp_extract_all("text", F.lit(rf"(?U)(?:\S++\s*+){{1,{tokens_per_page}}}+"), F.lit(0))
    lead = F.regexp_extract("text", r"^(?U)\s+", 0)
    base = docs.where("text is not null").select("doc_key", lead.alias("lead"), F.posexplode_outer(runs).alias("pos", "run"))
    body = F.when(F.coalesce("pos", F.lit(0)) == 0, F.concat("lead", F.coalesce("run", F.lit("")))).otherwise(F.col("run"))
    cut = base.select("doc_key", (F.coalesce("pos", F.lit(0)) + 1).alias("page"), body.alias("text")).withColumn("char_count", F.char_length("text"))
    w = Window.partitionBy("doc_key").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("char_count").over(w).cast("int")
    return cut.select("doc_key", "page", (end - F.col("char_count")).alias("doc_char_start"), end.alias("doc_char_end"), "char_count", T.word_count(F.col("text")).alias("token_count"), "text")


def chapter_segments(docs: DataFrame, pattern: str) -> DataFrame:
    """A line that matches ``pattern`` begins a segment; blank segments are dropped.

    ``doc_key, segment (from 1), doc_char_start, text``.
    """
    marked = docs.where("text is not null").select("doc_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_key").orderBy("line_no")
    lines = marked.withColumn("seg", F.sum(F.col("line").rlike(pattern).cast("int")).over(w)).withColumn("at", F.coalesce(F.sum(F.char_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.max("line_no").over(Window.partitionBy("doc_key"))
    own = F.concat("line", F.when(F.col("line_no") < last, "\n").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "own"))), lambda s: s["own"]), "")
    segs = lines.withColumn("own", own).groupBy("doc_key", "seg").agg(F.min("at").cast("int").alias("doc_char_start"), body.alias("text")).where(F.col("text").rlike(T.WORD))
    return segs.withColumn("segment", F.row_number().over(Window.partitionBy("doc_key").orderBy("seg"))).select("doc_key", "segment", "doc_char_start", "text")


def chapter_break_pages(docs: DataFrame, pattern: str, tokens_per_page: int = 400) -> DataFrame:
    """Segments cut at chapter breaks, each paginated by tokens; page numbers run over the document."""
    segs = chapter_segments(docs, pattern)
    inner = token_pages(segs.select(F.struct("doc_key", "segment", F.col("doc_char_start").alias("base")).alias("doc_key"), "text"), tokens_per_page)
    w = Window.partitionBy("doc_key").orderBy("segment", "p")
    flat = inner.select(F.col("doc_key.doc_key").alias("doc_key"), F.col("doc_key.segment").alias("segment"), F.col("page").alias("p"), (F.col("doc_key.base") + F.col("doc_char_start")).alias("doc_char_start"), (F.col("doc_key.base") + F.col("doc_char_end")).alias("doc_char_end"), "char_count", "token_count", "text")
    return flat.withColumn("page", F.row_number().over(w)).drop("p")


def scope_pages(docs: DataFrame, acts: DataFrame) -> DataFrame:
    """One page per act that isn't blank; ``acts(doc_key, act, start, end)``. A span outside the text raises."""
    met = docs.select("doc_key", "text").join(acts.select("doc_key", "act", "start", "end"), "doc_key")
    bad = (F.col("start") > F.col("end")) | (F.col("end") > F.char_length("text")) | (F.col("start") < 0)
    body = F.when(bad, F.raise_error(F.lit("an act lies outside its text")).cast("string")).otherwise(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    pages = met.withColumn("body", body).where(F.col("body").rlike(T.WORD))
    page = F.row_number().over(Window.partitionBy("doc_key").orderBy("act"))
    return pages.select("doc_key", page.alias("page"), F.col("start").alias("doc_char_start"), F.col("end").alias("doc_char_end"), F.char_length("body").alias("char_count"), T.word_count(F.col("body")).alias("token_count"), F.col("body").alias("text"))


def paginate(docs: DataFrame, acts: DataFrame | None = None, pattern: str | None = None, tokens_per_page: int | None = None) -> DataFrame:
    """Acts go before chapter breaks, which go before tokens (400 a page)."""
    n = tokens_per_page or 400
    if acts is not None:
        return scope_pages(docs, acts).withColumn("pagination_mode", F.lit("scope_segment"))
    if pattern:
        return chapter_break_pages(docs, pattern, n).drop("segment").withColumn("pagination_mode", F.lit("chapter"))
    return token_pages(docs, n).withColumn("pagination_mode", F.lit("token"))


def reassemble(pages: DataFrame) -> DataFrame:
    """``doc_key, text`` from its pages in order."""
    return pages.groupBy("doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "").alias("text"))


def sliding_windows(pages: DataFrame, window_size: int, stride: int) -> DataFrame:
    """Windows of tokens within each page: all full ones, and one shorter last one of at least 3 tokens.

    ``doc_key, window_index (over the document), page, char_start, char_end (in the page), doc_char_start, token_count, text``.
    """
    if not 1 <= stride <= window_size:
        raise ValueError("stride must be between 1 and window_size")
    base = pages.select("doc_key", "page", "doc_char_start", "text", T.spans(F.col("text"), T.WINDOW_TOKEN).alias("s")).withColumn("n", F.size("s")).where("n >= 3")
    full = F.when(F.col("n") >= window_size, F.floor((F.col("n") - window_size) / stride) + 1).otherwise(0)
    nxt = full * stride
    rest = F.col("n") - nxt
    count = (full + F.when((rest >= 3) & (rest < window_size), 1).otherwise(0)).cast("int")
    each = base.withColumn("count", count).where("count > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    a = F.col("i") * stride
    b = F.least(a + window_size, F.col("n"))
    win = each.select("doc_key", "page", "doc_char_start", "text", "i", F.get("s", a)["start"].alias("char_start"), F.get("s", b - 1)["end"].alias("char_end"), (b - a).alias("token_count"))
    index = F.row_number().over(Window.partitionBy("doc_key").orderBy("page", "i")) - 1
    return win.select("doc_key", index.alias("window_index"), "page", "char_start", "char_end", (F.col("doc_char_start") + F.col("char_start")).alias("doc_char_start"), "token_count", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"))


def window_estimate(tokens: Column, window_size: int, stride: int) -> Column:
    """Windows expected of a number of tokens, page borders left out of account."""
    return F.when(tokens > window_size, F.floor((tokens - window_size) / stride) + 1).when(tokens >= 3, 1).otherwise(0).cast("bigint")


def line_index(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """Pieces between separators that hold anything but white space: ``doc_key, piece, start, end, text``, trimmed."""
    raw = docs.where("text is not null").select("doc_key", F.posexplode(F.split("text", separator)).alias("pos", "raw"))
    w = Window.partitionBy("doc_key").orderBy("pos")
    at = F.coalesce(F.sum(F.char_length("raw") + len(separator)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"^(?U)\s+", ""))
    flat = raw.withColumn("at", at).withColumn("lead", lead).withColumn("body", F.regexp_replace("raw", r"^(?U)\s+|(?U)\s+$", "")).where("body <> ''")
    start = (F.col("at") + F.col("lead")).cast("int")
    return flat.select("doc_key", F.row_number().over(w).alias("piece"), start.alias("start"), (start + F.char_length("body")).alias("end"), F.col("body").alias("text"))


def chapter_offsets(acts: DataFrame, chapter: list[str]) -> DataFrame:
    """Act bodies, trimmed and joined by a blank line, without building the chapter: each act's span in it.

    ``acts(*chapter, act, text)``; blank acts are dropped.
    """
    w = Window.partitionBy(*chapter).orderBy("act")
    body = acts.withColumn("text", T.trimmed(F.col("text"))).where("text <> ''")
    start = F.coalesce(F.sum(F.char_length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return body.select(*chapter, "act", start.alias("start"), (start + F.char_length("text")).alias("end"), "text")


def paragraph_index(acts: DataFrame, chapter: list[str]) -> DataFrame:
    """Paragraphs (lines that aren't blank) of acts with their span and id: the manifest's flat form.

    ``acts`` as ``chapter_offsets`` gives them; the last of ``chapter`` is the chapter's number.
    """
    key = F.struct(*chapter, "act", F.col("start").alias("base"))
    lines = line_index(acts.select(key.alias("doc_key"), "text"))
    k = F.col("doc_key")
    return lines.select(*[k[c].alias(c) for c in chapter], k["act"].alias("act"), F.col("piece").alias("paragraph_index"), T.segment_id(k[chapter[-1]], k["act"], F.col("piece")).alias("segment_id"), (k["base"] + F.col("start")).alias("doc_char_start"), (k["base"] + F.col("end")).alias("doc_char_end"), "text")


def assembled(acts: DataFrame, chapter: list[str], blank: str = "drop") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A chapter from its act drafts: ``docs(doc_key, text)``, and its manifest as ``acts(doc_key, chapter, act, start, end)``
    and ``paragraphs(doc_key, act, paragraph_index, segment_id, doc_char_start, doc_char_end, text)``.

    ``acts(*chapter, act, text)``, the last of ``chapter`` being its number; ``doc_key`` is the struct of ``chapter``. Bodies are
    trimmed and joined by a blank line. A blank act is dropped, or raises with ``blank="error"``.
    """
    if blank == "error":
        acts = acts.withColumn("text", F.when(F.coalesce(T.trimmed(F.col("text")), F.lit("")) == "", F.raise_error(F.lit("act draft text is empty")).cast("string")).otherwise(F.col("text")))
    placed = chapter_offsets(acts, chapter)
    key, number = F.struct(*chapter).alias("doc_key"), F.col(chapter[-1]).alias("chapter")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n\n")
    docs = placed.groupBy(*chapter).agg(body.alias("text")).select(key, "text")
    paragraphs = paragraph_index(placed, chapter).select(key, "act", "paragraph_index", "segment_id", "doc_char_start", "doc_char_end", "text")
    return docs, placed.select(key, number, "act", "start", "end"), paragraphs


def text_manifest(docs: DataFrame, chapter: int = 1) -> tuple[DataFrame, DataFrame]:
    """``acts`` and ``paragraphs`` as ``assembled`` gives them, of texts that come without acts: blank lines part acts, line
    breaks paragraphs."""
    blocks = line_index(docs, "\n\n")
    acts = blocks.select("doc_key", F.lit(chapter).alias("chapter"), F.col("piece").alias("act"), "start", "end")
    inner = line_index(blocks.select(F.struct("doc_key", "piece", F.col("start").alias("base")).alias("doc_key"), "text"))
    k = F.col("doc_key")
    lines = inner.select(k["doc_key"].alias("doc_key"), k["piece"].alias("act"), F.col("piece").alias("paragraph_index"), (k["base"] + F.col("start")).alias("doc_char_start"), (k["base"] + F.col("end")).alias("doc_char_end"), "text")
    return acts, lines.withColumn("segment_id", T.segment_id(F.lit(chapter), F.col("act"), F.col("paragraph_index")))
