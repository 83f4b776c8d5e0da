"""Every query of the core engine by name, with its oracle where SQL can state it.

All queries run over whole tables. The oracles share their resolution of repeated rows through ``WITH`` parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.config import AnalysisParams, LexicalConfig, PRESETS
from echoloom.functions import color as C
from echoloom.functions import text as T
from echoloom.functions import vectors as V
from echoloom.operators import clusters, intervals, lexical, raster, report, segment
from echoloom.operators.graph import connected_components
from echoloom.sources import stored
from echoloom.runtime import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Fixed value: in RE2's terms, what Java's regex calls alphabetic in the scripts at hand.
LETTERS = r"\p{L}\p{Nl}\x{0E31}\x{0E34}-\x{0E3A}\x{0E4D}\x{0900}-\x{0903}\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}"
SQL_TOKENS = rf"regexp_extract_all(lower(text), '[{LETTERS}\p{{N}}'']+')"
SQL_WORD = r"[^\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQL_WORDS = rf"len(regexp_extract_all(text, '{SQL_WORD.replace(r'\x{1C}-\x{1F}', '')}'))"
DRAFTS = "d AS (SELECT DISTINCT draft_id, story_id, chapter, act, text FROM drafts WHERE text IS NOT NULL)"
PAGES = "p AS (SELECT DISTINCT job_id, page, doc_char_start, doc_char_end, char_count, token_count, text FROM pages)"
SPANS = "s AS (SELECT DISTINCT span_id, job_id, draft_id, location.act AS act, location.doc_char_start AS st, location.doc_char_end AS en, cluster_id, instance_id, text, similarity_to_centroid FROM spans)"
WINDOWS = "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY committed_at DESC NULLS LAST, job_id DESC, window_index DESC, page DESC, char_start DESC, char_end DESC, doc_char_start DESC, text DESC, cluster_id DESC NULLS LAST, sim_to_centroid DESC NULLS LAST) AS rn FROM windows) WHERE rn = 1)"
JOBS = "j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC, windows_committed DESC, status DESC) AS rn FROM jobs) WHERE rn = 1)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return stored.drafts(spark, d).select(F.col("draft_id").alias("doc_key"), "text")


# --- tokens, pages, windows


@query(f"WITH {DRAFTS} SELECT draft_id AS doc_key, len({SQL_TOKENS}) AS n_tokens, {SQL_WORDS} AS n_words, length(text) AS n_chars, strlen(text) AS n_bytes FROM d")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_key", F.size(T.lexical_tokens(t)).alias("n_tokens"), T.word_count(t).alias("n_words"), F.char_length(t).alias("n_chars"), F.octet_length(t).alias("n_bytes"))


@query(rf"""WITH {DRAFTS}, c AS (SELECT draft_id, {SQL_WORDS} AS n FROM d), e AS (SELECT draft_id, n, unnest(range(1, greatest(CAST(ceil(n / 400.0) AS BIGINT), 1) + 1)) AS page FROM c)
SELECT draft_id AS doc_key, page, least(400, n - (page - 1) * 400) AS token_count FROM e""")
def token_pages(spark: SparkSession, d: str) -> DataFrame:
    return segment.token_pages(_docs(spark, d), 400).select("doc_key", F.col("page").cast("bigint").alias("page"), "token_count")


BREAK = r"^(Chapter|CHAPTER|ACT|Act|Part|Kapitel|Chapitre|Acto) "


@query(rf"""WITH {DRAFTS}, l AS (SELECT draft_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{BREAK}') THEN 1 ELSE 0 END) OVER (PARTITION BY draft_id ORDER BY pos) AS seg, coalesce(sum(length(line) + 1) OVER (PARTITION BY draft_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
s AS (SELECT draft_id, seg, min(off) AS st, sum(len(regexp_extract_all(line, '{SQL_WORD.replace(r'\x{1C}-\x{1F}', '')}'))) AS n FROM g GROUP BY 1, 2)
SELECT draft_id AS doc_key, row_number() OVER (PARTITION BY draft_id ORDER BY seg) AS segment, CAST(st AS BIGINT) AS doc_char_start, CAST(n AS BIGINT) AS n_words FROM s WHERE n > 0""")
def chapter_break_segments(spark: SparkSession, d: str) -> DataFrame:
    s = segment.chapter_segments(_docs(spark, d), BREAK)
    return s.select("doc_key", F.col("segment").cast("bigint").alias("segment"), F.col("doc_char_start").cast("bigint").alias("doc_char_start"), T.word_count(F.col("text")).cast("bigint").alias("n_words"))


SQL_RUN = SQL_WORD.replace(r"\x{1C}-\x{1F}", "")
SQL_SPACE1 = f"[{SQL_RUN[2:-2]}]"
SQL_SPACE = SQL_SPACE1 + "*"


@query(rf"""WITH {DRAFTS}, l AS (SELECT draft_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos, len(string_split(text, chr(10))) AS lines FROM d),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{BREAK}') THEN 1 ELSE 0 END) OVER (PARTITION BY draft_id ORDER BY pos) AS seg, coalesce(sum(length(line) + 1) OVER (PARTITION BY draft_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
s AS (SELECT draft_id, seg, CAST(min(off) AS BIGINT) AS st, string_agg(line || CASE WHEN pos < lines - 1 THEN chr(10) ELSE '' END, '' ORDER BY pos) AS text FROM g GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY seg) AS segment, regexp_extract_all(text, '{SQL_RUN}{SQL_SPACE}') AS runs FROM s WHERE regexp_matches(text, '{SQL_RUN}')),
e AS (SELECT draft_id, segment, st, length(text) AS tl, unnest(range(len(runs))) AS i, unnest(runs) AS r FROM n),
p AS (SELECT draft_id, segment, st, tl, i // 400 AS p, sum(length(r)) AS len, count(*) AS tok FROM e GROUP BY 1, 2, 3, 4, 5),
q AS (SELECT *, st + tl - sum(len) OVER (PARTITION BY draft_id, segment) + sum(len) OVER (PARTITION BY draft_id, segment ORDER BY p) AS en FROM p)
SELECT draft_id AS doc_key, row_number() OVER (PARTITION BY draft_id ORDER BY segment, p) AS page, segment, CAST(CASE WHEN p = 0 THEN st ELSE en - len END AS BIGINT) AS doc_char_start, CAST(en AS BIGINT) AS doc_char_end, tok AS token_count FROM q""")
def chapter_break_pages(spark: SparkSession, d: str) -> DataFrame:
    p = segment.chapter_break_pages(_docs(spark, d), BREAK, 400)
    return p.select("doc_key", *[F.col(c).cast("bigint").alias(c) for c in ("page", "segment", "doc_char_start", "doc_char_end", "token_count")])


@query(rf"""WITH {PAGES}, n AS (SELECT job_id, page, len(regexp_extract_all(text, '[^ \t\n\f\r]+')) AS n FROM p WHERE text IS NOT NULL),
f AS (SELECT *, CASE WHEN n >= 50 THEN (n - 50) // 10 + 1 ELSE 0 END AS fulls FROM n WHERE n >= 3),
c AS (SELECT *, fulls + CASE WHEN n - fulls * 10 BETWEEN 3 AND 49 THEN 1 ELSE 0 END AS c FROM f),
e AS (SELECT job_id, page, n, unnest(range(c)) AS i FROM c)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY page, i) - 1 AS window_index, page, least(50, n - i * 10) AS token_count FROM e""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    p = stored.pages(spark, d).withColumnRenamed("job_id", "doc_key")
    return segment.sliding_windows(p, 50, 10).select(F.col("doc_key").alias("job_id"), F.col("window_index").cast("bigint").alias("window_index"), "page", F.col("token_count").cast("bigint").alias("token_count"))


@query(f"WITH {PAGES}, t AS (SELECT job_id, sum({SQL_WORDS}) AS n FROM p GROUP BY 1) SELECT job_id, CAST(n AS BIGINT) AS n_words, CAST(CASE WHEN n > 100 THEN (n - 100) // 25 + 1 WHEN n >= 3 THEN 1 ELSE 0 END AS BIGINT) AS n_windows FROM t")
def window_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = stored.pages(spark, d).groupBy("job_id").agg(F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).alias("n_words"))
    return t.select("job_id", "n_words", segment.window_estimate(F.col("n_words"), 100, 25).alias("n_windows"))


@query(f"WITH {PAGES} SELECT job_id, sha256(string_agg(text, '' ORDER BY page)) AS text_hash, count(*) AS n_pages FROM p GROUP BY 1")
def reassembled_documents(spark: SparkSession, d: str) -> DataFrame:
    p = stored.pages(spark, d).withColumnRenamed("job_id", "doc_key")
    n = p.groupBy("doc_key").agg(F.count("*").alias("n_pages"))
    return segment.reassemble(p).join(n, "doc_key").select(F.col("doc_key").alias("job_id"), F.sha2("text", 256).alias("text_hash"), "n_pages")


@query(rf"""WITH {DRAFTS}, l AS (SELECT draft_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
g AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY draft_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
t AS (SELECT *, length(regexp_extract(line, '^[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]*')) AS lead, regexp_replace(line, '^[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g') AS body FROM g)
SELECT draft_id AS doc_key, row_number() OVER (PARTITION BY draft_id ORDER BY pos) AS paragraph, CAST(off + lead AS BIGINT) AS doc_char_start, CAST(off + lead + length(body) AS BIGINT) AS doc_char_end FROM t WHERE body <> ''""")
def line_paragraph_index(spark: SparkSession, d: str) -> DataFrame:
    i = segment.line_index(_docs(spark, d))
    return i.select("doc_key", F.col("piece").cast("bigint").alias("paragraph"), F.col("start").cast("bigint").alias("doc_char_start"), F.col("end").cast("bigint").alias("doc_char_end"))


SQL_TRIM = r"regexp_replace(text, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')"


@query(rf"""WITH {DRAFTS}, b AS (SELECT story_id, chapter, draft_id, {SQL_TRIM} AS body FROM d)
SELECT story_id, chapter, draft_id, CAST(st AS BIGINT) AS doc_char_start, CAST(st + n AS BIGINT) AS doc_char_end FROM
(SELECT story_id, chapter, draft_id, length(body) AS n, coalesce(sum(length(body) + 2) OVER (PARTITION BY story_id, chapter ORDER BY draft_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM b WHERE body <> '')""")
def chapter_offsets(spark: SparkSession, d: str) -> DataFrame:
    o = segment.chapter_offsets(stored.drafts(spark, d).drop("act").withColumnRenamed("draft_id", "act"), ["story_id", "chapter"])
    return o.select("story_id", "chapter", F.col("act").alias("draft_id"), F.col("start").cast("bigint").alias("doc_char_start"), F.col("end").cast("bigint").alias("doc_char_end"))


# --- lexical units and pairs


@query(r"""WITH """ + DRAFTS + r""", x AS (SELECT draft_id, unnest(string_split(regexp_replace(text, '([.!?])([\t-\r "''])', '\1' || chr(31) || '\2', 'g'), chr(31))) AS s FROM d),
t AS (SELECT draft_id, regexp_replace(s, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS s FROM x)
SELECT draft_id AS doc_key, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars, CAST(max(length(s)) AS BIGINT) AS longest FROM t WHERE s <> '' GROUP BY 1""")
def sentence_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).select("doc_key", F.explode(T.sentences(F.col("text"))).alias("s"))
    n = F.char_length("s")
    return s.groupBy("doc_key").agg(F.count("*").alias("n_sentences"), F.sum(n).cast("bigint").alias("n_chars"), F.max(n).cast("bigint").alias("longest"))


@query(rf"""WITH {DRAFTS}, p AS (SELECT draft_id, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS text FROM d), n AS (SELECT draft_id, len({SQL_TOKENS}) AS n FROM p)
SELECT draft_id AS doc_key, CAST(sum((n - 12) // 6 + 1) AS BIGINT) AS n_phrases FROM n WHERE n >= 12 GROUP BY 1""")
def phrase_windows(spark: SparkSession, d: str) -> DataFrame:
    return lexical.candidates(_docs(spark, d)).where("kind = 'phrase'").groupBy("doc_key").agg(F.count("*").alias("n_phrases"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Drafts as the units of their story."""
    t = stored.drafts(spark, d).select(F.col("story_id").alias("doc_key"), F.col("draft_id").alias("id"), T.lexical_tokens(F.col("text")).alias("tokens"))
    return t.select("doc_key", "id", F.lit("paragraph").alias("kind"), "tokens", T.shingles(F.col("tokens"), 5).alias("shingles")).where(F.size("tokens") > 0)


def _hashed_units(spark: SparkSession, d: str) -> DataFrame:
    """The same units with hashed shingles, computed once: joins and intersections on longs instead of strings."""
    u = _units(spark, d)
    return cut(u.withColumn("shingles", F.transform("shingles", lambda s: F.xxhash64(s))))


SQL_SHINGLES = rf"""{DRAFTS}, t AS (SELECT story_id, draft_id, {SQL_TOKENS} AS k FROM d), u AS (SELECT *, len(k) AS n FROM t WHERE len(k) > 0),
sh AS (SELECT DISTINCT story_id, draft_id, array_to_string(k[i:i + 4], ' ') AS shingle FROM (SELECT story_id, draft_id, k, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM u)),
df AS (SELECT story_id, shingle, count(*) AS df FROM sh GROUP BY 1, 2), cap AS (SELECT story_id, count(*) AS n FROM u GROUP BY 1)"""
SQL_NEAR = rf"""{SQL_SHINGLES}, keep AS (SELECT df.story_id, shingle FROM df JOIN cap USING (story_id) WHERE df > 1 AND df <= greatest(2, ceil(n * 0.35))),
ix AS (SELECT sh.* FROM sh JOIN keep USING (story_id, shingle)),
hit AS (SELECT x.story_id, x.draft_id AS a, y.draft_id AS b, count(*) AS hits FROM ix x JOIN ix y ON x.story_id = y.story_id AND x.shingle = y.shingle AND x.draft_id < y.draft_id GROUP BY 1, 2, 3),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id, a ORDER BY hits DESC, b) AS r FROM hit) WHERE r <= 64)"""


@query(f"WITH {SQL_SHINGLES} SELECT story_id, shingle, df FROM df WHERE df > 1")
def shingle_df(spark: SparkSession, d: str) -> DataFrame:
    each = _units(spark, d).select(F.col("doc_key").alias("story_id"), F.explode("shingles").alias("shingle"))
    return each.groupBy("story_id", "shingle").agg(F.count("*").alias("df")).where("df > 1")


@query(f"WITH {SQL_SHINGLES} SELECT story_id, draft_id, count(*) AS n_kept FROM sh JOIN df USING (story_id, shingle) JOIN cap USING (story_id) WHERE df > 1 AND df <= greatest(2, ceil(n * 0.35)) GROUP BY 1, 2")
def shingle_pruned(spark: SparkSession, d: str) -> DataFrame:
    return lexical.shingle_index(_units(spark, d), 0.35).groupBy(F.col("doc_key").alias("story_id"), F.col("id").alias("draft_id")).agg(F.count("*").alias("n_kept"))


@query(f"""WITH {SQL_NEAR}, size AS (SELECT story_id, draft_id, count(*) AS n FROM sh GROUP BY 1, 2),
common AS (SELECT n.story_id, n.a, n.b, n.hits, count(*) AS c FROM near n JOIN sh x ON x.story_id = n.story_id AND x.draft_id = n.a JOIN sh y ON y.story_id = n.story_id AND y.draft_id = n.b AND x.shingle = y.shingle GROUP BY 1, 2, 3, 4)
SELECT c.story_id, a, b, hits, round(c / (p.n + q.n - c), 6) AS jaccard FROM common c JOIN size p ON p.story_id = c.story_id AND p.draft_id = a JOIN size q ON q.story_id = c.story_id AND q.draft_id = b""")
def near_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    u = _hashed_units(spark, d)
    near = lexical.near_pairs(lexical.shingle_index(u, 0.35), 64)
    met = near.join(u.select("doc_key", F.col("id").alias("a"), F.col("shingles").alias("sa")), ["doc_key", "a"]).join(u.select("doc_key", F.col("id").alias("b"), F.col("shingles").alias("sb")), ["doc_key", "b"])
    return met.select(F.col("doc_key").alias("story_id"), "a", "b", "hits", F.round(lexical.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


@query(f"""WITH {SQL_NEAR}, f AS (SELECT story_id, draft_id, tok, count(*) AS c FROM (SELECT story_id, draft_id, unnest(k) AS tok FROM u) GROUP BY 1, 2, 3),
sides AS (SELECT n.story_id, n.a, n.b, f.tok, f.c AS ca, 0 AS cb FROM near n JOIN f ON f.story_id = n.story_id AND f.draft_id = n.a UNION ALL SELECT n.story_id, n.a, n.b, f.tok, 0, f.c FROM near n JOIN f ON f.story_id = n.story_id AND f.draft_id = n.b),
each AS (SELECT story_id, a, b, tok, sum(ca) AS ca, sum(cb) AS cb FROM sides GROUP BY 1, 2, 3, 4)
SELECT story_id, a, b, round(sum(least(ca, cb)) / sum(greatest(ca, cb)), 6) AS score FROM each GROUP BY 1, 2, 3""")
def token_freq_score(spark: SparkSession, d: str) -> DataFrame:
    u = _hashed_units(spark, d)
    near = lexical.near_pairs(lexical.shingle_index(u, 0.35), 64)
    met = near.join(u.select("doc_key", F.col("id").alias("a"), F.col("tokens").alias("ta")), ["doc_key", "a"]).join(u.select("doc_key", F.col("id").alias("b"), F.col("tokens").alias("tb")), ["doc_key", "b"])
    return met.select(F.col("doc_key").alias("story_id"), "a", "b", F.round(lexical.frequency_score("ta", "tb"), 6).alias("score"))


@query()
def lcs_score(spark: SparkSession, d: str) -> DataFrame:
    u = _hashed_units(spark, d)
    near = lexical.near_pairs(lexical.shingle_index(u, 0.35), 64)
    met = near.join(u.select("doc_key", F.col("id").alias("a"), F.col("tokens").alias("ta")), ["doc_key", "a"]).join(u.select("doc_key", F.col("id").alias("b"), F.col("tokens").alias("tb")), ["doc_key", "b"])
    return met.select(F.col("doc_key").alias("story_id"), "a", "b", F.round(lexical.order_score("ta", "tb"), 6).alias("score"))


def _paragraph_units(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each story, in draft order, as units with places in the story's joined text."""
    p = lexical.paragraph_rows(_docs(spark, d)).join(stored.drafts(spark, d).select(F.col("draft_id").alias("doc_key"), "story_id"), "doc_key")
    w = Window.partitionBy("story_id").orderBy("doc_key", "para")
    at = F.coalesce(F.sum(F.char_length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.select(F.col("story_id").alias("doc_key"), (F.row_number().over(w) - 1).alias("para"), at.alias("start"), (at + F.char_length("text")).alias("end"), F.lit("paragraph").alias("kind"), T.lexical_tokens(F.col("text")).alias("tokens")).withColumn("id", F.col("para"))


SQL_UNITS = rf"""q AS (SELECT story_id, draft_id, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS text, unnest(range(len(regexp_split_to_array(text, '\n{{2,}}')))) AS pos FROM d),
b AS (SELECT story_id, draft_id, pos, regexp_replace(text, '^[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g') AS text FROM q),
u AS (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY draft_id, pos) - 1 AS para, {SQL_TOKENS} AS k FROM b WHERE text <> '')"""


@query(f"WITH {DRAFTS}, {SQL_UNITS}, k AS (SELECT story_id, para, array_to_string(k, ' ') AS k FROM u) SELECT story_id, para, min(para) OVER c AS first, count(*) OVER c AS n FROM k WHERE k <> '' WINDOW c AS (PARTITION BY story_id, k) QUALIFY n > 1")
def exact_duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of a story that stand in it more than once, word for word, with the first of their class."""
    c = lexical.exact_classes(_paragraph_units(spark, d))
    return c.select(F.col("doc_key").alias("story_id"), F.col("id").cast("bigint").alias("para"), F.col("first").cast("bigint").alias("first"), "n")


@query(rf"""WITH {DRAFTS}, {SQL_UNITS},
m AS (SELECT x.story_id, x.para AS pa, y.para AS pb, y.para - x.para AS dd, len(x.k) AS words FROM u x JOIN u y ON x.story_id = y.story_id AND array_to_string(x.k, ' ') = array_to_string(y.k, ' ') AND x.para < y.para),
i AS (SELECT *, pa - row_number() OVER (PARTITION BY story_id, dd ORDER BY pa) AS isle FROM m),
r AS (SELECT *, least(max(pa) OVER (PARTITION BY story_id, dd, isle) - pa + 1, dd) AS run FROM i),
z AS (SELECT r.story_id, r.pa, r.pb, r.run, (SELECT sum(o.words) FROM r o WHERE o.story_id = r.story_id AND o.dd = r.dd AND o.isle = r.isle AND o.pa BETWEEN r.pa AND r.pa + r.run - 1) AS w FROM r)
SELECT story_id, pa, pb, CAST(run AS BIGINT) AS run FROM z WHERE run >= 2 OR w >= 80""")
def block_chains(spark: SparkSession, d: str) -> DataFrame:
    u = _paragraph_units(spark, d)
    pairs = lexical.exact_pairs(u).withColumn("score", F.lit(1.0))
    c = lexical.block_chains(u, pairs)
    return c.select(F.col("doc_key").alias("story_id"), F.col("pa").cast("bigint").alias("pa"), F.col("pb").cast("bigint").alias("pb"), F.col("run").cast("bigint").alias("run"))


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapter texts: trimmed drafts of a story's chapter, joined by blank lines."""
    b = stored.drafts(spark, d).withColumn("text", T.trimmed(F.col("text"))).where("text <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("draft_id", "text"))), lambda s: s["text"]), "\n\n")
    return b.groupBy("story_id", "chapter").agg(body.alias("text")).select(F.struct("story_id", "chapter").alias("doc_key"), "text")


@query()
def lexical_report(spark: SparkSession, d: str) -> DataFrame:
    r = lexical.repetition_instances(_chapters(spark, d), LexicalConfig())
    return r.select("doc_key.story_id", "doc_key.chapter", "cluster_id", "instance_id", "start", "end", "score", "word_count")


@query(f"""WITH RECURSIVE {DRAFTS}, q AS (SELECT DISTINCT draft_id, t FROM (SELECT draft_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS t FROM d) WHERE length(t) >= 60),
e AS (SELECT DISTINCT draft_id AS a, min(draft_id) OVER (PARTITION BY t) AS b FROM q), n AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a, a AS b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a)
SELECT a AS draft_id, min(b) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Drafts that share a paragraph of 60 code points or more, directly or through others."""
    q = _docs(spark, d).select("doc_key", F.explode(F.split("text", r"\n{2,}")).alias("t")).where(F.char_length("t") >= 60).distinct()
    first = q.groupBy("t").agg(F.min("doc_key").alias("b"))
    e = q.join(first, "t").where("doc_key <> b").select(F.col("doc_key").alias("a"), "b")
    return connected_components(e).select(F.col("node").alias("draft_id"), "component")


# --- intervals, addresses, verdicts


@query(f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN st >= max(en) OVER (PARTITION BY job_id, cluster_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY st, en) = 1 THEN 1 ELSE 0 END AS nw FROM s),
g AS (SELECT *, sum(nw) OVER (PARTITION BY job_id, cluster_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS isle FROM f)
SELECT job_id, cluster_id, min(st) AS span_start, max(en) AS span_end, count(*) AS n_spans FROM g GROUP BY job_id, cluster_id, isle""")
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    m = intervals.merged(stored.spans(spark, d).select("job_id", "cluster_id", "start", "end"), ["job_id", "cluster_id"])
    return m.select("job_id", "cluster_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "n_spans")


@query(f"""WITH {SPANS}, {DRAFTS}, l AS (SELECT draft_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
g AS (SELECT draft_id, pos, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY draft_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT s.span_id, s.draft_id, g.pos AS line_no FROM s LEFT JOIN g ON g.draft_id = s.draft_id AND s.st >= g.off AND s.st < g.off + g.n""")
def span_location(spark: SparkSession, d: str) -> DataFrame:
    """The line of its draft in which each span's stored start lies; null where there is none."""
    raw = _docs(spark, d).select(F.col("doc_key").alias("draft_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("draft_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("line") + 1).over(w), F.lit(0))
    lines = raw.select("draft_id", F.col("pos").cast("bigint").alias("line_no"), at.alias("l0"), (at + F.char_length("line")).alias("l1")).where("l1 > l0")
    return intervals.containing(stored.spans(spark, d).select("span_id", "draft_id", "start"), lines, ["draft_id"], "start", "l0", "l1").select("span_id", "draft_id", "line_no")


@query(f"""WITH {SPANS}, {PAGES}, f AS (SELECT job_id, arg_min(page, doc_char_start) AS page FROM p GROUP BY 1), x AS (SELECT s.span_id, s.job_id, p.page FROM s ASOF LEFT JOIN p ON s.job_id = p.job_id AND s.st >= p.doc_char_start)
SELECT x.span_id, coalesce(x.page, f.page) AS page FROM x LEFT JOIN f USING (job_id)""")
def offset_to_page(spark: SparkSession, d: str) -> DataFrame:
    s = stored.spans(spark, d).select("span_id", "job_id", "start")
    return intervals.as_of(s, stored.pages(spark, d).select("job_id", "doc_char_start", "page"), ["job_id"], "start", "doc_char_start", "page").select("span_id", "page")


SQL_VERDICT = f"""{SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY st, span_id) AS rn, coalesce({SQL_WORDS}, 0) AS words FROM s),
a AS (SELECT job_id, cluster_id, count(*) AS n, count(DISTINCT act) > 1 AS x, coalesce(max(CASE WHEN rn > 1 THEN words END), 0) AS blast, coalesce(min(CASE WHEN rn > 1 THEN CASE WHEN coalesce(CAST(similarity_to_centroid AS DOUBLE), 0) >= 0.95 THEN 1 ELSE 0 END END), 1) AS high FROM o GROUP BY 1, 2)"""


@query(f"""WITH {SQL_VERDICT} SELECT job_id, cluster_id, n AS instance_count, x AS cross_act, CAST(blast AS BIGINT) AS blast_words, NOT x AND blast > 40 AS needs_bridge,
CASE WHEN NOT x AND high = 1 AND blast <= 15 THEN 'delete_span' WHEN blast > 40 THEN 'replace_paragraph' ELSE 'rewrite_span' END AS suggested_op FROM a""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = stored.spans(spark, d).withColumn("similarity", F.col("similarity_to_centroid").cast("double"))
    return report.verdicts(s, ["job_id", "cluster_id"], ["start", "span_id"])


@query(f"""WITH {SQL_VERDICT} SELECT job_id, count(DISTINCT cluster_id) AS cluster_count, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_duplicate_instances, CAST(sum(CASE WHEN rn > 1 THEN words ELSE 0 END) AS BIGINT) AS total_duplicate_words FROM o GROUP BY 1""")
def report_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stored.spans(spark, d).withColumn("place", F.struct("start", "span_id"))
    return report.report_stats(s, "job_id", order="place")


@query(f"""WITH {SPANS}, {WINDOWS}, x AS (SELECT DISTINCT job_id, cluster_id, st, en FROM s), y AS (SELECT job_id, cluster_id, doc_char_start AS ws, doc_char_start + length(text) AS we, coalesce(CAST(sim_to_centroid AS DOUBLE), 0) AS sim FROM w)
SELECT x.job_id, x.cluster_id, x.st AS span_start, x.en AS span_end, round(coalesce(max(y.sim), 0), 6) AS similarity FROM x LEFT JOIN y ON x.job_id = y.job_id AND x.cluster_id = y.cluster_id AND y.ws < x.en AND x.st < y.we GROUP BY 1, 2, 3, 4""")
def best_window_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = stored.spans(spark, d).select("job_id", "cluster_id", "start", "end").distinct()
    w = stored.windows(spark, d).select("job_id", "cluster_id", F.col("doc_char_start").alias("start"), (F.col("doc_char_start") + F.char_length("text")).alias("end"), F.coalesce(F.col("sim_to_centroid").cast("double"), F.lit(0.0)).alias("sim"))
    r = report.best_similarity(s, w, ["job_id", "cluster_id"])
    return r.select("job_id", "cluster_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {SPANS}, {PAGES}, g AS (SELECT DISTINCT job_id, cluster_id FROM windows WHERE cluster_id IS NOT NULL AND cluster_id <> -1), o AS (SELECT *, row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY st, span_id) AS rn FROM s),
f AS (SELECT job_id, arg_min(page, doc_char_start) AS page FROM p GROUP BY 1), x AS (SELECT o.*, p.page AS pg FROM o ASOF LEFT JOIN p ON o.job_id = p.job_id AND o.st >= p.doc_char_start)
SELECT x.job_id, coalesce(x.pg, f.page) AS page, x.st AS doc_char_start, x.en AS doc_char_end, x.cluster_id, rn - 1 AS instance_id, CASE WHEN rn = 1 THEN 'canonical' ELSE 'duplicate' END AS role, round(CASE WHEN g.job_id IS NOT NULL THEN (x.cluster_id * CAST(0.6180339887 AS DOUBLE)) % CAST(1 AS DOUBLE) ELSE ((x.cluster_id % 12 + 12) % 12) / 12 END, 6) AS hue FROM x LEFT JOIN f USING (job_id) LEFT JOIN g ON g.job_id = x.job_id AND g.cluster_id = x.cluster_id""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Where the viewer marks the stored spans; clusters that no stored window has get a hue of their own."""
    s = stored.spans(spark, d)
    s = s.withColumn("instance_id", F.row_number().over(Window.partitionBy("job_id", "cluster_id").orderBy("start", "span_id")) - 1).withColumn("similarity", F.col("similarity_to_centroid"))
    known = table(spark, d, "windows").select("job_id", "cluster_id").where("cluster_id is not null and cluster_id <> -1").distinct().withColumn("reg", C.hue(F.col("cluster_id")))
    h = raster.highlights(s, stored.pages(spark, d), known)
    return h.select("job_id", "page", F.col("start").alias("doc_char_start"), F.col("end").alias("doc_char_end"), "cluster_id", F.col("instance_id").cast("bigint").alias("instance_id"), "role", F.round("hue", 6).alias("hue"))


@query()
def merge_passes(spark: SparkSession, d: str) -> DataFrame:
    """The stored clusters of a draft's jobs, each job a pass, folded into one list per draft."""
    s = stored.spans(spark, d).where("draft_id is not null").withColumn("pass_no", F.dense_rank().over(Window.partitionBy("draft_id").orderBy("job_id")))
    return report.merge_passes(s, "draft_id").drop("spans")


SQL_GAP = "[" + SQL_RUN[2:-2] + r"\x{1C}-\x{1F}]"


@query(rf"""WITH {SPANS}, {DRAFTS}, x AS (SELECT s.span_id, d.text, least(s.st, length(d.text)) AS o FROM s JOIN d ON d.draft_id = s.draft_id),
n AS (SELECT span_id, text, len(regexp_extract_all(substr(text, 1, o), '[.!?]{SQL_GAP}')) AS k, len(regexp_extract_all(text, '[.!?]{SQL_GAP}')) + CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END AS n FROM x WHERE o IS NOT NULL)
SELECT span_id, CAST(greatest(1, CASE WHEN k < n OR n = 0 OR NOT regexp_matches(text, '[.!?]{SQL_GAP}*$') THEN k + 1 ELSE k END) AS INTEGER) AS sentence_index FROM n""")
def sentence_indexes(spark: SparkSession, d: str) -> DataFrame:
    """The sentence, by the engine's simple rule, in which each span of a known draft begins."""
    s = stored.spans(spark, d).where("start is not null").select("span_id", "draft_id", "start").join(_docs(spark, d).withColumnRenamed("doc_key", "draft_id"), "draft_id")
    return s.select("span_id", report.sentence_index("text", "start").alias("sentence_index"))


def _sql_expanded(source: str, *keys: str) -> str:
    """CTEs that end in ``xx(*keys, text, a, b)``: the spans ``st, en`` of ``source(*keys, text, st, en)`` widened to sentences."""
    k = ", ".join(keys)
    return rf"""x0 AS (SELECT {k}, text, CAST(length(text) AS BIGINT) AS n, CAST(least(st, length(text)) AS BIGINT) AS st, CAST(greatest(least(st, length(text)), least(en, length(text))) AS BIGINT) AS en FROM {source}),
x1 AS (SELECT *, reverse(substr(text, 1, st)) AS pre, CASE WHEN en > st THEN en - 1 ELSE en END AS anchor FROM x0),
x2 AS (SELECT *, CASE WHEN instr(pre, chr(10) || chr(10)) > 0 THEN st - instr(pre, chr(10) || chr(10)) - 1 ELSE -1 END AS para, st - length(regexp_extract(pre, '^[^.!?]*')) - 1 AS stop, regexp_extract(substr(text, anchor + 1), '(?s)^.*?[.!?]({SQL_GAP}|$)') AS found, instr(substr(text, en + 1), chr(10) || chr(10)) AS gap FROM x1),
x3 AS (SELECT *, CASE WHEN para >= 0 AND para + 2 < st THEN para + 2 ELSE stop + 1 END AS lead FROM x2),
x4 AS (SELECT *, lead + length(regexp_extract(substr(text, lead + 1), '^{SQL_GAP}*')) AS skipped FROM x3),
xx AS (SELECT {k}, text, CASE WHEN n = 0 OR st = 0 THEN 0 WHEN para >= 0 AND para + 2 < st THEN skipped WHEN stop >= 0 THEN least(skipped, st) ELSE 0 END AS a,
CASE WHEN en >= n THEN n WHEN anchor > 0 AND substr(text, anchor + 1, 1) IN ('.', '!', '?') THEN anchor + 1 WHEN gap > 0 THEN en + gap - 1 WHEN found <> '' THEN anchor + length(found) - CASE WHEN regexp_matches(found, '{SQL_GAP}$') THEN 1 ELSE 0 END ELSE n END AS b FROM x4)"""


@query(f"WITH {SPANS}, {DRAFTS}, q AS (SELECT s.span_id, d.text, s.st, s.en FROM s JOIN d USING (draft_id)), {_sql_expanded('q', 'span_id')} SELECT span_id, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end FROM xx")
def expanded_spans(spark: SparkSession, d: str) -> DataFrame:
    s = stored.spans(spark, d).select("span_id", "draft_id", "start", "end").join(_docs(spark, d).withColumnRenamed("doc_key", "draft_id"), "draft_id")
    return s.select("span_id", report.expand_to_sentences("text", "start", "end").alias("x")).select("span_id", F.col("x.start").alias("span_start"), F.col("x.end").alias("span_end"))


def _assembled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each story's chapters with their manifest; the drafts of a chapter, in order of their ids, are its acts."""
    drafts = stored.drafts(spark, d)
    no = F.dense_rank().over(Window.partitionBy("story_id", "chapter").orderBy("draft_id")).alias("act")
    return tuple(cut(x) for x in segment.assembled(drafts.where("chapter is not null").select("story_id", "chapter", no, "text"), ["story_id", "chapter"]))


SQL_ACTS = rf"""n AS (SELECT story_id, chapter, draft_id, dense_rank() OVER (PARTITION BY story_id, chapter ORDER BY draft_id) AS act, {SQL_TRIM} AS body FROM d WHERE chapter IS NOT NULL),
a AS (SELECT *, CAST(coalesce(sum(length(body) + 2) OVER (PARTITION BY story_id, chapter ORDER BY act ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM n WHERE body <> '')"""


@query(rf"""WITH {DRAFTS}, {SQL_ACTS}, w AS (SELECT *, len(regexp_extract_all(body, '{SQL_RUN}')) AS tok FROM a)
SELECT story_id, chapter, row_number() OVER (PARTITION BY story_id, chapter ORDER BY act) AS page, st AS doc_char_start, st + length(body) AS doc_char_end, CAST(tok AS BIGINT) AS token_count FROM w WHERE tok > 0""")
def scope_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each act of each chapter."""
    docs, acts, _ = _assembled(spark, d)
    p = segment.paginate(docs, acts)
    return p.select("doc_key.story_id", "doc_key.chapter", *[F.col(c).cast("bigint").alias(c) for c in ("page", "doc_char_start", "doc_char_end", "token_count")])


@query(rf"""WITH {DRAFTS}, {SQL_ACTS}, l AS (SELECT story_id, chapter, act, st, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM a),
g AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY story_id, chapter, act ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
t AS (SELECT *, length(regexp_extract(line, '^{SQL_SPACE}')) AS lead, regexp_replace(line, '^{SQL_SPACE}|{SQL_SPACE}$', '', 'g') AS t FROM g)
SELECT story_id, chapter, act, row_number() OVER (PARTITION BY story_id, chapter, act ORDER BY pos) AS paragraph_index, printf('ch%02d_a%02d_p%02d', chapter, act, row_number() OVER (PARTITION BY story_id, chapter, act ORDER BY pos)) AS segment_id, CAST(st + off + lead AS BIGINT) AS doc_char_start, CAST(st + off + lead + length(t) AS BIGINT) AS doc_char_end FROM t WHERE t <> ''""")
def paragraph_manifest(spark: SparkSession, d: str) -> DataFrame:
    p = _assembled(spark, d)[2]
    return p.select("doc_key.story_id", "doc_key.chapter", F.col("act").cast("bigint").alias("act"), F.col("paragraph_index").cast("bigint").alias("paragraph_index"), "segment_id", F.col("doc_char_start").cast("bigint").alias("doc_char_start"), F.col("doc_char_end").cast("bigint").alias("doc_char_end"))


def _draft_acts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every draft as the one act of its own text, with its lines as paragraphs."""
    src = stored.drafts(spark, d).withColumn("act", F.coalesce("act", F.lit(1))).withColumn("chapter", F.coalesce("chapter", F.lit(1)))
    acts = src.select("draft_id", "chapter", "act", F.lit(0).alias("start"), F.char_length("text").alias("end"))
    lines = segment.line_index(src.select(F.struct("draft_id", "chapter", "act").alias("doc_key"), "text"))
    k = F.col("doc_key")
    return acts, lines.select(k["draft_id"].alias("draft_id"), F.col("piece").alias("paragraph_index"), T.segment_id(k["chapter"], k["act"], F.col("piece")).alias("segment_id"), F.col("start").alias("doc_char_start"), F.col("end").alias("doc_char_end"), "text")


@query(rf"""WITH {SPANS}, {DRAFTS}, a AS (SELECT draft_id, coalesce(chapter, 1) AS chapter, coalesce(act, 1) AS act, text FROM d), l AS (SELECT draft_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM a),
g AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY draft_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
t AS (SELECT *, length(regexp_extract(line, '^{SQL_SPACE}')) AS lead, regexp_replace(line, '^{SQL_SPACE}|{SQL_SPACE}$', '', 'g') AS t FROM g),
p AS (SELECT draft_id, row_number() OVER (PARTITION BY draft_id ORDER BY pos) AS no, CAST(off + lead AS BIGINT) AS p0, CAST(off + lead + length(t) AS BIGINT) AS p1, t FROM t WHERE t <> ''),
m AS (SELECT s.span_id, a.chapter, a.act, s.st, s.en, length(a.text) AS n, p.no, least(s.st - p.p0, length(p.t)) AS o, p.t FROM s JOIN a USING (draft_id) LEFT JOIN p ON p.draft_id = s.draft_id AND s.st >= p.p0 AND s.st < p.p1 AND s.st < length(a.text) WHERE s.st IS NOT NULL AND s.en IS NOT NULL),
k AS (SELECT *, len(regexp_extract_all(substr(t, 1, o), '[.!?]{SQL_GAP}')) AS k, len(regexp_extract_all(t, '[.!?]{SQL_GAP}')) + CASE WHEN regexp_matches(t, '[.!?]$') THEN 1 ELSE 0 END AS e FROM m)
SELECT span_id, chapter, act, CAST(coalesce(no, 1) AS INTEGER) AS paragraph_index, printf('ch%02d_a%02d_p%02d', chapter, act, coalesce(no, 1)) AS segment_id, CAST(CASE WHEN no IS NULL THEN 1 ELSE greatest(1, CASE WHEN k < e OR e = 0 OR NOT regexp_matches(t, '[.!?]{SQL_GAP}*$') THEN k + 1 ELSE k END) END AS INTEGER) AS sentence_index FROM k""")
def span_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Chapter, act, paragraph, segment id and sentence of every span of a known draft."""
    acts, paragraphs = _draft_acts(spark, d)
    s = stored.spans(spark, d).where("start is not null and end is not null").select("span_id", "draft_id", "start", "end").join(acts.select("draft_id"), "draft_id", "left_semi")
    at = report.span_locations(s, acts, paragraphs, ["draft_id"])
    return at.select("span_id", "location.chapter", "location.act", F.col("location.paragraph_index").cast("int").alias("paragraph_index"), "location.segment_id", "location.sentence_index")


# --- vectors and clusters


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit("j").alias("job_id"), F.col("vec_id").alias("window_index"), "embedding", F.col("label").alias("cluster_id"))


SQL_CENT = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY 1)"


@query(f"WITH {SQL_CENT} SELECT label AS cluster_id, pos, round(x, 6) AS mean FROM m")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.centroids(_vectors(spark, d), ["cluster_id"])
    return c.select("cluster_id", F.posexplode("centroid").alias("pos", "m")).select("cluster_id", F.col("pos").cast("bigint").alias("pos"), F.round("m", 6).alias("mean"))


@query(f"WITH {SQL_CENT} SELECT vec_id, label AS cluster_id, round(list_cosine_similarity(v, c), 6) AS sim FROM e JOIN c USING (label)")
def sim_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarities(_vectors(spark, d), ["cluster_id"]).select(F.col("window_index").alias("vec_id"), "cluster_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {SQL_CENT}, s AS (SELECT vec_id, label, list_cosine_similarity(v, c) AS sim FROM e JOIN c USING (label)) SELECT label AS cluster_id, count(*) AS member_count, arg_max(vec_id, sim) AS central_vec, round(max(sim), 6) AS best, round((label * CAST(0.6180339887 AS DOUBLE)) % CAST(1 AS DOUBLE), 6) AS hue FROM s GROUP BY 1")
def cluster_registry(spark: SparkSession, d: str) -> DataFrame:
    s = clusters.similarities(_vectors(spark, d), ["cluster_id"])
    g = s.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.max_by("window_index", F.struct("sim", -F.col("window_index"))).alias("central_vec"), F.round(F.max("sim"), 6).alias("best"))
    return g.withColumn("hue", F.round(C.hue(F.col("cluster_id")), 6))


SQL_REGISTRY = f"""{WINDOWS}, v AS (SELECT job_id, cluster_id, window_index, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM w WHERE cluster_id IS NOT NULL AND cluster_id <> -1 AND len(embedding) > 0),
m AS (SELECT job_id, cluster_id, pos, avg(x) AS m FROM v GROUP BY 1, 2, 3), nz AS (SELECT job_id, cluster_id, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1, 2 HAVING sum(m * m) > 0),
q AS (SELECT v.job_id, v.cluster_id, v.window_index, sum(v.x * m.m) AS dot, sqrt(sum(v.x * v.x)) AS len FROM v JOIN m USING (job_id, cluster_id, pos) GROUP BY 1, 2, 3),
r AS (SELECT w.job_id, w.cluster_id, w.window_index, w.page, coalesce(CASE WHEN q.len > 0 THEN greatest(least(q.dot / q.len / nz.norm, 1), -1) ELSE 0 END, 0) AS sim FROM w JOIN nz USING (job_id, cluster_id) LEFT JOIN q USING (job_id, cluster_id, window_index)),
o AS (SELECT job_id, cluster_id, doc_char_start AS st, doc_char_start + length(text) AS en FROM w WHERE doc_char_start IS NOT NULL AND cluster_id <> -1),
i AS (SELECT *, CASE WHEN st >= max(en) OVER (PARTITION BY job_id, cluster_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY st, en) = 1 THEN 1 ELSE 0 END AS nw FROM o),
n AS (SELECT job_id, cluster_id, sum(nw) AS n FROM i GROUP BY 1, 2)"""


@query(f"WITH {SQL_REGISTRY} SELECT r.job_id, r.cluster_id, count(*) AS member_count, arg_max(window_index, (round(sim, 12), -window_index)) AS central_window, CAST(coalesce(max(n.n), 0) AS BIGINT) AS instance_count, CAST(count(DISTINCT page) AS INTEGER) AS n_pages, round((r.cluster_id * CAST(0.6180339887 AS DOUBLE)) % CAST(1 AS DOUBLE), 6) AS hue FROM r LEFT JOIN n USING (job_id, cluster_id) GROUP BY r.job_id, r.cluster_id")
def window_registry(spark: SparkSession, d: str) -> DataFrame:
    w = stored.windows(spark, d, "job_id", "window_index", "page", "doc_char_start", "text", "cluster_id", "embedding").withColumn("doc_char_end", F.col("doc_char_start") + F.char_length("text"))
    return clusters.registry(w).select("job_id", "cluster_id", "member_count", "central_window", "instance_count", F.size("pages").alias("n_pages"), F.round("hue", 6).alias("hue"))


@query(f"WITH {SQL_CENT} SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(x.c, y.c), 6) AS sim FROM c x JOIN c y ON x.label < y.label WHERE list_cosine_similarity(x.c, y.c) >= -1")
def centroid_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.centroids(_vectors(spark, d), ["job_id", "cluster_id"])
    return clusters.centroid_pairs(c, "job_id", -1.0).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {SQL_CENT}, s AS (SELECT vec_id, c.label, list_cosine_similarity(v, c) AS sim FROM e CROSS JOIN c), b AS (SELECT vec_id, arg_max(label, sim) AS l, max(sim) AS m FROM s GROUP BY 1) SELECT vec_id, CASE WHEN m >= 0.3 THEN l ELSE -1 END AS cluster_id FROM b")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return clusters.nearest_centroid(v, clusters.centroids(v, ["job_id", "cluster_id"]), "job_id", 0.3).select(F.col("window_index").alias("vec_id"), "cluster_id")


def _job_vectors(spark: SparkSession, d: str) -> DataFrame:
    return stored.windows(spark, d, "job_id", "window_index", "embedding")


@query()
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_jobs(_job_vectors(spark, d), AnalysisParams(100, 50, enable_hdbscan=False))


@query()
def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_jobs(_job_vectors(spark, d), AnalysisParams(100, 50))


@query(rf"""WITH RECURSIVE {SQL_REGISTRY}, ce AS (SELECT job_id, cluster_id, list(m ORDER BY pos) AS c FROM m JOIN nz USING (job_id, cluster_id) GROUP BY 1, 2), le AS (SELECT job_id, cluster_id, avg(strlen(text)) AS len FROM w WHERE cluster_id <> -1 GROUP BY 1, 2),
sd AS (SELECT a.job_id, CASE WHEN la.len < lb.len THEN a.cluster_id ELSE b.cluster_id END AS child, CASE WHEN la.len < lb.len THEN b.cluster_id ELSE a.cluster_id END AS parent FROM ce a JOIN ce b ON a.job_id = b.job_id AND a.cluster_id < b.cluster_id JOIN le la ON la.job_id = a.job_id AND la.cluster_id = a.cluster_id JOIN le lb ON lb.job_id = b.job_id AND lb.cluster_id = b.cluster_id WHERE list_cosine_similarity(a.c, b.c) >= 0.85),
tx AS (SELECT job_id, window_index, cluster_id, page, lower(text) AS t, regexp_replace(lower(text), '^[	-
 ]+|[	-
 ]+$', '', 'g') AS k FROM w),
hi AS (SELECT sd.job_id, child, parent, c.window_index, coalesce(max(CASE WHEN c.k <> '' AND contains(p.t, c.k) THEN 1 ELSE 0 END), 0) AS hit FROM sd JOIN tx c ON c.job_id = sd.job_id AND c.cluster_id = child LEFT JOIN tx p ON p.job_id = sd.job_id AND p.cluster_id = parent AND p.page = c.page GROUP BY 1, 2, 3, 4),
su AS (SELECT job_id, child, parent FROM hi GROUP BY 1, 2, 3 HAVING avg(hit) >= 0.5), ed AS (SELECT job_id, child AS a, parent AS b FROM su UNION SELECT job_id, parent, child FROM su),
re AS (SELECT job_id, a, a AS b FROM ed UNION SELECT re.job_id, re.a, ed.b FROM re JOIN ed ON ed.job_id = re.job_id AND ed.a = re.b), ro AS (SELECT job_id, a AS cluster_id, min(b) AS root FROM re GROUP BY 1, 2),
za AS (SELECT w.job_id, w.window_index, CASE WHEN coalesce(w.cluster_id, -1) = -1 THEN -1 ELSE coalesce(ro.root, w.cluster_id) END AS root FROM w LEFT JOIN ro ON ro.job_id = w.job_id AND ro.cluster_id = w.cluster_id),
fi AS (SELECT job_id, root, dense_rank() OVER (PARTITION BY job_id ORDER BY min(window_index)) - 1 AS no FROM za WHERE root <> -1 GROUP BY job_id, root)
SELECT za.job_id, za.window_index, CAST(coalesce(fi.no, -1) AS INTEGER) AS cluster_id FROM za LEFT JOIN fi ON fi.job_id = za.job_id AND fi.root = za.root""")
def linked_subphrases(spark: SparkSession, d: str) -> DataFrame:
    return clusters.subphrase_links(stored.windows(spark, d, "job_id", "window_index", "page", "text", "cluster_id", "embedding"))


@query(rf"""WITH {DRAFTS}, t AS (SELECT draft_id, unnest(regexp_extract_all(text, '{SQL_WORD}')) AS w FROM d), u AS (SELECT DISTINCT w, encode(w) AS b FROM t),
x AS (SELECT w, list_reduce(list_prepend(5381::HUGEINT, [('0x' || hex(b)[2 * i - 1:2 * i])::HUGEINT FOR i IN range(1, octet_length(b) + 1)]), lambda h, y: (h * 33 + y) % 18446744073709551616::HUGEINT) % 64 AS k FROM u),
c AS (SELECT draft_id, k, count(*) AS c FROM t JOIN x USING (w) GROUP BY 1, 2)
SELECT d.draft_id AS doc_key, CASE WHEN count(c) > 0 THEN 1.0::DOUBLE ELSE 0 END AS norm, CAST(count(c) AS INTEGER) AS n_buckets FROM d LEFT JOIN c USING (draft_id) GROUP BY d.draft_id""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = V.hash_embedding(F.col("text"), 64)
    return _docs(spark, d).select("doc_key", v.alias("v")).select("doc_key", F.round(V.norm(F.col("v")), 4).alias("norm"), F.size(F.filter("v", lambda x: x > 0)).alias("n_buckets"))


SQL_HASHED = rf"""t AS (SELECT draft_id, unnest(regexp_extract_all(text, '{SQL_WORD}')) AS w, unnest(range(len(regexp_extract_all(text, '{SQL_WORD}')))) AS pos FROM d), u AS (SELECT DISTINCT w, encode(w) AS b FROM t),
x AS (SELECT w, list_reduce(list_prepend(5381::HUGEINT, [('0x' || hex(b)[2 * i - 1:2 * i])::HUGEINT FOR i IN range(1, octet_length(b) + 1)]), lambda h, y: (h * 33 + y) % 18446744073709551616::HUGEINT) AS h FROM u)"""


@query(f"WITH {DRAFTS}, {SQL_HASHED} SELECT draft_id AS doc_key, count(*) AS n_tokens, CAST(sum(h % 30521 + 1) AS BIGINT) AS id_sum, CAST(arg_min(h % 30521 + 1, pos) AS INTEGER) AS first_id FROM t JOIN x USING (w) GROUP BY 1")
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo token ids of every draft that has a word."""
    ids = _docs(spark, d).select("doc_key", V.token_ids(F.col("text")).alias("k")).where(F.size("k") > 0)
    return ids.select("doc_key", F.size("k").cast("bigint").alias("n_tokens"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), F.get("k", F.lit(0)).alias("first_id"))


@query(rf"""WITH {DRAFTS}, s AS (SELECT draft_id, text, regexp_extract_all(text, '{SQL_RUN}|{SQL_SPACE1}') AS parts FROM d),
p AS (SELECT draft_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM s), c AS (SELECT *, sum(CASE WHEN regexp_full_match(part, '{SQL_SPACE1}') THEN 1 ELSE 0 END) OVER (PARTITION BY draft_id ORDER BY pos) AS seen FROM p)
SELECT d.draft_id AS doc_key, CAST(coalesce(sum(CASE WHEN seen < 256 THEN length(part) END), 0) AS BIGINT) AS n_chars FROM d LEFT JOIN c USING (draft_id) GROUP BY 1""")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length of what an embedder that reads 256 words gets of each draft."""
    return _docs(spark, d).select("doc_key", F.char_length(V.truncated(F.col("text"))).cast("bigint").alias("n_chars"))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM n), l AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM x GROUP BY 1) SELECT vec_id, pos, round(CASE WHEN l > 0 THEN x / l ELSE x END, 6) AS x FROM x JOIN l USING (vec_id)")
def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.normalised(F.col("embedding"))).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


# --- rasters


SQL_CELLS = f"""{WINDOWS}, {PAGES}, r AS (SELECT w.job_id, w.page, w.window_index, w.cluster_id, CAST(w.sim_to_centroid AS DOUBLE) AS sim, CASE WHEN char_count > 0 THEN least(CAST(floor(w.char_start / char_count * 400) AS BIGINT), 399) ELSE 0 END AS c0, CASE WHEN char_count > 0 THEN least(CAST(floor(greatest(w.char_end - 1, w.char_start) / char_count * 400) AS BIGINT), 399) ELSE 0 END AS c1 FROM w JOIN p ON p.job_id = w.job_id AND p.page = w.page WHERE w.cluster_id <> -1 AND w.sim_to_centroid IS NOT NULL),
z AS (SELECT job_id, page, window_index, cluster_id, sim, unnest(range(c0, greatest(c0, c1) + 1)) AS cell FROM r),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page, cell ORDER BY sim DESC, window_index) AS rank FROM z) WHERE rank <= 8)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    w = stored.windows(spark, d).where("sim_to_centroid is not null").withColumn("sim", F.col("sim_to_centroid").cast("double"))
    return raster.painted_cells(w, stored.pages(spark, d))


@query(f"WITH {SQL_CELLS} SELECT job_id, page, cell, rank, cluster_id, window_index FROM k")
def subcell_topk(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("job_id", "page", F.col("cell").cast("bigint").alias("cell"), F.col("rank").cast("bigint").alias("rank"), "cluster_id", "window_index")


SQL_BLEND = f"""{SQL_CELLS}, v AS (SELECT job_id, page, cell, pow(sim, 1.5) AS wt, (((cluster_id * CAST(0.6180339887 AS DOUBLE)) % 1.0 + 1.0) % 1.0) * 6 AS h FROM k WHERE sim >= 0.75),
x AS (SELECT *, wt * (1 - abs(h % 2.0 - 1)) AS xx FROM v),
c AS (SELECT job_id, page, cell, wt, CASE WHEN h < 1 THEN wt WHEN h < 2 THEN xx WHEN h < 4 THEN 0 WHEN h < 5 THEN xx ELSE wt END AS r, CASE WHEN h < 1 THEN xx WHEN h < 3 THEN wt WHEN h < 4 THEN xx ELSE 0 END AS g, CASE WHEN h < 2 THEN 0 WHEN h < 3 THEN xx WHEN h < 5 THEN wt ELSE xx END AS b FROM x),
t AS (SELECT job_id, page, cell, sum(wt * r) / sum(wt) AS r, sum(wt * g) / sum(wt) AS g, sum(wt * b) / sum(wt) AS b FROM c GROUP BY 1, 2, 3 HAVING sum(wt) > 0)"""


def _srgb(c: str) -> str:
    return f"CAST(floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END) * 255 + 0.5) AS INTEGER) AS {c}"


@query(f"WITH {SQL_BLEND} SELECT job_id, page, cell, {_srgb('r')}, {_srgb('g')}, {_srgb('b')} FROM t")
def subcell_blend(spark: SparkSession, d: str) -> DataFrame:
    return raster.blended_cells(_cells(spark, d)).withColumn("cell", F.col("cell").cast("bigint"))


@query(f"""WITH {SQL_BLEND}, u AS (SELECT job_id, page, cell, {_srgb('r')}, {_srgb('g')}, {_srgb('b')} FROM t), q AS (SELECT DISTINCT job_id, page FROM p), y AS (SELECT job_id, page, unnest(range(400)) AS cell FROM q),
j AS (SELECT y.job_id, y.page, y.cell, CASE WHEN u.cell IS NULL THEN '22222AFF' ELSE printf('%02X%02X%02XFF', u.r, u.g, u.b) END AS px FROM y LEFT JOIN u ON u.job_id = y.job_id AND u.page = y.page AND u.cell = y.cell)
SELECT job_id, page, base64(from_hex(string_agg(px, '' ORDER BY cell))) AS rgba_base64 FROM j GROUP BY 1, 2""")
def page_canvases(spark: SparkSession, d: str) -> DataFrame:
    return raster.encoded(raster.canvases(raster.blended_cells(_cells(spark, d)), stored.pages(spark, d)))


SQL_SPAN_PAGES = f"""{SPANS}, f AS (SELECT job_id, arg_min(page, doc_char_start) AS page FROM p GROUP BY 1), o AS (SELECT s.job_id, p.page FROM s ASOF LEFT JOIN p ON s.job_id = p.job_id AND s.st >= p.doc_char_start),
sel AS (SELECT DISTINCT o.job_id, coalesce(o.page, f.page) AS page FROM o LEFT JOIN f USING (job_id))"""


@query(f"""WITH {SQL_BLEND}, {SQL_SPAN_PAGES}, u AS (SELECT job_id, page, cell, {_srgb('r')}, {_srgb('g')}, {_srgb('b')} FROM t), y AS (SELECT job_id, page, unnest(range(400)) AS cell FROM (SELECT DISTINCT p.job_id, p.page FROM p JOIN sel ON sel.job_id = p.job_id AND sel.page = p.page)),
j AS (SELECT y.job_id, y.page, y.cell, CASE WHEN u.cell IS NULL THEN '22222AFF' ELSE printf('%02X%02X%02XFF', u.r, u.g, u.b) END AS px FROM y LEFT JOIN u ON u.job_id = y.job_id AND u.page = y.page AND u.cell = y.cell)
SELECT job_id, page, base64(from_hex(string_agg(px, '' ORDER BY cell))) AS rgba_base64 FROM j GROUP BY 1, 2""")
def selected_canvases(spark: SparkSession, d: str) -> DataFrame:
    """The pages that hold a stored span, drawn again; no other page's cells are painted."""
    s = stored.spans(spark, d).select("job_id", "start")
    chosen = cut(intervals.as_of(s, stored.pages(spark, d).select("job_id", "doc_char_start", "page"), ["job_id"], "start", "doc_char_start", "page").select("job_id", "page").where("page is not null").distinct())
    w = stored.windows(spark, d).where("sim_to_centroid is not null").withColumn("sim", F.col("sim_to_centroid").cast("double"))
    pages = raster.selected(stored.pages(spark, d), chosen)
    return raster.encoded(raster.canvases(raster.blended_cells(raster.painted_cells(raster.selected(w, chosen), pages)), pages))


@query(f"WITH {SQL_CELLS} SELECT job_id, page, cell, max(sim) > 0.8 AS shown FROM k GROUP BY 1, 2, 3")
def tolerance_mask(spark: SparkSession, d: str) -> DataFrame:
    return raster.tolerance_mask(_cells(spark, d), 0.8).withColumn("cell", F.col("cell").cast("bigint"))


@query(f"WITH {SQL_CELLS}, b AS (SELECT job_id, page, cluster_id, max(sim) AS sim FROM k GROUP BY 1, 2, 3) SELECT job_id, page, cluster_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY sim DESC, cluster_id) AS rank FROM b) WHERE rank <= 3")
def page_tooltips(spark: SparkSession, d: str) -> DataFrame:
    return raster.page_tooltips(_cells(spark, d)).select("job_id", "page", "cluster_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SQL_CELLS}, s AS (SELECT * FROM k WHERE sim >= 0.75), f AS (SELECT job_id, cluster_id, page, min(cell) AS cell FROM s GROUP BY 1, 2, 3) SELECT s.job_id, s.page, s.cell, s.cluster_id, round(s.sim, 6) AS sim, f.page AS other_page, f.cell AS other_cell FROM s JOIN f ON f.job_id = s.job_id AND f.cluster_id = s.cluster_id AND f.page <> s.page WHERE s.rank = 1")
def cell_detail(spark: SparkSession, d: str) -> DataFrame:
    c = raster.cell_detail(_cells(spark, d))
    return c.select("job_id", "page", F.col("cell").cast("bigint").alias("cell"), "cluster_id", F.round("sim", 6).alias("sim"), "other_page", F.col("other_cell").cast("bigint").alias("other_cell"))


@query(f"""WITH {SQL_CELLS}, s AS (SELECT * FROM k WHERE sim >= 0.75), t AS (SELECT job_id, page, cell, arg_min(cluster_id, rank) AS cluster_id, arg_min(sim, rank) AS sim, count(DISTINCT cluster_id) AS n_clusters FROM s GROUP BY 1, 2, 3),
l AS (SELECT job_id, page, cluster_id, arg_max(text, (strlen(text), -window_index)) AS text FROM w WHERE text IS NOT NULL GROUP BY 1, 2, 3)
SELECT t.job_id, t.page, t.cell, t.cluster_id, round(t.sim, 6) AS sim, t.n_clusters, l.text FROM t LEFT JOIN l ON l.job_id = t.job_id AND l.page = t.page AND l.cluster_id = t.cluster_id""")
def cell_windows(spark: SparkSession, d: str) -> DataFrame:
    w = stored.windows(spark, d, "job_id", "window_index", "page", "text", "cluster_id")
    return raster.cell_windows(_cells(spark, d), w).withColumn("cell", F.col("cell").cast("bigint")).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SQL_CELLS}, s AS (SELECT *, row_number() OVER (PARTITION BY job_id, page, cell ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY job_id, page, cell) AS n FROM k WHERE sim >= 0.75),
q AS (SELECT job_id, page, cell, n, unnest(range(24)) AS px FROM (SELECT DISTINCT job_id, page, cell, n FROM s)), y AS (SELECT *, px // 6 AS r, px % 6 AS c FROM q),
j AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN (r + c) % 2 WHEN n = 3 THEN (r * 3 + c * 7) % 3 WHEN n = 4 THEN (r % 2) * 2 + c % 2 ELSE (r * 11 + c * 7) % n END AS i FROM y)
SELECT j.job_id, j.page, j.cell, string_agg(CAST(s.cluster_id AS VARCHAR), ',' ORDER BY px) AS pixels FROM j JOIN s ON s.job_id = j.job_id AND s.page = j.page AND s.cell = j.cell AND s.i = j.i GROUP BY 1, 2, 3""")
def dithered_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's clusters spread over patches of six by four pixels."""
    x = raster.dithered_cells(_cells(spark, d), 6, 4)
    return x.select("job_id", "page", F.col("cell").cast("bigint").alias("cell"), F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


@query(f"WITH {WINDOWS}, {PAGES}, m AS (SELECT w.window_id, CASE WHEN char_count > 0 THEN least(CAST(floor(((char_start + char_end) // 2) / char_count * 400) AS INTEGER), 399) ELSE 0 END AS c FROM w JOIN p ON p.job_id = w.job_id AND p.page = w.page) SELECT window_id, CAST(c // 20 AS SMALLINT) AS sub_cell_row, CAST(c % 20 AS SMALLINT) AS sub_cell_col FROM m")
def midpoint_cells(spark: SparkSession, d: str) -> DataFrame:
    w = stored.windows(spark, d, "job_id", "page", "char_start", "char_end").join(stored.pages(spark, d).select("job_id", "page", "char_count"), ["job_id", "page"])
    r, c = C.midpoint_cell(F.col("char_start"), F.col("char_end"), F.col("char_count"))
    return w.select("window_id", r.alias("sub_cell_row"), c.alias("sub_cell_col"))


@query("SELECT DISTINCT cluster_id, round(((cluster_id * CAST(0.6180339887 AS DOUBLE)) % CAST(1 AS DOUBLE) + 1) % CAST(1 AS DOUBLE), 6) AS hue FROM windows WHERE cluster_id IS NOT NULL")
def hue_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "windows").select("cluster_id").where("cluster_id is not null").distinct().select("cluster_id", F.round(C.hue(F.col("cluster_id")), 6).alias("hue"))


# --- stored jobs


@query(f"WITH {DRAFTS} SELECT draft_id AS doc_key, sha256(text) AS text_hash FROM d")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_key", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {JOBS} SELECT job_id, sha256(concat_ws('|', window_size, stride, coalesce(tokens_per_page, 0), min_repetitions, min_samples)) AS settings_key FROM j")
def settings_hash(spark: SparkSession, d: str) -> DataFrame:
    j = stored.latest_jobs(spark, d)
    return j.select("job_id", F.sha2(F.concat_ws("|", "window_size", "stride", F.coalesce("tokens_per_page", F.lit(0)), "min_repetitions", "min_samples"), 256).alias("settings_key"))


@query(f"WITH {JOBS} SELECT job_id, status, windows_total, windows_committed FROM j")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return stored.latest_jobs(spark, d).select("job_id", "status", "windows_total", "windows_committed")


@query(f"""WITH {JOBS}, c AS (SELECT document_path, arg_max(job_id, (CAST(created_at AS TIMESTAMPTZ), job_id)) AS cj FROM j WHERE status = 'complete' GROUP BY 1), q AS (SELECT document_path, arg_max(job_id, (CAST(updated_at AS TIMESTAMPTZ), job_id)) AS pj FROM j WHERE status = 'partial' GROUP BY 1)
SELECT document_path, cj AS complete_job, pj AS partial_job FROM c FULL JOIN q USING (document_path)""")
def job_for_document(spark: SparkSession, d: str) -> DataFrame:
    return stored.job_for_document(stored.latest_jobs(spark, d))


@query(f"WITH {JOBS}, {WINDOWS}, n AS (SELECT job_id, count(*) AS n FROM w GROUP BY 1) SELECT j.job_id, j.status, coalesce(n.n, 0) AS stored, greatest(j.windows_total - coalesce(n.n, 0), 0) AS missing FROM j LEFT JOIN n USING (job_id)")
def resume_progress(spark: SparkSession, d: str) -> DataFrame:
    n = stored.windows(spark, d, "job_id").groupBy("job_id").agg(F.count("*").alias("stored"))
    j = stored.latest_jobs(spark, d).select("job_id", "status", "windows_total").join(n, "job_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)).cast("bigint"))
    return j.select("job_id", "status", "stored", F.greatest(F.col("windows_total") - F.col("stored"), F.lit(0)).alias("missing"))


@query(f"WITH {WINDOWS} SELECT job_id, count(*) AS n_windows, count(CASE WHEN len(embedding) = 384 THEN 1 END) AS n_vectors, CAST(max(window_index) AS BIGINT) AS last_index FROM w GROUP BY 1")
def job_windows(spark: SparkSession, d: str) -> DataFrame:
    w = stored.windows(spark, d, "job_id", "window_index", "embedding")
    return w.groupBy("job_id").agg(F.count("*").alias("n_windows"), F.sum(F.coalesce((F.size("embedding") == 384).cast("bigint"), F.lit(0))).alias("n_vectors"), F.max("window_index").cast("bigint").alias("last_index"))


SQL_ESTIMATES = ", ".join(f"CAST(CASE WHEN n > {p.window_size} THEN (n - {p.window_size}) // {p.stride} + 1 WHEN n >= 3 THEN 1 ELSE 0 END AS BIGINT) AS {p.name}" for p in PRESETS["full_multi_pass"].passes if p.method == "embedding")


@query(f"WITH {DRAFTS}, c AS (SELECT draft_id, {SQL_WORDS} AS n FROM d) SELECT draft_id AS doc_key, {SQL_ESTIMATES} FROM c")
def pass_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Windows that each pass of the full bundle would make of each draft."""
    n = _docs(spark, d).select("doc_key", T.word_count(F.col("text")).alias("n"))
    return n.select("doc_key", *[segment.window_estimate(F.col("n"), p.window_size, p.stride).alias(p.name) for p in PRESETS["full_multi_pass"].passes if p.method == "embedding"])


SQL_DRAFT_PATH = r"CAST(nullif(regexp_extract(document_path, '([0-9]+)(\.[A-Za-z]+)?$', 1), '') AS BIGINT)"


@query(rf"""WITH {JOBS}, {DRAFTS}, h AS (SELECT draft_id, sha256(text) AS hash FROM d), n AS (SELECT job_id, count(*) AS n FROM (SELECT DISTINCT job_id, page FROM pages) GROUP BY 1), k AS (SELECT j.*, h.hash AS now FROM j LEFT JOIN h ON h.draft_id = {SQL_DRAFT_PATH}),
c AS (SELECT document_path, arg_max(job_id, (CAST(created_at AS TIMESTAMPTZ), job_id)) AS complete_job FROM k WHERE status = 'complete' AND document_hash = now GROUP BY 1),
p AS (SELECT document_path, arg_max(job_id, (CAST(updated_at AS TIMESTAMPTZ), job_id)) AS partial_job FROM k WHERE status = 'partial' GROUP BY 1),
a AS (SELECT DISTINCT document_path FROM j WHERE document_path IS NOT NULL)
SELECT a.document_path, complete_job, coalesce(n.n, 0) AS page_count, partial_job, round(CASE WHEN q.windows_total > 0 THEN CAST(q.windows_committed AS DOUBLE) / q.windows_total WHEN q.job_id IS NOT NULL THEN 0 END, 6) AS done FROM a LEFT JOIN c USING (document_path) LEFT JOIN p USING (document_path) LEFT JOIN n ON n.job_id = complete_job LEFT JOIN j q ON q.job_id = partial_job""")
def session_check(spark: SparkSession, d: str) -> DataFrame:
    """Per document: the newest complete job of its present text with its pages, and the last partial one with its share done."""
    path = F.regexp_extract("document_path", r"([0-9]+)(\.[A-Za-z]+)?$", 1)
    now = _docs(spark, d).select(F.col("doc_key").alias("draft_id"), F.sha2("text", 256).alias("current_hash"))
    jobs = stored.latest_jobs(spark, d).withColumn("draft_id", F.when(path != "", path.cast("bigint")))
    return stored.session_state(jobs.join(now, "draft_id", "left"), stored.pages(spark, d))


@query(f"""WITH {WINDOWS}, b AS (SELECT job_id, window_index // 32 AS batch, max(committed_at) AS done_at FROM w WHERE committed_at IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN lag(done_at) OVER o IS NOT NULL THEN greatest(epoch_us(done_at) - epoch_us(lag(done_at) OVER o), 0) / 1000000.0 END AS took FROM b WINDOW o AS (PARTITION BY job_id ORDER BY batch)),
m AS (SELECT *, avg(took) OVER (PARTITION BY job_id ORDER BY batch ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean FROM t)
SELECT job_id, batch, round(coalesce(mean, 0), 3) AS mean_seconds, round(coalesce(mean, 0) * (max(batch) OVER (PARTITION BY job_id) - batch), 3) AS eta_seconds FROM m""")
def batch_eta(spark: SparkSession, d: str) -> DataFrame:
    """Rolling mean of the last 50 batches' durations, and the time the job's remaining batches would take at it."""
    w = stored.windows(spark, d, "job_id", "window_index").join(table(spark, d, "windows").groupBy("window_id").agg(F.max("committed_at").alias("committed_at")), "window_id")
    return stored.rolling_eta(w.where("committed_at is not null"), 32).select("job_id", "batch", F.round("mean_seconds", 3).alias("mean_seconds"), F.round("eta_seconds", 3).alias("eta_seconds"))


# --- whole analyses


@query()
def embedding_report(spark: SparkSession, d: str) -> DataFrame:
    """One embedding pass over all drafts with leader clustering, from pages to located spans."""
    from echoloom.operators import contract

    return contract.embedding_instances(_docs(spark, d), AnalysisParams(20, 10, enable_hdbscan=False)).select("doc_key", "cluster_id", "instance_id", "start", "end", "members", F.round("similarity", 4).alias("similarity"))


@query(rf"""WITH {SQL_REGISTRY}, {PAGES}, dt AS (SELECT job_id, string_agg(text, '' ORDER BY page) AS text FROM p GROUP BY 1),
wi AS (SELECT r.job_id, r.cluster_id, w.doc_char_start AS st, w.doc_char_start + length(w.text) AS en, CASE WHEN len(w.embedding) > 0 THEN r.sim ELSE 0 END AS sim FROM r JOIN w ON w.job_id = r.job_id AND w.window_index = r.window_index WHERE w.text IS NOT NULL),
wf AS (SELECT *, CASE WHEN st >= max(en) OVER (PARTITION BY job_id, cluster_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY st, en) = 1 THEN 1 ELSE 0 END AS nw FROM wi),
wg AS (SELECT *, sum(nw) OVER (PARTITION BY job_id, cluster_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS isle FROM wf),
wm AS (SELECT job_id, cluster_id, min(st) AS st, max(en) AS en, count(*) AS members FROM wg GROUP BY job_id, cluster_id, isle), wx AS (SELECT wm.*, wm.st AS place, dt.text FROM wm JOIN dt USING (job_id)),
{_sql_expanded('wx', 'job_id', 'cluster_id', 'members', 'place')}, sp AS (SELECT * FROM xx WHERE b > a),
bs AS (SELECT job_id, cluster_id, a, b, coalesce(max(sim), 0) AS sim FROM (SELECT DISTINCT job_id, cluster_id, a, b FROM sp) LEFT JOIN wi USING (job_id, cluster_id) WHERE st < b AND a < en GROUP BY 1, 2, 3, 4)
SELECT sp.job_id, sp.cluster_id, CAST(row_number() OVER (PARTITION BY sp.job_id, sp.cluster_id ORDER BY sp.a, sp.place) - 1 AS INTEGER) AS instance_id, CAST(sp.a AS INTEGER) AS span_start, CAST(sp.b AS INTEGER) AS span_end, sp.members, round(coalesce(bs.sim, 0), 6) AS similarity FROM sp LEFT JOIN bs ON bs.job_id = sp.job_id AND bs.cluster_id = sp.cluster_id AND bs.a = sp.a AND bs.b = sp.b""")
def stored_report(spark: SparkSession, d: str) -> DataFrame:
    """The spans of all stored jobs, from their windows and pages."""
    from echoloom.operators import contract

    w = stored.windows(spark, d, "job_id", "window_index", "doc_char_start", "text", "cluster_id", "embedding")
    return contract.stored_report(w, stored.pages(spark, d)).select("job_id", "cluster_id", "instance_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "members", F.round("similarity", 6).alias("similarity"))


@query()
def multi_pass_report(spark: SparkSession, d: str) -> DataFrame:
    """All five passes of the full bundle over every chapter with its acts, merged into one JSON report each."""
    from echoloom.operators import contract

    docs, acts, paragraphs = _assembled(spark, d)
    bundle = PRESETS["full_multi_pass"]
    passes = contract.multi_pass(docs, bundle, acts)
    return contract.report_json(docs, passes, bundle.passes, acts, paragraphs, bundle.tokens_per_page).select("doc_key.story_id", "doc_key.chapter", "report")


@query()
def page_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What a viewer needs of each page as JSON: its highlights and its top clusters; one row per page, so bounded."""
    h = highlights(spark, d).groupBy("job_id", "page").agg(F.array_sort(F.collect_list(F.struct("doc_char_start", "doc_char_end", "cluster_id", "hue"))).alias("highlights"))
    t = page_tooltips(spark, d).groupBy("job_id", "page").agg(F.array_sort(F.collect_list(F.struct("rank", "cluster_id", "sim"))).alias("clusters"))
    p = stored.pages(spark, d).select("job_id", "page", "char_count").join(h, ["job_id", "page"], "left").join(t, ["job_id", "page"], "left")
    return p.select("job_id", "page", F.to_json(F.struct("char_count", "highlights", "clusters")).alias("payload"))
