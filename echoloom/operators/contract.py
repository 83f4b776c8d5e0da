"""The versioned report: per document one JSON with passes, merged clusters and their addresses."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoloom.config import LEXICAL, AnalysisParams, LexicalConfig, MultiPassConfig, PassSpec
from echoloom.functions import text as T
from echoloom.functions import vectors as V
from echoloom.operators import clusters, lexical, report, segment
from echoloom.operators.intervals import merged
from echoloom.runtime import cut, settled

SCHEMA_VERSION, BOUNDARY_VERSION = "1", 1


class ContractError(ValueError):
    """A report that breaks the contract."""


def window_instances(windows: DataFrame, docs: DataFrame, acts: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """``doc_key, cluster_id, instance_id, start, end, text, similarity, members``: the spans of clustered windows.

    ``windows(doc_key, cluster_id, embedding, start, end)`` with offsets in ``docs(doc_key, text)``. Overlapping windows of a
    cluster are one span, which is cut to its act and widened to sentences; its similarity is that of the best window it
    then overlaps. ``instance_id`` counts from 0 in document order. Noise and windows without a vector make no span.
    """
    key = ["doc_key", "cluster_id"]
    sims = cut(clusters.similarities(windows.where("cluster_id is not null and cluster_id <> -1").select(*key, "start", "end", "embedding"), key))
    spans = merged(sims.select(*key, "start", "end"), key).select(*key, "start", "end", F.col("start").alias("place"), F.col("n_spans").alias("members"))
    full = cut(report.widened(spans, docs, ["doc_key"], acts, expand))
    best = report.best_similarity(full.select(*key, "start", "end").distinct(), sims, key)
    full = full.join(best, [*key, "start", "end"])
    # of spans that begin alike once they are widened, the one whose windows come first goes first
    return report.canonical_first(full, key, ["start", "place"]).select("doc_key", "cluster_id", "instance_id", "start", "end", "text", "similarity", "members")


def embedding_instances(docs: DataFrame, params: AnalysisParams, acts: DataFrame | None = None, embedder=V.hash_embedding, expand: bool = True) -> DataFrame:
    """The spans of one embedding pass, as ``window_instances`` gives them: pages, windows, vectors, clusters, spans.

    With ``acts`` a page is an act and spans stay within theirs.
    """
    pages = segment.paginate(docs, acts, params.chapter_break_regex, params.tokens_per_page)
    win = segment.sliding_windows(pages, params.window_size, params.stride).withColumnRenamed("doc_key", "job_id")
    # job ids may be any type here; the window's text is embedded once and written down
    win = cut(win.withColumn("embedding", embedder(F.col("text"))).withColumn("end", F.col("doc_char_start") + F.char_length("text")))
    labels = cut(clusters.cluster_jobs(win, params).select("job_id", "window_index", "cluster_id").where("cluster_id <> -1"))
    lab = win.join(labels, ["job_id", "window_index"])
    if params.link_subphrases:
        lab = lab.drop("cluster_id").join(clusters.subphrase_links(lab), ["job_id", "window_index"])
    return window_instances(lab.select(F.col("job_id").alias("doc_key"), "cluster_id", "embedding", F.col("doc_char_start").alias("start"), "end"), docs, acts, expand)


def stored_report(windows: DataFrame, pages: DataFrame, expand: bool = True) -> DataFrame:
    """The spans of jobs as they are stored: their pages give the text, their windows the clusters.

    ``windows(job_id, cluster_id, embedding, doc_char_start, text)``, ``pages(job_id, page, text)``.
    """
    docs = segment.reassemble(pages.withColumnRenamed("job_id", "doc_key"))
    win = windows.select(F.col("job_id").alias("doc_key"), "cluster_id", "embedding", F.col("doc_char_start").alias("start"), (F.col("doc_char_start") + F.char_length("text")).alias("end"))
    return window_instances(win.where("text is not null"), docs, None, expand).withColumnRenamed("doc_key", "job_id")


def multi_pass(docs: DataFrame, bundle: MultiPassConfig, acts: DataFrame | None = None, embedder=V.hash_embedding) -> DataFrame:
    """``doc_key, pass_no, pass_name, cluster_id, instance_id, start, end, text, similarity, members`` of every pass of a bundle.

    Act passes paginate by act and keep absolute offsets; they need ``acts``, else they run over the whole text.
    """
    def rows_of(p: PassSpec) -> DataFrame:
        if p.method == "lexical":
            return lexical.repetition_instances(docs, bundle.lexical).withColumnRenamed("score", "similarity").withColumn("members", F.lit(1))
        params = AnalysisParams(p.window_size, p.stride, bundle.tokens_per_page, None, bundle.min_repetitions, bundle.min_samples, bundle.enable_hdbscan, bundle.link_subphrases)
        return embedding_instances(docs, params, acts if p.scope == "act" else None, embedder, bundle.expand_to_sentences)

    out = None
    for no, p in enumerate(bundle.passes):
        # what a pass writes on its way, vectors above all, is removed before the next one begins
        one = settled(docs.sparkSession, lambda: rows_of(p).select("doc_key", F.lit(no).alias("pass_no"), F.lit(p.name).alias("pass_name"), "cluster_id", "instance_id", "start", "end", "text", F.col("similarity").cast("double").alias("similarity"), F.col("members").cast("bigint").alias("members")))  # noqa: B023
        out = one if out is None else out.unionByName(one)
    return out


def cluster_summaries(spans: DataFrame, acts: DataFrame, paragraphs: DataFrame, key: list[str], representative: str | None = None) -> DataFrame:
    """``*key, cluster_id, place, summary``: every cluster with its located spans, verdict and canonical instance.

    ``spans(*key, cluster_id, start, end, text, similarity, members)``; ``key`` begins with ``doc_key``. The span that comes
    first in the document is the canonical one, the others are its duplicates.
    """
    own = [*key, "cluster_id"]
    at = cut(report.span_locations(spans, acts, paragraphs, ["doc_key"]).withColumn("act", F.col("location.act")))
    order = Window.partitionBy(*own).orderBy("start", "end")
    span = F.struct("location", "cluster_id", F.row_number().over(order).alias("instance_id"), "text", F.col("similarity").alias("similarity_to_centroid"), F.col("members").cast("bigint").alias("member_window_count"))
    said = F.first(representative) if representative else F.lit(None).cast("string")
    listed = at.withColumn("span", span).groupBy(*own).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("span.instance_id", "span"))), lambda s: s["span"]).alias("spans"), F.sum(T.word_count(F.col("text"))).cast("bigint").alias("words"), F.min("start").alias("place"), said.alias("said"))
    v = report.verdicts(at, own, ["start", "end"])
    first = F.element_at("spans", 1)
    summary = F.struct(
        "cluster_id", F.coalesce("said", first["text"]).alias("representative_text"), F.size("spans").alias("instance_count"), F.col("words").alias("total_word_estimate"), first.alias("canonical"),
        F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(1))).alias("duplicates"), "spans", "suggested_op", "cross_act", "needs_bridge")
    return listed.join(v.select(*own, "suggested_op", "cross_act", "needs_bridge"), own).select(*own, "place", summary.alias("summary"))


def _report(listed: DataFrame, key: list[str]) -> DataFrame:
    """``*key, report``: clusters in the order of their canonical spans, and statistics."""
    words = lambda c: F.aggregate(c["duplicates"], F.lit(0).cast("bigint"), lambda n, s: n + T.word_count(s["text"]))
    clusters_ = F.transform(F.array_sort(F.collect_list(F.struct("place", "cluster_id", "summary"))), lambda x: x["summary"])
    each = listed.groupBy(*key).agg(clusters_.alias("clusters"))
    total = lambda f: F.aggregate("clusters", F.lit(0).cast("bigint"), lambda n, c: n + f(c))
    stats = F.struct(F.size("clusters").cast("bigint").alias("cluster_count"), total(lambda c: F.size(c["duplicates"]).cast("bigint")).alias("total_duplicate_instances"), total(words).alias("total_duplicate_words_estimate"))
    return each.select(*key, F.struct(F.lit(BOUNDARY_VERSION).alias("boundary_version"), stats.alias("stats"), "clusters").alias("report"))


def report_json(docs: DataFrame, passes: DataFrame, specs: tuple[PassSpec, ...] | None = None, acts: DataFrame | None = None, paragraphs: DataFrame | None = None, tokens_per_page: int | None = None, pretty: bool = False) -> DataFrame:
    """``doc_key, report``: scope, manifest, every pass run and the merged clusters as JSON; documents without any repeat too.

    ``passes`` as ``multi_pass`` gives them and ``specs`` the bundle's passes, by default one lexical one. ``acts`` and
    ``paragraphs`` are the manifest (``segment.assembled``), by default that of the text itself (``segment.text_manifest``).
    """
    specs = (LEXICAL,) if specs is None else specs
    if acts is None or paragraphs is None:
        acts, paragraphs = (cut(x) for x in segment.text_manifest(docs))
    passes = cut(passes)
    by_pass = _report(cluster_summaries(passes, acts, paragraphs, ["doc_key", "pass_no"]), ["doc_key", "pass_no"])
    folded = cut(report.merge_passes(passes.withColumn("doc", F.to_json(F.struct("doc_key"))), "doc"))
    keys = docs.where("text is not null").select("doc_key", F.to_json(F.struct("doc_key")).alias("doc"), F.char_length("text").alias("n"), F.sha2("text", 256).alias("hash"))
    merged_spans = folded.join(keys.select("doc", "doc_key"), "doc").select("doc_key", "cluster_id", "representative", F.inline("spans"))
    whole = _report(cluster_summaries(merged_spans, acts, paragraphs, ["doc_key"], "representative"), ["doc_key"])
    offsets = lambda a, b: (a.alias("scope_char_start"), b.alias("scope_char_end"), a.alias("doc_char_start"), b.alias("doc_char_end"))
    par = F.struct("paragraph_index", "segment_id", *offsets(F.col("doc_char_start"), F.col("doc_char_end")))
    pars = paragraphs.groupBy("doc_key", "act").agg(F.array_sort(F.collect_list(par)).alias("paragraphs"))
    act = F.struct("act", *offsets(F.col("start"), F.col("end")), F.coalesce("paragraphs", F.array().cast(pars.schema["paragraphs"].dataType)).alias("paragraphs"))
    manifest = acts.join(pars, ["doc_key", "act"], "left").groupBy("doc_key").agg(F.min("chapter").alias("chapter"), F.transform(F.array_sort(F.collect_list(F.struct("start", act.alias("a")))), lambda x: x["a"]).alias("acts"))
    base = keys.join(manifest, "doc_key", "left").withColumn("chapter", F.coalesce("chapter", F.lit(1)))
    scope = F.struct("chapter", F.col("hash").alias("document_hash"), *offsets(F.lit(0), F.col("n")))
    empty = lambda t: F.from_json(F.lit(json.dumps({"boundary_version": BOUNDARY_VERSION, "stats": dict.fromkeys(("cluster_count", "total_duplicate_instances", "total_duplicate_words_estimate"), 0), "clusters": []})), t)
    run = F.array(*[F.struct(F.lit(no).alias("pass_no"), F.lit(f"{no}").alias("pass_id"), F.lit(p.name).alias("pass_label"), F.lit(None if p.method == "embedding" else p.method).cast("string").alias("method"), F.lit(p.window_size).alias("window_size"), F.lit(p.stride).alias("stride"), F.lit(tokens_per_page).cast("int").alias("tokens_per_page")) for no, p in enumerate(specs)])
    each = base.select("doc_key", scope.alias("scope"), F.explode(run).alias("p")).withColumn("pass_no", F.col("p.pass_no")).join(by_pass, ["doc_key", "pass_no"], "left")
    filled = F.coalesce("report", empty(by_pass.schema["report"].dataType.simpleString()))
    record = F.struct("p.pass_id", "p.pass_label", "scope", *[F.col(f"p.{c}") for c in ("method", "window_size", "stride", "tokens_per_page")], filled.alias("repetition_report"))
    listed = each.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass_no", record.alias("r")))), lambda x: x["r"]).alias("passes"))
    done = base.join(listed, "doc_key").join(whole, "doc_key", "left")
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), scope.alias("scope"), F.struct("chapter", F.coalesce("acts", F.array().cast(manifest.schema["acts"].dataType)).alias("acts")).alias("scope_manifest"), "passes",
        F.coalesce("report", empty(whole.schema["report"].dataType.simpleString())).alias("merged_repetition_report"))
    return done.select("doc_key", F.to_json(body, {"pretty": str(pretty).lower()}).alias("report"))


def validate_report(raw: str) -> dict:
    """The parsed report, or ``ContractError``: versions, at least one pass, one chapter throughout."""
    try:
        r = json.loads(raw)
    except json.JSONDecodeError as e:
        raise ContractError(f"not JSON: {e}") from e
    if not isinstance(r, dict) or r.get("schema_version") != SCHEMA_VERSION:
        raise ContractError("unknown schema_version")
    if not r.get("passes"):
        raise ContractError("a report needs at least one pass")
    chapter = (r.get("scope") or {}).get("chapter")
    if chapter is None or chapter != (r.get("scope_manifest") or {}).get("chapter"):
        raise ContractError("scope and manifest name different chapters")
    for part in [r.get("merged_repetition_report") or {}, *[p.get("repetition_report") or {} for p in r["passes"]]]:
        if part.get("boundary_version") != BOUNDARY_VERSION:
            raise ContractError("unknown boundary_version")
        for c in part.get("clusters", ()):
            for s in c.get("spans", ()):
                loc = s.get("location") or {}
                if loc.get("chapter") != chapter or not str(loc.get("segment_id")).startswith(f"ch{chapter:02d}_"):
                    raise ContractError("a span of another chapter")
    return r


def lexical_json(docs: DataFrame, cfg: LexicalConfig = LexicalConfig()) -> DataFrame:
    return report_json(docs, multi_pass(docs, MultiPassConfig((LEXICAL,), lexical=cfg)))
