"""Readers of the stored tables: repeated rows and superseded versions are resolved, columns are pruned by use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.runtime import cut, table

#: Windows that stand more than once, up to which number their hashes are broadcast.
AGAIN = 1_000_000


def moment(text: Column) -> Column:
    """Timestamp of an RFC 3339 string in either spelling of UTC."""
    return F.to_timestamp(F.regexp_replace(text, r"(Z|\+00:00)$", "+00:00"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drafts").select("draft_id", "story_id", "chapter", "act", "text").where("text is not null").distinct()


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("job_id", "page", "doc_char_start", "doc_char_end", "char_count", "token_count", "text").distinct()


def windows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last committed row of each window, with ``columns`` only."""
    names = list(columns or ("job_id", "window_index", "page", "char_start", "char_end", "doc_char_start", "text", "cluster_id", "sim_to_centroid"))
    w = table(spark, d, "windows").select("window_id", "committed_at", *names)

    def newest(rows: DataFrame) -> DataFrame:
        # by a grouped maximum: partial aggregation, no sort of whole groups
        last = rows.groupBy("window_id").agg(F.max_by(F.struct(*names), F.struct("committed_at", *[n for n in names if n != "embedding"])).alias("r"))
        return last.select("window_id", "r.*")

    if "embedding" not in names:
        return newest(w)
    # most windows stand once, and their vectors needn't be shuffled to find that out; windows whose hashes are equal are told apart later
    again = cut(w.groupBy("window_id").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("window_id").alias("h")).distinct())
    if again.count() > AGAIN:
        return newest(w)
    keyed, few = w.withColumn("h", F.xxhash64("window_id")), F.broadcast(again)
    return keyed.join(few, "h", "left_anti").select("window_id", *names).unionByName(newest(keyed.join(few, "h", "left_semi")))


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spans").select("span_id", "job_id", "draft_id", "location", "cluster_id", "instance_id", "text", "similarity_to_centroid").distinct()
    return s.select("*", F.col("location.act").alias("act"), F.col("location.doc_char_start").alias("start"), F.col("location.doc_char_end").alias("end")).drop("location")


def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Last saved status of each job: an event log stands in for rows that are updated in place."""
    j = table(spark, d, "jobs")
    names = [c for c in j.columns if c != "job_id"]
    return j.groupBy("job_id").agg(F.max_by(F.struct(*names), F.struct(moment(F.col("updated_at")), "windows_committed", "status")).alias("r")).select("job_id", "r.*")


def job_for_document(jobs: DataFrame) -> DataFrame:
    """Per document: its newest complete job, else its last updated partial one."""
    done = jobs.where("status = 'complete'").groupBy("document_path").agg(F.max_by("job_id", F.struct(moment(F.col("created_at")), "job_id")).alias("complete_job"))
    part = jobs.where("status = 'partial'").groupBy("document_path").agg(F.max_by("job_id", F.struct(moment(F.col("updated_at")), "job_id")).alias("partial_job"))
    return done.join(part, "document_path", "full").select("document_path", "complete_job", "partial_job")


def session_state(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """``document_path, complete_job, page_count, partial_job, done`` of every document with a job.

    ``jobs`` carry ``current_hash``, that of the document as it is now: a complete job counts only for the text it was run
    over. Documents without either kind of job have nulls.
    """
    found = job_for_document(jobs.where("status <> 'complete' or document_hash = current_hash"))
    n = pages.select("job_id", "page").distinct().groupBy(F.col("job_id").alias("complete_job")).agg(F.count("*").alias("page_count"))
    share = F.when(F.col("windows_total") > 0, F.col("windows_committed") / F.col("windows_total")).otherwise(0.0)
    part = jobs.where("status = 'partial'").select(F.col("job_id").alias("partial_job"), F.round(share, 6).alias("done"))
    every = jobs.select("document_path").where("document_path is not null").distinct()
    return every.join(found, "document_path", "left").join(n, "complete_job", "left").join(part, "partial_job", "left").select("document_path", "complete_job", F.coalesce("page_count", F.lit(0)).alias("page_count"), "partial_job", "done")


def rolling_eta(windows: DataFrame, batch: int, last: int = 50) -> DataFrame:
    """``job_id, batch, mean_seconds, eta_seconds``: the mean duration of the last ``last`` batches and what the remaining ones
    would take; 0 before a duration is known. ``windows(job_id, window_index, committed_at)``; a batch lasts from the commit of the one
    before it to its own."""
    per = windows.groupBy("job_id", F.floor(F.col("window_index") / batch).alias("batch")).agg(F.max("committed_at").alias("at"))
    w = Window.partitionBy("job_id").orderBy("batch")
    took = F.greatest(F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)), F.lit(0)) / 1e6
    mean = F.coalesce(F.avg("took").over(w.rowsBetween(1 - last, 0)), F.lit(0.0))
    left = F.max("batch").over(Window.partitionBy("job_id")) - F.col("batch")
    timed = per.withColumn("took", F.when(F.lag("at").over(w).isNotNull(), took)).withColumn("mean_seconds", mean)
    return timed.select("job_id", "batch", "mean_seconds", (F.col("mean_seconds") * left).alias("eta_seconds"))
