"""The job store: parquet tables partitioned by job. Status is an append-only log, rows are never changed in place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.runtime import drop_path

TABLES = {
    "windows": "job_id string, window_id string, window_index int, page int, char_start int, char_end int, doc_char_start int, text string, embedding array<float>, cluster_id int, hdbscan_label int, sim_to_centroid float, sub_cell_row smallint, sub_cell_col smallint",
    "pages": "job_id string, page int, doc_char_start int, doc_char_end int, char_count int, token_count int, pagination_mode string",
    "job_events": "job_id string, document_path string, document_hash string, settings_hash string, status string, windows_total int, windows_committed int, created_at timestamp, updated_at timestamp",
    "outputs": "job_id string, report string",
    "settings": "job_id string, settings string",
}
#: Where settings of no job in particular are kept.
GENERAL = "_general"


class JobStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """The table, empty where nothing has been written; a filter on ``job_id`` reads that job's files only."""
        try:
            return self.spark.read.schema(TABLES[name]).parquet(self.path(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], TABLES[name]).schema]
        rows.select(*cols).write.mode("append").partitionBy("job_id").parquet(self.path(name))

    def replace_job(self, name: str, rows: DataFrame) -> None:
        """Overwrites the partitions of the jobs in ``rows`` and leaves all others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(self.path(name))

    def latest(self) -> DataFrame:
        e = self.read("job_events")
        names = [c for c in e.columns if c != "job_id"]
        return e.groupBy("job_id").agg(F.max_by(F.struct(*names), F.struct("updated_at", "windows_committed", "status")).alias("r")).select("job_id", "r.*")

    def uncommitted(self, windows: DataFrame) -> DataFrame:
        """Windows that the store doesn't hold yet: what a resumed job still has to do."""
        return windows.join(self.read("windows").select("job_id", "window_index"), ["job_id", "window_index"], "left_anti")

    def resumable(self, job_id: str, document_hash: str) -> bool:
        """Only a partial job of the same document is taken up again."""
        r = self.latest().where(F.col("job_id") == job_id).select("status", "document_hash").first()
        return r is not None and r["status"] == "partial" and r["document_hash"] == document_hash

    def delete_job(self, job_id: str) -> None:
        for name in TABLES:
            drop_path(self.spark, f"{self.path(name)}/job_id={job_id}")

    def ensure_tables(self) -> None:
        """Writes every table that isn't there yet, empty."""
        for name, schema in TABLES.items():
            if self.read(name).isEmpty():
                self.spark.createDataFrame([], schema).write.mode("append").partitionBy("job_id").parquet(self.path(name))

    def save_settings(self, settings: dict, job_id: str = GENERAL) -> None:
        """Display settings of a job, or general ones, in place of those kept before."""
        self.replace_job("settings", self.spark.createDataFrame([(json.dumps(settings), job_id)], "settings string, job_id string"))

    def load_settings(self, defaults: dict, job_id: str = GENERAL) -> dict:
        """The settings kept, completed by ``defaults``; these alone where none are kept or they can't be read."""
        row = self.read("settings").where(F.col("job_id") == job_id).select("settings").first()
        try:
            kept = json.loads(row["settings"]) if row else {}
        except (TypeError, json.JSONDecodeError):
            kept = {}
        return defaults | (kept if isinstance(kept, dict) else {})

    def save_output(self, reports: DataFrame) -> None:
        self.replace_job("outputs", reports.select("report", "job_id"))


def synced_catalog(catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """``job_id, name, alias``: entries of jobs that still exist, and new complete jobs under a default name, in
    order of window size and age."""
    done = jobs.where("status = 'complete'").select("job_id", "window_size", "created_at")
    kept = catalog.join(done, "job_id", "left_semi")
    new = done.join(catalog, "job_id", "left_anti").select("job_id", F.concat(F.lit("window "), F.col("window_size")).alias("name"), F.lit(None).cast("string").alias("alias"))
    return kept.select("job_id", "name", "alias").union(new).join(done, "job_id").orderBy("window_size", "created_at").select("job_id", "name", "alias")


def renamed(catalog: DataFrame, job_id: str, name: str) -> DataFrame:
    """The catalog with another name for one entry; an empty name, one that is taken and an unknown entry raise ``ValueError``."""
    name = name.strip()
    if not name:
        raise ValueError("a result's name can't be empty")
    rows = catalog.where((F.col("job_id") == job_id) | (F.col("name") == name)).select("job_id", "name").collect()
    if any(r["name"] == name and r["job_id"] != job_id for r in rows):
        raise ValueError(f"a result named {name!r} exists already")
    if not any(r["job_id"] == job_id for r in rows):
        raise ValueError(f"no result of job {job_id!r}")
    return catalog.withColumn("name", F.when(F.col("job_id") == job_id, name).otherwise(F.col("name")))


def aliased(catalog: DataFrame, job_id: str, alias: str | None) -> DataFrame:
    """The catalog with another alias for one entry; none or a blank one takes it away."""
    alias = (alias or "").strip() or None
    return catalog.withColumn("alias", F.when(F.col("job_id") == job_id, F.lit(alias).cast("string")).otherwise(F.col("alias")))


def without(catalog: DataFrame, job_id: str) -> DataFrame:
    return catalog.where(F.col("job_id") != job_id)


def activated(catalog: DataFrame, job_id: str | None) -> DataFrame:
    """The catalog with ``active`` true for one entry at most; an unknown job makes none active."""
    return catalog.withColumn("active", F.coalesce(F.col("job_id") == F.lit(job_id), F.lit(False)))


def with_page_counts(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``page_count``, 0 for jobs without pages."""
    n = pages.select("job_id", "page").distinct().groupBy("job_id").agg(F.count("*").alias("page_count"))
    return catalog.join(n, "job_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
