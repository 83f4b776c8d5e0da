"""File sources: text files, story folders with act drafts, JSON requests, pass bundles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.config import MultiPassConfig
from echoloom.functions.text import trimmed
from echoloom.operators.segment import assembled

ACT_NAME = r"chapter_(\d+)_act_(\d+)\.json$"
REQUEST = """text string, scope_manifest struct<chapter:int, acts:array<struct<act:int, scope_char_start:int, scope_char_end:int, doc_char_start:int, doc_char_end:int,
paragraphs:array<struct<paragraph_index:int, segment_id:string, scope_char_start:int, scope_char_end:int, doc_char_start:int, doc_char_end:int>>>>>,
params struct<window_size:int, stride:int, tokens_per_page:int, chapter_break_regex:string, min_repetitions:int, min_samples:int, enable_hdbscan:boolean, link_subphrases:boolean>"""


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_key`` (the path) and ``text`` of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_key"), F.col("value").alias("text"))


def act_drafts(spark: SparkSession, story: str) -> DataFrame:
    """``chapter, act, text`` of a story's act drafts; intro and revision files don't match the name, numbers count from 1. An
    empty or blank act raises."""
    raw = spark.read.schema("text string").option("multiLine", True).json(f"{story}/drafts/chapter_*_act_*.json")
    name = F.col("_metadata.file_name")
    rows = raw.select(F.regexp_extract(name, ACT_NAME, 1).alias("c"), F.regexp_extract(name, ACT_NAME, 2).alias("a"), "text").where("c <> ''")
    ok = F.when(F.coalesce(trimmed(F.col("text")), F.lit("")) == "", F.raise_error(F.lit("an act is empty")).cast("string")).otherwise(F.col("text"))
    return rows.select(F.col("c").cast("int").alias("chapter"), F.col("a").cast("int").alias("act"), ok.alias("text")).where("chapter > 0 and act > 0")


def chapter_source(spark: SparkSession, story: str, chapter: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One chapter of a story folder as text with its manifest (``segment.assembled``); a chapter without acts raises."""
    acts = act_drafts(spark, story).where(F.col("chapter") == chapter)
    if acts.isEmpty():
        raise FileNotFoundError(f"chapter {chapter} has no act draft")
    return assembled(acts, ["chapter"], blank="error")


#: Fixed value: pages of a PDF that are read.
PDF_PAGES = 300


def pdf_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``doc_key, page, text`` of the first ``PDF_PAGES`` pages of each PDF file.

    ``extract`` gives the texts of a file's pages; without it the library ``pypdf`` is used, which has to be installed on the
    executors. A file that can't be read raises.
    """

    def pages(content: bytes) -> list[str]:
        import io

        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages[:PDF_PAGES]]

    read = extract or pages

    @F.pandas_udf("array<string>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: list(read(bytes(c))))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return raw.select(F.col("path").alias("doc_key"), F.posexplode(run("content")).alias("page", "text")).where(F.col("page") < PDF_PAGES).withColumn("page", F.col("page") + 1)


def chapter_list(spark: SparkSession, story: str) -> DataFrame:
    """Chapters that have act drafts, in order; where there are none, those of the story's outline."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "chapter_*_act_*.json").load(f"{story}/drafts").select(F.regexp_extract("path", ACT_NAME, 1).alias("c")).where("c <> ''")
    found = names.select(F.col("c").cast("int").alias("chapter")).distinct()
    if found.isEmpty():
        outline = spark.read.schema("chapters array<struct<chapter_number:int>>").option("multiLine", True).json(f"{story}/story_outline.json")
        found = outline.select(F.explode("chapters.chapter_number").alias("chapter")).where("chapter is not null").distinct()
    return found.where("chapter > 0").orderBy("chapter")


def chapter_fallback(spark: SparkSession, story: str, chapter: int) -> DataFrame:
    """``text`` of the first of a chapter's other sources: ``drafts/*.json``, ``chapters/*.md``, ``drafts/*.md`` without a ``---`` header."""
    n = f"chapter_{chapter:02d}"
    places = [(f"{story}/drafts", f"{n}.json"), (f"{story}/chapters", f"{n}.md"), (f"{story}/drafts", f"{n}.md")]
    for folder, name in places:
        try:
            raw = spark.read.option("pathGlobFilter", name).text(folder, wholetext=True)
            if not raw.isEmpty():
                body = F.get_json_object("value", "$.text") if name.endswith(".json") else F.regexp_replace("value", r"^(?s)---\n.*?\n---\n", "")
                return raw.select(body.alias("text"))
        except Exception as e:  # a folder that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"chapter {chapter} has no source")


def requests(frame: DataFrame, column: str = "value") -> DataFrame:
    """Analysis requests from JSON strings, with their defaults (3 repetitions, 3 samples, density clusters, no links)."""
    r = frame.select(F.from_json(column, REQUEST).alias("r")).select("r.*")
    p = F.col("params")
    filled = F.struct(
        p["window_size"].alias("window_size"), p["stride"].alias("stride"), p["tokens_per_page"].alias("tokens_per_page"), p["chapter_break_regex"].alias("chapter_break_regex"),
        F.coalesce(p["min_repetitions"], F.lit(3)).alias("min_repetitions"), F.coalesce(p["min_samples"], F.lit(3)).alias("min_samples"), F.coalesce(p["enable_hdbscan"], F.lit(True)).alias("enable_hdbscan"), F.coalesce(p["link_subphrases"], F.lit(False)).alias("link_subphrases"))
    return r.withColumn("params", filled)


def pass_bundle(spark: SparkSession, path: str) -> MultiPassConfig:
    return MultiPassConfig.from_yaml(spark.read.text(path, wholetext=True).first()["value"])
