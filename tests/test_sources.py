import json

import pytest

from echoloom.sources import files, store
from echoloom.streaming.ingest import embed_stream


def test_story_folder(spark, tmp_path):
    d = tmp_path / "drafts"
    d.mkdir()
    (tmp_path / "story_outline.json").write_text(json.dumps({"chapters": [{"chapter_number": 4}, {"chapter_number": 2}]}))
    assert [r[0] for r in files.chapter_list(spark, str(tmp_path)).collect()] == [2, 4]
    for name, text in (("chapter_01_act_02", "two"), ("chapter_01_act_01", "one"), ("chapter_03_act_01", "x"), ("chapter_01_act_01_rev", "no"), ("chapter_01_intro", "no")):
        (d / f"{name}.json").write_text(json.dumps({"text": text}))
    assert sorted(map(tuple, files.act_drafts(spark, str(tmp_path)).collect())) == [(1, 1, "one"), (1, 2, "two"), (3, 1, "x")]
    assert [r[0] for r in files.chapter_list(spark, str(tmp_path)).collect()] == [1, 3]
    (tmp_path / "chapters").mkdir()
    (tmp_path / "chapters" / "chapter_07.md").write_text("---\ntitle: t\n---\nbody")
    assert files.chapter_fallback(spark, str(tmp_path), 7).first()[0] == "body"
    with pytest.raises(FileNotFoundError):
        files.chapter_fallback(spark, str(tmp_path), 8)


def test_requests(spark):
    r = files.requests(spark.createDataFrame([(json.dumps({"text": "t", "params": {"window_size": 5, "stride": 2}}),)], "value string")).first()
    assert (r["params"]["min_repetitions"], r["params"]["min_samples"], r["params"]["enable_hdbscan"]) == (3, 3, True)


def test_store_and_resume(spark, tmp_path):
    s = store.JobStore(spark, f"file://{tmp_path}/store")
    assert s.read("windows").count() == 0
    rows = [("j", i, 1, 0, 3, 0, f"text {i}") for i in range(6)]
    cols = "job_id string, window_index int, page int, char_start int, char_end int, doc_char_start int, text string"
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows[:3], cols).coalesce(1).write.parquet(src)
    embed_stream(spark, src, s, f"file://{tmp_path}/cp").awaitTermination()
    assert s.read("windows").count() == 3
    spark.createDataFrame(rows[2:], cols).coalesce(1).write.mode("append").parquet(src)
    embed_stream(spark, src, s, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["window_index"] for r in s.read("windows").collect()) == list(range(6))
    ev = "job_id string, document_hash string, status string, windows_committed int, updated_at timestamp, window_size int"
    import datetime as dt

    s.append("job_events", spark.createDataFrame([("j", "h", "running", 0, dt.datetime(2024, 1, 1), 5), ("j", "h", "partial", 3, dt.datetime(2024, 1, 2), 5)], ev))
    assert s.resumable("j", "h") and not s.resumable("j", "other") and not s.resumable("k", "h")
    s.delete_job("j")
    assert s.read("windows").count() == 0 and s.latest().count() == 0


def test_catalog(spark):
    import datetime as dt

    jobs = spark.createDataFrame([("a", "complete", 50, dt.datetime(2024, 1, 1)), ("b", "complete", 20, dt.datetime(2024, 1, 1)), ("c", "running", 5, dt.datetime(2024, 1, 1))], "job_id string, status string, window_size int, created_at timestamp")
    cat = spark.createDataFrame([("a", "mine", "x"), ("gone", "old", None)], "job_id string, name string, alias string")
    assert [tuple(r) for r in store.synced_catalog(cat, jobs).collect()] == [("b", "window 20", None), ("a", "mine", "x")]


def test_catalog_edits(spark):
    cat = spark.createDataFrame([("a", "mine", "x"), ("b", "other", None)], "job_id string, name string, alias string")
    assert {tuple(r) for r in store.renamed(cat, "a", " new ").collect()} == {("a", "new", "x"), ("b", "other", None)}
    for job, name in (("a", " "), ("a", "other"), ("zz", "fresh")):
        with pytest.raises(ValueError):
            store.renamed(cat, job, name)
    assert {r["alias"] for r in store.aliased(cat, "a", " ").collect()} == {None}
    assert [r["job_id"] for r in store.without(cat, "a").collect()] == ["b"]
    assert {(r["job_id"], r["active"]) for r in store.activated(cat, "b").collect()} == {("a", False), ("b", True)}
    assert not any(r["active"] for r in store.activated(cat, None).collect())
    pages = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "job_id string, page int")
    assert {(r["job_id"], r["page_count"]) for r in store.with_page_counts(cat, pages).collect()} == {("a", 2), ("b", 0)}


def test_settings_and_tables(spark, tmp_path):
    s = store.JobStore(spark, f"file://{tmp_path}/store")
    s.ensure_tables()
    s.ensure_tables()
    assert all(s.read(name).count() == 0 for name in store.TABLES)
    defaults = {"threshold": 0.75, "hidden": []}
    assert s.load_settings(defaults, "j") == defaults
    s.save_settings({"threshold": 0.9}, "j")
    s.save_settings({"threshold": 0.8}, "j")
    assert s.load_settings(defaults, "j") == {"threshold": 0.8, "hidden": []} and s.load_settings(defaults) == defaults
    s.replace_job("settings", spark.createDataFrame([("not json", "k")], "settings string, job_id string"))
    assert s.load_settings(defaults, "k") == defaults


def test_chapter_source(spark, tmp_path):
    d = tmp_path / "drafts"
    d.mkdir()
    for name, text in (("chapter_01_act_02", " two\nlines "), ("chapter_01_act_01", "one"), ("chapter_00_act_01", "no"), ("chapter_02_act_01", "\n\n")):
        (d / f"{name}.json").write_text(json.dumps({"text": text}))
    docs, acts, paragraphs = files.chapter_source(spark, str(tmp_path), 1)
    assert docs.first()["text"] == "one\n\ntwo\nlines"
    assert sorted((r["act"], r["start"], r["end"]) for r in acts.collect()) == [(1, 0, 3), (2, 5, 14)]
    assert {r["segment_id"] for r in paragraphs.collect()} == {"ch01_a01_p01", "ch01_a02_p01", "ch01_a02_p02"}
    assert [r[0] for r in files.chapter_list(spark, str(tmp_path)).collect()] == [1, 2]
    with pytest.raises(FileNotFoundError):
        files.chapter_source(spark, str(tmp_path), 9)
    with pytest.raises(Exception, match="empty"):
        files.act_drafts(spark, str(tmp_path)).collect()


def test_pdf_hook(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.PDF").write_bytes(b"|".join(b"%d" % i for i in range(310)))
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = files.pdf_files(spark, str(tmp_path), lambda c: c.decode().split("|")).collect()
    assert len(rows) == 302 and {(r["page"], r["text"]) for r in rows if r["doc_key"].endswith("a.pdf")} == {(1, "one"), (2, "two")}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [(r["doc_key"].endswith("a.txt"), r["text"]) for r in files.text_files(spark, str(tmp_path)).collect()] == [(True, "one\ntwo")]
