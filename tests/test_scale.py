"""Work that grows with a job's size: what is shuffled, kept and compared."""

import numpy as np
import pyarrow as pa
import pytest

from echoloom.config import LEXICAL, LexicalConfig, MultiPassConfig, PassSpec
from echoloom.operators import clusters, contract, lexical, report
from echoloom.runtime import WRITTEN, cut


def brute(x, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j): s[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= floor}


def test_centroid_pairs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SQUARE", 16)
    x = np.random.default_rng(3).normal(size=(90, 4))
    cents = spark.createDataFrame([("j", i, v.tolist()) for i, v in enumerate(x)] + [("k", 5, [1.0, 0.0]), ("l", 1, [1.0, 1.0]), ("l", 2, [1.0, 0.5])], "job_id string, cluster_id int, centroid array<double>")
    got = {(r["job_id"], r["a"], r["b"]): r["sim"] for r in clusters.centroid_pairs(cents, "job_id", 0.7).collect()}
    want = {("j", *k): s for k, s in brute(x, 0.7).items()} | {("l", 1, 2): 1.5 / np.sqrt(2.5)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_vectors_are_not_exploded(spark):
    w = spark.createDataFrame([("j", i, 0, [float(i), 1.0]) for i in range(4)], "job_id string, window_index int, cluster_id int, embedding array<float>")
    assert "Generate" not in clusters.centroids(w, ["job_id", "cluster_id"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [1, 100, 1 << 20])
def test_a_cluster_waits_in_a_file(monkeypatch, held):
    monkeypatch.setattr(clusters, "HELD", held)
    x = np.random.default_rng(1).normal(size=(12, 3))
    c = clusters._Cluster("k")
    for a in range(0, 12, 4):
        b = pa.RecordBatch.from_pydict({"__v": x[a : a + 4].tolist()})
        c.add(b, *clusters._grid(b.column("__v")))
    assert np.allclose(c.mean(), x.mean(0)) and c.rows == 12 and (c.file is None) == (held > 1000)
    assert np.allclose(np.concatenate([clusters._grid(b.column("__v"))[0] for b in c.parts()]), x)


def test_clusters_over_several_batches(spark):
    """Clusters that cross batches, of unequal or missing vectors, and noise."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(5)
        of = rng.integers(-1, 6, 120)
        x = rng.normal(size=(120, 3))
        rows = [("j", i, int(c), None if i % 11 == 0 else v.tolist()) for i, (c, v) in enumerate(zip(of, x))] + [("j", 200, 7, [1.0, None, 3.0]), ("j", 201, 7, [3.0, None]), ("j", 202, 8, None), (None, 203, 1, [1.0, 2.0, 3.0])]
        w = spark.createDataFrame(rows, "job_id string, window_index int, cluster_id int, embedding array<double>")
        cents = {r["cluster_id"]: r for r in clusters.centroids(w, ["job_id", "cluster_id"]).where("job_id is not null").collect()}
        sims = {r["window_index"]: r["sim"] for r in clusters.similarities(w, ["job_id", "cluster_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    has = np.arange(120) % 11 != 0
    assert set(cents) == {0, 1, 2, 3, 4, 5, 7} and cents[7]["centroid"] == [2.0, None, 3.0] and cents[7]["member_count"] == 2
    for c in range(6):
        mean = x[has & (of == c)].mean(0)
        assert cents[c]["centroid"] == pytest.approx(mean.tolist()) and cents[c]["member_count"] == (has & (of == c)).sum()
        for i in np.flatnonzero(of == c):
            assert sims[i] == pytest.approx(x[i] @ mean / np.linalg.norm(x[i]) / np.linalg.norm(mean) if has[i] else 0.0)
    assert all(sims[i] == 0 for i in [*np.flatnonzero(of == -1), 202, 203])


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle") for i in range(files.size()))


def test_written_frames_leave_no_shuffle(spark):
    before = shuffle_files(spark)
    assert cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()).count() == 7
    assert shuffle_files(spark) <= before + 4  # of the count alone


def naive(text, start, end):
    n = len(text)
    para, stop = text.rfind("\n\n", 0, start), max(text.rfind(c, 0, start) for c in ".!?")
    skip = lambda i: i + len(text[i:]) - len(text[i:].lstrip())
    begin = 0 if not start else skip(para + 2) if 0 <= para and para + 2 < start else min(skip(stop + 1), start) if stop >= 0 else 0
    if end >= n:
        return begin, n
    anchor = end - 1 if end > start else end
    if anchor > 0 and text[anchor] in ".!?":
        return begin, anchor + 1
    if (gap := text.find("\n\n", end)) >= 0:
        return begin, gap
    m = report.TERMINATOR.search(text, anchor)
    return begin, m.end() if m else n


def test_borders_agree_with_a_search():
    rng = np.random.default_rng(2)
    for letters, size in (("ab .!\n", 60), ("ab . ", 40), ("a\n", 30), ("ab", 9)):
        for _ in range(150):
            text = "".join(rng.choice(list(letters), size))
            borders = report.Borders(text)
            for _ in range(6):
                a, b = sorted(rng.integers(0, size + 1, 2).tolist())
                assert borders.expand(a, b) == naive(text, a, b)


def test_a_long_text_is_not_copied_for_its_spans(spark):
    text = "One sentence of some words. " * 40_000
    d = spark.createDataFrame([("d", text)], "doc_key string, text string")
    s = spark.range(3000).selectExpr("'d' as doc_key", "cast(id * 28 + 3 as int) as start", "cast(id * 28 + 9 as int) as end", "id as place")
    w = report.widened(s, d, ["doc_key"])
    assert w.columns == ["doc_key", "start", "end", "place", "text"]
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    assert {(r["start"], r["end"], r["text"]) for r in w.collect()} == {(i * 28, i * 28 + 27, "One sentence of some words.") for i in range(3000)}


def test_density_clusters_in_bounded_memory():
    """Distances of 6,000 vectors took 300 MB and more, those to 2,000 centres as well."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(20, 4)) * 0.01 for c in rng.normal(size=(300, 4)) * 9])
    tracemalloc.start()
    label = clusters.hdbscan_labels(x, 4, 3)
    found = clusters.stabilised(x, label)
    spread = clusters.stabilised(x, np.arange(len(x)) // 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    assert len(set(label)) >= 290 and (found >= -1).all() and len(set(spread.tolist())) > 1500


def test_pairs_within_a_text_agree_with_the_joins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(25)]
    lines = [" ".join(rng.choice(words, 14)) for _ in range(12)]
    texts = [("\n\n".join(" ".join(w if rng.random() > 0.04 else "new" for w in lines[i].split()) + "." for i in rng.integers(0, 12, 25)),) for _ in range(3)]
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_key int, text string")
    units = lexical.candidates(docs).cache()
    for cfg in (LexicalConfig(), LexicalConfig(max_candidate_fanout=3, max_df_fraction=0.05)):
        found = []
        for most in (0, 1 << 20):
            monkeypatch.setattr(lexical, "WITHIN", most)
            found.append({(r["doc_key"], r["a"], r["b"]): round(r["score"], 9) for r in lexical.scored_pairs(units, cfg).collect()})
        assert found[0] == found[1] and len(found[0]) > 20
    units.unpersist()


def test_a_pass_leaves_only_its_spans(spark):
    line = "The quick brown fox jumps over the lazy dog while the band plays on and on tonight."
    docs = spark.createDataFrame([("d", f"{line}\n\nSomething else is here.\n\n{line}")], "doc_key string, text string")
    bundle = MultiPassConfig((LEXICAL, PassSpec("fine", "chapter", "embedding", 10, 10)), enable_hdbscan=False)
    before = set(WRITTEN)
    rows = contract.multi_pass(docs, bundle)
    assert len(WRITTEN - before) == 2
    assert {r["pass_no"] for r in rows.collect()} == {0, 1}
