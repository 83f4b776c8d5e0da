import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.config import LEXICAL, AnalysisParams, LexicalConfig, MultiPassConfig, PassSpec
from echoloom.functions import color as C
from echoloom.functions import text as T
from echoloom.functions import vectors as V
from echoloom.operators import clusters, contract, intervals, lexical, raster, report, segment
from echoloom.operators.graph import connected_components
from echoloom.sources import stored

A = "The old mill stood by the river and nobody had entered it for eleven long years."
B = "Nora counted the lanterns twice before she let the others into the narrow damp hall."
MIDDLE = "Between them stood other words that appear once."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_key int, text string")


def test_components_agree_with_a_walk(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a int, b int")).collect()))
    assert got == label
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_intervals(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 9, 12), (1, 1, 2), (2, 3, 4)], "k int, start int, end int")
    got = sorted(tuple(r)[2:] + (r["k"],) for r in intervals.merged(s, ["k"]).collect())
    assert got == [(0, 9, 3, 1), (3, 4, 1, 2), (9, 12, 1, 1)]
    p = spark.createDataFrame([(1, 0), (1, 7), (1, 50), (3, 1)], "k int, at int")
    m = spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "k int, mark int, v string")
    assert sorted((r["k"], r["at"], r["v"]) for r in intervals.as_of(p, m, ["k"], "at", "mark", "v").collect() if r["v"]) == [(1, 0, "a"), (1, 7, "b"), (1, 50, "b")]
    c = intervals.containing(p, s.withColumnRenamed("start", "s").withColumnRenamed("end", "e"), ["k"], "at", "s", "e").where("s is not null")
    assert sorted((r["at"], r["s"]) for r in c.collect()) == [(0, 0), (7, 4)]


def test_lexical_report(spark):
    body = f"{A} {B}\n\n{B}"
    rows = lexical.repetition_instances(docs(spark, f"{body}\n\n{MIDDLE}\n\n{body}", "", None, A)).orderBy("start").collect()
    assert {r["doc_key"] for r in rows} == {0}
    assert {r["cluster_id"] for r in rows} == {0} and len(rows) == 2  # the two paragraphs chain to one block
    assert all(r["word_count"] >= 15 for r in rows)
    # near copies: one word of a long paragraph changed
    long = f"{A} {B} {A.replace('mill', 'house')} {B.replace('Nora', 'Ida')}"
    near = lexical.repetition_instances(docs(spark, f"{long}\n\n{MIDDLE}\n\n{long.replace('narrow', 'wide', 1)}")).collect()
    assert len({r["instance_id"] for r in near}) >= 2
    assert lexical.repetition_instances(docs(spark, f"{A}\n\n{MIDDLE}")).count() == 0


def test_blocks_match_the_loop(spark):
    rng = random.Random(5)
    n = 14
    pairs = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25})
    want = set()
    for pa, pb in pairs:
        run = 1
        while pa + run < pb and (pa + run, pb + run) in pairs:
            run += 1
        if run >= 2:
            want.add((pa, pb, run))
    units = spark.createDataFrame([(0, i, i, 10 * i, 10 * i + 9, "paragraph", ["t"] * 8) for i in range(n)], "doc_key int, id int, para int, start int, end int, kind string, tokens array<string>")
    got = lexical.block_chains(units, spark.createDataFrame([(0, a, b, 1.0) for a, b in pairs], "doc_key int, a int, b int, score double"), LexicalConfig(block_min_words=1000)).collect()
    assert {(r["pa"], r["pb"], r["run"]) for r in got} == want


def test_scores(spark):
    df = spark.createDataFrame([(list("abcdef"), list("bxdfe")), ([], ["a"]), (["a", "a"], ["a"])], "x array<string>, y array<string>")
    got = [tuple(round(v, 4) for v in r) for r in df.select(lexical.order_score("x", "y"), lexical.frequency_score("x", "y")).collect()]
    assert got == [(0.5, 0.5714), (0.0, 0.0), (0.5, 0.5)]
    assert docs(spark, "Don't STOP ٣ näive").select(T.lexical_tokens(F.col("text"))).first()[0] == ["don't", "stop", "٣", "näive"]


def test_report_rules(spark):
    long = "word " * 41
    rows = [("a", 1, 0, 1, "x y", 0.99), ("a", 1, 9, 1, "x y", 0.99), ("b", 1, 0, 1, long, 0.9), ("b", 1, 9, 1, long, 0.9), ("c", 1, 0, 1, "x", 0.99), ("c", 1, 9, 2, "x", None), ("d", 1, 0, 1, None, 0.1)]
    v = report.verdicts(spark.createDataFrame(rows, "job_id string, cluster_id int, start int, act int, text string, similarity double"), ["job_id"], ["start"])
    got = {r["job_id"]: (r["cross_act"], r["needs_bridge"], r["suggested_op"]) for r in v.collect()}
    assert got == {"a": (False, False, "delete_span"), "b": (False, True, "replace_paragraph"), "c": (True, False, "rewrite_span"), "d": (False, False, "delete_span")}
    assert report.expand("One two. Three four. Five.", 10, 13) == (9, 20)
    assert report.expand("Para one here.\n\nMid sentence. Another one here.", 30, 33)[0] == 16
    assert report.expand("", 1, 2) == (0, 0)
    s = docs(spark, "A b. C d! E").select(*[report.sentence_index("text", F.lit(i)) for i in (0, 4, 5, 10, 99)]).first()
    assert tuple(s) == (1, 1, 2, 3, 3)


def test_merge_passes(spark):
    t = "doc int, pass_no int, cluster_id int, start int, end int, text string"
    rows = [(1, 0, 0, 0, 10, "short"), (1, 0, 0, 50, 60, "short"), (1, 1, 0, 2, 12, "a longer text"), (1, 1, 0, 80, 90, "a longer text"), (1, 1, 1, 200, 210, "other"), (2, 0, 0, 0, 5, "x"), (2, 0, 1, 0, 5, "y")]
    got = {(r["doc"], r["cluster_id"]): (r["n_spans"], r["n_passes"], r["representative"]) for r in report.merge_passes(spark.createDataFrame(rows, t), "doc").collect()}
    assert got == {(1, 0): (3, 2, "a longer text"), (1, 1): (1, 1, "other"), (2, 0): (1, 1, "x"), (2, 1): (1, 1, "y")}


def test_colours_and_cells(spark):
    r = spark.range(1).select(C.hue(F.lit(3)), C.linear_cell(F.lit(99), F.lit(100)), C.linear_cell(F.lit(5), F.lit(0)), C.srgb_byte(F.lit(1.0)), C.srgb_byte(F.lit(0.0))).first()
    assert round(r[0], 6) == 0.854102 and tuple(r)[1:] == (396, 0, 255, 0)
    w = spark.createDataFrame([("j", 1, 0, 0, 10, 1, 0.9), ("j", 1, 1, 0, 10, -1, 0.9), ("j", 2, 2, 0, 10, 1, 0.9)], "job_id string, page int, window_index int, char_start int, char_end int, cluster_id int, sim double")
    p = spark.createDataFrame([("j", 1, 400), ("j", 3, 0)], "job_id string, page int, char_count int")
    cells = raster.painted_cells(w, p)
    assert sorted(r["cell"] for r in cells.collect()) == list(range(10))
    got = {r["page"]: r["rgba"] for r in raster.canvases(raster.blended_cells(cells), p).collect()}
    assert len(got[1]) == 1600 and bytes(got[3]) == bytes(C.EMPTY) * 400 and bytes(got[1][:4]) != bytes(C.EMPTY)


def _groups(n=2, size=12, noise=3, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = np.eye(dim)[:n]
    x = np.concatenate([b + rng.normal(0, 0.02, (size, dim)) for b in base] + [rng.normal(0, 1, (noise, dim)) * 3])
    return x, np.repeat([*range(n), -1], [*[size] * n, noise])


def test_clusterings():
    x, truth = _groups()
    for got in (clusters.leader_labels(x, 3), clusters.hdbscan_labels(x, 5, 3), clusters.stabilised(x, truth)):
        assert len(set(got[:12])) == 1 and len(set(got[12:24])) == 1 and got[0] != got[12]
    assert (clusters.hdbscan_labels(x, 5, 3)[24:] == -1).all()
    assert (clusters.hdbscan_labels(x[:2], 5, 3) == -1).all()
    assert (clusters.stabilised(x, np.full(len(x), -1)) == -1).all()


def test_cluster_frames(spark):
    x, truth = _groups()
    rows = [("j", i, v.tolist(), int(c), 1, 10 * i, 10 * i + 12) for i, (v, c) in enumerate(zip(x, truth))] + [("j", 90, None, 1, 1, 0, 1), ("j", 91, [], -1, 1, 0, 1)]
    w = spark.createDataFrame(rows, "job_id string, window_index int, embedding array<float>, cluster_id int, page int, doc_char_start int, doc_char_end int")
    labels = {r["window_index"]: r["cluster_id"] for r in clusters.cluster_jobs(w, AnalysisParams(10, 5, enable_hdbscan=False)).collect()}
    assert len(labels) == len(rows) and labels[90] == labels[91] == -1 and labels[0] != labels[12]
    reg = {r["cluster_id"]: r for r in clusters.registry(w).collect()}
    assert set(reg) == {0, 1} and reg[0]["instance_count"] == 1 and reg[0]["pages"] == [1]
    near = {r["window_index"]: r["cluster_id"] for r in clusters.nearest_centroid(w, clusters.centroids(w, ["job_id", "cluster_id"]), "job_id", 0.8).collect()}
    assert near[3] == 0 and near[15] == 1 and near[90] == -1


def test_vectors(spark):
    v = docs(spark, "a b a", "", None).select("doc_key", V.hash_embedding(F.col("text"), 8).alias("v")).orderBy("doc_key").collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-6 and set(v[1]["v"]) == {0.0} and v[2]["v"] is None
    assert V.token_hash("ab") == (5381 * 33 + 97) * 33 + 98
    assert docs(spark, "a b c d").select(V.truncated(F.col("text"), 2)).first()[0] == "a b"
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b"))).collect()
    assert [round(x[0], 6) for x in r] == [0.0, 1.0]


def test_report_json(spark):
    body = f"{A} {B}\n\n{B}"
    out = contract.lexical_json(docs(spark, f"{body}\n\n{MIDDLE}\n\n{body}", MIDDLE)).orderBy("doc_key").collect()
    r = contract.validate_report(out[0]["report"])
    c = r["merged_repetition_report"]["clusters"][0]
    assert c["instance_count"] == 2 and len(c["duplicates"]) == 1 and c["canonical"] == c["spans"][0]
    none = contract.validate_report(out[1]["report"])  # nothing repeats, but the pass was run
    assert [p["repetition_report"]["clusters"] for p in none["passes"]] == [[]] and none["merged_repetition_report"]["stats"]["cluster_count"] == 0
    for bad in ("{", "[]", out[0]["report"].replace('"chapter":1', '"chapter":2', 1), out[0]["report"].replace("ch01_", "ch02_")):
        with pytest.raises(contract.ContractError):
            contract.validate_report(bad)


def test_report_shape(spark):
    """Every field of the contract, over a chapter of two acts that share a passage."""
    acts = spark.createDataFrame([("s", 3, 1, f"  {A} {B}\n{MIDDLE}"), ("s", 3, 2, f"{A} {B}\nOnce more, something else was said.\n"), ("s", 3, 4, " \n ")], "story string, chapter int, act int, text string")
    docs_, manifest, paragraphs = segment.assembled(acts, ["story", "chapter"])
    passes = contract.multi_pass(docs_, MultiPassConfig((LEXICAL, PassSpec("fine", "act", "embedding", 10, 10)), enable_hdbscan=False, tokens_per_page=200), manifest)
    rows = contract.report_json(docs_, passes, (LEXICAL, PassSpec("fine", "act", "embedding", 10, 10)), manifest, paragraphs, 200).collect()
    r = contract.validate_report(rows[0]["report"])
    text = docs_.first()["text"]
    assert set(r) == {"schema_version", "scope", "scope_manifest", "passes", "merged_repetition_report"}
    assert r["scope"]["chapter"] == 3 and r["scope"]["doc_char_end"] == len(text)
    assert [a["act"] for a in r["scope_manifest"]["acts"]] == [1, 2] and r["scope_manifest"]["acts"][0]["paragraphs"][1]["segment_id"] == "ch03_a01_p02"
    assert [(p["pass_label"], p.get("method"), p["window_size"]) for p in r["passes"]] == [("lexical", "lexical", 0), ("fine", None, 10)]
    for part in [r["merged_repetition_report"], *[p["repetition_report"] for p in r["passes"]]]:
        assert set(part) == {"boundary_version", "stats", "clusters"} and part["clusters"]
        assert part["stats"]["total_duplicate_instances"] == sum(len(c["duplicates"]) for c in part["clusters"])
        for c in part["clusters"]:
            assert set(c) == {"cluster_id", "representative_text", "instance_count", "total_word_estimate", "canonical", "duplicates", "spans", "suggested_op", "cross_act", "needs_bridge"}
            assert [s["instance_id"] for s in c["spans"]] == list(range(1, c["instance_count"] + 1)) and c["duplicates"] == c["spans"][1:]
            assert c["cross_act"] == (len({s["location"]["act"] for s in c["spans"]}) > 1)
            for s in c["spans"]:
                at = s["location"]
                assert set(s) == {"location", "cluster_id", "instance_id", "text", "similarity_to_centroid", "member_window_count"}
                assert set(at) == {"chapter", "act", "paragraph_index", "segment_id", "sentence_index", "scope_char_start", "scope_char_end", "doc_char_start", "doc_char_end"}
                assert s["text"] == text[at["doc_char_start"] : at["doc_char_end"]]
                base = r["scope_manifest"]["acts"][at["act"] - 1]
                assert at["scope_char_start"] == at["doc_char_start"] - base["doc_char_start"]
    for s in (s for c in r["passes"][1]["repetition_report"]["clusters"] for s in c["spans"]):
        act = r["scope_manifest"]["acts"][s["location"]["act"] - 1]
        assert act["doc_char_start"] <= s["location"]["doc_char_start"] < s["location"]["doc_char_end"] <= act["doc_char_end"]


def test_spans_stay_in_their_act(spark):
    text = "One act ends here without a stop\n\nthe next act begins. And it goes on."
    acts = spark.createDataFrame([(1, 1, 1, 0, 32), (1, 1, 2, 34, len(text))], "doc_key int, chapter int, act int, start int, end int")
    spans = spark.createDataFrame([(1, 8, 40), (1, 38, 45)], "doc_key int, start int, end int")
    d = spark.createDataFrame([(1, text)], "doc_key int, text string")
    got = {(r["start"], r["end"], r["text"]) for r in report.widened(spans, d, ["doc_key"], acts).collect()}
    assert got == {(0, 32, text[:32]), (34, 54, text[34:54])}
    assert {(r["start"], r["end"]) for r in report.widened(spans, d, ["doc_key"], acts, expand=False).collect()} == {(8, 32), (38, 45)}


def test_blank_acts(spark):
    acts = spark.createDataFrame([(1, 1, "a"), (1, 2, "\n\n")], "chapter int, act int, text string")
    assert [r["text"] for r in segment.assembled(acts, ["chapter"])[0].collect()] == ["a"]
    with pytest.raises(Exception, match="empty"):
        segment.assembled(acts, ["chapter"], blank="error")[0].collect()


def test_leader_labels_are_stabilised(spark):
    x, _ = _groups(noise=0)
    rows = [("j", i, v.tolist()) for i, v in enumerate(x)] + [("lone", 0, [1.0] * 16)]
    w = spark.createDataFrame(rows, "job_id string, window_index int, embedding array<float>")
    got = {(r["job_id"], r["window_index"]): (r["hdbscan_label"], r["cluster_id"]) for r in clusters.cluster_jobs(w, AnalysisParams(10, 5, enable_hdbscan=False)).collect()}
    assert {f for f, _ in got.values()} == {-1} and got["lone", 0] == (-1, -1)
    assert [got["j", i][1] for i in range(24)] == clusters.stabilised(x, clusters.leader_labels(x, 6)).tolist()


def test_subphrases(spark):
    def w(c, i, page, text, v):
        return ("j", i, page, text, [float(k) for k in v], c)

    rows = [w(0, 0, 1, "a long repeated block of words", (1, 0)), w(0, 1, 2, "a long repeated block of words", (1, 0)), w(1, 2, 1, "  Repeated BLOCK ", (1, 0.1)), w(1, 3, 2, "repeated block", (1, 0.1)), w(2, 4, 1, " ", (1, 0.2)), w(2, 5, 2, "", (1, 0.2)), w(-1, 6, 1, "noise", (0, 1))]
    got = {r["window_index"]: r["cluster_id"] for r in clusters.subphrase_links(spark.createDataFrame(rows, "job_id string, window_index int, page int, text string, embedding array<float>, cluster_id int")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: -1}


def test_sessions(spark):
    t = "document_path string, job_id string, status string, document_hash string, current_hash string, windows_total int, windows_committed int, created_at string, updated_at string"
    at = "2024-01-01T00:00:00Z"
    jobs = spark.createDataFrame([("a", "old", "complete", "x", "y", 1, 1, at, at), ("a", "part", "partial", "x", "y", 4, 1, at, at), ("b", "new", "complete", "y", "y", 1, 1, at, at), ("c", "run", "running", None, None, 0, 0, at, at)], t)
    pages = spark.createDataFrame([("new", 1), ("new", 1), ("new", 2)], "job_id string, page int")
    got = {r["document_path"]: tuple(r)[1:] for r in stored.session_state(jobs, pages).collect()}
    assert got == {"a": (None, 0, "part", 0.25), "b": ("new", 2, None, None), "c": (None, 0, None, None)}


def test_components_raise_rather_than_stop(spark):
    chain = spark.range(64).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)
    star = spark.range(1, 2000).selectExpr("0L as a", "id as b")
    assert connected_components(star).where("component <> 0").count() == 0


def test_intermediates_are_removed(spark, tmp_path):
    from pathlib import Path

    from echoloom import runtime

    folder = Path(runtime.shared_dir(spark).removeprefix("file://"))
    with runtime.intermediates(spark):
        kept = set(folder.iterdir()) if folder.exists() else set()
        assert runtime.cut(spark.range(3)).count() == 3
        assert set(folder.iterdir()) - kept
    assert set(folder.iterdir()) == kept


WORDS = "river lantern orchard winter kettle harbour ledger tailor meadow copper window garden stair bridge candle market copper thread wagon saddle basket hollow timber velvet anchor chapel ribbon marble cellar pepper".split()


def paragraphs_of(seed, n, words=30):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words)).capitalize() + "." for _ in range(n)]


def repetition(spark, *blocks):
    rows = lexical.repetition_instances(docs(spark, "\n\n".join(x for b in blocks for x in b)), LexicalConfig()).orderBy("start").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["cluster_id"], []).append(r)
    return out


def test_exact_block_is_one_cluster(spark):
    block = paragraphs_of(1, 13)
    got = repetition(spark, block, paragraphs_of(2, 8), block)
    largest = max(got.values(), key=lambda c: c[0]["word_count"])
    assert len(largest) == 2 and largest[0]["word_count"] >= 300 and largest[0]["end"] <= largest[1]["start"]
    assert largest[0]["text"] == largest[1]["text"] == "\n\n".join(block).rstrip(".")  # from the first token to the last


def test_adjacent_copies_do_not_overlap(spark):
    block = paragraphs_of(3, 12)
    got = repetition(spark, block, block)
    largest = max(got.values(), key=lambda c: c[0]["word_count"])
    assert len(largest) == 2 and largest[0]["end"] <= largest[1]["start"] and largest[0]["word_count"] >= 300


def test_near_block_covers_both_halves(spark):
    block = paragraphs_of(4, 10)
    edited = [p.replace(p.split()[14], "changed", 1) if i % 2 else p for i, p in enumerate(block)]
    text = "\n\n".join(block + paragraphs_of(5, 6) + edited)
    got = repetition(spark, block, paragraphs_of(5, 6), edited)
    spans = [(r["start"], r["end"]) for c in got.values() for r in c]
    first, second = len("\n\n".join(block)), text.rindex(edited[0])
    covered = lambda a, b: sum(max(0, min(e, b) - max(s, a)) for s, e in spans) / (b - a)
    assert covered(0, first) > 0.9 and covered(second, len(text)) > 0.9


def test_formulaic_lines_are_no_repetition(spark):
    assert repetition(spark, [f"He nodded at {a}. She smiled at {a}." for a in WORDS[:12]]) == {}


def test_highlights_of_several_reports(spark):
    t = "job_id string, cluster_id int, instance_id int, start int, end int, similarity double, text string"
    spans = spark.createDataFrame([("j", 1, 0, 5, 9, 0.9, "a"), ("j", 1, 1, 25, 29, 0.8, "a")], t).unionByName(spark.createDataFrame([("j", 14, 0, 12, 15, 1.0, "b")], t))
    pages = spark.createDataFrame([("j", 1, 0), ("j", 2, 10), ("j", 3, 20)], "job_id string, page int, doc_char_start int")
    hues = spark.createDataFrame([("j", 1, 0.618)], "job_id string, cluster_id int, reg double")
    got = {(r["cluster_id"], r["instance_id"]): (r["page"], r["role"], round(r["hue"], 4)) for r in raster.highlights(spans, pages, hues).collect()}
    assert got == {(1, 0): (1, "canonical", 0.618), (1, 1): (3, "duplicate", 0.618), (14, 0): (2, "canonical", round(2 / 12, 4))}


def test_dithering(spark):
    cells = spark.createDataFrame([("j", 1, 0, k + 1, 10 + k, 0.9, k) for k in range(3)] + [("j", 1, 1, 1, 7, 0.9, 0), ("j", 1, 1, 2, 8, 0.5, 1)], "job_id string, page int, cell int, rank int, cluster_id int, sim double, window_index int")
    got = {r["cell"]: r["pixels"] for r in raster.dithered_cells(cells, 3, 2).collect()}
    assert got == {0: [10 + (3 * r + 7 * c) % 3 for r in range(2) for c in range(3)], 1: [7] * 6}
    assert spark.range(1).select(C.dithers(F.lit(100), F.lit(200)), C.dithers(F.lit(99), F.lit(200))).first()[:] == (True, False)
