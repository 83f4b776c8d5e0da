import random

import pytest
from pyspark.sql import functions as F

from echoloom.config import AnalysisParams, MultiPassConfig, ParameterError, PRESETS, PassSpec, min_cluster_size
from echoloom.operators import segment as S

DOC = "doc_key int, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


def test_pages_concatenate_to_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bé", " ", "\n\n", " ", "中", "\t"]) for _ in range(200)) for _ in range(6)] + ["", "   ", None]
    d = docs(spark, *texts)
    back = {r["doc_key"]: r["text"] for r in S.reassemble(S.token_pages(d, 7)).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t is not None}
    pages = S.token_pages(d, 7).collect()
    assert all(p["token_count"] <= 7 and p["doc_char_end"] - p["doc_char_start"] == p["char_count"] for p in pages)


def test_windows_follow_the_loop(spark):
    def loop(n, ws, st):
        out, i = [], 0
        while i < n:
            if i + ws <= n:
                out.append((i, i + ws))
            else:
                if n - i >= 3 and n >= 3:
                    out.append((i, n))
                break
            i += st
        return out

    for n, ws, st in [(10, 5, 2), (10, 5, 5), (3, 5, 1), (2, 5, 1), (12, 5, 5), (23, 7, 3)]:
        text = " ".join(f"w{i}" for i in range(n))
        got = S.sliding_windows(S.token_pages(docs(spark, text), 1000), ws, st).orderBy("window_index").collect()
        assert [r["text"] for r in got] == [" ".join(f"w{i}" for i in range(a, b)) for a, b in loop(n, ws, st)]
        assert all(text[r["doc_char_start"] :].startswith(r["text"]) for r in got)


def test_chapter_breaks_keep_offsets(spark):
    text = "intro words\nChapter 1\none two three\n\nChapter 2\nfour"
    rows = S.chapter_break_pages(docs(spark, text, "", None), r"^Chapter \d", 2).orderBy("doc_key", "page").collect()
    assert all(text[r["doc_char_start"] : r["doc_char_end"]] == r["text"] for r in rows)
    assert "".join(r["text"] for r in rows) == text


def test_scope_pages_reject_bad_acts(spark):
    acts = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 3, 6)], "doc_key int, act int, start int, end int")
    assert [r["text"] for r in S.scope_pages(docs(spark, "abc   "), acts).collect()] == ["abc"]
    with pytest.raises(Exception, match="outside"):
        S.scope_pages(docs(spark, "abc"), acts).collect()


def test_paragraph_index_and_offsets(spark):
    acts = spark.createDataFrame([(1, 1, " one\n two "), (1, 2, "three"), (1, 3, " ")], "chapter int, act int, text string")
    o = S.chapter_offsets(acts, ["chapter"])
    whole = "one\n two\n\nthree"
    assert [(whole[r["start"] : r["end"]], r["act"]) for r in o.orderBy("act").collect()] == [("one\n two", 1), ("three", 2)]
    p = S.paragraph_index(o, ["chapter"]).orderBy("act", "paragraph_index").collect()
    assert [(r["segment_id"], whole[r["doc_char_start"] : r["doc_char_end"]]) for r in p] == [("ch01_a01_p01", "one"), ("ch01_a01_p02", "two"), ("ch01_a02_p01", "three")]


def test_parameters():
    with pytest.raises(ParameterError):
        AnalysisParams(4, 1)
    with pytest.raises(ParameterError):
        AnalysisParams(10, 11)
    with pytest.raises(ParameterError):
        MultiPassConfig((PassSpec("a", "act", "embedding", 50, 10), PassSpec("a", "act", "embedding", 50, 10)))
    assert [len(PRESETS[k].passes) for k in ("act_fine", "chapter_coarse", "full_multi_pass")] == [3, 3, 5]
    b = PRESETS["full_multi_pass"]
    assert MultiPassConfig.from_yaml(b.to_yaml()) == b
    assert min_cluster_size(2, 50, 10) == 10 and min_cluster_size(3, 5, 10) == 3


def test_window_estimate(spark):
    r = spark.range(1).select(*[S.window_estimate(F.lit(n), 5, 2).alias(f"n{n}") for n in (2, 3, 5, 6, 9)]).first()
    assert tuple(r) == (0, 1, 1, 1, 3)
