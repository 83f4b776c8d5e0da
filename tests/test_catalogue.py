"""Every catalogued query against its oracle in DuckDB, over the smallest test tables."""

import math
import os

import pytest

from echoloom.plans import catalogue

DATA = os.environ.get("ECHOLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "documents embeddings drafts jobs pages windows spans".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(map(plain, r))) for r in df.select(*cols).collect())
    sql = f"select {', '.join(cols)} from ({catalogue.ORACLE[name]})"
    assert got == sorted(str(tuple(map(plain, r))) for r in duck.execute(sql).fetchall())


#: What must hold for every row of the queries that SQL can't restate; each must have rows.
HOLDS = {
    "lcs_score": "a < b and score between 0 and 1",
    "lexical_report": "end > start and score > 0 and word_count > 0 and instance_id >= 0",
    "merge_passes": "n_spans >= 1 and n_passes >= 1 and representative is not null",
    "leader_clusters": "hdbscan_label = -1 and cluster_id >= -1",
    "hdbscan": "hdbscan_label >= -1 and (cluster_id >= 0 or hdbscan_label = -1)",
    "embedding_report": "end > start and members >= 1 and similarity > 0.5",
    "multi_pass_report": "size(from_json(report, 'passes array<struct<pass_label:string>>').passes) = 5",
    "page_payloads": "get_json_object(payload, '$.char_count') is not null",
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows_hold(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA).cache()
    n, bad = rows.count(), rows.where(f"not coalesce({HOLDS[name]}, false)").limit(3).collect()
    rows.unpersist()
    assert not bad
    assert n or name == "embedding_report"  # the smallest tables may have no group of windows large enough


def test_lcs_against_dynamic_programming(spark):
    tokens = {(r["doc_key"], r["id"]): r["tokens"] for r in catalogue._units(spark, DATA).collect()}
    rows = catalogue.lcs_score(spark, DATA).orderBy("story_id", "a", "b").collect()
    for r in rows[:: max(1, len(rows) // 12)]:
        x, y = tokens[r["story_id"], r["a"]], tokens[r["story_id"], r["b"]]
        line = [0] * (len(y) + 1)
        for t in x:
            last = 0
            for j, u in enumerate(y, 1):
                last, line[j] = line[j], last + 1 if t == u else max(line[j], line[j - 1])
        assert r["score"] == pytest.approx(line[-1] / max(len(x), len(y)), abs=1e-6)


def test_reports_are_valid(spark):
    from echoloom.operators.contract import validate_report

    for r in catalogue.multi_pass_report(spark, DATA).collect():
        out = validate_report(r["report"])
        assert out["scope"]["chapter"] == r["chapter"]
