"""Every query with SQL gives DuckDB's result; the others run."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from raceflow import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(x) if isinstance(x, (bool, str)) or not hasattr(x, "__float__") else repr(float(x))
    return sorted(tuple(show(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_yolo_of_all_images(spark, tmp_path):
    rows = [(k, 1, 0.5, 0.25, 0.5) for k in (1, 1999, 2000, 70_000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.image for r in catalog.queries()["snk_yolo"](spark, str(tmp_path)).collect()} == {1, 1999, 2000, 70_000}


def test_uniform_frames(spark, tmp_path):
    frames = [1, 2, 299, 301, 350, 601, 700, 899, 1100, 1399, 1400]  # none at a multiple of 300 or 500
    one = "CAST(1 AS BIGINT) AS l_partkey, CAST(1 AS BIGINT) AS l_suppkey, 1 AS l_linenumber, 1.0 AS l_quantity, 0.1 AS l_discount, 'A' AS l_returnflag"
    spark.createDataFrame([(k,) for k in frames for _ in range(2)], "l_orderkey long").selectExpr("l_orderkey", *one.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, catalog.queries()["win_uniform"](spark, str(tmp_path)).collect())) == [(1, 2), (301, 2), (601, 2), (1100, 2), (1400, 2)]
    how = {r.frame_idx: r.how for r in catalog.queries()["set_selection"](spark, str(tmp_path)).collect()}
    assert set(how) == set(frames) and {f for f, h in how.items() if h == "both"} == {1, 601, 1399}


def test_samples_at_even_steps(spark, tmp_path):
    spark.createDataFrame([(7 * k + 1, k) for k in range(2000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.o_custkey for r in catalog.queries()["ds_samples"](spark, str(tmp_path)).collect()) == [0, 500, 1000, 1500]


def test_postproc_of_crossings(spark, tmp_path):
    """Run a: 1002 is free and registered, 1001 isn't registered; run b: 1002 is taken by a sure crossing."""
    events = []  # confidence is (30 + event_id % 70) / 100

    def crosses(run, track, first, k):  # the third row beyond the line is the crossing
        events.extend((first + n, track, run, x, k) for n, x in enumerate((10.0, 10.0, 60.0, 60.0, 60.0)))

    crosses("a", 1, 700, 4)  # unsure
    events.append((726, 9, "a", 60.0, 2))
    crosses("a", 2, 7_000, 4)  # unsure
    events.append((7_026, 9, "a", 60.0, 1))
    crosses("b", 3, 14_050, 2)  # sure
    crosses("b", 4, 14_070, 4)  # unsure
    rows = [(i, t, e, x, f'{{"k": {k}}}') for i, t, e, x, k in events]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1002,), (999,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    near = {(r.sequence, r.number) for r in catalog.queries()["join_postproc_candidates"](spark, str(tmp_path)).collect()}
    assert near == {(704, "1002"), (7_004, "1001"), (14_074, "1002")}
    assert [tuple(r) for r in catalog.queries()["join_postproc"](spark, str(tmp_path)).collect()] == [("a", 704, "1002")]


def test_completeness_of_whole_texts(spark, tmp_path):
    texts = ["\u00e4" * 600, "\u00e4" * 600 + "z A" * 500, "x" * 50, "x" * 50 + " " * 30, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in catalog.queries()["flt_completeness"](spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[0] != got[1] and got[2] == got[3] and got[2][1] > 0 and set(got[4]) == {0.0}
