"""Every query against its SQL in DuckDB over the smallest tables, and operators on small cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from scholium import plans as catalogue
from scholium.functions import scalars as S
from scholium.operators import contamination, scoring, selection, statistics

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events documents pages benchmark labels conversations".split()


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) and math.isfinite(value) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted([plain(x) for x in r] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in names] for r in got.collect()) == want


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert column(spark, ["MIT License", "cc-by-sa 4.0", "CC BY 4.0", "Creative Commons Attribution NonCommercial 4", "admit", None], S.spdx) == ["MIT", "CC-BY-SA-4.0", "CC-BY-4.0", "CC-BY-NC-4.0", None, None]
    assert column(spark, ["March 5, 2021", "05/06/2020", "May 2019", "2018-01-02T03", "in 1999.", "none", "Nov 18, 2021", "18 Nov 2021", "Nov 2021", "1850", "2020-04", "18 November 2021"], S.iso_date) == ["2021-03-05", "2020", "2019-05", "2018", "1999", None, "2021-11-18", "2021-11-18", "2021-11", "1850", "2020-04", "2021-11-18"]
    assert column(spark, ["HTTPS://a.b/c//", None], S.normal_url) == ["a.b/c", None]
    assert column(spark, [" Yes", "0", "Maybe"], S.normal_boolean) == ["true", "false", "maybe"]
    assert column(spark, [None, " N/A ", "x"], S.is_null_text) == [True, True, False]
    assert column(spark, ["a b c", "a", "", None], lambda v: F.size(S.grams(S.gram_words(v), 2))) == [2, 0, 0, 0]
    assert column(spark, [None, "", "ab", "a☃"], S.odd_share) == [1.0, 1.0, 0.0, 0.5]


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "system string, paper long, field int, score double")
    for f in (scoring.composites, scoring.leaderboard, scoring.discordant, scoring.bootstrap):
        assert f(cells).collect() == []
    texts = spark.createDataFrame([], "item_id long, text string")
    assert contamination.overlap(texts, texts, "item_id").collect() == []
    assert selection.dense_years(spark.createDataFrame([], "d timestamp"), F.col("d")).collect() == []
    assert statistics.majority(spark.createDataFrame([], "u long, v string"), "u", "v").collect() == []


def test_bootstrap_holds_the_composite(spark):
    rows = [("s", p, f, float((p * f) % 3 == 0)) for p in range(30) for f in range(5)]
    r = scoring.bootstrap(spark.createDataFrame(rows, "system string, paper long, field int, score double")).first()
    assert r["low"] <= r["composite"] <= r["high"] and r["high"] - r["low"] < 0.4


def test_record_columns(spark):
    from scholium.operators import records as R

    r = spark.sql("select map('a', '1', 'b', ' ', 'x', null) as ours, map('a', '2', 'c', '3') as host")
    a, b = F.col("ours"), F.col("host")
    got = r.select(R.missing(a, ["a", "b", "c"]), R.extra(a, ["a", "b"]), R.merged(a, b), R.added(a, b), R.kept(a, b), R.document(a)).first()
    assert list(got) == [["b", "c"], ["x"], {"a": "2", "c": "3"}, [], ["a"], '{"a":"1"}']


def test_files_round_trip(spark, tmp_path):
    from scholium.sources import files

    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, v string")
    files.write_json_lines(rows, f"{tmp_path}/j")
    files.write_csv(rows, f"{tmp_path}/c")
    for got in (files.read_json_lines(spark, f"{tmp_path}/j", rows.schema), files.read_csv(spark, f"{tmp_path}/c", rows.schema)):
        assert sorted(map(tuple, got.collect())) == [(1, 'a "b", c'), (2, None)]
    assert files.markdown(rows.orderBy("i")) == '| i | v |\n| --- | --- |\n| 1 | a "b", c |\n| 2 |  |\n'
    with pytest.raises(ValueError):
        files.markdown(rows, 1)
