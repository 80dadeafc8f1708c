"""Files, streams and sequences."""

import difflib
import json
import re

from pyspark.sql import functions as F

from scholium.functions import sequences as Q
from scholium.sources import corpora as C
from scholium.sources import files
from scholium.streaming import scores


def test_texts_answers_and_gold(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.b.txt").write_text("one\n\n[PAGE_BREAK]\n\ntwo")
    (tmp_path / "texts" / "c.md").write_text("")
    got = {r.paper: (r.text, r.pages) for r in C.read_texts(spark, f"{tmp_path}/texts").collect()}
    assert got["a.b"][1] == 2 and got["a.b"][0].startswith("one")
    for system, paper, body in (("s1", "p1", json.dumps({"extraction": {"sc:name": "X", "rai:dataBiases": None}})), ("s1", "p2", "no json"), ("s2", "p1", '```json\n{"fields": {"url": "u"}}\n```'), ("s2", "p3", '{"name": "flat"}')):
        (tmp_path / "answers" / system).mkdir(parents=True, exist_ok=True)
        (tmp_path / "answers" / system / f"{paper}.json").write_text(body)
    rows = {(r.system, r.paper): (r.record, r.valid) for r in C.read_answers(spark, f"{tmp_path}/answers/*").collect()}
    assert rows == {("s1", "p1"): ({"name": "X", "rai:dataBiases": None}, True), ("s1", "p2"): (None, False), ("s2", "p1"): ({"url": "u"}, True), ("s2", "p3"): ({"name": "flat"}, True)}
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "p1.md").write_text("# Title\n## name\nA set\nof two lines\n\n### url\n\n**license**: MIT\n")
    assert {tuple(r) for r in C.read_markdown_gold(spark, f"{tmp_path}/gold").collect()} == {("p1", "name", "A set\nof two lines"), ("p1", "url", None), ("p1", "license", "MIT")}


def test_verdicts_upsert_and_resume(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "paper long, v2min_score int").write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([(2, 3, "x")], "paper long, score int, judge string").write.parquet(f"{tmp_path}/new")
    assert sorted((r.paper, r.score) for r in C.read_verdicts(spark, [f"{tmp_path}/old", f"{tmp_path}/new"]).collect()) == [(1, 2), (2, 3)]
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at int")
    C.upsert(spark, first, f"{tmp_path}/none", ["k"], "at", f"{tmp_path}/t1")
    got = C.upsert(spark, spark.createDataFrame([(2, "d", 5), (3, "e", 0)], "k long, v string, at int"), f"{tmp_path}/t1", ["k"], "at", f"{tmp_path}/t2")
    assert {tuple(r) for r in got.collect()} == {(1, "b", 2), (2, "d", 5), (3, "e", 0)}
    assert [r.k for r in C.to_do(first.select("k").distinct(), got.where("k = 1"), ["k"]).collect()] == [2]


def test_chats_reports_and_descriptions(spark, tmp_path):
    lines = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"instruction": "i", "output": "o"}, {"x": 1}, {"messages": [{"role": "bot", "content": " "}]}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = C.read_chats(spark, f"{tmp_path}/c.jsonl").withColumn("e", C.chat_errors(F.col("messages"))).collect()
    assert sorted(str(r.kind) for r in rows) == ["None", "alpaca", "chatml", "chatml"]
    assert sorted(",".join(r.e) for r in rows if r.kind == "chatml") == ["", "unknown role,empty turn"]
    assert [(r.file, r.bytes) for r in C.described(spark, f"{tmp_path}/c.jsonl").collect()] == [("c.jsonl", (tmp_path / "c.jsonl").stat().st_size)]
    table = spark.createDataFrame([(1, "a_b & <c>")], "n long, s string")
    assert [tuple(r) for r in C.record_set(table).collect()] == [("n", "sc:Integer"), ("s", "sc:Text")]
    assert files.html(table) == "<table><tr><th>n</th><th>s</th></tr><tr><td>1</td><td>a_b &amp; &lt;c&gt;</td></tr></table>\n"
    assert files.latex(table) == "\\begin{tabular}{ll}\nn & s \\\\\n1 & a\\_b \\& <c> \\\\\n\\end{tabular}\n"
    C.write_answers(spark.createDataFrame([("s", "p", {"name": "x"})], "system string, paper string, record map<string,string>"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").select("system", "record.name").first() == ("s", "x")


def test_streams(spark, tmp_path):
    schema = "system string, paper long, field int, verdict int, scored_at timestamp"
    rows = [("a", 1, 1, 1, "2024-01-01 00:01:00"), ("a", 1, 1, 1, "2024-01-01 00:02:00"), ("a", 2, 1, 3, "2024-01-01 00:20:00"), ("b", 1, 1, 2, "2024-01-01 00:03:00")]
    data = spark.createDataFrame(rows, "system string, paper long, field int, verdict int, t string").select("system", "paper", "field", "verdict", F.to_timestamp("t").alias("scored_at"))
    data.write.parquet(f"{tmp_path}/in")
    stream = lambda: scores.verdict_stream(spark, f"{tmp_path}/in", schema)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(scores.once(stream()), "once", "append").count() == 3
    got = {(r.system, str(r.start)[11:16]): (r.n, r["mean"]) for r in run(scores.rates(stream()), "rates", "complete").collect()}
    assert got == {("a", "00:00"): (2, 1.0), ("a", "00:20"): (1, 0.0), ("b", "00:00"): (1, 0.5)}
    q = stream().writeStream.foreachBatch(scores.leaderboard_writer(f"{tmp_path}/cells", f"{tmp_path}/board")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.system: r.composite for r in spark.read.parquet(f"{tmp_path}/board").collect()} == {"a": 0.5, "b": 0.5}


def test_sequences(spark):
    pairs = [("The quick brown fox", "the quick, brown dog"), ("a", "b"), ("", ""), ("same", "Same"), ("short", "a very much longer text than that"), ("x" * 250, "x" * 249 + "y"), (None, "z")]
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split())
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = rows.select(Q.ratio(F.col("a"), F.col("b")).alias("r"), Q.alike(F.col("a"), F.col("b")).alias("s"), Q.runs_agree(F.col("a"), F.col("b")).alias("g")).collect()
    want = [None if a is None else difflib.SequenceMatcher(None, plain(a), plain(b)).ratio() for a, b in pairs]
    assert all((x.r is None) == (w is None) and (w is None or abs(x.r - w) < 1e-12) for x, w in zip(got, want, strict=True))
    assert [x.s for x in got][:6] == [w >= 0.8 for w in want[:6]]
    assert [x.g for x in got] == [False, False, True, True, False, want[5] >= 0.8, False]
