"""Small fixtures for the cleaning, pipeline, judging, record and report operators: nulls, ties, repeats, empty values."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cleaning as L
from quillspark.operators import events as E
from quillspark.operators import judging as J
from quillspark.operators import metrics as M
from quillspark.operators import pipeline as P
from quillspark.operators import rank as K
from quillspark.operators import records as Q
from quillspark.operators import reports as W
from quillspark.sources import readers as I


def test_rules_by_source(spark):
    rows = [("a", 1, "who_factsheet", "打印本页"), ("a", 2, "who_factsheet", "发热[1]，咳嗽。相关链接：x"), ("a", 3, "wikipedia", "流感[编辑]是[12]病"), ("a", 4, "who_publication", " xi "), ("a", 5, None, "第 3 页"), ("a", 6, "wikipedia", None)]
    df = spark.createDataFrame(rows, "doc string, n int, kind string, line string")
    assert {r.n: r.line for r in L.clean_lines(df, "kind").collect()} == {2: "发热，咳嗽。", 3: "流感是病", 5: "第 3 页"}


def test_merged_lines(spark):
    lines = ["流感是由病毒", "引起的疾病。", "一、概述", "The virus", "spreads", "1.1", "范围", "· 项目", "第一章 总则 12"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)] + [("e", 0, "")], "d string, i int, line string")
    assert [r.line for r in L.merged_lines(df, "d", "i", "line").where("d = 'd'").orderBy("seq").collect()] == ["流感是由病毒引起的疾病。", "一、概述", "The virus spreads", "1.1 范围", "· 项目第一章 总则 12"]


def test_spans_and_masks(spark):
    df = spark.createDataFrame([("尚未确诊，已确诊。Stock stocking stock", ), ("",), (None,)], "t string")
    got = [r.m for r in df.select(L.masked(F.col("t"), L.term_spans(F.col("t"), ["确诊", "stock"])).alias("m")).collect()]
    assert got == ["尚未确诊，已***。*** stocking ***", "", None]


def test_furniture_and_numbers(spark):
    rows = [("d", p, x) for p in range(3) for x in ("页眉", f"正文{p}", f"- {p} -")] + [("s", 0, "页眉")]
    df = spark.createDataFrame(rows, "d string, p int, line string")
    assert {r.line for r in L.furniture(df, "d", "p", "line").collect()} == {"页眉", "- 0 -", "- 1 -", "- 2 -"}


def test_rerank_and_pipeline(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "query_id int, id string, rank int")
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.5)], "query_id int, id string, score double")
    assert [r.id for r in P.rerank(hits, scores, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    with pytest.raises(Exception, match="no score of c"):
        P.rerank(hits, scores.where("id <> 'c'"), 3).collect()
    assert [r.id for r in P.pipeline(hits, scores, None, 1).collect()] == ["b"]


def test_dense_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id int, vector array<double>")
    q = v.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    one, many = K.dense(v, q, 4), K.dense(v, q, 4, block=7, part=25)
    key = lambda d: sorted((r.query_id, r.rank, r.id) for r in d.collect())
    assert key(one) == key(many) and one.count() == 160
    assert K.dense(v.limit(0), q, 4).count() == 0 and K.dense(v, q.limit(0), 4).count() == 0


def test_filters(spark):
    f = spark.createDataFrame([(1, "topic", "流感"), (1, "period", "latest"), (2, "section_type", "x"), (2, "colour", "red"), (2, "period", "1999"), (2, "topic", None)], "query_id int, key string, value string")
    periods = spark.createDataFrame([("2024-01",), ("2025-02",)], "period string")
    topics = spark.createDataFrame([("流感",)], "value string")
    got = {(r.query_id, r.key): (r.value, r.reason) for r in P.validated(f, {"section_type": ["symptoms"]}, periods, topics).collect()}
    assert got[(1, "topic")] == ("流感", None) and got[(1, "period")] == ("2025-02", None)
    assert {k[1]: v[1] for k, v in got.items() if k[0] == 2} == {"section_type": "not_in_enum", "colour": "unknown_key", "period": "not_in_corpus", "topic": "invalid_value"}
    names = spark.createDataFrame([("d1", "季节性流行性感冒"), ("d2", "流感"), ("d3", "高血压")], "doc string, name string")
    al = spark.createDataFrame([("流感", "流行性感冒")], "alias string, target string")
    assert {r.doc for r in P.resolved_topics(topics, names, al).collect()} == {"d1", "d2"}


def test_gates(spark):
    rows = [(0.9, True, True, True), (0.5, True, True, False), (0.5, False, True, False), (None, True, False, False), (0.1, False, False, False)]
    df = spark.createDataFrame(rows, "score double, answerable boolean, answered boolean, correct boolean")
    taus = spark.createDataFrame([(0.5,), (float("-inf"),), (float("inf"),)], "tau double")
    got = {r.tau: (r.blocked, r.answered, r.useful, r.false_answers, r.over_refusals) for r in J.gated(df, taus).collect()}
    assert got == {0.5: (2, 3, 1, 1, 1), float("-inf"): (0, 3, 1, 1, 1), float("inf"): (5, 0, 0, 0, 3)}
    assert J.budget_tau(df, 0.34).first().tau == float("-inf") or J.budget_tau(df, 0.34).first().tau < 0.5
    assert J.budget_tau(df, 0.0).first().tau == float("-inf") and J.budget_tau(df, 1.0).first().tau == float("inf")


def test_running_sums(spark):
    rng = random.Random(2)
    xs = sorted({rng.randrange(10_000) for _ in range(500)})
    df = spark.createDataFrame([(float(x), i % 7) for i, x in enumerate(xs)], "x double, n int")
    total, want = 0, {}
    for i, x in enumerate(xs):
        total += i % 7
        want[float(x)] = total
    assert {r.x: r.n_to for r in M.running(df, "x", ["n"], 16).collect()} == want
    assert M.running(df.limit(0), "x", ["n"]).count() == 0


def test_labels_and_verdicts(spark):
    rows = [('{"relevant": ["a"], "partial": ["b"]}', True), ('{"relevant": ["a", "a"]}', False), ('{"relevant": ["z"]}', False), ('{"good": []}', False), ("nope", False), (None, False), ("{}", True)]
    df = spark.createDataFrame([(r, ["a", "b"]) for r, _ in rows], "c string, v array<string>")
    assert [r.p is not None for r in df.select(J.parsed_labels(F.col("c"), F.col("v")).alias("p")).collect()] == [ok for _, ok in rows]
    ids = spark.createDataFrame([([0, 1, 2],), ([2, 0, 1],), ([0, 0],), ([1],), ([],)], "i array<int>")
    assert [r.c for r in ids.select(J.complete_ids(F.col("i")).alias("c")).collect()] == [True, True, False, False, True]


def test_admission_uses_up_nothing_when_it_rejects(spark):
    rows = [("c", i, n, 5.0) for i, n in enumerate(["a", "a", "b", "c", "d", None])]
    df = spark.createDataFrame(rows, "k string, i int, n string, cost double")
    assert [r.reason for r in E.admitted(df, "k", "i", "n", "cost", 100, 3).orderBy("i").collect()] == [None, "duplicate", None, None, "tool_limit", "tool_limit"]
    assert [r.reason for r in E.admitted(df, "k", "i", "n", "cost", 10, 9).orderBy("i").collect()] == [None, "duplicate", None, "cost_limit", "cost_limit", "cost_limit"]


def test_mapped_excerpts(spark):
    c = spark.createDataFrame([("d", 1, "c1", "甲乙 丙丁"), ("d", 2, "c2", "戊己庚辛"), ("d", 3, "c3", None)], "doc string, seq int, id string, text string")
    e = spark.createDataFrame([("e1", "d", "乙丙"), ("e2", "d", "丁戊"), ("e3", "d", "壬"), ("e4", "d", None), ("e5", "x", "甲")], "excerpt_id string, doc string, text string")
    got = {r.excerpt_id: (r.how, r.ids) for r in Q.mapped_excerpts(e, c).collect()}
    assert got == {"e1": ("exact", ["c1"]), "e2": ("span", ["c1", "c2"]), "e3": ("failed", []), "e4": ("failed", []), "e5": ("failed", [])}


def test_paragraph_duplicates(spark):
    long = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [("a", "1", long, 2), ("b", "1", long[:-1] + "变", 1), ("b", "2", "短", 1), ("c", "9", None, 1), ("a", "2", long, 2)]
    df = spark.createDataFrame(rows, "doc string, para string, text string, rank int")
    assert {(r.doc, r.para, r.kept_doc) for r in Q.paragraph_duplicates(df).collect()} == {("a", "1", "b"), ("a", "2", "b")}


def test_pages():
    html = "<title>t</title><body><p>out</p><div id=main><p>one<p>two<div class='x share-box'>no<p>no</div><p><b>Bold</b></p><ul><li>li</ul><table><tr><th>h<tr><td>v</table></div></body>"
    rules = I.PageRules(content_ids=frozenset({"main"}), skip_classes=frozenset({"share"}))
    title, got = I.parse_html(html, rules)
    assert title == "t" and got == [("paragraph", 0, "one"), ("paragraph", 0, "two"), ("heading", 2, "Bold"), ("list", 0, "li"), ("table_row", 0, "h：v")]
    assert I.parse_html("")[1] == [] and I.has_header(["a", "b", "1"]) and not I.has_header(["1", "2", "x"])


def test_strict_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.line_no for r in I.checked_jsonl(spark, f"file://{tmp_path}/a.jsonl").collect()] == [1, 3]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="line 2 is no JSON object"):
        I.checked_jsonl(spark, f"file://{tmp_path}/b.jsonl").collect()


def test_report_pieces(spark):
    df = spark.createDataFrame([('{"name": "search", "arguments": {"q": " x "}}',), ('{"name": "other", "arguments": {"q": "x"}}',), ('{"name": "search"}',), ("",)], "c string")
    assert [r.t and r.t.argument for r in df.select(W.tool_call(F.col("c"), {"search": "q"}).alias("t")).collect()] == ["x", None, None, None]
    b = M.bootstrap_poisson(spark.createDataFrame([("g", float(i % 2), i) for i in range(400)], "g string, v double, k int"), "g", "v", "k").first()
    assert 0.4 < b.low < 0.5 < b.high < 0.6
    one = spark.createDataFrame([(["甲", "预防", "附录"],), (["x"],), ([],)], "p array<string>")
    assert [r.s for r in one.select(T.section_type_of_path(F.col("p")).alias("s")).collect()] == ["prevention", None, None]
