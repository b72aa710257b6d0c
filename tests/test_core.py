import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers as A
from quillspark.operators import chunking as C
from quillspark.operators import dedup as D
from quillspark.operators import events as E
from quillspark.operators import metrics as M
from quillspark.operators import rank as K
from quillspark.operators import store as S
from quillspark.operators import text as X
from quillspark.sources import readers as I


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_tokens_and_splits(spark):
    assert one(spark, "发热咳嗽 Covid-19，流感２", T.tokens_bigram) == ["发热", "热咳", "咳嗽", "covid", "19", "流感"]
    assert sorted(one(spark, "发热咳嗽 Covid-19，流感２x 一", T.token_bag)) == sorted(one(spark, "发热咳嗽 Covid-19，流感２x 一", T.tokens_bigram))
    assert one(spark, "  A b\tC ", T.tokens_whitespace) == ["a", "b", "c"]
    assert one(spark, "甲。乙！”丙", T.sentences) == ["甲。", "乙！”", "丙"]
    assert one(spark, "甲，乙、丙", T.clauses) == ["甲，", "乙、", "丙"]
    assert one(spark, None, T.sentences) is None
    assert one(spark, "ＡＢ１　，\r\nx", T.normalize) == "AB1 ，\nx"


def test_shingles_and_ratio(spark):
    assert set(one(spark, "ab cdefg", T.shingles)) == {"abcde", "bcdef", "cdefg"}
    assert one(spark, "ab", T.shingles) == ["ab"]
    assert one(spark, " ", T.shingles) == []
    assert one(spark, "a b甲乙", T.ascii_ratio) == 0.5
    assert one(spark, "", T.ascii_ratio) == 0.0


@pytest.mark.parametrize(("line", "level"), [("第一章 总则", 1), ("一、概述", 1), ("（二）症状", 2), ("1.2 范围", 3), ("3、定义", 3), ("75.8号决议", 0), ("（1）发热", 4), ("1. 这一条的文字写得很长很长很长很长很长很长很长很长很长很长", 0), ("正文", 0), ("1.2 范围 12", 0), ("第一章 总则 3", 0)])
def test_headings(spark, line, level):
    assert one(spark, line, T.heading_level) == level


def test_redaction(spark):
    assert one(spark, "Bearer abc.def a@b.cn 13812345678 11010119900101123X 138123456789", T.redact) == "Bearer [REDACTED] [REDACTED] [REDACTED] [REDACTED] 138123456789"


def test_runs(spark):
    df = spark.createDataFrame([("d", i, f) for i, f in enumerate([True, True, False, True, True, True])], "d string, i int, f boolean")
    assert [r.in_run for r in X.runs(df, ["d"], "i", "f", 3).orderBy("i").collect()] == [False, False, False, True, True, True]


def test_contained_questions(spark):
    q = "这是一个很长的问题" * 7
    texts = spark.createDataFrame([(1, "前" + q + "后"), (2, q[:-1]), (3, None)], "text_id int, text string")
    qs = spark.createDataFrame([(9, q), (8, "短")], "question_id int, question string")
    assert [(r.text_id, r.question_id) for r in X.contained_questions(texts, qs).collect()] == [(1, 9)]


def test_split_keeps_text_limits_and_sentence_edges():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("甲乙丙，、。！x") for _ in range(rng.randrange(0, 400)))
        parts = C.split(t, 50)
        assert "".join(parts) == t and all(len(p) <= 50 for p in parts)
        # a sentence that fits is never cut
        ends, at = set(), 0
        for p in parts:
            at += len(p)
            ends.add(at)
        at = 0
        for s in C.pieces(t, C.ENDS):
            if len(s) <= 50 and len(t) > 50:
                assert not any(at < e < at + len(s) for e in ends)
            at += len(s)
    long = "甲" * 30 + "，" + "乙" * 30 + "。"
    assert C.split("短句。" + long + "尾句。", 50) == ["短句。", "甲" * 30 + "，", "乙" * 30 + "。", "尾句。"]
    assert C.split("字" * 120, 50) == ["字" * 50, "字" * 50, "字" * 20]


def test_children_pair_cut_and_absorb():
    s = lambda c, n: c * (n - 1) + "。"
    assert C.children([s("甲", 50), s("乙", 60), s("丙", 20)]) == [s("甲", 50) + s("乙", 60), s("丙", 20)]
    assert C.children([s("甲", 60), s("乙", 60), s("丙", 40)]) == [s("甲", 60), s("乙", 60) + s("丙", 40)]
    assert C.children([s("甲", 100), s("乙", 14)]) == [s("甲", 100) + s("乙", 14)]
    assert C.children([s("乙", 14), s("甲", 105)]) == [s("乙", 14), s("甲", 105)]
    cut = C.children([s("字", 230), s("乙", 20)])
    assert [len(c) for c in cut] == [110, 110, 10, 20] and "".join(cut) == s("字", 230) + s("乙", 20)
    assert C.cut_long("甲" * 60 + "；" + "乙" * 60, 110) == ["甲" * 60 + "；", "乙" * 60]
    assert C.cut_long("甲" * 5 + "，" + "乙" * 120, 110) == ["甲" * 5 + "，" + "乙" * 104, "乙" * 16]
    assert C.children(["2024年3月1日", "打印", s("甲", 30)]) == ["2024年3月1日打印", s("甲", 30)] and C.children(["打印"]) == []


def element(kind, text="", items=(), header=(), rows=(), section=0):
    return {"kind": kind, "text": text, "items": list(items), "header": list(header), "rows": [list(r) for r in rows], "section": section}


def test_document_chunks_and_families():
    es = [element("paragraph", "甲" * 300), element("list", items=["乙" * 100, " ", "打印", "丙" * 50]), element("table", header=["名"], rows=[["A", "b"], ["", ""]]), element("paragraph", "丁" * 600 + "。" + "戊" * 20), element("paragraph", "己", section=1)]
    got = C.document_chunks(es)
    assert [(a, b, k, len(t)) for a, b, k, t in got] == [(0, 0, "text", 450), (0, 1, "table_row", 8), (0, 2, "text", 512), (0, 3, "text", 76 + 89), (0, 4, "text", 76 + 20), (1, 0, "text", 1)]
    assert got[1][3] == "名：A；列2：b"
    fam = C.document_families(es)
    assert [(r, p, k) for _, r, p, _, k, _ in fam if r == "parent"] == [("parent", 0, "text"), ("parent", 1, "list"), ("parent", 2, "table_summary"), ("parent", 3, "text"), ("parent", 4, "text"), ("parent", 5, "text"), ("parent", 0, "text")]
    assert [t for _, r, p, _, k, t in fam if k == "table_summary"] == ["表格共 2 行，列：名"]
    assert all(len(t) <= 600 for _, r, *_, t in fam if r == "parent") and all(len(t) <= 130 for _, r, *_, t in fam if r == "child")
    assert C.document_chunks([]) == [] and C.units(element("table", "概述")) == [("table", "概述")]


def test_overlap(spark):
    df = spark.createDataFrame([("d", 1, "abcdef"), ("d", 2, "xyz")], "d string, i int, t string")
    assert [r.chunk for r in C.with_overlap(df, "d", "i", "t", 2).orderBy("i").collect()] == ["abcdef", "efxyz"]


def test_similar_pairs_and_greedy(spark):
    base = "".join(chr(0x4E00 + i) for i in range(200))
    rows = [(1, base), (2, base[:190] + "甲乙"), (3, base), (4, "完全不同的文字" * 20), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    pairs = D.similar_pairs(df, "id")
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    assert {(r.id, r.rep) for r in D.classes(df, "id").collect()} >= {(1, 1), (3, 1), (2, 2)}
    ids = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "id int, o int")
    kept = {r.id: r.kept_as for r in D.greedy_keep(ids, pairs, "o").collect()}
    assert kept == {2: 2, 1: 2, 4: 4}


def test_greedy_is_not_transitive(spark):
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, o int")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a int, b int, similarity double")
    assert {r.id: r.kept_as for r in D.greedy_keep(ids, pairs, "o").collect()} == {1: 1, 2: 1, 3: 3}


def test_bm25_against_a_loop(spark):
    docs = {"a": "发热 发热 咳嗽".split(), "b": "咳嗽 流感".split(), "c": "流感 疫苗 接种 疫苗".split(), "d": []}
    got = {(r.query_id, r.id): r.score for r in K.bm25(spark.createDataFrame(list(docs.items()), "id string, tokens array<string>"), spark.createDataFrame([("q", ["疫苗", "流感", "无"])], "query_id string, tokens array<string>"), positive=False).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(raw.values()) / len(raw)
    for k, d in docs.items():
        s = sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ("疫苗", "流感") if t in d)
        assert got.get(("q", k), 0) == pytest.approx(s)


def test_dense_ties_and_missing(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [(r.id, r.rank) for r in K.dense(v, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert K.dense(v, q.limit(0), 2).count() == 0 if q.limit(0).count() else True
    r = K.dense(v, q, 3).select("query_id", "id", "score")
    assert [x.id for x in K.mmr(r, v.where("id <> 3"), 2, 0.4).orderBy("rank").collect()] == [1, 3]


def test_fusion_and_relaxation(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, id string, rank int")
    f = {r.id: r.score for r in K.rrf([a, b]).collect()}
    assert f["y"] == pytest.approx(1 / 61 + 1 / 62) and f["x"] == pytest.approx(1 / 61)
    levels = spark.createDataFrame([("q", 0, "x"), ("q", 1, "x"), ("q", 1, "y")], "query_id string, level int, id string")
    assert {r.level for r in K.relaxed(levels, 2).collect()} == {1} and {r.level for r in K.relaxed(levels, 5).collect()} == {1}


def test_metrics(spark):
    rank = spark.createDataFrame([("q", "x", 1), ("q", "g", 2), ("q", "h", 4)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q", "g"), ("q", "h"), ("p", "z")], "query_id string, id string")
    m = {r.query_id: r for r in M.per_query(rank, gold).collect()}
    assert (m["q"].hit_1, m["q"].hit_3, m["q"].recall, m["q"].rr) == (0, 1, 1.0, 0.5)
    assert m["q"].ap == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert m["q"].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert m["p"].ndcg == 0
    w = spark.createDataFrame([(8, 10), (0, 0)], "h int, n int").select(*M.wilson(F.col("h"), F.col("n"))).collect()
    assert tuple(w[0]) == pytest.approx((0.4901568, 0.9433191), abs=1e-6) and tuple(w[1]) == (None, None)
    s = spark.createDataFrame([(7, 1), (0, 0)], "a int, b int").select(M.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    assert s[0].p == pytest.approx(2 * 9 / 256) and s[1].p == 1.0
    e = spark.createDataFrame([(10, 2)], "n int, g int").select(M.random_hit(F.col("n"), F.col("g"), 3).alias("p")).first().p
    assert e == pytest.approx(1 - math.comb(8, 3) / math.comb(10, 3))


def test_curves(spark):
    rows = [(0.9, True), (0.8, False), (0.8, True), (0.1, False)]
    df = spark.createDataFrame(rows, "s double, ok boolean")
    pos, neg = [s for s, o in rows if o], [s for s, o in rows if not o]
    assert M.auroc(df, "s", "ok").first().auroc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 4)
    assert M.auroc(df.where("ok"), "s", "ok").first().auroc is None
    t = M.select_threshold(df, "s", "ok").first()
    assert (t.threshold, t.useful, t.false_answers) == (pytest.approx(0.45), 2, 1)
    r = {x.threshold: (x.n, x.risk) for x in M.risk_coverage(df, "s", "ok").collect()}
    assert r[0.8] == (3, pytest.approx(1 / 3))
    k = M.kappa(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "x string, y string"), "x", "y").first()
    assert k.n == 3 and k.kappa == pytest.approx(((2 / 3) - (4 / 9)) / (1 - 4 / 9))
    b = M.bootstrap_mean(df.withColumn("g", F.lit("g")), "g", "s", "s").first()
    assert b.low <= b["mean"] <= b.high


def test_incremental_sync_equals_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "doc string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "doc string, content_hash string")
    assert {r.doc: r.status for r in S.corpus_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    store = S.sync(old.select("doc", "content_hash", F.lit(1).alias("version"), F.lit("active").alias("status")), new)
    assert {(r.doc, r.content_hash) for r in store.where("status = 'active'").collect()} == {(r.doc, r.content_hash) for r in new.collect()}
    assert store.where("doc = 'b'").count() == 2 and S.sync(store, new).exceptAll(store).count() == 0


def test_events(spark):
    rows = [(1, "c", None, "A", 10), (2, "c", "A", "B", 20), (2, "c", "A", "B", 20), (3, "c", "X", "C", 5)]
    e = spark.createDataFrame(rows, "id int, case_id string, from_status string, to_status string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    d = E.first_delivery(e, ["id"])
    assert d.count() == 3
    assert [r.consistent for r in E.chained(d).orderBy("id").collect()] == [True, True, False]
    assert [r.late_us for r in E.late(d).collect()] == [15_000_000]
    assert E.final_states(d).first().status == "C"
    cases = spark.createDataFrame([("a", "o", None), ("b", "o", "a"), ("c", "o", "b"), ("d", "x", "c")], "case_id string, owner_id string, parent_case_id string")
    assert {(r.case_id, r.step, r.ancestor) for r in E.ancestors(cases).collect()} == {("b", 1, "a"), ("c", 1, "b"), ("c", 2, "a")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert I.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"x": 1}\nnope\n')
    with pytest.raises(Exception):  # noqa: B017
        I.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    assert I.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int", strict=False).count() == 1
    assert I.decode_bytes("病历".encode("gb18030")) == ("病历", "gb18030", "detected") and I.decode_bytes(b"\xff\xff")[1:] == ("utf-8", "fallback")
    assert I.decode_bytes("我們一起去學校".encode("big5"))[:2] == ("我們一起去學校", "big5")
    assert I.decode_bytes(b"a\xffb", "UTF8") == ("a\ufffdb", "utf-8", "declared") and I.decode_bytes(b"ab", "no-such")[2] == "detected"
    title, els = I.parse_html("<title>T</title><nav>x</nav><h2>A</h2><p>one<p>two<ul><li>i</ul><table><tr><th>n<th>v<tr><td>a<td>1</table><script>s</script>")
    assert title == "T" and els == [("heading", 2, "A"), ("paragraph", 0, "one"), ("paragraph", 0, "two"), ("list", 0, "i"), ("table_row", 0, "n：a；v：1")]
    req = spark.createDataFrame([("a",), ("b",)], "key string")
    own = spark.createDataFrame([("a", "1")], "key string, body string")
    base = spark.createDataFrame([("a", "0"), ("b", "2")], "key string, body string")
    assert {r.key: r.body for r in I.replayed(req, own, base).collect()} == {"a": "1", "b": "2"}
    with pytest.raises(Exception):  # noqa: B017
        I.replayed(req, own, own).collect()


def test_answers(spark):
    rows = [(True, ["a"], ["a"]), (True, ["b"], ["a"]), (False, None, ["a"]), (False, None, []), (True, ["a"], None), (None, None, None)]
    df = spark.createDataFrame(rows, "x boolean, cited array<string>, gold array<string>").select(F.lit("g").alias("g"), A.outcome(F.col("x"), F.col("cited"), F.col("gold")).alias("outcome"))
    assert [r.outcome for r in df.collect()] == ["correct", "wrong", "refused", "correct_refusal", "false_answer", "invalid"]
    f = A.answer_f1(df, ["g"]).first()
    assert (f.precision, f.recall) == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert A.answer_f1(df.where("outcome = 'invalid'"), ["g"]).first().f1 is None
    assert one(spark, "约12例，共5", A.change_number) == "约25例，共5" and one(spark, "无", A.change_number) == "无"
    heads = spark.createDataFrame([("d", 1, 1, "A"), ("d", 2, 2, "B"), ("d", 3, 3, "C"), ("d", 4, 2, "D")], "d string, o int, l int, t string")
    assert [r.path for r in A.section_paths(heads, "d", "o", "l", "t").orderBy("o").collect()] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    r = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("q", 3, True), ("p", 1, False)], "query_id string, rank int, relevant boolean")
    assert {x.query_id: x.context_precision for x in A.context_precision(r).collect()} == {"q": pytest.approx((1 + 2 / 3) / 2), "p": 0.0}


def test_catalogue_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
