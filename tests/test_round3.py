"""Findings of round 3: queries do their whole job."""

import os
import random

import pytest

from quillspark import catalog
from quillspark.operators import metrics as M
from quillspark.operators import rank as K
from quillspark.plans import retrieval as R
from quillspark.registry import table

TABLES = "/root/testdata/sf0.001"


def _corpus(spark):
    docs = [(f"d{i:03}", [f"t{(i * j) % 17}" for j in range(1, 4 + i % 9)] + ["all"]) for i in range(150)] + [("e", []), ("n", None)]
    asks = [("q1", ["t3", "t3", "all"]), ("q2", ["t5", "none"]), ("q3", ["none"]), ("q4", [f"t{i}" for i in range(17)]), ("q5", ["all", "t1"]), ("q6", ["t2", "t7"])]
    return spark.createDataFrame(docs, "id string, tokens array<string>"), spark.createDataFrame(asks, "query_id string, tokens array<string>")


@pytest.mark.parametrize(("rows", "part"), [(10_000, 1_000), (40, 7), (150, 150)])
def test_bm25_reached_has_every_gold_among_the_best(spark, rows, part):
    docs, asks = _corpus(spark)
    ids = [f"d{i:03}" for i in range(150)] + ["e", "n", "missing"]
    best = {(r.query_id, r.id): r["rank"] for r in K.bm25_top(docs, asks, 7).collect()}
    for step in (1, 11, 37):
        pairs = [(f"q{q}", i) for q in range(1, 7) for i in ids[q::step]]
        gold = spark.createDataFrame(pairs, "query_id string, id string")
        got = {(r.query_id, r.id): r["rank"] for r in K.bm25_reached(docs, asks, gold, 7, rows, part).collect()}
        assert {p: got.get(p) for p in pairs} == {p: best.get(p) for p in pairs}
        assert got.items() <= best.items()


def test_bm25_reached_ranks_few_queries(spark):
    docs, asks = _corpus(spark)
    last = max((r.id for r in K.bm25(docs, asks).where("query_id = 'q1'").orderBy("score").limit(1).collect()))
    gold = spark.createDataFrame([("q1", last), ("q3", "d001")], "query_id string, id string")
    assert K.bm25_reached(docs, asks, gold, 7).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1023, 1024, 1025, 20_000])
def test_draws_are_those_of_pythons_generator(n):
    r = random.Random(5)
    assert [at.tolist() for at in M._draws(n, 4, 5)] == [[r.randrange(n) for _ in range(n)] for _ in range(4)]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_bootstrap_mean_takes_every_question(spark):
    q = table(spark, TABLES, "queries").selectExpr("sample_id as query_id", "split", "question", "gold_evidence_ids")
    gold = q.selectExpr("query_id", "explode(gold_evidence_ids) as id")
    asks = q.select("query_id", R.T.token_bag(R.F.col("question")).alias("tokens"))
    per = M.per_query(K.top(K.bm25(R.docs(spark, TABLES), asks), 10), gold).join(q, "query_id").orderBy("query_id").collect()
    want = {}
    for split in {r.split for r in per}:
        v, draw = [r.rr for r in per if r.split == split], random.Random(0)
        means = sorted(sum(v[draw.randrange(len(v))] for _ in v) / len(v) for _ in range(2000))
        want[split] = (sum(v) / len(v), means[50], means[1949])
    got = catalog.queries()["bootstrap_mean"](spark, TABLES).collect()
    assert {r.split: (r["mean"], r.low, r.high) for r in got} == want and len(want) > 1


def _kept(docs):
    """The kept row of each document by definition: every document against all kept ones before it."""

    def grams(x):
        x = "".join(x.split())
        return {x[i : i + 5] for i in range(max(1, len(x) - 4))}

    kept, out = [], {}
    for id_, text, level in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[2] or "level_9", -d[1].count("\n"), d[0])):
        g = grams(text)
        out[id_] = next((k for k, o in kept if len(g & o) / len(g | o) >= 0.85), id_)
        if out[id_] == id_:
            kept.append((id_, g))
    return out


def test_document_dedup_has_a_row_for_every_copy(spark, tmp_path):
    base = ["".join(chr(0x4E00 + (i * 7919 + j * (31 + i)) % 9000) for j in range(120)) for i in range(6)]
    docs = [(f"a{i}{k}", b[: 120 - k], f"level_{1 + (i + k) % 4}") for i, b in enumerate(base) for k in range(0, 15, 3)]
    docs += [("z0", base[0], "level_0"), ("z1", base[0] + " ", None), ("z2", base[1][:60] + "\n" + base[1][60:], "level_1"), ("z3", base[2][:111], "level_0"), ("z4", base[2][:111], "level_1"), ("z5", base[3], "level_1"), ("z6", base[3], "level_1")]
    docs += [("e0", "", "level_2"), ("e1", " ", "level_1"), ("n", None, "level_0"), ("s0", "短", None), ("s1", "短 ", None), ("s2", "短短", None)]
    spark.createDataFrame(docs, "chunk_id string, text string, evidence_level string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = catalog.queries()["document_dedup"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs) - 1
    assert {r.id: r.kept_as for r in got} == _kept(docs)


def test_topic_resolution_takes_titles_with_brackets(spark, tmp_path):
    titles = [("a", "儿童流感（2020年版）"), ("b", "大流行性疾病（流感）"), ("c", "空腹检查 (血糖)"), ("d", "高血压（含流感附件）"), ("e", "流感疫苗"), ("f", None), ("g", "（试行）"), ("h", "预防（感冒）指南")]
    spark.createDataFrame(titles, "document_id string, title string").write.parquet(f"{tmp_path}/sources.parquet")
    spark.createDataFrame([({"topic": "流感"},), ({"topic": "糖尿病"},), ({"other": "高血压"},), (None,)], "expected_filters map<string,string>").write.parquet(f"{tmp_path}/queries_authored.parquet")
    got = sorted(map(tuple, catalog.queries()["topic_resolution"](spark, str(tmp_path)).collect()))
    assert got == [("流感", "a"), ("流感", "b"), ("流感", "e"), ("流感", "h"), ("糖尿病", "c")]
