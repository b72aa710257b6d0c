"""Findings of round 2: what is staged or shuffled stays small, results stay whole."""

import os
from itertools import combinations

import pytest

from quillspark import catalog
from quillspark.operators import dedup as D
from quillspark.operators import pipeline as P
from quillspark.operators import rank as K


TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def staged_rows(monkeypatch):
    """Rows of every table that an operator of `dedup` stages."""
    rows, keep = [], D.staged

    def staged(df, name):
        out = keep(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(D, "staged", staged)
    return rows


def _texts(n: int) -> list[str]:
    return ["".join(chr(0x4E00 + (i * 7919 + j * (31 + i)) % 9000) for j in range(120)) for i in range(n)]


def test_similar_pairs_stages_candidates_only(spark, staged_rows):
    texts = _texts(60)
    texts += [texts[0][:-3] + "甲乙丙", texts[1]]
    pairs = D.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()
    assert [(r.a, r.b) for r in pairs] == [(0, 60)]
    assert max(n for _, n in staged_rows) <= 2  # texts without a partner are staged in no form


def test_similar_pairs_equal_brute_force(spark):
    base = _texts(3)
    texts = [b[: 120 - k] + chr(0x5000 + k) * (k % 4) for b in base for k in range(0, 30, 3)] + ["短", "短文本", "短文本一二", "短文本一二三", "𠀀𠀁𠀂𠀃𠀄𠀅"]

    def grams(x):
        return {x[i : i + 5] for i in range(max(1, len(x) - 4))}

    want = {(a, b): len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for (a, x), (b, y) in combinations(enumerate(texts), 2)}
    got = D.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()
    assert {(r.a, r.b): pytest.approx(r.similarity) for r in got} == {k: v for k, v in want.items() if v >= D.THRESHOLD}


def _corpus(spark):
    docs = [(f"d{i:03}", [f"t{(i * j) % 17}" for j in range(1, 4 + i % 9)] + ["all"]) for i in range(150)] + [("e", []), ("n", None)]
    asks = [("q1", ["t3", "t3", "all"]), ("q2", ["t5", "none"]), ("q3", ["none"]), ("q4", [f"t{i}" for i in range(17)])]
    return spark.createDataFrame(docs, "id string, tokens array<string>"), spark.createDataFrame(asks, "query_id string, tokens array<string>")


def _ranking(df):
    return {(r.query_id, r["rank"]): (r.id, pytest.approx(r.score, abs=1e-9)) for r in df.collect()}


@pytest.mark.parametrize("limit", [1_500_000, 8])
def test_bm25_top_ranks_as_all_pairs_do(spark, limit, monkeypatch):
    docs, asks = _corpus(spark)
    want = {(r.query_id, r["rank"]): (r.id, r.score) for r in K.top(K.bm25(docs, asks), 7).collect()}
    monkeypatch.setattr(K.best_sums, "__defaults__", (1.0, True, limit))
    got = K.bm25_top(docs, asks, 7)
    assert _ranking(got) == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["bm25_topk", "bm25_normalised", "hybrid_linear_topk", "rrf_fuse", "graded_metrics", "judgment_pool", "rank_metrics", "paired_compare", "bootstrap_mean"])
def test_no_row_for_every_pair_of_query_and_document(spark, monkeypatch, name):
    def fail(*args, **kwargs):
        raise AssertionError("a row a pair")

    monkeypatch.setattr(K, "bm25", fail)
    monkeypatch.setattr(K, "coverage", fail)
    catalog.queries()[name](spark, TABLES).collect()


@pytest.mark.parametrize("sent", [20_000, 0])
def test_contained_moves_no_pieces_of_the_large_side(spark, monkeypatch, sent):
    monkeypatch.setattr(P, "SENT", sent)
    needles = spark.createDataFrame([("流感",), ("感",), (None,), ("a\nb",), ("𠀀𠀁",), ("流感",)], "v string")
    hays = spark.createDataFrame([("儿童流感与流感疫苗",), ("流",), (None,), ("xa\nbc",), ("甲𠀀𠀁乙",)], "t string")
    got = P.contained(needles, hays, "v", "t")
    assert sorted((r.needle, r.hay) for r in got.collect()) == sorted([("流感", "儿童流感与流感疫苗"), ("a\nb", "xa\nbc"), ("𠀀𠀁", "甲𠀀𠀁乙")])
    if sent:
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_many_names_inside_few_keywords_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(P, "SENT", 5)
    names = spark.createDataFrame([(f"甲乙{i}",) for i in range(10)], "name string")
    got = P.contained(names, spark.createDataFrame([("前甲乙7后",)], "keyword string"), "name", "keyword")
    assert [(r.needle, r.hay) for r in got.collect()] == [("甲乙7", "前甲乙7后")]
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [500, 0])
def test_topics_stage_keywords_but_no_names(spark, monkeypatch, most):
    rows, keep = [], P.staged
    monkeypatch.setattr(P, "staged", lambda df, name: (out := keep(df, name), rows.append(out.count()))[0])
    monkeypatch.setattr(P, "KEYWORDS", most, raising=False)
    values = ["流感疫苗", "糖尿病", "痛", None]
    names = [(f"d{i}", f"别的名称{i}") for i in range(40)] + [("a", "儿童流感疫苗接种"), ("b", "感疫苗"), ("c", "流感"), ("d", "空腹血糖"), ("e", None), ("a", "儿童流感疫苗接种")]
    aliases = spark.createDataFrame([("糖尿病", "血糖"), ("流感", "感冒")], "alias string, target string")
    got = P.resolved_topics(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(names, "doc string, name string"), aliases)
    assert sorted(map(tuple, got.collect())) == [("流感疫苗", "a"), ("流感疫苗", "b"), ("糖尿病", "d")]
    if most:
        assert rows == [4]


def test_few_long_hays_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(P, "SENT_CHARS", 10_000, raising=False)
    needles = spark.createDataFrame([("乙丙",)], "v string")
    hay = "".join(chr(0x4E00 + i) for i in range(300)) + "乙丙"
    got = P.contained(needles, spark.createDataFrame([(hay,)], "t string"), "v", "t")
    assert [(r.needle, r.hay) for r in got.collect()] == [("乙丙", hay)]
    assert got._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == 1  # of the needles alone


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_document_dedup_stages_no_text_without_partner(spark, staged_rows):
    rows = catalog.queries()["document_dedup"](spark, TABLES).count()
    search = {"candidates", "asked", "asked-texts"}
    assert {x for x, _ in staged_rows if not x.startswith("greedy")} == search
    assert sum(n for x, n in staged_rows if x in search) < rows


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_document_dedup_decides_only_ids_in_pairs(spark, staged_rows):
    rows = catalog.queries()["document_dedup"](spark, TABLES).count()
    assert max(n for x, n in staged_rows if x.startswith("greedy")) < rows / 2
    assert sum(x == "greedy-pairs" for x, _ in staged_rows) == 1


def test_greedy_keep_passes_ids_without_pairs_and_pairs_without_ids(spark):
    ids = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (5, 0)], "id int, o int")
    pairs = spark.createDataFrame([(2, 3), (3, 9)], "a int, b int")
    assert sorted(map(tuple, D.greedy_keep(ids, pairs, "o").collect())) == [(1, 1), (2, 2), (3, 2), (5, 5)]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_paragraphs_are_split_without_a_shuffle_of_texts(spark, monkeypatch):
    seen, keep = [], D.similar_pairs

    def similar_pairs(df, *args, **kwargs):
        seen.append(df)
        return keep(df, *args, **kwargs)

    monkeypatch.setattr(D, "similar_pairs", similar_pairs)
    catalog.queries()["paragraph_duplicates"](spark, TABLES).collect()
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_p10_labels_lines_of_all_documents(spark):
    p10 = pytest.importorskip("quillspark.llm.p10_residue")
    words = [a + b for a in ("zorblat", "quixfen", "vumptro", "jaskwel") for b in ("ix", "omu", "erd")]
    rows = [(k, f"lorem {w} {tail} ipsum") for k, (w, tail) in enumerate((w, x) for w in words for x in ("dolor", "amet"))]
    prose = spark.range(100, 16_100).selectExpr("id as doc_id", "concat('Rain fell on day ', id, ' of the year') as text")
    model = p10.fit(spark.createDataFrame(rows, "doc_id bigint, text string").union(prose))
    keys = set(model.keys.tolist())
    assert all(g in keys for w in words for g in p10._grams(w).tolist() if g)


P10_TEXTS = ["", "a", "abc", "abcd", "abcde", "中文", "中文字\n第12行\n\n", "1a１2", "ΑΣ", "ΑΣ1 ΑΣ", "{{ name", "}} [[x y]] __ab__", "\x00\n404 not found\n", "The page\nthe page you requested\nThe page"]


def test_p10_texts_side_by_side_have_the_n_grams_of_each(monkeypatch):
    np, p10 = pytest.importorskip("numpy"), pytest.importorskip("quillspark.llm.p10_residue")
    made, keep = [], p10._hashes
    monkeypatch.setattr(p10, "_hashes", lambda a: made.append(len(a)) or keep(a))
    texts = P10_TEXTS * 40
    got = [(chars[edges[k] + 1 : edges[k + 1]], g[edges[k] + 1 : edges[k + 1]], g[edges[k + 1]]) for which, chars, edges, g in p10.chunked(texts) for k in range(len(which))]
    assert len(made) < len(texts) / 100  # made for many texts at once, not a text at a time
    assert len(got) == len(texts)
    for t, (chars, g, beyond) in zip(texts, got, strict=True):
        shaped = p10.shaped(t)
        assert "".join(map(chr, chars)) == shaped and beyond == 0
        assert g.tolist() == p10._grams(shaped).tolist()
    model = p10.Model(np.array(sorted(set(p10._grams("the page you requested").tolist()) - {0}), np.uint64), np.full((2, 18), 4.0))
    alone = [(k, x) for k, t in enumerate(texts) if (x := model.spans(t))]
    assert alone == list(model.all_spans(texts)) and len(alone) == 40


def test_p10_counts_equal_brute_force(spark):
    np, p10 = pytest.importorskip("numpy"), pytest.importorskip("quillspark.llm.p10_residue")
    keys = np.array(sorted({g for t in ("the page you requested", "404 not found", "第12行") for g in p10._grams(p10.shaped(t)).tolist()} - {0}), np.uint64)
    place = {int(g): k for k, g in enumerate(keys)}
    n, total, lines = {}, 0, {}
    for t in P10_TEXTS * 3:
        shaped = p10.shaped(t)
        grams = p10._grams(shaped).tolist()
        total += len(shaped)
        at = 0
        for line in shaped.split("\n"):
            own = grams[at : at + len(line) + 1]
            at += len(line) + 1
            held = [place[g] for g in own if g in place]
            if held:
                total -= len(line)
                full = [g for g in own if g]
                if not (len(full) >= p10.FEW and len(held) >= p10.KNOWN * len(full)):
                    lines.setdefault(line, held)
    for line, held in lines.items():
        total += len(line)
        for k in held:
            n[k] = n.get(k, 0) + 1
    got = {r.gram: (r.n, r.total) for r in p10.gram_counts(spark.createDataFrame(list(enumerate(P10_TEXTS * 3)), "doc_id int, text string"), keys, np.ones(len(keys), bool)).collect()}
    assert got.pop(-1) == (0, total)
    assert got == {k: (v, 0) for k, v in n.items()} and n
