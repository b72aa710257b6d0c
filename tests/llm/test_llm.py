import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import p01_canonical as p1
from quillspark.llm import p02_overlap as p2
from quillspark.llm import p03_encoding as p3
from quillspark.llm import p04_sentences as p4
from quillspark.llm import p05_page_body as p5
from quillspark.llm import p06_near_duplicates as p6
from quillspark.llm import p07_site_lines as p7
from quillspark.llm import p08_packing as p8
from quillspark.llm import p09_leakage as p9
from quillspark.llm import p10_residue as p10

META = "struct<title:string,content_kind:string>"
CHUNKS = f"chunk_id string, source string, source_id string, text string, metadata {META}, key string, doc string, line_no string, n string, cls string, host string"


def chunks(spark, rows, kind="web_page"):
    """rows: (chunk_id, source, source_id, text); further columns clash with names that operators use."""
    return spark.createDataFrame([(*r, (None, kind), "x", "x", "x", "x", "x", "x") for r in rows], CHUNKS)


ODD = [("n1", None, None, None), (None, "s", "d", "text"), ("e1", "s", "d1", ""), ("e2", "s", None, " \n \n"), ("r1", "s", "d2", "abc"), ("r1", "s", "d2", "abc")]
DOCS = "doc_id long, text string, key string, size long, shard int, n long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], DOCS)


def test_p1_forms():
    same = [("Ｈｅｌｌｏ １", "Hello 1"), ("Не", "He"), ("ﬁn", "fin"), ("⼈", "人"), ("a​b", "ab"), ("é", "é"), ("ӓ", "ä"), ("ｶﾞ", "ガ"), ("a b", "a b"), ("𝟸", "2"), ("更", "更"), ("µ", "μ"), ("a\tb", "a b")]
    for a, b in same:
        assert p1.canonical(a) == p1.canonical(b), (a, b)
    for a, b in [("A", "a"), ("10⁵", "105"), ("②", "2"), ("，", ","), ("½", "1/2"), ("a", "b")]:
        assert p1.canonical(a) != p1.canonical(b), (a, b)
    assert p1.canonical("") == ""


def test_p1_splicing_equals_whole_normalisation():
    rng = random.Random(2)
    alphabet = "aeＡé́̈​а人⼈ｶﾞカ゛ガ゙ क़़한한1²"
    table = p1._tables()[0]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert p1.canonical(t) == unicodedata.normalize("NFC", t.translate(table)), ascii(t)


def test_p1_pairs(spark):
    rows = [("a", "x y"), ("b", "x y"), ("c", "x y"), ("d", None), ("e", ""), ("f", "X y"), (None, "x y"), ("b", "x y")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "id string, text string, look int, raw int, rep int")
    assert {(r.key_a, r.key_b) for r in p1.lookalike_pairs(df, "id", "text").collect()} == {("a", "b"), ("b", "c")}
    assert p1.lookalike_pairs(df.limit(0), "id", "text").count() == 0
    assert p1.canonical_texts(df, "id", "text").where("canonical is null").count() == 1


def test_p2_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = rng.choice("xyz甲")
        rows.append((f"q{i:03d}", rng.choice(["train", "dev", "test", None]), rng.choice(["s", None]), "".join(t)))
    rows += [("n", "dev", "s", None), ("s", "dev", "s", "甲"), ("t", "train", "s", "甲"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "sample_id string, split string, source string, question string, key string, norm string")
    want = set()
    for a, sa, _, ta in rows:
        for b, sb, _, tb in rows:
            if sa == "train" and sb not in ("train", None) and ta and tb:
                u, v = p2.grams(p2.reduced(ta)), p2.grams(p2.reduced(tb))
                if u and v and len(u & v) / len(u | v) >= 0.7:
                    want.add((min(a, b), max(a, b)))
    assert {(r.sample_a, r.sample_b) for r in p2.found(df).collect()} == want and want
    norm = p2.reduced_questions(df)
    assert p2.record_pairs(norm, shard=7, part=11).count() == p2.record_pairs(norm).count()
    assert p2.found(df.limit(0)).count() == 0
    assert sum(r.questions for r in p2.report(df).collect()) == sum(1 for r in rows if r[1] in ("dev", "test") and r[3] is not None)


ZH = ["采自{}镇的样本里，检出率偏高。", "护士对{}县的孕妇说：“也要戒烟限酒。”", "为什么{}社区的青少年更容易得脚癣？"]


def garbled_corpus():
    rng = random.Random(4)
    rows = [(f"c{i}", "s", f"d{i}", "".join(s.format(rng.choice("甲乙丙丁") + rng.choice("云山水")) for s in ZH) + "\nDie Prüfung für Übelkeit im März. A café – “open” it.") for i in range(60)]
    clean = [r[3] for r in rows]
    bad = [clean[0].encode("utf-8").decode("latin-1"), clean[1].encode("gb18030", "replace").decode("latin-1"), clean[2].encode("utf-8").decode("gb18030", "replace"), clean[3].replace("Prüfung", "PrÃ¼fung"), clean[4].encode("gb18030").decode("utf-8", "replace"), clean[5].encode("gb18030").decode("big5", "replace"), clean[6].replace("für", "f�r")]
    return rows, [(f"g{i}", "s", f"e{i}", t) for i, t in enumerate(bad)]


def test_p3(spark):
    rows, bad = garbled_corpus()
    df = chunks(spark, rows + bad + [("so", "s", "x", "SÃO and Ærlø"), *ODD])
    assert {r.chunk_id for r in p3.found(df).collect()} == {b[0] for b in bad}
    back = {r.chunk_id: r.text for r in p3.restored_texts(df).collect()}
    assert back["g3"] == rows[3][3] and "检出率偏高" in back["g0"] and "检出率偏高" in back["g5"]
    assert back["g6"] == bad[6][3]
    assert p3.found(df.limit(0)).count() == 0
    p3.TABLE_LIMIT, keep = 0, p3.TABLE_LIMIT
    try:
        assert {r.chunk_id for r in p3.found(df).collect()} == {b[0] for b in bad}
    finally:
        p3.TABLE_LIMIT = keep


def test_p3_scripts_without_ascii(spark):
    texts = ["बुखार और खाँसी के रोगी अस्पताल में भर्ती हुए।", "пациенты посещали больницу каждую неделю", "οι ασθενείς πήγαν στο νοσοκομείο", "ذهب المرضى إلى المستشفى", "החולים הלכו לבית החולים"]
    clean = [(f"c{i}-{j}", "s", "d", t) for i, t in enumerate(texts) for j in range(8)]
    bad = [(f"g{i}", "s", "d", t.encode().decode("latin-1")) for i, t in enumerate(texts)]
    df = chunks(spark, clean + bad)
    assert {r.chunk_id for r in p3.found(df).collect()} == {b[0] for b in bad}
    back = {r.chunk_id: r.text for r in p3.restored_texts(df).collect()}
    assert "खाँसी" in back["g0"] or "अस्पताल" in back["g0"]


def test_p3_joined_restores_as_sent(spark):
    rows, bad = garbled_corpus()
    df = chunks(spark, rows + bad + [(None, "s", "z", bad[0][3]), bad[3], ("g3", "s", "z", bad[1][3]), *ODD])
    want = sorted((r.chunk_id or "", r.text) for r in p3.restored_texts(df).collect())
    p3.TABLE_LIMIT, keep = 0, p3.TABLE_LIMIT
    try:
        got = p3.restored_texts(df)
        assert got.columns == ["chunk_id", "text"]
        assert sorted((r.chunk_id or "", r.text) for r in got.collect()) == want and len(want) == len(bad) + 3
    finally:
        p3.TABLE_LIMIT = keep


def test_p3_chains_round_trip():
    for c in p3.CHAINS:
        g = p3.garbled("检出率", c)
        if g and "�" not in g and (r := p3.restored(g, c)) is not None:
            assert r == "检出率"


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("Dr. Ada of X saw 5.5 cases, e.g. at 7 a.m. Mr. B left. The end", ["Dr. Ada of X saw 5.5 cases, e.g. at 7 a.m.", "Mr. B left.", "The end"]),
        ("“Stop now!” said Ada. “Is it? Yes,” he told us.", ["“Stop now!” said Ada.", "“Is it? Yes,” he told us."]),
        ("甲说：“先停。再看！”随后走了。乙问：“好吗？”", ["甲说：“先停。再看！”随后走了。", "乙问：“好吗？”"]),
        ("护士说：“休息。”（以上共3条。）干咳……这些。", ["护士说：“休息。”", "（以上共3条。）", "干咳……这些。"]),
        ("—¿Debo ir? Sí —dijo Ana. ¡No vaya!", ["—¿Debo ir? Sí —dijo Ana.", "¡No vaya!"]),
        ("Am 3. März kam er. In X, z. B. nach 5 Tagen.", ["Am 3. März kam er.", "In X, z. B. nach 5 Tagen."]),
        ("ไข้หวัด 3 วัน พบแพทย์", ["ไข้หวัด 3 วัน", "พบแพทย์"]),
        ("ไข้หวัดพบแพทย์ ล้างมือ", ["ไข้หวัดพบแพทย์", "ล้างมือ"]),
        ("एक। दो? तीन", ["एक।", "दो?", "तीन"]),
        ("Heading\n\n  body. ", ["Heading", "body."]),
        ("「減塩は必要ですか。はい。」と答えた。終わり！", ["「減塩は必要ですか。はい。」と答えた。", "終わり！"]),
        ("Days. pH fell.", ["Days.", "pH fell."]),
        ("", []),
    ],
)
def test_p4_units(text, units):
    ends = p4.unit_ends(text, p4.Evidence({}, {}))
    assert [text[a:e].strip() for a, e in zip([0, *ends], ends)] == units


def test_p4_positions_skip_invisible():
    t = "On​e.​ Two."
    assert p4.unit_ends(t, p4.Evidence({}, {})) == [5, len(t)]


def test_p4_table(spark):
    df = chunks(spark, [("a", "s", "d", "One. Two."), *ODD], "verbatim_short_excerpt")
    assert {(r.chunk_id, r.end_pos) for r in p4.found(df).collect()} == {("a", 4), ("a", 9), ("r1", 3), (None, 4)}
    assert [r.sentence for r in p4.units(df, texts=True).where("chunk_id = 'a'").orderBy("seq").collect()] == ["One.", "Two."]
    assert p4.found(df.limit(0)).count() == 0


def test_p4_evidence_beyond_the_bound(spark):
    rows = [(f"a{i}", "s", "d", "They met gen. adams here, and lt. baker too. A visit to Xanten, as Xanten said, was short.") for i in range(20)]
    rows += [("t", "s", "d", "Then gen. Xanten left. So lt. Xanten stayed. Zed. Done."), (None, "s", "d", "See gen. Adams. End."), ("t", "s", "d", "Then gen. Xanten left. So lt. Xanten stayed. Zed. Done.")]
    df = chunks(spark, rows, "verbatim_short_excerpt")
    want = sorted((r.chunk_id or "", r.end_pos) for r in p4.units(df).collect())
    p4.MAX_EVIDENCE, keep = 1, p4.MAX_EVIDENCE
    try:
        assert sorted((r.chunk_id or "", r.end_pos) for r in p4.units(df).collect()) == want
    finally:
        p4.MAX_EVIDENCE = keep
    assert {e for c, e in want if c == "t"} == {22, 44, 49, 55}


def pages(n, host="h"):
    names = ["".join(p) for p in zip("甲乙丙丁戊己庚辛壬癸" * 6, "子丑寅卯辰巳午未申酉戌亥" * 5)]
    rng = random.Random(5)
    out = []
    for i in range(n):
        a, b = rng.choice(names) + str(i), rng.choice(names)
        a = "".join(chr(0x4E00 + (i * 37 + k) % 5000) for k in range(4))
        out.append((f"{host}{i:03d}", host, f"{host}d{i}", f"首页 新闻 联系\n{a}如何应对流感\n{a}的居民在{i}天后好转。\n更新时间：2024-{i % 12 + 1}-1\n相关阅读：{a}与{b}\n· {a}要点\n版权所有 {i}"))
    return out


def test_p5(spark):
    df = chunks(spark, pages(40) + ODD)
    got = defaultdict(set)
    for r in p5.found(df).collect():
        got[r.chunk_id].add(r.line_no)
    assert all(got[f"h{i:03d}"] == {0, 3, 4, 5, 6} for i in range(40))
    assert "r1" not in got
    assert p5.page_lines(df, block=7).where("furniture").count() >= 40 * 3
    body = {r.chunk_id: r.text for r in p5.bodies(df).where("chunk_id like 'h%'").collect()}
    assert all(t.count("\n") == 1 for t in body.values()) and len(body) == 40
    assert p5.found(df.limit(0)).count() == 0


def test_p5_suffix_ranks_order_suffixes():
    import numpy as np

    rng = random.Random(6)
    ids = np.array([rng.randrange(3) for _ in range(60)])
    r = p5.suffix_ranks(ids, 6)[-1]
    assert sorted(range(60), key=lambda i: ids[i:].tolist()) == np.argsort(r, kind="stable").tolist()
    ranks = p5.suffix_ranks(ids, 6)
    for i in range(0, 60, 7):
        for j in range(i + 1, 60, 5):
            k = 0
            while j + k < 60 and ids[i + k] == ids[j + k]:
                k += 1
            assert p5.common_prefix(ranks, np.array([i]), np.array([j]))[0] == k


def near_rows(n, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = [chr(0x4E00 + rng.randrange(3000)) for _ in range(200)]
        rows.append((f"k{i:03d}", "s", f"d{i}", "".join(t)))
        u = list(t)
        for _ in range(rng.randrange(1, 7)):
            u[rng.randrange(200)] = "改"
        rows.append((f"m{i:03d}", "s", f"d{i}" if i % 10 == 0 else f"f{i}", "".join(u)))
    return rows


def exact_pairs(rows, t=0.8):
    s = []
    for r in rows:
        q = p6.squashed(r[3] or "")
        if len(q) >= 5:
            s.append((r[0], r[2], {q[k : k + 5] for k in range(len(q) - 4)}))
    out = set()
    for i, (a, x, u) in enumerate(s):
        for b, y, v in s[:i]:
            if not (x is not None and x == y) and a != b and u & v and len(u & v) / len(u | v) >= t:
                out.add((min(a, b), max(a, b)))
    return out


def test_p6_recall_and_precision(spark):
    rows = near_rows(60)
    df = chunks(spark, rows + [r for r in ODD if r[0]] + [rows[0]])
    want = exact_pairs(rows)
    got = {(r.chunk_a, r.chunk_b) for r in p6.found(df).collect()}
    assert got == want and len(want) > 30
    assert {(r.chunk_a, r.chunk_b) for r in p6.found(df, node=1).collect()} == want
    g = {r.chunk_id: r.group_id for r in p6.groups(df).collect()}
    assert all(g[a] == g[b] for a, b in want)
    assert p6.found(df.limit(0)).count() == 0


def test_p6_copies_form_a_star(spark):
    t = "".join(chr(0x4E00 + i) for i in range(150))
    rows = [(f"c{i}", "s", f"d{i}", t if i % 2 else " ".join(t)) for i in range(5)] + [("v", "s", "dv", t[:140])]
    got = {(r.chunk_a, r.chunk_b) for r in p6.found(chunks(spark, rows)).collect()}
    assert got == {("c0", f"c{i}") for i in range(1, 5)} | {(f"c{i}", "v") for i in range(5)}


def test_p6_index_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    bits = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 63, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 30, dtype=np.uint64)) for _ in range(30))])
    order = np.argsort(p6.gray_rank(bits), kind="stable")
    b = bits[order]
    i, j = p6.node_pairs(b)
    want = {(x, y) for x in range(len(b)) for y in range(x + 1, len(b)) if bin(int(b[x] ^ b[y])).count("1") <= p6.MAX_BITS}
    assert set(zip(i.tolist(), j.tolist())) == want
    i, j = p6.node_pairs(b[:500], b[500:])
    assert set(zip(i.tolist(), (j + 500).tolist())) == {(x, y) for x, y in want if x < 500 <= y}
    assert (p6.bits_of(p6.gray_order(bits)) == bits).all()


def test_p7_against_a_loop(spark):
    rng = random.Random(9)
    lines = ["Menu", "菜单 12", "a" * 300, "b" * 70 + "x", "", "  ", "12 34", "ÄB c"]
    rows = [(f"c{i}", rng.choice(["s", "t", None]), rng.choice([f"d{i % 17}", None]), "\n".join(rng.choice([*lines, f"unique {i} line"]) for _ in range(6))) for i in range(80)]
    docs = defaultdict(set)
    for _, s, d, t in rows:
        for x in t.split("\n"):
            if d is not None:
                docs[s, p7.line_form(x)].add(d)
            else:
                docs[s, p7.line_form(x)].add("null")
    want = {(c, n) for c, s, _, t in rows for n, x in enumerate(t.split("\n")) if p7.line_form(x) and len(docs[s, p7.line_form(x)]) >= 6}
    df = chunks(spark, rows + [r for r in ODD if r[0] in ("n1", "e1", "e2")])
    assert {(r.chunk_id, r.line_no) for r in p7.repeated_lines(df).collect()} == want
    assert {(r.chunk_id, r.line_no) for r in p7.repeated_lines(df, key_limit=0).collect()} == want
    clean = {r.chunk_id: (r.text, r.removed) for r in p7.without_repeated_lines(df).collect()}
    assert all(clean[c][1] == sum(k == c for k, _ in want) for c, *_ in rows) and clean["n1"] == (None, 0)
    assert p7.repeated_lines(df.limit(0)).count() == 0


def test_p8(spark):
    rng = random.Random(10)
    rows = [(i, "x" * rng.randrange(0, 900)) for i in range(300)] + [(300, None), (301, "y" * 5000), (1, "again"), (None, "z")]
    df = documents(spark, rows)
    for caps in ([1000], [500, 1000, 4000]):
        for tokens in (10_000, 10**9):
            got = p8.packed(df, [("p", caps)], tokens).collect()
            load = Counter()
            for r in got:
                load[r.container_id] += r.n_tokens
                assert r.capacity_tokens in caps and r.container_tokens <= r.capacity_tokens
            assert all(load[r.container_id] == r.container_tokens for r in got)
            placed = Counter()
            for r in got:
                placed[r.doc_id] += r.n_tokens
            want = Counter()
            for d, t in rows:
                if t is not None:
                    want[d] += len(t.encode()) + 1
            assert placed == want
            assert all(r.piece_no == 0 for r in got if r.doc_id != 301)
    used = p8.pack([len(t or "") + 1 for _, t in rows], [1000])
    assert sum(r[3] for r in used) / (1000 * (1 + max(r[4] for r in used))) > 0.98
    assert p8.packed(df.limit(0), [("p", [10])]).count() == 0 and p8.packed(df, [("p", [])]).count() == 0


def test_p9(spark):
    rng = random.Random(11)
    item = "".join(rng.choice("abcdefghij甲乙丙") for _ in range(180))
    rows = [(1, "x" + item[30:80].upper() + "y"), (2, item[30:79]), (3, ", ".join(item[100:170])), (4, None), (5, ""), (1, "x" + item[30:80].upper() + "y"), (None, "q")]
    items = spark.createDataFrame([(7, item, "x"), (8, "short", "x"), (9, None, "x"), (7, item, "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    df = documents(spark, rows)
    assert {(r.doc_id, r.item_id) for r in p9.leaks(df, items).collect()} == {(1, 7), (3, 7)}
    assert {(r.doc_id, r.item_id) for r in p9.leaks(df, items, block_limit=2).collect()} == {(1, 7), (3, 7)}
    s = {r.doc_id: (r.start_pos, r.end_pos) for r in p9.leaks(df, items, spans=True).collect()}
    assert s[1] == (1, 51)
    assert p9.leaks(df, items.limit(0)).count() == 0 and p9.leaks(df.limit(0), items).count() == 0


def test_p10(spark):
    prose = [(i, f"护士对第{i}社区的孕妇说：“入秋以后也要戒烟限酒。”随访系统基于 JavaScript 编写。 Nurses met {i} older adults with dry cough after 404 days.") for i in range(200)]
    bad = [(900, "待补充内容。测试数据勿删。"), (901, prose[0][1] + "\n{{ page.title }}\n" + prose[1][1]), (902, "HTTP 404\nNot Found"), (903, "Please enable JavaScript to continue."), (904, "尊敬的XXX用户，您在____医院预约的项目为____。"), (905, "会话已过期，请重新登录"), (906, "[object Object]")]
    df = documents(spark, prose + bad + [(990, None), (991, ""), (None, "ok"), (5, prose[5][1])])
    assert {r.doc_id for r in p10.found(df).collect()} == {b[0] for b in bad}
    assert p10.found(df.limit(0)).count() == 0


def test_p10_frequent_residue(spark):
    prose = [(i, f"Nurses met older adults in ward {chr(97 + i % 26)}{chr(97 + i // 26)} and " + "".join(chr(0x4E00 + (i * 53 + k * 7) % 4000) for k in range(1500))) for i in range(600)]
    notice = [(1000 + i, f"Please enable JavaScript to continue. {i}") for i in range(3000)]
    df = documents(spark, prose + notice)
    assert {r.doc_id for r in p10.found(df).collect()} == {r[0] for r in notice}


def test_windows_are_maximal_sums():
    import numpy as np

    s = np.array([-0.8, 5, 5, -0.8, 5, *[-0.8] * 30, 9.5, -0.8])
    assert [(a, b) for a, b, _ in p10.windows(s, 9.0)] == [(1, 5), (35, 36)]


def test_p10_places_and_coverage():
    import numpy as np

    t = "İX 2024-05 {{ page.title }} Ω99"
    assert len(p10.places(t)) == len(p10.shaped(t))
    assert [t[i].lower()[0] for i in p10.places(t)[:3]] == [p10.shaped(t)[0], t[0].lower()[0], "x"]
    assert p10.covered([(0, 5, 9.0, 0), (3, 8, 9.0, 1), (20, 21, 9.0, 0)]) == 9
    m = p10.Model(np.array([1], np.uint64), np.zeros((2, 1)))
    assert m.spans("") == [] and m.spans("a") == []


def test_p10_models_find_phrases_of_families_they_never_saw(spark):
    """Every fifth family of either grammar is kept from the models; documents that hold its phrases must come out nevertheless."""
    prose = [(i, f"Nurses met older adults with dry cough in ward {i}. 护士对第{i}社区的孕妇进行随访，入秋以后也要戒烟限酒。") for i in range(300)]
    parts = [[x.strip().split("\n") for x in (p10.FILLER, p10.NOTICES)], [[], []]]
    held = []
    for m in (0, 1):
        parts[1][m] = [x for k, x in enumerate(parts[0][m]) if k % 5 != 2]
        held += [x for k, x in enumerate(parts[0][m]) if k % 5 == 2]
    rows = [(1000 + k, prose[k][1] + "\n" + p10.phrases(x)[0][0] + "\n" + prose[k + 1][1]) for k, x in enumerate(held)]
    df = documents(spark, prose + rows)
    model = p10.fit(df, "\n".join(parts[1][0]), "\n".join(parts[1][1]))
    hit = sum(p10.covered(model.spans(t)) >= p10.COVER for _, t in rows)
    print("held-out families found:", hit, "of", len(rows))
    assert hit >= 0.6 * len(rows)
    assert not any(model.spans(t) for _, t in prose)


def test_p3_scripts_rare_words_and_frequent_garbling(spark):
    """Russian, Greek and Hindi stretches are restored, a word seen once gives forms, and a garbling more frequent than its original is found."""
    clean = ["Врач советует регулярно измерять давление", "Ο γιατρός συνιστά τακτικό έλεγχο της πίεσης", "डॉक्टर नियमित जाँच की सलाह देते हैं", "Die Fußgängerbrücke bleibt offen"]
    rows = [(f"c{i}", "s", f"d{i}", t) for i, t in enumerate(clean * 6)]
    rows.append(("once", "s", "d", "Selten: Zürichseeüberfahrt"))
    bad = [(f"g{i}", "s", f"e{i}", t.encode().decode("latin-1")) for i, t in enumerate(clean[:3])]
    often = [(f"m{i}", "s", f"m{i}", "ZÃ¼richseeÃ¼berfahrt") for i in range(40)]
    df = chunks(spark, rows + bad + often)
    assert {r.chunk_id for r in p3.found(df).collect()} == {b[0] for b in bad + often}
    back = {r.chunk_id: r.text for r in p3.restored_texts(df).collect()}
    assert [back[f"g{i}"] for i in range(3)] == clean[:3] and back["m0"] == "Zürichseeüberfahrt"


def test_p4_document_overrules_corpus_and_lists():
    from collections import Counter

    ev = p4.Evidence({"foo": (0, 500, 500), "bar": (300, 0, 0), "abc": (0, 0, 400)}, {})
    assert ev.kind("dr", Counter()) == "never" and ev.kind("dr", Counter({("dr", "eol"): 5})) == "word"
    assert ev.kind("foo", Counter()) == "word" and ev.kind("foo", Counter({("foo", "low"): 9})) == "mixed"
    assert ev.kind("bar", Counter()) == "never" and ev.kind("bar", Counter({("bar", "eol"): 2})) == "word"
    assert ev.kind("abc", Counter({("abc", "low"): 1, ("abc", "eol"): 1})) == "mixed" and ev.kind("unseen", Counter()) == "word"


def test_p4_tokens_and_brackets_of_any_length():
    long = "x" * 500
    assert p4.token_of("see " + long) == long and p4.token_of("z.B") == "z.b" and p4.token_of("a..b.c") == "b.c" and p4.token_of("e.") == "" and p4.token_of("") == ""
    assert p4._protected("(" * 20_000 + "a)") == [] or len(p4._protected("((a) b)")) == 1


def test_p5_blocks_and_long_lines(spark):
    """Blocks of any size give the same lines, and lines that share their first 1,100 tokens but differ after them stay apart."""
    rng = random.Random(12)
    same = " ".join(f"word{rng.randrange(50)}a" for _ in range(1100))
    rows = []
    for i in range(240):
        own = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30)) + "."
        long = same + " " + " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(20)) + "." if i < 12 else own
        rows.append((f"h{i:03d}", "s", f"d{i}", f"Home Search Contact\n{long}\nWe use cookies to make this site work for you, visitor {chr(97 + i % 26)}\n{own[::-1]}"))
    df = chunks(spark, rows)
    got = [{(r.chunk_id, r.line_no) for r in p5.page_lines(df, block=b).where("furniture").collect()} for b in (2000, 80, 40)]
    assert got[0] == got[1] == got[2]
    assert {(f"h{i:03d}", 0) for i in range(240)} <= got[0] and not any(n in (1, 3) for _, n in got[0])


def test_p1_line_ends_and_rare_blanks():
    for odd in ("a\r\nb", "a\rb", "a\x0cb", "a\u2028b", "a\x85b"):
        assert p1.canonical(odd) == "a\nb"
    assert p1.canonical("葛\U000e0100城") == "葛城" and p1.canonical("a\u3164b\u2800c") == "a b c" and p1.canonical("a b") != p1.canonical("a\nb")
