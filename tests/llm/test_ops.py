"""Each operation against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import check

from geoloom.llm import decontamination, entries, hilbert_pack, html_text, language_id, orc_tokens, parity_join, pii, runtime, sharding, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "Ünï \x1c<|endoftext|> it's 42!! 日本"), (6, "a b c d e f g " * 3000), (7, "a b c d e f g " * 3000), (8, "1d10t")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i != 4 else None, "s", 0, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return runtime.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {i: np.array([*e.ids, 1], "<u4") for i, e in zip(texts, t.encode_batch(list(texts.values()), add_special_tokens=False))}


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.default_path()), tokens.ChunkEncoder(max_pieces=50)
    samples = ["", "It's THE Σ ΑΣ é́ \x85x \x1c y", "<|endoftext|>a", "½² ..!?'re 'LL日本", *(t for _, t in ODD if t)]
    for _ in range(2):
        for text, got in zip(samples, e.encode(samples)):
            assert got.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_op1(spark, ids):
    p = hilbert_pack.op1(spark, SF).toPandas()
    for r in p.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert p.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(np.r_[0, g.length.to_numpy()[:-1]])).all()
        assert (n := g.length.sum()) <= 2048 and n & (n - 1) == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert_pack.hilbert_index(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_pack_odd(odd, empty):
    p = hilbert_pack.pack_documents(odd).toPandas()
    assert p.length.sum() == sum(len(x) for x in tokens.ChunkEncoder().encode([t or "" for _, t in ODD])) and all(len(r.ids) == r.length for r in p.itertuples())
    assert hilbert_pack.pack_documents(empty).count() == 0


def test_op2(spark, ids, odd, empty):
    start = 0
    for r in sorted(orc_tokens.op2(spark, SF).collect()):
        x = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        orc_tokens.write_tokens(docs, path := runtime.new_path(spark, "odd"))
        assert orc_tokens.read_tokens(spark, path).count() == n
    assert orc_tokens.read_tokens(spark, path, [4]).count() == 0


def test_op3_learns_and_restores(spark):
    docs, labels = (runtime.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    p = toxicity.op3(spark, "/root/testdata/sf0.1").join(labels, "doc_id").toPandas()
    held = p[p.held_out]
    assert (held.predicted == held.toxic).mean() > 0.96 and held[held.toxic == 0].predicted.mean() < 0.01
    restorer = toxicity.Restorer(toxicity.character_model(docs.limit(500)))
    for odd, plain in (("m0ron", "moron"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("$cum", "scum"), ("p@thetic", "pathetic")):
        assert plain in restorer.words(odd)


def test_op3_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == len(ODD) and toxicity.score_toxicity(empty, labels).count() == 0
    kept = toxicity.reject_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def brute_components(texts, words, num, den):
    sets, holders = {}, defaultdict(list)
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_op4(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.op4(spark, SF).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_op4_edited_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 400, 160)]
    rows = {}
    for i in range(150):
        w = list(base[: 60 + 100 * (i % 2)])
        for at in rng.integers(0, len(w), rng.integers(0, 5)):
            w[at] = f"x{rng.integers(0, 9)}"
        rows[i] = " ".join(w)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for words, num, den in ((4, 85, 100), (5, 4, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.link_documents(docs, words, num, den).collect()}
        assert got == brute_components(rows, words, num, den)


def test_op4_odd(odd, empty):
    got = [tuple(r) for r in parity_join.link_documents(odd).collect()]
    assert len(got) == len(ODD) and (7, 7, 6) in got and (2, 0, 2) in got and got.count((4, 1, 4)) == 2
    kept = parity_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 8}
    assert parity_join.link_documents(empty).count() == 0


def test_blocks_suffice():
    b = parity_join.Bands(85, 100)
    for n in [*range(1, 300), 5000]:
        mine = dict(b.of(n))
        for m in range(-(-n * 85 // 100), n + 1):
            k = b.blocks(m)
            assert k == 0 or (k in mine and k in dict(b.of(m)) and mine[k] >= k - b.most(m) - (b._largest(k) - m) and mine[k] > 0)


def test_op5(spark, texts, odd, empty):
    p = sharding.op5(spark, SF).toPandas()
    assert len(p) == len(texts) and set(p.law) == {"key"} and ((p.grown_shard == p.shard) | (p.grown_shard == 8)).all()
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for r in p.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    small = sharding.shard_documents(odd, bucket_bytes=1000)
    assert small.count() == len(ODD) and sorted(r.slot for r in small.where("shard = 0").collect()) == list(range(small.where("shard = 0").count()))
    assert sharding.shard_documents(empty).count() == 0


def test_op6(spark, docs, odd, empty):
    p = language_id.op6(spark, SF).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    held = p[p.held_out & (p.n_chars > 100)]
    assert (held.lang_pred == held.lang).mean() > 0.95
    got = {r.doc_id: r.lang_pred for r in language_id.identify_language(odd).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[6] == "en"
    assert language_id.identify_language(empty).count() == 0


def test_suffix_automaton_phrases():
    rng = np.random.default_rng(2)
    train, text = ("".join("ab c"[k] for k in rng.integers(0, 4, n)) for n in (60, 90))
    train, text = " ".join(train.split()), " ".join(text.split()) + "d"
    parser = language_id.CrossParser({"x": train})
    n, at = 1, 0
    for k in range(len(text)):
        if text[at : k + 1] not in train:
            n, at = n + 1, (k if text[k] in train else k + 1)
    assert parser.phrases([text])[0, 0] == n


def test_op7(spark, texts, odd, empty):
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: r.text for r in runtime.table(spark, SF, "benchmark").collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if words(b) in words(t)}
    assert exact <= {(r.doc_id, r.item_id) for r in decontamination.op7(spark, SF).collect()}
    benchmark = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(40))), (2, None), (3, ""), (4, "a b")], "item_id long, text string")
    copy = " ".join(f"word{k}" if k % 5 else f"other{k}" for k in range(40))
    leaky = odd.select("doc_id", "text").union(spark.createDataFrame([(99, f"before it {copy} and after")], "doc_id long, text string"))
    (r,) = decontamination.find_leaks(leaky, benchmark, block_items=2).collect()
    assert (r.doc_id, r.item_id) == (99, 1) and 0.5 < r.score < 1
    assert decontamination.drop_leaks(odd, benchmark).count() == len(ODD) and decontamination.find_leaks(empty, benchmark).count() == 0


def test_alignment_against_table():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15))
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == pytest.approx(h.max() / 18)


def test_op8(spark):
    check(spark, topk.op8, entries.oracle_sql()["op8_exact_top_k"], SF)
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (5, [3.0]), (6, [-1.0, 0.5]), (100, [1e30, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(e, F.col("vec_id") % 100 == 0, 2, group_rows=2, query_block=1).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)}
    assert topk.top_k(e.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_op9(spark):
    pages = {r.page_id: r.html for r in runtime.table(spark, SF, "pages").collect()}
    for r in html_text.op9(spark, SF).collect():
        article = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1])
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>only</nav>") == ""
    page = '<body><div class="cookie-notice">We use</div><div id=sidebar><p>side</p></div><main><p>First &amp; <i>best</i></p><form>x</form><p>Second</p></main><div class="comments"><p>nice</p></div><p'
    assert html_text.main_text(page) == "First & best\nSecond"


def naive_base(t):
    luhn = lambda s: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join("{}:{}:{}".format(*x) for x in out)


def test_op10(spark, texts, odd, empty):
    for r in pii.op10(spark, SF).collect():
        base = naive_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    rng = np.random.default_rng(6)
    for _ in range(3000):
        t = "".join(rng.choice(list("a@.-+ 0149(5")) for _ in range(rng.integers(0, 60)))
        spans = pii.base_spans(t)
        assert ",".join(f"{k}:{a}:{b}" for k, x in spans.items() for a, b in x) == naive_base(t), t
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(empty).count() == 0


def test_mask(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now", 18), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.mask_pii(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", 16), (2, None, None)]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs, labels = runtime.table(spark, SF, "documents"), runtime.table(spark, SF, "labels")
    rows, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    stages = dict(c.STAGES)
    one = stages["toxicity"](spark, docs, SF)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    kept = {i: t for i, t in rows.items() if scores[i] < 0.5}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(kept)
    two = stages["near_duplicates"](spark, one, SF)
    kept = {i: kept[i] for i, (_, root) in brute_components({i: t or "" for i, t in kept.items()}, 5, 4, 5).items() if root == i}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == set(kept)
    three = stages["decontamination"](spark, two, SF)
    leaks = {r.doc_id for r in decontamination.op7(spark, SF).collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} >= set(kept) - leaks
    four = stages["pii"](spark, three, SF)
    assert four.columns == columns and four.where("text LIKE '%@mail%'").count() == 0
    want = tokens.ChunkEncoder().encode([r.text or "" for r in four.collect()])
    assert c.run(spark, SF).agg(F.sum("length")).first()[0] == sum(map(len, want))
