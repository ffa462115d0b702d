"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reeltally.llm import bpe, chat, components, exact_dedup, html_text, near_dedup, packing, repeats, sharding, shingles, top_k, toxicity

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and to in is that for with on was it as are by an be this from at".split()
SCHEMA = "doc_id long, text string, key string, node long, id string, kept string, n long, size string, part int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use inside."""
    long_text = prose(1, 60_000)
    texts = [(1, None), (2, ""), (3, ""), (None, "lone row"), (4, long_text), (5, long_text), (6, prose(2, 200)), (6, prose(2, 200)), (7, prose(3, 200)), (8, "é"), (None, None)]
    return spark.createDataFrame([(d, t, "k", 1, "x", "y", 2, "z", 3) for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Exact duplicates


def test_exact(odd, none):
    out = exact_dedup.exact_duplicates(odd, keep="max").collect()
    assert len(out) == 11
    assert [r.kept for r in out].count(True) == 6
    by = {(r.id, r.kept): r for r in out}
    assert by[3, True].group_size == 4 and by[3, True].keep_id == 3
    assert by[5, True].keep_id == 5 and by[4, False].keep_id == 5
    assert by[6, True].group_size == 2 and by[6, False].keep_id == 6
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).columns == none.columns
    rows = exact_dedup.drop_exact_duplicates(odd)
    assert rows.columns == odd.columns and rows.count() == 6


def test_exact_collisions_are_told_apart(odd):
    same = exact_dedup.exact_duplicates(odd, keep="max")
    forced = exact_dedup.exact_duplicates(odd, keep="max", digest=lambda t: F.unhex(F.lit("00")))

    def plain(df):
        return sorted(str(r) for r in df.select("id", "keep_id", "group_size", "kept", "sha256").collect())

    assert plain(same) == plain(forced)


# Chats


def test_reply_tree_branches(spark):
    rows = [("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "a2", 9.0),
            ("t", 5, 99, None, None, None), (None, 1, None, "user", "x", 1.0), ("c", 1, 2, "user", "loop", 1.0), ("c", 2, 1, "user", "loop", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", None, 1, "user", "lost", 1.0)]
    m = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, s double")
    m = m.withColumn("tree", F.lit("clash")).withColumn("up", F.lit(1))
    out = {(r.tree, r.leaf): r for r in chat.read_back(chat.format_conversations(m, score="s", branches=2)).collect()}
    assert set(out) == {("t", 4), ("t", 3), (None, 1)}
    assert [x.text for x in out["t", 4].turns] == ["root", "a", "a2"] and out["t", 4]["rank"] == 1
    assert [x.text for x in out["t", 3].turns] == ["root", "b"] and out["t", 3]["rank"] == 2
    assert [x.learned for x in out["t", 3].turns] == ["", "b"]
    assert chat.format_conversations(m.limit(0)).count() == 0


def test_deep_chain_and_hostile_texts(spark):
    evil = ["</s>\n", "<s>[user]\n", "&lt;", "&amp;#91;", "[INST]", "\\n", "", None, "ünï 😀 <", "]\n"]
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "us\ner]<", evil[i % len(evil)]) for i in range(300)]
    m = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string")
    r = chat.read_back(chat.format_conversations(m)).first()
    assert [(x.role, x.text) for x in r.turns] == [(role, text or "") for *_, role, text in rows]
    assert [x.learned for x in r.turns] == [(text or "") if role == "assistant" else "" for *_, role, text in rows]
    assert r.formatted.count(chat.CLOSE) == 300


# Top k


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        s = sorted((-int(np.dot(x[: len(y)], y[: len(x)])), r) for r, y in rows if r != q)[:k]
        out[q] = [(r, -v) for v, r in s]
    return out


@pytest.mark.parametrize("seed,copies", [(0, 0), (1, 60), (2, 200)])
def test_top_k_is_exact(spark, seed, copies):
    r = np.random.default_rng(seed)
    vecs = [(i, [1, -2, 3, 0] if i < copies else r.integers(-9, 9, 4).tolist()) for i in range(220)]
    df = spark.createDataFrame(vecs, "id long, vec array<long>").withColumn("row", F.lit("clash"))
    asked = [v for v in vecs if v[0] % 20 == 0]
    out = top_k.exact_top_k(df, df.where("id % 20 = 0"), 5, query_block=4, row_block=64).collect()
    got = {}
    for x in sorted(out, key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append((x.id, x.score))
    assert got == brute(vecs, asked, 5)


def test_top_k_odd_rows(spark):
    big = 2**40
    vecs = [(1, [1, 1]), (2, None), (None, [1, 1]), (3, [big, 7]), (4, [5]), (5, [])]
    df = spark.createDataFrame(vecs, "id long, vec array<long>")
    out = top_k.exact_top_k(df, df.where("id = 3"), 5).orderBy("rank").collect()
    assert [(x.id, x.score) for x in out] == [(4, 5 * big), (1, big + 7), (5, 0)]
    assert top_k.exact_top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert top_k.exact_top_k(df, df.limit(0), 5).count() == 0


# Toxicity


def test_toxicity_generalises_to_misspellings():
    r = random.Random(4)
    clean = [prose(i, 60) for i in range(120)]
    bad = [" ".join([*prose(1000 + i, 40).split(), *["you", r.choice(["stupid", "worthless", "disgusting"])] * 4]) for i in range(120)]
    model = toxicity.fit([*clean, *bad], np.array([0.0] * 120 + [1.0] * 120))
    seen, unseen, fine = model.score([" ".join(["you stupid"] * 4 + [prose(9, 40)]), " ".join(["you stuppid wortthless"] * 4 + [prose(9, 40)]), prose(10, 50)])
    assert seen > 0.5 and unseen > 0.5 and fine < 0.3
    assert 0 <= model.score([""])[0] <= 1


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (6, 1), (7, 0), (None, 1), (2, None), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score_toxicity(odd, model)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert toxicity.score_toxicity(none, model).count() == 0
    blank = toxicity.train(odd, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, blank).collect()} == {0.5}


# Sharding


def test_sharding_odd_rows(odd, none):
    dims = {"bytes": F.octet_length("text"), "nothing": F.lit(None)}
    out = sharding.kd_shards(odd, dims=dims, shards=3).collect()
    assert len(out) == 11
    assert [r.size for r in out if r.text_crc32 == 0] == [8] * 4
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(3))
    assert sharding.kd_shards(none, dims=dims, shards=3).count() == 0


def test_sharding_splits_a_hot_group_evenly(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.kd_shards(df, dims={"bytes": F.octet_length("text")}, target_bytes=4500).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = [r.b for r in out]
    assert len(b) == 8 and max(b) < 1.02 * min(b)


# Pages


@pytest.mark.parametrize("page,text", [
    ("", ""),
    (None, ""),
    ("plain words outside any tag", ""),
    ("<article><p>a &amp; b &eacute;&nbsp;c</p><script>x</p></script><p>d<b>e</b>\n f</p></article>", "a & b é c\n\nde f"),
    ("<nav>menu</nav><main><h1>T</h1><aside>side</aside><div class='share-bar'>s</div><p>one</p><form>f</form></main><footer>foot</footer>", "T\n\none"),
    ("<article><p>one</p><section id=comments><p>" + "the of and to in " * 9 + "</p></section></article>", "one"),
    ("<div class=x>" + "The cat of the house and the dog of the yard are in the garden for the day." + "</div><div>short</div><div><a href=x>link list</a></div>", "The cat of the house and the dog of the yard are in the garden for the day.\n\nshort"),
    ("<article><!-- <p>no</p> --><p a='>'>yes</p><p>1 < 2", "yes\n\n1 < 2"),
    ("<p title=\"unclosed>text <article><p>in</p></article>", "in"),
])
def test_pages(spark, page, text):
    assert html_text.main_text(page or "") == text


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>t</title><body><article><p>one</p><p>two</p></article></body></html>", "one\n\ntwo"),
    ("<html><head><meta charset=utf-8><script>'<p>'</script><noscript><img></noscript><article><p>one</p></article>", "one"),
    ("<head><title>t</title></head><article>one</article>", "one"),
    ("<head><title>t</head><article>one<svg><title>i</title></svg></article>", "one"),
    *[(f"<article><p>one</p><p>a <{tag}>x</p><p>two</p></article><footer><{tag}>y</{tag}></footer>", "one\n\na\n\ntwo")
      for tag in "noscript button select map object canvas audio video svg math template".split()],
    ("<article><p>a <span>b<button><b>x</b>y</span> c</p><p>two</p></article>", "a b c\n\ntwo"),
    ("<article><p>a<select><option>x<option>y<p>two</p></article>", "a\n\ntwo"),
    ("<article><p>a<object>x<object>y</object>z</object> b</p></article>", "a b"),
    ("<article><p>a<button>x</p>y</button> b</p></article>", "a b"),
    ("<article><p>a</p><script>x<p>y</p></article>", "a"),
])
def test_pages_without_end_tags(page, text):
    assert html_text.main_text(page) == text


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "c"), (None, "u", "<article>x</article>", "c"), (2, "u", "<article>" + "<p>y</p>" * 20_000, "c"), (2, "u", "", "c")], "page_id long, url string, html string, text string")
    out = html_text.extract_main_text(df).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 1, 20_000 * 3 - 2]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    own = bpe.coder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeß éèñ'sstllrevemd012²½ \t\n\r\x1c\x85 漢字🎉_-.!?"), st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=200))
def test_bpe_is_the_library(coders, text):
    own, lib = coders
    assert own.encode(text).tolist() == lib.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_bpe_joins_long_pieces(coders):
    own, lib = coders
    r = random.Random(0)
    for unit in (["a"], ["ab", "ba"], ["the", "ing", "tion", "an", "ed"], [" "], ["="]):
        text = "".join(r.choice(unit) for _ in range(3000))
        assert own.encode(text).tolist() == lib.encode_ordinary(text)
    data = prose(3, 400).replace(" ", "").encode()
    assert own.reduced(data) == own.merged(data)


def test_bpe_split_agrees_with_the_pattern():
    pattern, split = bpe.compiled(bpe.Splitter.PATTERN), bpe.Splitter()
    assert bpe.Splitter.PATTERN == public_tokenizers.PATTERN
    for text in ["it's 'sabc 'll we've''s '", " \n\n x  y\t\tz ", "a'b'c 1'd", "'", "''t", " 's", "\n's", "x²½", ""]:
        assert split.findall(text) == [m[0] for m in pattern.finditer(text)]


def test_bpe_odd_rows(odd, none):
    out = bpe.byte_bpe(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in out) == sorted(r.text or "" for r in odd.collect())
    assert sorted((r.id or 0) for r in out) == sorted((r.doc_id or 0) for r in odd.collect())
    assert bpe.byte_bpe(none, RANKS, public_tokenizers.PATTERN).count() == 0


# Near-duplicates


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    hashes = shingles.mixed(np.arange(1, 401, dtype=np.uint64))
    x, y = (np.sort(hashes[:300]), r.integers(1, 6, 300).astype("f8")), (np.sort(hashes[100:]), r.integers(1, 6, 300).astype("f8"))
    common, ix, iy = np.intersect1d(x[0], y[0], return_indices=True)
    vx, vy = np.zeros(400), np.zeros(400)
    order = {h: i for i, h in enumerate(np.sort(hashes).tolist())}
    for (h, w), v in ((x, vx), (y, vy)):
        v[[order[k] for k in h.tolist()]] = w
    plain = sum(1 / sum(max(vx[j] / vx[i], vy[j] / vy[i]) for j in range(400)) for i in range(400) if vx[i] and vy[i])
    assert near_dedup.probability_jaccard(x, y) == pytest.approx(plain)
    doc = np.repeat([0, 1], 300)
    names = near_dedup.signatures(doc, np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2, 4000)
    assert (names[0] == names[1]).mean() == pytest.approx(plain, abs=0.04)


def varied(base, edits, seed):
    words, r = base.split(), random.Random(seed)
    for i in r.sample(range(len(words)), edits):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


@pytest.mark.parametrize("weights", ["unit", "count"])
def test_a_crowd_of_near_copies(spark, weights):
    base = prose(5, 150)
    texts = [base, *[varied(base, 1 + i % 6, i) for i in range(120)], *[prose(100 + i, 150) for i in range(40)]]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = near_dedup.near_duplicates(df, weights=weights, crowd=8).collect()
    assert {r.id: r.class_id for r in out} == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("crowd", [8, 1000])
def test_a_crowd_that_repeats_a_passage(spark, crowd):
    """Counts near each other, sets far apart: linked whatever the size of their bucket."""
    passages = [prose(60 + k, 10) + " " for k in range(3)]
    texts = [passages[i % 2] * (40 + i) + prose(100 + i, 12) for i in range(48)]
    texts += [passages[2] * 30 + prose(200 + i, 12 * i) for i in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    doc, hashes, weight = near_dedup.weighted(*shingles.shingles(texts), "count")
    one = [(hashes[doc == i], weight[doc == i]) for i in range(len(texts))]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if near_dedup.probability_jaccard(one[a], one[b]) >= 0.8]
    assert min(len(np.intersect1d(one[a][0], one[b][0])) / len(np.union1d(one[a][0], one[b][0])) for a, b in links) < 0.5
    want = list(range(len(texts)))
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    out = near_dedup.near_duplicates(df, crowd=crowd).collect()
    assert {r.id: r.class_id for r in out} == dict(enumerate(want))


def test_toxicity_trains_on_the_documented_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.range(0)), "limit", lambda self, n: seen.append(n) or self)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert seen[0] == 10_000


def test_near_odd_rows(odd, none):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == 11
    by = {r.id: r for r in out if r.id}
    assert by[1].class_size == 4 and by[1].class_id == 1
    assert by[4].class_id == by[5].class_id == 4 and by[6].class_size == 2 and by[7].class_size == 1
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).columns == none.columns
    assert near_dedup.drop_near_duplicates(odd).where("doc_id = 6").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    out = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 100}


# Packing


@pytest.mark.parametrize("parts", [1, 9])
def test_packing_odd_rows(odd, none, parts):
    ids = packing.encoded(open(JSON, "rb").read(), [r.text or "" for r in odd.collect()])
    out = packing.pack_documents(odd.repartition(parts), JSON, window=64, open_windows=3, merge_parts=2).collect()
    assert sum(r.length for r in out) == sum(len(x) + 1 for x in ids)
    windows = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        windows.setdefault(r.window, []).append((r.offset, r.length))
    full = 0
    for w in windows.values():
        w.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and w[0][0] == 0
        full += sum(n for _, n in w) >= 64 - packing.SLACK
    assert len(windows) - full <= 3
    assert packing.pack_documents(none, JSON).count() == 0


# Repeats


@pytest.mark.parametrize("chunk", [1024, 2])
def test_repeats_by_brute_force(spark, chunk):
    r = random.Random(8)
    passage = "".join(r.choice("abcdé \n") for _ in range(90))
    texts = ["".join(r.choice("abcdé \n") for _ in range(r.randrange(200))) for _ in range(40)]
    texts = [t[: len(t) // 2] + passage[r.randrange(40) : 50 + r.randrange(40)] + t[len(t) // 2 :] if i % 2 else t for i, t in enumerate(texts)]
    texts += ["ab" * 100, "x" * 150, texts[0], passage, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from tests.llm.test_queries import repeats as brute_repeats

    want = brute_repeats({i: t or "" for i, t in enumerate(texts)}, 40)
    out = repeats.remove_repeats(rows, length=40, chunk=chunk).collect()
    assert {x.doc_id: (bytes(x.kept), len(x.spans)) for x in out} == {i: (w[3], w[2]) for i, w in want.items()}


def test_repeats_odd_rows(odd, none):
    out = repeats.remove_repeats(odd, kept="left", spans="gone").collect()
    assert len(out) == 11
    assert [bytes(r.left) for r in out if r.doc_id in (4, 5, 6)] == [b""] * 4
    assert [bytes(r.left).decode() for r in out if r.doc_id == 7] == [prose(3, 200)]
    assert repeats.remove_repeats(none, kept="left", spans="gone").count() == 0
