"""The ten queries and the pipeline against brute force on the small driver tables."""

import base64
import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from reeltally.llm import queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.connect().execute(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())


def frame(spark, sf, name):
    return queries.QUERIES[name](spark, sf).toPandas()


def packs(pieces, ids, window=2048):
    """Every id in one piece, checksums right, sequences gapless; returns the share of padding."""
    seen = collections.defaultdict(list)
    for r in pieces.itertuples():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.start, r.length))
    assert seen.keys() == ids.keys()
    for doc, parts in seen.items():
        assert sum(n for _, n in parts) == len(ids[doc])
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    padding = 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert [0, *np.cumsum(g.length)][:-1] == list(g.offset)
        assert g.length.sum() <= window
        padding += window - g.length.sum()
    return padding / (padding + pieces.length.sum())


def token_ids(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    found = t.encode_batch(list(docs.values()), add_special_tokens=False)
    return {d: np.array([*x.ids, 1], "<u4") for d, x in zip(docs, found)}


def test_op3_learns_from_other_rows(spark, sf):
    out = frame(spark, "/root/testdata/sf0.1", "op3_toxicity").merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas())
    assert all(out.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id])
    assert out.score.between(0, 1).all() and all(out.predicted == (out.score >= 0.3))
    held = out[out.held_out]
    rank, toxic = held.score.rank(), held.toxic == 1
    auc = (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert auc > 0.93
    assert (held.predicted == held.toxic).mean() > 0.93


def test_op4_shards_are_even(spark, sf, docs):
    out = frame(spark, sf, "op4_sharding")
    assert sorted(out.doc_id) == sorted(docs)
    for r in out.itertuples():
        data = docs[r.doc_id].encode()
        assert (r.size_ if hasattr(r, "size_") else r[2]) == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
    bytes_ = out.groupby("shard")["size"].sum()
    assert sorted(bytes_.index) == list(range(24))
    # No cut is finer than a text.
    assert bytes_.max() <= bytes_.mean() + 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_op5_is_the_article(spark, sf):
    pages = dict(duckdb.connect().execute(f"select page_id, html from '{sf}/pages.parquet'").fetchall())
    out = frame(spark, sf, "op5_html_text")
    assert len(out) == len(pages)
    for r in out.itertuples():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|li)>", article.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r.text == "\n\n".join(t for t in texts if t)
        assert r.n_chars == len(r.text)


def test_op6_is_the_library(spark, sf, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = frame(spark, sf, "op6_byte_bpe").set_index("doc_id")
    assert len(out) == len(docs)
    for doc, text in docs.items():
        ids = lib.encode_ordinary(text)
        assert out.n_tokens[doc] == len(ids)
        assert out.ids_sha256[doc] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out.decoded_sha256[doc] == hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def near_classes(docs):
    sets, root = {d: shingle_set(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (docs[a] == docs[b] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def test_op7_classes(spark, sf, docs):
    out = frame(spark, sf, "op7_near_dedup")
    want = near_classes(docs)
    assert dict(zip(out.doc_id, out.class_id)) == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in out.itertuples())


def test_op9_packs_every_id_once(spark, sf, docs):
    assert packs(frame(spark, sf, "op9_packing"), token_ids(docs)) < 0.05


def repeats(docs, length=400):
    """(bytes, removed, spans, kept) by counting every string."""
    data = {d: t.encode() for d, t in docs.items()}
    seen = collections.Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_op10_counts_every_string(spark, sf, docs):
    out = frame(spark, sf, "op10_suffix_dedup")
    want = {d: (a, b, c, hashlib.sha256(k).hexdigest()) for d, (a, b, c, k) in repeats(docs).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples()} == want


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    import corpus_pipeline
    from reeltally.llm import toxicity as tox

    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        path = str(tmp_path / str(i))
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        rows = now.collect()
        after = {r.doc_id: r for r in rows}
        texts = {d: r.text or "" for d, r in before.items()}
        if name != "packing":
            assert now.columns == columns
            assert len(rows) == len(after)
        if name == "toxicity":
            model = tox.trained(spark, sf)
            ids = list(before)
            score = model.score([texts[d] for d in ids])
            assert set(after) == {d for d, s in zip(ids, score) if s < 0.3}
        elif name == "exact_dedup":
            best = {}
            for d, t in texts.items():
                best[t] = min(d, best.get(t, d))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            assert set(after) == set(near_classes(texts).values())
        elif name == "suffix_dedup":
            want = repeats(texts)
            assert {d: r.text for d, r in after.items()} == {d: w[3].decode("utf-8", "ignore") for d, w in want.items()}
        else:
            assert packs(now.toPandas(), token_ids(texts)) < 0.05
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run
