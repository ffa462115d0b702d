"""Features, weights and the draw against a version with regular expressions and lists."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from reeltally.llm import queries, resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def features(text, words=2):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [" ".join(found[i : i + n]) for n in range(1, words + 1) for i in range(len(found) - n + 1)]


def plain(docs, target, least=20):
    count = lambda texts: collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for doc, text in docs:
        n, own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: 25 * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out]


def test_op12_by_brute_force(spark, sf):
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    target = [x for (x,) in con.execute(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    out = queries.QUERIES["op12_importance_resampling"](spark, sf).collect()
    assert sorted(map(tuple, out)) == sorted(plain(docs, target))


@pytest.mark.parametrize("words", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [1, 7, 40, 1 << 20])
def test_blocks_do_not_cut_runs(monkeypatch, words, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    for text in ["", " ", "A", "one TWO, drei-vier  fünf\x00six_7", "x " * 30, "İSTANBUL Ünï 中文 a▁b\xa0c", "w" * 100 + " " + "v" * 60]:
        n, want = features(text, words)
        got = list(resampling.grams(text, words))
        assert sum(k for k, _ in got) == n
        assert sorted(c for _, found in got for c in found) == sorted(zlib.crc32(f.encode()) for f in want)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "?!"), (None, "lone row " * 12), (4, "the cat sat " * 9000), (5, "b c d " * 10), (6, "b c d " * 10), (6, "b c d " * 10), (7, "É " * 25)]
    schema = "doc_id long, text string, rank string, score string, bucket int, n int, id string, __above int"
    docs = spark.createDataFrame([(*x, "r", "s", 1, 2, "i", 3) for x in texts], schema)
    target = spark.createDataFrame([("b c d",), (None,), ("cat",)], "text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for goal in (target, target.limit(0)):
        out = resampling.resample(docs.repartition(3), goal).select("id", "n_features", "weight", "score", "rank").collect()
        want = plain(texts, [r.text for r in goal.collect()])
        assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_draw_takes_ties_by_id(spark):
    rows = [(i, 20, 5, 0, i % 3) for i in range(100)] + [(200, 19, 5, 0, 9), (201, None, 5, 0, 9)]
    out = resampling.draw(spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long"), percent=40).collect()
    best = sorted((r for r in rows if r[1] == 20), key=lambda r: (-r[4], r[0]))[:40]
    assert {r.id: r["rank"] for r in out if r["rank"]} == {r[0]: i + 1 for i, r in enumerate(best)}
    assert len(out) == 102
