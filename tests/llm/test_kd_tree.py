"""The shards against a plain k-d split of sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from reeltally.llm import sharding


def split(rows, shards, first, dims):
    """``{place: shard}``: cut at the weighted median along the widest dimension, rows in the order of their digits."""
    if shards == 1:
        return {r["place"]: first for r in rows}
    wide = max(range(dims), key=lambda d: max(r["d"][d] for r in rows) - min(r["d"][d] for r in rows))
    rows = sorted(rows, key=lambda r: (r["d"][wide], r["text_hash"] % 2**64, r["id_hash"] % 2**64))
    goal, upto, left = sum(r["size"] for r in rows) * (shards // 2) / shards, 0, []
    for r in rows:
        if upto + r["size"] < goal or upto < goal and 2 * (goal - upto) >= r["size"]:
            left.append(r)
        upto += r["size"]
    right = rows[len(left) :]
    half = shards // 2
    return split(left, half, first, dims) | split(right, shards - half, first + half, dims)


@pytest.mark.parametrize("shards", [2, 7, 12])
def test_cuts_are_those_of_a_plain_tree(spark, shards):
    r = random.Random(shards)
    texts = ["x" * r.randrange(400) + "\n" * r.randrange(30) + "é" * r.randrange(60) for _ in range(300)]
    texts += [texts[5]] * 150 + ["y" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dims = {"bytes": F.octet_length("text"), "wide": F.octet_length("text") - F.length("text"), "lines": F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))}
    rows = docs.select("doc_id", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id").alias("id_hash"), *[c.alias(f"d_{n}") for n, c in dims.items()]).collect()
    low = [min(x[f"d_{n}"] for x in rows) for n in dims]
    wide = [max(x[f"d_{n}"] for x in rows) - a for n, a in zip(dims, low)]
    scaled = lambda x: [int((x[f"d_{n}"] - a) * (65535 / (w or 1.0))) for n, a, w in zip(dims, low, wide)]
    plain = [{"place": x.doc_id, "size": x.bytes + 8, "text_hash": x.text_hash, "id_hash": x.id_hash, "d": scaled(x)} for x in rows]
    out = sharding.kd_shards(docs, dims=dims, shards=shards, tolerance=0.0)
    assert {x.id: x.shard for x in out.collect()} == split(plain, shards, 0, len(dims))
