from __future__ import annotations

import zlib

import pytest

from quillmesh.llm.sharding import shard_by_bytes

DOCS = "doc_id long, text string"


def brute(rows, shards):
    sized = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), len(r[1].encode())))
    total = sum(len(t.encode()) + 8 for _, t in sized)
    at, out, seen = 0, [], {}
    for d, t in sized:
        n = len(t.encode()) + 8
        s = min(shards - 1, int((at + n / 2) * shards / total))
        at += n
        out.append((d, n, zlib.crc32(t.encode()), s, seen.setdefault(s, 0)))
        seen[s] += 1
    return out


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_against_brute_force(spark, shards):
    rows = [(i * 37 % 211, "é" * (i % 50)) for i in range(211)] + [(5, None), (5, None), (None, "x"), (900, "y" * 5000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", shard int").repartition(7)
    got = [tuple(r) for r in shard_by_bytes(docs, shards).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, shards)))


def test_empty(spark):
    assert shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, sf_dir):
    from quillmesh.llm.queries import op7_byte_shards

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in op7_byte_shards(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(rows, 24))
