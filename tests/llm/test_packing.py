from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import packing as P
from quillmesh.llm.bpe import vocabulary_path

DOCS = "doc_id long, text string"
LIBRARY = Tokenizer.from_file(vocabulary_path())


def balanced(rows, step_tokens, tiers=P.TIERS):
    """Over all partitions each tier has one part-filled step group at most, and none holds too much."""
    groups, kinds = Counter(), {}
    for r in rows:
        groups[r["step_group"]] += r["length"]
        assert kinds.setdefault(r["step_group"], r["window"] if r["window"] in tiers else 0) == (r["window"] if r["window"] in tiers else 0)
    assert sorted(groups) == list(range(len(groups)))
    part_filled = Counter(kinds[g] for g, n in groups.items() if n < step_tokens)
    assert max(part_filled.values(), default=1) == 1
    # a window isn't cut, so groups of the shortest windows may run over by less than one of them
    assert all(n <= step_tokens or kinds[g] == 0 and n < step_tokens + min(tiers) for g, n in groups.items())


def whole(rows, documents, longest):
    """Every id in one piece, offsets gapless, windows full or of a power of two."""
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for found in windows.values():
        found.sort(key=lambda r: r["offset"])
        at = 0
        for r in found:
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        size = found[0]["window"]
        assert at == size <= longest and size & (size - 1) == 0
    for doc, ids in documents.items():
        found = sorted(pieces.pop(doc), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in found) == ids
        assert [r["start"] for r in found] == [sum(x["length"] for x in found[:i]) for i in range(len(found))]
        assert {r["doc_tokens"] for r in found} == {len(ids) // 4}
    assert not pieces
    return windows


@pytest.mark.parametrize("buffer", [50, 2000, 10**6])
@pytest.mark.parametrize("longest", [[1, 3000], [100, 130], [1, 40], [4096, 4096], [4000, 4095], [1, 20000]])
def test_packer(buffer, longest):
    rng = random.Random(str((buffer, longest)))
    p = P.Packer(3, buffer_tokens=buffer)
    documents, rows = {}, []
    for d in range(rng.randrange(1, 400)):
        documents[d] = np.arange(rng.randint(*longest), dtype="<u4").tobytes()
        p.add(d, documents[d])
        rows += p.drain()
    p.finish()
    names = [x.split()[0] for x in P.PACKED.split(", ")]
    windows = whole([dict(zip(names, r, strict=True)) for r in rows + p.drain()], documents, 4096)
    tails = [w for w in windows.values() if w[0]["window"] not in P.TIERS]
    assert len(tails) <= 9
    upto = defaultdict(list)
    for w in windows.values():
        upto[w[0]["tier"]].append((w[0]["before"], w[0]["window"]))
    for tier, found in upto.items():  # running tokens of each tier
        assert all(at == sum(x for _, x in sorted(found)[:i]) for i, (at, _) in enumerate(sorted(found))), tier


def test_frames(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "word " * 9000), (5, "<|endoftext|> x")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], DOCS + ", window string").coalesce(1)
    got = [r.asDict() for r in P.pack_documents(docs).collect()]
    want = {d: np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in rows}
    whole([{**r, "ids": bytes(r["ids"])} for r in got], want, 4096)
    assert P.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    twice = P.pack_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], DOCS)).collect()
    assert sum(r.length for r in twice) == 6


def test_groups_over_many_partitions(spark):
    docs = spark.range(0, 3000, 1, 40).selectExpr("id AS doc_id", "repeat('word ', cast(pmod(hash(id), 900) AS int)) AS text")
    rows = [r.asDict() for r in P.pack_documents(docs, step_tokens=8192).collect()]
    want = {r.doc_id: np.array([*LIBRARY.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect()}
    whole([{**r, "ids": bytes(r["ids"])} for r in rows], want, 4096)
    balanced(rows, 8192)


def test_query(spark, sf_dir):
    """Every column against the library."""
    from quillmesh.llm.queries import op9_hierarchical_packing

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {d: [*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    rows = [r.asDict() for r in op9_hierarchical_packing(spark, sf_dir).collect()]
    taken, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        taken[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for d, ids in want.items():
        spans = sorted(taken[d])
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == len(ids)
    for found in windows.values():
        found.sort()
        assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]]
        assert found[-1][1] <= 4096 and found[-1][1].bit_count() == 1
    balanced(rows, P.STEP_TOKENS)
