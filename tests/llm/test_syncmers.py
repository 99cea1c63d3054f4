from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import syncmers as S

DOCS = "doc_id long, text string"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = S.edited(t, after)
        a, b, c = map(S.sketch_anchors, (t, e, after))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), S.written(*a), S.written(*b), S.likeness(a, b), S.likeness(a, c)))
    return out


def key(rows):
    return sorted(map(repr, rows))


def test_against_brute_force(spark):
    rows = [(i * 7 % 101, ("word%d " % i) * (i % 40)) for i in range(101)] + [(500, None), (501, ""), (502, "é☃" * 50), (503, "x"), (-5, "a b" * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", range int")
    for ranges in (1, 5, 64):
        assert key(map(tuple, S.compare_with_next(docs, ranges).collect())) == key(expected(rows))


def test_ties_single_and_empty(spark):
    for rows in ([(1, "same " * 20)], [(1, "b" * 40), (1, "a" * 40), (2, "c" * 40), (2, "c" * 40)], [(None, "n" * 30), (4, "m" * 30)]):
        assert key(map(tuple, S.compare_with_next(spark.createDataFrame(rows, DOCS), 3).collect())) == key(expected(rows))
    assert S.compare_with_next(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a text " * 30), (2, "a text " * 30), (3, None)], DOCS)
    got = {r.doc_id: r.fingerprint for r in S.fingerprint_documents(docs).collect()}
    assert got[1] == got[2] != "" and got[3] == ""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc é", max_size=200))
def test_anchors_are_closed_and_context_free(text):
    points = S.signs(text)
    hashes, place = S.anchors(points)
    if len(points) >= S.K:
        small = S._windows(points, S.S)
        for i in range(len(points) - S.K + 1):
            inside = small[i : i + S.K - S.S + 1]
            assert (i in place) == (inside.min() in (inside[0], inside[-1]))
        for h, p in zip(hashes, place, strict=True):
            alone, at = S.anchors(points[p : p + S.K])
            assert alone.tolist() == [h] and at.tolist() == [0]
    assert [x.tolist() for x in S.read(S.written(*S.sketch_anchors(text)))] == [x.tolist() for x in S.sketch_anchors(text)]


def test_likeness():
    import random

    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    other = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    a = S.sketch_anchors(text)
    assert S.likeness(a, a) == 1
    assert S.likeness(a, S.sketch_anchors("inserted in front " + text)) > 0.8
    assert 0.4 < S.likeness(a, S.sketch_anchors(S.edited(text, other))) < 0.8
    assert S.likeness(a, S.sketch_anchors(other)) == 0
    assert S.likeness(S.sketch_anchors(""), S.sketch_anchors("")) == 1 and S.likeness(a, S.sketch_anchors("")) == 0


def plain_anchors(text):
    """Closed syncmers by their definition, sign by sign; only the hash of an s-mer is the module's."""
    if len(text) < S.K:
        return [(text, 0)] if text else []
    small = [int(S._windows(S.signs(text[i : i + S.S]), S.S)[0]) for i in range(len(text) - S.S + 1)]
    width = S.K - S.S + 1
    out = []
    for i in range(len(text) - S.K + 1):
        inside = small[i : i + width]
        if min(inside) in (inside[0], inside[-1]):
            out.append((text[i : i + S.K], i))
    return out


def test_query(spark, tmp_path):
    """Every column against plain Python: order, edits, digests, anchors and their places, likeness."""
    from quillmesh.llm.queries import op3_syncmer_fingerprints

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000 OR text IS NULL")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    order = sorted(texts)
    got = {r.doc_id: r for r in op3_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    assert sorted(got) == order
    prints = {}
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        r, text, cut = got[d], texts[d], len(texts[d]) // 4
        changed = text[: len(text) - cut] + texts[after][:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        places = dict.fromkeys(p for _, p in plain_anchors(text))
        kept = [x.split(":") for x in r.fingerprint.split(",") if x]
        assert len(kept) == min(S.ANCHORS, len(places)) and all(int(p, 16) in places for _, p in kept)
        assert [h for h, _ in kept] == sorted(h for h, _ in kept)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        for other, near in ((r.edited_fingerprint, r.near_edited), (got[after].fingerprint, r.near_next)):
            mine, its = ({h: int(p, 16) for h, p in (x.split(":") for x in f.split(",") if x)} for f in (r.fingerprint, other))
            if not mine or not its:
                assert near == (not mine and not its)
                continue
            union = sorted({*mine, *its})[: S.ANCHORS]
            moved = sorted(its[h] - mine[h] for h in union if h in mine and h in its)
            far = S.DRIFT + max(*mine.values(), *its.values()) // 100
            same = sum(abs(m - moved[(len(moved) - 1) // 2]) <= far for m in moved)
            assert abs(near - same / len(union)) < 1e-12
