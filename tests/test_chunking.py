from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.functions import text as T
from quillmesh.functions.text import TOKEN
from quillmesh.operators import chunking as C


def windows(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.content for r in C.fixed_chunks(df, size, overlap).orderBy("chunk_index").collect()]


def test_fixed_windows(spark):
    assert windows(spark, "one two three four five", 3, 1) == ["one two three", "three four five"]
    assert windows(spark, "  ", 3, 1) == []
    assert windows(spark, None, 3, 1) == []
    with pytest.raises(ValueError):
        windows(spark, "a", 3, 3)


def test_token_count(spark):
    df = spark.createDataFrame([("知识 graph",), ("",), (None,), ("a.b_c!",)], "t string")
    assert [r[0] for r in df.select(T.token_count(df.t)).collect()] == [3, 0, 0, 4]


def test_hierarchy(spark):
    words = " ".join(f"token_{i}" for i in range(700))
    df = spark.createDataFrame([(1, words), (2, "short one"), (3, "")], "doc_id long, text string")
    rows = C.hierarchical_chunks(df, (128, 256, 512), 32).collect()
    one = [r for r in rows if r.doc_id == 1]
    assert {r.granularity for r in one} == set(C.LEVELS)
    spans = {(r.token_start, r.token_end): r for r in one}
    assert len(spans) == len(one)
    by_place = {(r.granularity, r.token_start): r for r in one}
    for r in one:
        if r.granularity == "small":
            p = by_place[r.parent_granularity, r.parent_start]
            assert p.token_start <= (r.token_start + r.token_end - 1) / 2 < p.token_end
    assert [(r.granularity, r.token_end) for r in rows if r.doc_id == 2] == [("small", 2)]
    assert not [r for r in rows if r.doc_id == 3]
    with pytest.raises(ValueError):
        C.hierarchical_chunks(df, (128, 128, 512), 32)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.\n 知", max_size=120), st.integers(1, 40))
def test_pre_split_is_lossless(text, most):
    parts = C.pre_split(text, most)
    assert "".join(parts) == text
    assert all(len(p) <= most for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a#\n ", max_size=120), st.integers(5, 40))
def test_sections_are_lossless(text, most):
    assert "".join(C.heading_sections(text, most)) == text


def test_blocks_and_ranges():
    text = "# 主题\n\n第一段事实。\n\n## 子主题\n\n第二段事实。"
    blocks = C.semantic_blocks(text)
    assert "".join(blocks) == text and len(blocks) == 4
    assert C.valid_ranges([(1, 2), (3, 4)], 4)
    assert not C.valid_ranges([(1, 1), (3, 3)], 3)
    assert not C.valid_ranges([], 1)
    assert len(C.boundary_chunks(text, lambda b: [(1, 2), (3, 4)], 8, 1)) == 2
    assert len(C.boundary_chunks(text, lambda b: [(1, 1)], 100, 1)) == 1


def test_leaves():
    assert C.semantic_leaves([(0, 8), (8, 28), (28, 68)], 64) == [(0, 68)] or C.semantic_leaves([(0, 8), (8, 28), (28, 68)], 128) == [(0, 68)]
    spans = [(i * 50, i * 50 + 50) for i in range(3)]
    leaves = C.semantic_leaves(spans, 64)
    assert leaves[0][0] == 0 and leaves[-1][1] == 150
    assert C.group_spans(leaves, 128)[0][0] == 0


def test_tokens_match_python(spark):
    text = "Größe 知识-graph  x_1,\t¡hola!"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.token_count(df.t)).first()[0] == len(re.findall(T.TOKEN, text))


def naive_hierarchy(text, boundaries, sizes, overlap, most):
    """Levels of token spans and their tree, span by span."""
    tokens = [m.span() for m in re.finditer(TOKEN, text)]
    try:
        spans, at = [], 0
        for part in C.pre_split(text, most):
            blocks = C.semantic_blocks(part)
            ranges = boundaries(blocks) if len(blocks) > 1 else [(1, 1)] * len(blocks)
            assert not blocks or [b for r in ranges for b in range(r[0], r[1] + 1)] == list(range(1, len(blocks) + 1))
            for a, b in ranges:
                low, high = at + len("".join(blocks[: a - 1])), at + len("".join(blocks[:b]))
                own = [i for i, (s, _) in enumerate(tokens) if low <= s < high]
                if own:
                    spans.append((own[0], own[-1] + 1))
            at += len(part)
        assert spans
        leaves = C.semantic_leaves(spans, sizes[0])
        levels = [leaves, C.group_spans(leaves, sizes[1])]
        levels.append(C.group_spans(levels[1], sizes[2]))
        semantic = True
    except Exception:
        semantic, levels = False, []
        for size in sizes:
            step = size - min(size - 1, round(size * overlap / sizes[1]))
            spans, s = [], 0
            while s < len(tokens):
                spans.append((s, min(s + size, len(tokens))))
                if s + size >= len(tokens):
                    break
                s += step
            levels.append(spans)
    rows = sorted({(span, min(lv for lv in range(3) if span in levels[lv])) for spans in levels for span in spans}, key=lambda r: (-r[1], r[0]))
    out = []
    for i, ((a, e), lv) in enumerate(rows):
        centre = (a + e - 1) / 2
        held = sorted((up, y - x, x) for (x, y), up in rows if up > lv and x <= centre < y)
        out.append((i, C.LEVELS[lv], a, e, C.LEVELS[held[0][0]] if held else None, held[0][2] if held else None, text[tokens[a][0] : tokens[e - 1][1]], semantic))
    return out


def test_semantic_hierarchy_of_all_documents(spark, sf_dir):
    from quillmesh.queries import texts

    docs = {r.doc_id: (r.text or "").replace("\n", "\n\n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in texts.semantic_hierarchy(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    kinds = set()
    for doc_id, text in docs.items():
        if len(text) < 40_000:  # the naive version is slow
            want = naive_hierarchy(text, texts.by_two, (64, 160, 400), 40, 12_000)
            assert sorted(got.get(doc_id, [])) == want
            kinds |= {r[-1] for r in want}
    assert kinds == {True, False}


def test_semantic_hierarchy_falls_back(spark):
    texts = ["", "   ", "one two\n\nthree four five\n\nsix", "word " * 100, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for model in (None, lambda blocks: [(1, 1)], lambda blocks: 1 / 0):
        rows = C.semantic_hierarchy(docs, model, (4, 16, 64), 4).collect()
        assert {r.doc_id for r in rows} == {2, 3} and not any(r.semantic for r in rows if r.doc_id == 2)
    with pytest.raises(ValueError):
        C.semantic_hierarchy(docs, None, (4, 4, 64), 1)


def test_parts_go_back_before_they_are_many_or_long(spark, monkeypatch):
    """Texts of a batch become Python's a few at a time, and their parts leave it before the batch is done."""
    import pyarrow as pa

    texts = ["# a\n" + "x" * 700 + "\n", None, ""] + [f"# h{i}\nline {i}\n" * 30 for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sizes, ran = [], []

    class Docs:
        """Runs what is given to ``mapInArrow`` here, over one batch."""

        sparkSession, dtypes = spark, docs.dtypes

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            ran.append(schema)
            for b in run(iter([pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])])):
                sizes.append((b.num_rows, sum(map(len, b.column("part" if "part" in b.schema.names else "content").to_pylist()))))

    for made in (lambda d: C.explode_parts(d, lambda t: C.heading_sections(t, 100)), lambda d: C.semantic_hierarchy(d, None, (8, 16, 32), 4)):
        want = sorted(map(tuple, made(docs).collect()), key=repr)
        monkeypatch.setattr(C, "ROWS", 50)
        monkeypatch.setattr(C, "SIGNS", 3000)
        sizes.clear()
        made(Docs())
        assert sum(n for n, _ in sizes) == len(want) and len(sizes) > 5
        assert all(n <= 50 and signs <= 3000 + 900 for n, signs in sizes)
        monkeypatch.undo()


def test_fixed_chunks_split_a_text_once(spark):
    df = spark.createDataFrame([(1, "a b\x01c d  "), (2, ""), (3, None)], "doc_id long, text string").repartition(1)
    found = C.fixed_chunks(df, 4, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\(text#", plan)) == 1
    rows = found.orderBy("chunk_index").select("doc_id", "token_start", "token_end", "content").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 4, "a b\x01c"), (1, 2, 5, "\x01c d")]


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (64, 8), (7, 2), (1, 0), (96, 0), (130, 0)])
def test_fixed_chunks_by_runs(spark, size, overlap):
    texts = [" \n" + "wörd, 你好\t" * 200 + " ", "x " * 64, "x " * 65, "中" * 700, "a　"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        spans = C.token_spans(t)
        for n, (a, e) in enumerate(C.mechanical_spans(len(spans), size, overlap)):
            want.append((i, n, a, e, e - a, t[spans[a][0] : spans[e - 1][1]]))
    assert sorted(tuple(r) for r in C.fixed_chunks(df, size, overlap).collect()) == want
