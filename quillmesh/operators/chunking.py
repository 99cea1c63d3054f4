"""Tokenising and chunking.  Fixed and hierarchical chunks are row-local JVM expressions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import TOKEN, token_count, token_parts

LEVELS = ("small", "medium", "large")
#: Chunks, and signs of them, handed back at a time; texts taken from a batch at a time.
ROWS, SIGNS, TEXTS = 4096, 4_000_000, 16
#: Tokens that fixed windows take at a time, at most.
RUN = 64
_token = re.compile(TOKEN)


def _windows(n: Column, size: int, step: int) -> Column:
    """How many windows cover n tokens; none for no tokens."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must lie in 0..{size - 1}")


def fixed_chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chunk_index, token_start, token_end, token_count, content`` of sliding windows, without a shuffle."""
    _check(size, overlap)
    step = size - overlap
    # windows begin and end between runs of so many tokens, so a text becomes few parts
    run = max(d for d in range(1, RUN + 1) if gcd(size, step) % d == 0)
    parts = docs.select(F.col(key), token_parts(F.col(text), run).alias("parts"))
    parts = parts.withColumn("n", F.greatest(F.size("parts") - 1, F.lit(0)) * run + token_count(F.try_element_at("parts", F.lit(-1))).cast("int"))
    # a window takes its own tokens before windows become rows, so no row holds the whole text
    every = F.sequence(F.lit(0), _windows(F.col("n"), size, step) - 1)

    def window(i: Column) -> Column:
        first, last = i * (step // run) + 1, F.least(i * (step // run) + size // run, F.size("parts"))
        return F.struct(i.alias("i"), F.least(i * step + size, F.col("n")).alias("stop"), F.array_join(F.slice("parts", first, last - first), "").alias("head"), F.get("parts", last - 1).alias("tail"))

    cut = F.transform(every, window)
    # no filter on n: Spark would push it below and split each text again for it
    spread = parts.select(key, F.explode(F.when(F.col("n") > 0, cut)).alias("w"))
    start = F.col("w.i") * step
    return spread.select(
        key,
        F.col("w.i").cast("long").alias("chunk_index"),
        start.cast("long").alias("token_start"),
        F.col("w.stop").cast("long").alias("token_end"),
        (F.col("w.stop") - start).cast("long").alias("token_count"),
        F.concat("w.head", F.regexp_replace("w.tail", r"(?U)\s+$", "")).alias("content"),
    )


def level_steps(sizes: tuple[int, int, int], overlap: int, base: int) -> list[int]:
    """Steps of each level: the overlap keeps its ratio to ``base``, rounded half to even."""
    return [s - min(s - 1, round(s * overlap / base)) for s in sizes]


def hierarchical_chunks(docs: DataFrame, sizes: tuple[int, int, int], overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of three sizes; of equal spans the finest stays; parents by the chunk's centre.

    ``key, chunk_index, granularity, token_start, token_end, parent_granularity, parent_start``,
    all from the token count, so nothing is joined or shuffled.
    """
    small, medium, large = sizes
    if not small < medium < large:
        raise ValueError("sizes must grow from small to large")
    _check(small, overlap)
    steps = level_steps(sizes, overlap, small)
    counted = docs.select(F.col(key), token_count(F.col(text)).cast("int").alias("n"))
    return chunk_tree(counted, sizes, steps, key)


def chunk_tree(counted: DataFrame, sizes: tuple[int, int, int], steps: list[int], key: str) -> DataFrame:
    n = F.col("n")

    def end(level: int, i: Column) -> Column:
        return F.least(i * steps[level] + sizes[level], n)

    def held(level: int, start: Column, stop: Column) -> Column:
        """Whether a finer level has the same span."""
        out = F.lit(False)
        for finer in range(level):
            i = F.floor(start / steps[finer]).cast("int")
            out = out | ((start % steps[finer] == 0) & (i < _windows(n, sizes[finer], steps[finer])) & (end(finer, i) == stop))
        return out

    def spans(level: int) -> Column:
        count = _windows(n, sizes[level], steps[level])
        every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
        made = F.transform(every, lambda i: F.struct(F.lit(level).alias("level"), (i * steps[level]).alias("start"), end(level, i).alias("stop")))
        return F.filter(made, lambda s: ~held(level, s["start"], s["stop"]))

    def parent(s: Column) -> Column:
        """Of the coarser spans that hold the centre: the finest, then shortest, then first."""
        centre = (s["start"] + s["stop"] - 1) / 2
        found = []
        for level in (1, 2):
            first = F.greatest(F.lit(0), F.floor((centre - sizes[level]) / steps[level]).cast("int"))
            last = F.least(_windows(n, sizes[level], steps[level]) - 1, F.floor(centre / steps[level]).cast("int"))
            near = F.when((F.lit(level) > s["level"]) & (last >= first), F.sequence(first, last)).otherwise(F.expr("cast(array() AS array<int>)"))
            made = F.transform(
                near,
                lambda i: F.struct(F.lit(level).alias("level"), (end(level, i) - i * steps[level]).alias("size"), (i * steps[level]).alias("start")),
            )
            found.append(
                F.filter(
                    made,
                    lambda p: (p["start"] <= centre) & (centre < p["start"] + p["size"]) & ~held(level, p["start"], p["start"] + p["size"]),
                )
            )
        return F.array_min(F.concat(*found))

    tree = F.concat(spans(2), spans(1), spans(0))
    rows = counted.select(key, "n", F.posexplode(tree).alias("chunk_index", "s"))
    named = F.array(*[F.lit(x) for x in LEVELS])
    return rows.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "s", parent(F.col("s")).alias("p")).select(
        key,
        "chunk_index",
        F.get(named, F.col("s.level")).alias("granularity"),
        F.col("s.start").cast("long").alias("token_start"),
        F.col("s.stop").cast("long").alias("token_end"),
        F.get(named, F.col("p.level")).alias("parent_granularity"),
        F.col("p.start").cast("long").alias("parent_start"),
    )


def chunk_id(key: Column, granularity: Column, start: Column) -> Column:
    return F.concat_ws(":", key.cast("string"), granularity, start.cast("string"))


# ---- structure-aware chunking: sequential over one text, so in Python, a text at a time


def semantic_blocks(text: str) -> list[str]:
    """Parts between blank lines, each with the break behind it; blank parts join the next."""
    out, carry = [], ""
    for part in re.findall(r".*?(?:\n[ \t]*\n\s*|\Z)", text, re.S):
        carry += part
        if carry.strip():
            out.append(carry)
            carry = ""
    if carry and out:
        out[-1] += carry
    return out


def pre_split(text: str, most: int) -> list[str]:
    """Lossless parts of at most ``most`` signs, cut in their second half where a break allows."""
    if most < 1:
        raise ValueError("most must be positive")
    out = []
    while len(text) > most:
        window, half = text[:most], most // 2
        cut = -1
        for sign in ("\n\n", "\n"):
            at = window.rfind(sign, half)
            if at >= 0:
                cut = at + len(sign)
                break
        if cut < 0:
            ends = [m.end() for m in re.finditer(r"[。！？!?.;；]|\s", window) if m.end() > half]
            cut = ends[-1] if ends else most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def valid_ranges(ranges: list[tuple[int, int]], blocks: int) -> bool:
    """Whether 1-based ranges of blocks follow each other without gap from the first to the last."""
    at = 1
    for first, last in ranges:
        if first != at or last < first or last > blocks:
            return False
        at = last + 1
    return bool(ranges) and at == blocks + 1


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _token.finditer(text)]


def semantic_leaves(spans: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """Token spans split above ``target`` and merged greedily up to it; a short tail joins the last."""
    pieces = [(s, min(s + target, e)) for a, e in spans for s in range(a, e, target)]
    least, out = max(16, target // 2), []
    for a, e in pieces:
        if out and not (out[-1][1] - out[-1][0] >= least and e - out[-1][0] > target):
            out[-1] = (out[-1][0], e)
        else:
            out.append((a, e))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        tail = out.pop()
        out[-1] = (out[-1][0], tail[1])
    return out


def group_spans(spans: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined while they fit into ``target`` tokens."""
    out: list[tuple[int, int]] = []
    for a, e in spans:
        if out and e - out[-1][0] <= target:
            out[-1] = (out[-1][0], e)
        else:
            out.append((a, e))
    return out


def heading_sections(text: str, most: int) -> list[str]:
    """Parts that begin at Markdown headings, packed up to ``most`` signs; longer ones cut losslessly."""
    out, held = [], ""
    for part in re.split(r"(?m)^(?=#{1,6}\s)", text):
        if not part:
            continue
        if held and len(held) + len(part) > most:
            out.append(held)
            held = ""
        if len(part) > most:
            out += pre_split(part, most)
        else:
            held += part
    return [*out, held] if held else out


def boundary_chunks(text: str, boundaries: Callable[[list[str]], list[tuple[int, int]]], size: int, overlap: int) -> list[str]:
    """Chunks along the ranges of blocks that a model names; fixed chunks if these are no cover."""
    blocks = semantic_blocks(text)
    try:
        ranges = [tuple(r) for r in boundaries(blocks)]
    except Exception:  # a model's failure is not ours
        ranges = []
    if valid_ranges(ranges, len(blocks)):
        return ["".join(blocks[a - 1 : b]).strip() for a, b in ranges]
    _check(size, overlap)
    spans = token_spans(text)
    out = []
    for s in range(0, max(1, len(spans)), size - overlap):
        window = spans[s : s + size]
        if window:
            out.append(text[window[0][0] : window[-1][1]])
        if s + size >= len(spans):
            break
    return out


def _spread(docs: DataFrame, key: str, text: str, schema: str, rows_of: Callable[[object, str], Iterator[tuple]], at: int) -> DataFrame:
    """Rows that a function makes of a key and a text; the column numbered ``at`` holds their signs.

    Texts become Python's a few at a time and rows go back before they are many or long, so a task holds
    one batch of Arrow's bytes and little else, however many texts or parts there are.
    """
    fields = docs.sparkSession.createDataFrame([], schema).schema
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names)
        for batch in batches:
            held, signs = [], 0
            for first in range(0, batch.num_rows, TEXTS):
                some = batch.slice(first, TEXTS)
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    for row in rows_of(k, t) if t else ():
                        held.append(row)
                        signs += len(row[at])
                        if len(held) >= ROWS or signs >= SIGNS:
                            yield made(held)
                            held, signs = [], 0
            if held:
                yield made(held)

    return docs.select(key, text).mapInArrow(run, schema)


def explode_parts(docs: DataFrame, split: Callable[[str], list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, part_index, part`` by a function from text to parts, Arrow batch by batch."""
    kind = dict(docs.dtypes)[key]

    rows_of = lambda k, t: ((k, i, p) for i, p in enumerate(split(t)))
    return _spread(docs, key, text, f"{key} {kind}, part_index long, part string", rows_of, 2)


def boundary_spans(text: str, boundaries: Callable[[list[str]], list[tuple[int, int]]], starts: list[int], most: int) -> list[tuple[int, int]]:
    """Token spans of the ranges of blocks that a model names, part by part; ValueError if these are no cover."""
    out, at = [], 0
    for part in pre_split(text, most):
        blocks = semantic_blocks(part)
        ranges = [tuple(r) for r in boundaries(blocks)] if len(blocks) > 1 else [(1, 1)] * len(blocks)
        if blocks and not valid_ranges(ranges, len(blocks)):
            raise ValueError("the ranges don't cover the blocks")
        ends = list(accumulate(map(len, blocks), initial=at))
        for first, last in ranges:
            a, b = bisect_left(starts, ends[first - 1]), bisect_left(starts, ends[last])
            if a < b:
                out.append((a, b))
        at += len(part)
    return out


def mechanical_spans(tokens: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Sliding windows over so many tokens."""
    step = size - overlap
    count = 0 if not tokens else 1 if tokens <= size else -(-(tokens - size) // step) + 1
    return [(i * step, min(i * step + size, tokens)) for i in range(count)]


def span_tree(levels: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, tuple[int, int] | None]]:
    """``level, start, stop, parent`` of spans by level, coarse ones first; of equal spans the finest stays.

    A parent is the finest of the coarser spans that hold the centre, then the shortest, then the first.
    """
    finest: dict[tuple[int, int], int] = {}
    for level, spans in enumerate(levels):
        for span in spans:
            finest.setdefault(span, level)
    of_level = [sorted(s for s, own in finest.items() if own == level) for level in range(len(levels))]
    begins = [[s[0] for s in spans] for spans in of_level]
    longest = [max((e - a for a, e in spans), default=0) for spans in of_level]

    def parent(level: int, a: int, e: int) -> tuple[int, int] | None:
        centre = (a + e - 1) / 2
        for up in range(level + 1, len(levels)):
            # spans of a level begin in order, so only those that begin close enough can hold the centre
            near = of_level[up][bisect_left(begins[up], centre - longest[up]) : bisect_right(begins[up], centre)]
            held = [(y - x, x) for x, y in near if x <= centre < y]
            if held:
                return up, min(held)[1]
        return None

    return [(level, a, e, parent(level, a, e)) for level in reversed(range(len(levels))) for a, e in of_level[level]]


def semantic_hierarchy(
    docs: DataFrame, boundaries: Callable[[list[str]], list[tuple[int, int]]] | None, sizes: tuple[int, int, int], overlap: int, key: str = "doc_id", text: str = "text", most: int = 12_000,
) -> DataFrame:
    """Chunks of three sizes along the meaning of a text: ``key, chunk_index, granularity, token_start, token_end,
    parent_granularity, parent_start, content, semantic``.

    A model names ranges of blocks (``boundaries``), which become leaves of the small size; neighbouring leaves
    are joined to medium ones and these to large ones.  A text for which the model fails, or names no
    cover, is cut into windows of the three sizes, whose overlap keeps its ratio to the medium one; so are
    all without a model.  One pass, a text at a time; texts without tokens give nothing.
    """
    if not sizes[0] < sizes[1] < sizes[2]:
        raise ValueError("sizes must grow from small to large")
    _check(sizes[1], overlap)
    kind = dict(docs.dtypes)[key]

    def levels_of(t: str, starts: list[int]) -> tuple[list[list[tuple[int, int]]], bool]:
        if boundaries is not None:
            try:
                spans = boundary_spans(t, boundaries, starts, most)
            except Exception:  # a model's failure is not ours
                spans = []
            if spans:
                leaves = semantic_leaves(spans, sizes[0])
                medium = group_spans(leaves, sizes[1])
                return [leaves, medium, group_spans(medium, sizes[2])], True
        return [mechanical_spans(len(starts), size, min(size - 1, round(size * overlap / sizes[1]))) for size in sizes], False

    def rows_of(k: object, t: str) -> Iterator[tuple]:
        tokens = token_spans(t)
        levels, semantic = levels_of(t, [a for a, _ in tokens])
        for i, (level, a, e, up) in enumerate(span_tree(levels)):
            yield k, i, LEVELS[level], a, e, LEVELS[up[0]] if up else None, up[1] if up else None, t[tokens[a][0] : tokens[e - 1][1]], semantic

    schema = f"{key} {kind}, chunk_index long, granularity string, token_start long, token_end long, parent_granularity string, parent_start long, content string, semantic boolean"
    return _spread(docs, key, text, schema, rows_of, 7)
