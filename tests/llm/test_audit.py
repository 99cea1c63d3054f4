from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import audit as A
from quillmesh.llm import queries
from tests.oracle import compare, connection

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    words = WORD.findall(t)
    return len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)


def random_text(rng: random.Random) -> str:
    alphabet = rng.choice(["ab \n", "aB #é中 \t", "AB\x0b\x0c\x1c  |", "x"])
    return "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 40, 300])))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_scan_against_plain(kind, monkeypatch):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(400)]
    for size in (7, 64, 1 << 20):  # pieces of a text, too
        monkeypatch.setattr(A, "SLICE_BYTES", size)
        column = pa.array(texts, kind).slice(3, 380)
        of = A.scan(column)
        got = list(zip(*(of[k].tolist() for k in ("words", "distinct", "capitals", "symbols", "points")), strict=True))
        assert got == [plain(t) for t in texts[3:383]]
    assert A.scan(pa.array([], kind))["words"].tolist() == []


def test_words_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(A, "hash_words", lambda data, begin, end: np.zeros(len(begin), "u8"))
    texts = ["a b a c aa", "", "b b b", "x y x y zz zz yy"]
    of = A.scan(pa.array(texts))
    assert of["distinct"].tolist() == [plain(t)[1] for t in texts]


def brute(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first: dict[str, int] = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, lang in docs:
        words, distinct, capitals, symbols, points = plain(t)
        fails = {k for k, v in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols > 0, d is not None and d > first[t or ""]), strict=True) if v}
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shares = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                gone = [r for r in own if f in r[1] and not any(r is x for x in left)]
                left = [r for r in left if f not in r[1]]
                shares[f] += len(here)
                steps[part, order, step] = [len(left), len(here), len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
        out |= {k: (*v, shares[k[1][k[2] - 1]]) for k, v in steps.items()}
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(220))
    pool = [None, "", "  ", "A B", "a #", long, long + " |", "same " * 250, "X" * 30 + " " + long, "ÄÖ 中"]
    docs = [(rng.choice([None, *range(30)]), rng.choice(pool), rng.choice([None, "", "en", "de"])) for _ in range(80)]
    docs += docs[:6]
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"mask": F.lit(7), "n": F.lit("x"), "salt": F.lit(1), "digest": F.lit("d")})
    got = A.audit(frame, spark.createDataFrame(labels, LABELS), F.col("lang"))
    assert got.columns == ["part", "filter_order", "step", *A._COUNTS]
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got.collect()} == brute(docs, labels)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit(none, labels, F.col("lang")).count() == 0
    one = A.audit(spark.createDataFrame([(1, None, None)], DOCS), labels, F.col("lang")).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.kept for r in one} == {0, 1}


def test_a_text_of_megabytes(spark):
    text = "word " * 300_000 + "Z" * 70_000 + " end" * 3
    of = A.scan(pa.array([text, "b"]))
    assert (of["words"][0], of["distinct"][0], of["capitals"][0]) == (300_004, 3, 70_000)


def test_query_against_sql(spark, sf_dir):
    compare(queries.op12_filter_audit(spark, sf_dir), connection(sf_dir), queries.ORACLE["op12_filter_audit"])
