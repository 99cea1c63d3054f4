r"""Secret scans with a randomness test battery (operator 6), in DataFrame functions only.

Base kinds are patterns: ``assign`` (a credential's name, a sign, 12 or more signs), ``access``
(key ids) and ``hex`` runs.  The method adds kind ``random``: runs of 20 or more signs of
the base64 family that hold letters and digits, cut where no encoding holds them.  Each run's encoding is the smallest that
holds it (hex, base32, lower-case alphanumeric, alphanumeric, base64).  Three tests compare it
with uniform randomness in that encoding:

* chi-squared of the alphabet's uniformity, over groups of signs that ordinary text uses unevenly
  (frequent, middling and rare letters, capitals, digits, separators; of hexadecimal pairs of values),
* the runs test over kinds of signs (small letters, capitals, digits, separators): the squared
  distance of the number of changes from what uniform randomness yields,
* the lag-1 serial correlation of vowels (of hexadecimal: of the upper half), squared, times n.

Their sum X, in which the runs test counts twice, doesn't grow with the length n of a random string; of ordinary ones it does.  So
sqrt(X / n) is compared with that of *ordinary* runs in normal approximation, whose mean and spread by
encoding and length are fitted to names and paths (``ORDINARY``): z, and the longer a run, the
further a random one lies below.  Benjamini-Hochberg over all runs of the corpus picks the
p value up to which the share of false discoveries stays below ``rate``; it needs a
histogram of fixed size only.  Runs whose X uniform randomness would exceed once in a thousand
or less often (``UNLIKELY``, simulated for each encoding) are never called random.

Base spans inside a run are known already: what is left of the run without them is tested, and
where it is random the whole run is a span.  Of what is left 12 signs or more are needed.

Positions: between the matches of a pattern lie the parts that ``split`` returns, so
running sums of their lengths give every span in code points.

Defined results: a null text is empty and has no spans; spans of different kinds may
overlap; repeated rows are scanned like any other; no candidates, no added spans; a run of
any length is scored as a whole; other columns than doc_id and text are not read.  Runs of
letters only, or of digits only, are words and numbers and never candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, cut, pieces_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
_RUN_STARTS = r"(?<![A-Za-z0-9+/_-])"
#: ``=`` pads a run and never joins two.  A run is taken whole where one encoding can hold it,
#: otherwise by the parts between ``+`` and ``/``; signs of padding count towards the 20.
RANDOM = (
    rf"{_RUN_STARTS}[A-Za-z0-9+/]{{20,}}+(?![_-])=*+|{_RUN_STARTS}(?:[A-Za-z0-9+/]{{18}}==|[A-Za-z0-9+/]{{19}}=)=*+"
    r"|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+=*+|(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]{18}==|[A-Za-z0-9_-]{19}=)=*+"
)
#: The parts between ``-`` and ``_`` of a run that holds ``+`` or ``/`` too.
RANDOM_PARTS = (
    r"(?<=[_-])(?=[A-Za-z0-9]*+[+/])[A-Za-z0-9+/]{20,}+=*+"
    rf"|{_RUN_STARTS}(?=[A-Za-z0-9]*+[+/])[A-Za-z0-9+/]{{20,}}+(?=[_-])"
)
KINDS = ("assign", "access", "hex", "random")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, what it holds, alphabet in the order of the ordinals
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower36", r"^[a-z0-9]+$", _LOWER + _DIGITS),
    ("alnum62", r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: A run's signs beside base spans, at least.
REST_LEAST = 12
#: Base spans that a run can hold.
KNOWN = f"{ACCESS}|{HEX}"
_SIGNS = _UPPER + _LOWER + _DIGITS + "+/-_"
_HEXADECIMAL = "0123456789abcdef"
#: Groups of signs for the chi-squared test, kinds of signs for the runs test, marks for the serial test.
GROUPS = "".join("f" if c in "aeioulnrst" else "m" if c in "bcdfghmp" else "r" if c in _LOWER else "u" if c in _UPPER else "d" if c in _DIGITS else "s" for c in _SIGNS)
TYPES = "".join("l" if c in "fmr" else c for c in GROUPS)
VOWELS = "".join(str(int(c.lower() in "aeiou")) for c in _SIGNS)
HEX_GROUPS, HEX_TYPES, HEX_UPPER_HALF = "0011223344556677", "ddddddddddllllll", "0000000011111111"
#: Of ordinary runs: sqrt(X / n) has mean m0 - m1 / n and variance s / n; ``tests/llm/battery.py`` fits
#: m0, m1 and s to the names of Python's library, s so that one run in a thousand lies 3.09 roots below.
ORDINARY = {
    "hex": (1.325, -2.59, 0.561), "base32": (1.251, 3.99, 0.393), "lower36": (1.499, 6.89, 0.319),
    "alnum62": (1.951, 7.33, 1.623), "base64": (1.964, 5.22, 0.677), "base64url": (1.898, 5.85, 0.467),
}
#: X that a random string exceeds once in a thousand, simulated at 20 to 200 signs.
UNLIKELY = {"hex": 38.9, "base32": 35.4, "lower36": 33.4, "alnum62": 32.6, "base64": 33.0, "base64url": 33.0}
#: The histogram's bins of z: width and range.
STEP, LOW, HIGH = 0.02, -40.0, 8.0
BLOCK = 256
MARK = "[SECRET]"


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The combination (a sum, a maximum) of all earlier values, for each; blocks keep the copying of accumulators in bounds."""

    def running(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.expr("cast(array() AS array<int>)").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    blocks = F.when(
        F.size(values) > 0,
        F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK)),
    ).otherwise(F.expr("cast(array() AS array<array<int>>)"))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
    return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))


def _parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies before each match, and the matches; both empty where there is none."""
    none = F.expr("cast(array() AS array<string>)")
    hit = text.rlike(pattern)
    matches = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(hit, F.split(text, pattern)).otherwise(none)
    return gaps, matches


def _spans(gaps: str, matches: str) -> Column:
    """``start, end`` of each match, in code points."""
    lengths = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))
    )
    start = _before(F.transform(lengths, lambda x: x["g"] + x["m"]), lambda a, x: a + x)
    return F.zip_with(
        start, lengths, lambda s, x: F.struct((s + x["g"]).alias("start"), (s + x["g"] + x["m"]).alias("end"))
    )


def _encoding(run: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        out = F.when(run.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(run.rlike("[0-9]") & run.rlike("[A-Za-z]"), out)


def _uniform(name: str, alphabet: str) -> tuple[list[tuple[str, float]], float, float]:
    """What uniform randomness over an alphabet yields: its groups with their shares, how probable a
    change of kind is, and the covariance of two changes in a row."""
    signs, groups, types = (_HEXADECIMAL, HEX_GROUPS, HEX_TYPES) if name == "hex" else (_SIGNS, GROUPS, TYPES)
    held = [signs.index(c) for c in (alphabet.lower() if name in ("hex", "base32") else alphabet)]

    def share(of: str) -> dict[str, float]:
        return {x: sum(of[i] == x for i in held) / len(held) for x in sorted({of[i] for i in held})}

    change = 1 - sum(p * p for p in share(types).values())
    twice = sum(p * (1 - p) ** 2 for p in share(types).values())
    return list(share(groups).items()), change, twice - change * change


def _number(text: Column, pattern: str) -> Column:
    """How many matches of one sign each."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def scored(runs: Column) -> Column:
    """``x`` (X as a share of what is unlikely for random strings) and ``z`` (its place among ordinary strings) of each run.

    Null for runs without an encoding.  A sign's group, kind and mark are found by translation,
    so each statistic is a pass of string functions over the run.  Each step is a list of its own, so that
    what a later step uses often is a field and not a copy of the expression.
    """
    uniform = {name: _uniform(name, alphabet) for name, _, alphabet in ENCODINGS}

    def told(encoding: Column, value: Callable[[str], Column]) -> Column:
        out = F.lit(None)
        for name in uniform:
            out = F.when(encoding == name, value(name)).otherwise(out)
        return out

    def groups(name: str) -> Column:
        return F.array(*[F.struct(F.lit(g).alias("sign"), F.lit(p).alias("share")) for g, p in uniform[name][0]])

    def translated(r: Column, hexadecimal: str, other: str) -> Column:
        return F.when(r["encoding"] == "hex", F.translate(r["body"], _HEXADECIMAL, hexadecimal)).otherwise(F.translate(r["body"], _SIGNS, other))

    left = F.transform(runs, lambda r: F.when(r.rlike(KNOWN), F.regexp_replace(r, KNOWN, "")).otherwise(r))
    named = F.transform(left, lambda r: F.struct(r.alias("run"), F.when(F.length(r) >= REST_LEAST, _encoding(r)).alias("encoding")))
    bodies = F.transform(
        named,
        lambda r: F.struct(
            r["encoding"].alias("encoding"),
            # null without an encoding, as is all that follows from it
            F.regexp_replace(F.when(r["encoding"].isin("hex", "base32"), F.lower(r["run"])).when(r["encoding"].isNotNull(), r["run"]), "=+$", "").alias("body"),
        ),
    )
    placed = F.transform(
        bodies,
        lambda r: F.struct(
            r["encoding"].alias("encoding"),
            F.length(r["body"]).cast("double").alias("n"),
            translated(r, HEX_GROUPS, GROUPS).alias("groups"),
            translated(r, HEX_TYPES, TYPES).alias("types"),
            translated(r, HEX_UPPER_HALF, VOWELS).alias("marks"),
        ),
    )
    counted = F.transform(
        placed,
        lambda r: F.struct(
            r["encoding"].alias("encoding"),
            r["n"].alias("n"),
            F.transform(
                told(r["encoding"], groups),
                lambda g: F.struct((r["n"] - F.length(F.replace(r["groups"], g["sign"], F.lit("")))).alias("count"), (r["n"] * g["share"]).alias("expected")),
            ).alias("groups"),
            (F.length(F.regexp_replace(r["types"], "l++|u++|d++|s++", "x")) - 1).alias("changes"),
            told(r["encoding"], lambda name: F.lit(uniform[name][1])).alias("change"),
            told(r["encoding"], lambda name: F.lit(uniform[name][2])).alias("joint"),
            _number(r["marks"], "1").alias("ones"),
            _number(r["marks"], "1(?=1)").alias("pairs"),
            (F.startswith(r["marks"], F.lit("1")).cast("double") + F.endswith(r["marks"], F.lit("1")).cast("double")).alias("ends"),
        ),
    )
    tested = F.transform(
        counted,
        lambda r: F.struct(
            r["encoding"].alias("encoding"),
            r["n"].alias("n"),
            F.aggregate(r["groups"], F.lit(0.0), lambda acc, g: acc + (g["count"] - g["expected"]) * (g["count"] - g["expected"]) / g["expected"]).alias("chi"),
            (
                F.pow(r["changes"] - (r["n"] - 1) * r["change"], F.lit(2.0))
                / ((r["n"] - 1) * r["change"] * (1 - r["change"]) + 2 * (r["n"] - 2) * r["joint"])
            ).alias("runs"),
            # sums over neighbours of (mark - mean) * (next mark - mean), and over all of (mark - mean) squared
            (r["pairs"] - (2 * r["ones"] - r["ends"]) * r["ones"] / r["n"] + (r["n"] - 1) * F.pow(r["ones"] / r["n"], F.lit(2.0))).alias("along"),
            (r["ones"] - r["ones"] * r["ones"] / r["n"]).alias("spread"),
        ),
    )
    summed = F.transform(
        tested,
        lambda r: F.struct(
            r["encoding"].alias("encoding"),
            r["n"].alias("n"),
            (r["chi"] + 2 * r["runs"] + F.when(r["spread"] > 0, r["n"] * F.pow(r["along"] / r["spread"], F.lit(2.0))).otherwise(0.0)).alias("x"),
        ),
    )

    def among_ordinary(r: Column, name: str) -> Column:
        m0, m1, s = ORDINARY[name]
        return (F.sqrt(r["x"] / r["n"]) - (m0 - m1 / r["n"])) / F.sqrt(s / r["n"])

    return F.transform(
        summed,
        lambda r: F.struct(
            (r["x"] / told(r["encoding"], lambda name: F.lit(UNLIKELY[name]))).alias("x"),
            F.least(F.lit(HIGH), F.greatest(F.lit(LOW), told(r["encoding"], lambda name: among_ordinary(r, name)))).alias("z"),
        ),
    )


def with_parts(docs: DataFrame) -> DataFrame:
    """The input with a column ``parts_<kind>`` of ``gaps`` and ``matches`` for each kind, and for parts of runs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = dict(zip((*KINDS, "within"), (ASSIGN, ACCESS, HEX, RANDOM, RANDOM_PARTS), strict=True))
    out = docs
    for kind, pattern in patterns.items():
        gaps, matches = _parts(text, pattern)
        out = out.withColumn(f"parts_{kind}", F.struct(gaps.alias("gaps"), matches.alias("matches")))
    return out


def located(docs: DataFrame) -> DataFrame:
    """The input with ``base array<start, rank, end>`` and ``candidates array<start, end, x, z>``."""
    held = with_parts(docs).select(
        *docs.columns,
        *[F.struct(_spans(f"parts_{k}.gaps", f"parts_{k}.matches").alias("spans"), F.col(f"parts_{k}.matches").alias("matches")).alias(k) for k in (*KINDS, "within")],
    )

    runs = F.struct(F.concat("random.spans", "within.spans").alias("spans"), F.concat("random.matches", "within.matches").alias("matches"))
    held = held.withColumn("random", runs).withColumn("random", F.struct("random.spans", scored(F.col("random.matches")).alias("scores")))

    def base(kind: str, rank: int) -> Column:
        spans = F.zip_with(f"{kind}.spans", f"{kind}.matches", lambda s, m: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), m.alias("match")))
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
        return F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"]))

    candidates = F.zip_with(
        "random.spans", "random.scores", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v["x"].alias("x"), v["z"].alias("z"))
    )
    return held.select(
        *docs.columns,
        F.concat(*[base(k, i) for i, k in enumerate(KINDS[:3])]).alias("base"),
        F.filter(candidates, lambda c: c["z"].isNotNull()).alias("candidates"),
    )


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, candidates`` without the texts."""
    return located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "base", "candidates")


def discovery_threshold(z: DataFrame, rate: float) -> float | None:
    """The z up to which candidates are discoveries; ``z(z)`` has a row a candidate.

    Benjamini-Hochberg over the bins of a histogram, by their upper edges.
    """
    bins = z.groupBy(F.floor((F.col("z") - LOW) / STEP).alias("bin")).agg(F.count("*").alias("n"))
    edge = F.col("bin") * STEP + STEP + LOW
    p = 1 / (1 + F.exp(-1.5976 * edge - 0.070566 * edge * edge * edge))  # the normal distribution, nearly
    ordered = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row a bin, of a fixed number of bins
    ranked = bins.select(edge.alias("edge"), p.alias("p"), F.sum("n").over(ordered).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return ranked.filter(F.col("p") * F.col("all") <= rate * F.col("upto")).agg(F.max("edge")).first()[0]


def is_secret(x: Column, z: Column, threshold: float | None) -> Column:
    return F.lit(False) if threshold is None else F.coalesce((z < threshold) & (x <= 1), F.lit(False))


def scan_secrets(found: DataFrame, rate: float = 0.05) -> DataFrame:
    """``doc_id, base, spans``: spans ``start, rank, end`` by place; ``rank`` counts KINDS.

    ``found`` is ``found_spans``, cut off by the caller as it is read twice.
    """
    z = found.select(F.explode("candidates").alias("c")).select("c.z")
    return found.select("doc_id", F.array_sort("base").alias("base"), all_spans(discovery_threshold(z, rate)).alias("spans"))


def all_spans(threshold: float | None) -> Column:
    """Base spans and the candidates that are secrets, by place."""
    added = F.transform(
        F.filter("candidates", lambda c: is_secret(c["x"], c["z"], threshold)),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")),
    )
    return F.array_sort(F.concat("base", added))


def redact_secrets(docs: DataFrame, rate: float = 0.05, mark: str = MARK) -> DataFrame:
    """The input with its secrets in ``text`` replaced by ``mark``; texts without any, and null, stay as they are.

    The spans are those of ``scan_secrets``, found in the text as it came; spans that overlap or
    touch are united and replaced by one mark, so no sign of a span is left.  Columns of any
    name pass through.  Two passes over the texts: the first yields the threshold, a single number.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.select(F.concat(_parts(text, RANDOM)[1], _parts(text, RANDOM_PARTS)[1]).alias("runs"))
    z = parts.select(F.explode(scored(F.col("runs"))).alias("c")).filter(F.col("c.z").isNotNull()).select("c.z")
    threshold = discovery_threshold(z, rate)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    spanned = located(rows).select("row", "text", all_spans(threshold).alias("spans"))
    clean = F.when(F.size("spans") > 0, without_spans(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    return spanned.select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def without_spans(text: Column, spans: Column, mark: str = MARK) -> Column:
    """``text`` with each run of overlapping or touching ``spans(start, ..., end)``, sorted, replaced by ``mark``.

    What lies before a run is cut out of pieces, so the time is linear in the text.
    """

    def rest(x: Column) -> Column:
        # the furthest end before each span: where it is passed, a run of spans begins
        reached = _before(F.transform(x["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        begins = F.filter(
            F.zip_with(x["spans"], reached, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reached"))),
            lambda b: (b["start"] > b["reached"]) | (b["reached"] == 0),
        )
        kept = F.transform(begins, lambda b: cut(x["pieces"], b["reached"], b["start"]))
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(kept, mark), F.lit(mark), cut(x["pieces"], last, x["n"]))

    return bound(F.struct(pieces_of(text).alias("pieces"), spans.alias("spans"), F.length(text).alias("n")), rest)
