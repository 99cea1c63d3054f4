"""The randomness battery in plain Python, ordinary runs, and the fit of what ordinary runs yield."""

from __future__ import annotations

import glob
import random
import re
import sysconfig
from functools import cache

import numpy as np

from quillmesh.llm import secrets as S

SHAPES = ("/".join, "_".join, "-".join, "".join, lambda w: "".join(x.title() for x in w), lambda w: "".join(w).upper(), lambda w: "_".join(w).upper())


def encoding(run: str) -> str | None:
    if re.search("[0-9]", run) and re.search("[A-Za-z]", run):
        return next((name for name, pattern, _ in S.ENCODINGS if re.search(pattern, run)), None)
    return None


def _kind(sign: str) -> str:
    return "d" if sign.isdigit() else "s" if sign in "+/-_" else "u" if sign.isupper() else "l"


def _cell(sign: str) -> str:
    return _kind(sign) if _kind(sign) in "dsu" else "f" if sign in "aeioulnrst" else "m" if sign in "bcdfghmp" else "r"


def battery(run: str, name: str) -> tuple[int, float, float, float]:
    """Length, chi-squared, twice the squared z of the runs test, n times the squared lag-1 correlation."""
    alphabet = next(a for n, _, a in S.ENCODINGS if n == name)
    body = run.rstrip("=")
    if name in ("hex", "base32"):
        alphabet, body = alphabet.lower(), body.lower()
    if name == "hex":
        cell, kind, marked = (lambda c: alphabet.index(c) // 2), _kind, (lambda c: alphabet.index(c) >= 8)
    else:
        cell, kind, marked = _cell, _kind, (lambda c: c.lower() in "aeiou")
    n = len(body)

    def share(of) -> dict:
        named = [of(c) for c in alphabet]
        return {x: named.count(x) / len(named) for x in dict.fromkeys(named)}

    cells, kinds, marks = [cell(c) for c in body], [kind(c) for c in body], [marked(c) for c in body]
    chi = sum((cells.count(x) - n * p) ** 2 / (n * p) for x, p in share(cell).items())
    q = 1 - sum(p * p for p in share(kind).values())
    twice = sum(p * (1 - p) ** 2 for p in share(kind).values())
    turns = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    runs = 2 * (turns - (n - 1) * q) ** 2 / ((n - 1) * q * (1 - q) + 2 * (n - 2) * (twice - q * q))
    mean = sum(marks) / n
    spread = sum((x - mean) ** 2 for x in marks)
    along = sum((x - mean) * (y - mean) for x, y in zip(marks, marks[1:], strict=False))
    return n, chi, runs, n * (along / spread) ** 2 if spread > 0 else 0.0


@cache
def ordinary_runs() -> dict[str, list[str]]:
    """Runs of Python's own library, and names made of its words; hexadecimal ones are its words as bytes."""
    rng = random.Random(5)
    home = sysconfig.get_path("stdlib")
    files = sorted(glob.glob(f"{home}/*.py")) + sorted(glob.glob(f"{home}/*/*.py"))
    text = "\n".join(open(f, errors="ignore").read() for f in files if not re.search("/test|site-packages|/encodings", f))
    words = sorted(set(re.findall("[a-z]{3,12}", text)))
    some = lambda low, high: [rng.choice(words) for _ in range(rng.randint(low, high))]
    made = [rng.choice(SHAPES)(some(3, 7)) + str(rng.randint(1, 2030)) for _ in range(20_000)]
    # names without separators that hold only capitals fit base32 where their digits do
    made += ["".join(some(3, 7)).upper() + str(rng.choice((2, 3, 4, 5, 6, 7, 23, 64, 256))) for _ in range(3000)]
    out: dict[str, list[str]] = {}
    for run in made + re.findall(S.RANDOM, text):
        if len(run) >= 20 and (name := encoding(run)) not in (None, "hex"):
            out.setdefault(name, []).append(run)
    out["hex"] = [h for _ in range(3000) if len(h := " ".join(some(3, 6)).encode().hex().upper()) >= 20]
    return out


def random_run(rng: random.Random, name: str, n: int) -> str:
    alphabet = next(a for m, _, a in S.ENCODINGS if m == name)
    while True:
        run = "".join(rng.choice(alphabet) for _ in range(n))
        if encoding(run) == name:
            return run


def fit(name: str) -> tuple[float, float, float]:
    """``m0, m1, s``: sqrt(X / n) of ordinary runs has mean m0 - m1 / n; of s / n (a variance) one run in a thousand lies 3.09 roots below."""
    got = np.array([battery(r, name) for r in ordinary_runs()[name]])
    n, y = got[:, 0], np.sqrt(got[:, 1:].sum(1) / got[:, 0])
    by = np.c_[np.ones(len(n)), -1 / n]
    m = np.linalg.lstsq(by, y, rcond=None)[0]
    far = np.quantile((y - by @ m) * np.sqrt(n), 0.001) / -3.09
    return float(m[0]), float(m[1]), float(far**2)
