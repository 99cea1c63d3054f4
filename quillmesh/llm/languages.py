"""Language identification by unigrams summed over all segmentations (operator 11).

Each language has a probability for each piece of a fixed public vocabulary of byte strings, which
holds every single byte.  A word's probability is the sum over all ways to cut it into pieces of the
product of their probabilities; a forward recursion over its bytes sums them, for many words and all
languages at once.  A text's log probability is the sum over its words; with the shares of the
languages as prior the posterior names the language.

A word is a run of letters and the marks on them, in lower case, behind a blank, as pieces of such
vocabularies begin with one; runs longer than LETTERS, as in scripts without blanks, are several.
Digits and signs tell no language and are passed over.

Learning is expectation maximisation: expected counts of pieces by the forward-backward recursion,
from equal probabilities on.  It uses SAMPLE_DOCS documents of each language as a mean, chosen by hash
of their id, and whole texts of those; words are counted by language first, so a round passes over
distinct words.  To the driver come the expected counts: as many as the vocabulary has pieces for each of
at most LANGUAGES languages, the most frequent ones, which bounds the model.

Predicting is one pass without a shuffle over whole texts; a worker keeps the words it has scored.

Defined results: ``und`` and a score of 0 where a text is null, empty or without letters, or where
there was nothing to learn from; of equal posteriors the language that sorts first; documents
without ``lang``, or without id, teach nothing; an empty ``lang`` is a language like others; repeated
rows count as often as they are there; an empty table gives no rows; columns of the names this adds
are replaced, others pass through.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import release, slices_of_bytes
from .common import durable
from .sketches import mix

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LANGUAGES = 256
SAMPLE_DOCS = 1000
ROUNDS = 3
FOLDS, HELD_OUT = 4, 2
#: Parts of a piece's probability that all languages share, and of that part what all pieces share.
SHARED, EVEN = 0.02, 0.01
LETTERS = 32
UNKNOWN = "und"
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LETTERS - 1}}}")
_GOES_ON = regex.compile(r"[\p{L}\p{M}]*")
#: Signs of a text looked at together, words scored at once (by cells of the recursion), scored words kept.
PART, CELLS, KEPT = 1 << 18, 1 << 20, 200_000
_LETTER = mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD6E8FEB86659FD93))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Finds pieces by hash: which substrings of which words are in the vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            known = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        self.pieces = sorted(known | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, self.pieces))
        keys = np.zeros(len(self.pieces), "u8")
        size = np.array([len(p) for p in self.pieces])
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            keys[rows] = self._keys(np.frombuffer(b"".join(self.pieces[i] for i in rows), "u1").reshape(-1, n), n)[:, 0]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << _FILTER, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER)] = True

    @staticmethod
    def _keys(letters: np.ndarray, n: int) -> np.ndarray:
        """A key for each substring of n bytes of each row."""
        width = letters.shape[1] - n + 1
        total = np.zeros((len(letters), width), "u8")
        for i in range(n):
            total = total * _BASE + _LETTER[letters[:, i : i + width]]
        return mix(total + np.uint64(n))

    def found(self, letters: np.ndarray) -> list[np.ndarray]:
        """For each length n from 1: the piece at each start in each row, or -1."""
        out = []
        prefix = np.zeros((len(letters), letters.shape[1] + 1), "u8")  # hash of everything before a place
        for i in range(letters.shape[1]):
            prefix[:, i + 1] = prefix[:, i] * _BASE + _LETTER[letters[:, i]]
        power = np.ones(1, "u8")
        for n in range(1, min(self.longest, letters.shape[1]) + 1):
            power = power * _BASE
            key = mix(prefix[:, n:] - prefix[:, :-n] * power + np.uint64(n))
            piece = np.full(key.shape, -1, "i4")
            row, at = np.nonzero(self.maybe[key >> np.uint64(64 - _FILTER)])
            wanted = key[row, at]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[place] == wanted
            piece[row[hit], at[hit]] = self.order[place[hit]]
            out.append(piece)
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    with np.errstate(over="ignore"):
        return Vocabulary(path)


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, part by part; no part cuts a run of letters."""
    t = (text or "").lower()
    at = 0
    while at < len(t):
        to = min(at + PART, len(t))
        to = _GOES_ON.match(t, to).end() if to < len(t) else to
        yield _WORD.findall(t, at, to)
        at = to


def _batches(words: list[bytes], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words, their bytes in rows by falling length, and their lengths."""
    size = np.array([len(w) for w in words])
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        longest = int(size[order[at]])
        most = max(64, CELLS // ((longest + 1) * columns))
        rows = order[at : at + most]
        rows = rows[size[rows] > longest // 2]  # so that rows are not mostly empty
        letters = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in rows), "u1").reshape(len(rows), longest)
        yield rows, letters, size[rows]
        at += len(rows)


def _alive(size: np.ndarray, n: int) -> int:
    """Rows of at least n bytes; rows come by falling length."""
    return int(np.searchsorted(-size, -n, "right"))


def forward(pieces: list[np.ndarray], size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of the first e bytes of each row, for each column of p."""
    width = int(size[0])
    out = np.zeros((len(size), width + 1, p.shape[1]))
    for e in range(1, width + 1):
        rows = _alive(size, e)
        total = p[pieces[0][:rows, e - 1]].astype("f8")
        for n in range(2, min(e, len(pieces)) + 1):
            piece = pieces[n - 1][:rows, e - n]
            have = np.flatnonzero(piece >= 0)
            if len(have):
                total[have] += p[piece[have]] * np.exp(out[have, e - n] - out[have, e - 1])
        out[:rows, e] = out[:rows, e - 1] + np.log(total)
    return out


def expected(pieces: list[np.ndarray], size: np.ndarray, p: np.ndarray, column: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, columns and expected counts over all segmentations of rows, each of one column of p."""
    width, count = int(size[0]), len(size)
    ahead = np.zeros((count, width + 1))
    for e in range(1, width + 1):
        rows = _alive(size, e)
        total = p[pieces[0][:rows, e - 1], column[:rows]].astype("f8")
        for n in range(2, min(e, len(pieces)) + 1):
            piece = pieces[n - 1][:rows, e - n]
            have = np.flatnonzero(piece >= 0)
            total[have] += p[piece[have], column[have]] * np.exp(ahead[have, e - n] - ahead[have, e - 1])
        ahead[:rows, e] = ahead[:rows, e - 1] + np.log(total)
    whole = ahead[np.arange(count), size]
    behind = np.zeros((count, width + 1))
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(width - 1, -1, -1):
        rows = _alive(size, s + 1)
        total = np.zeros(rows)
        for n in range(1, min(width - s, len(pieces)) + 1):
            piece = pieces[n - 1][: _alive(size, s + n), s]
            have = np.flatnonzero(piece >= 0)
            if len(have):
                of = p[piece[have], column[have]].astype("f8")
                total[have] += of * np.exp(behind[have, s + n] - behind[have, s + 1])
                share = of * np.exp(ahead[have, s] + behind[have, s + n] - whole[have])
                found.append((piece[have], column[have], share * weight[have]))
        behind[:rows, s] = behind[:rows, s + 1] + np.log(total)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _encoded(words: Iterable[str]) -> list[bytes]:
    return [b" " + w.encode("utf-8", "surrogatepass") for w in words]


@dataclass
class LanguageModel:
    """Languages in order, log prior, and the probability of each piece (row) in each language."""

    languages: list[str]
    prior: np.ndarray
    p: np.ndarray
    path: str

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        v, out = vocabulary(self.path), np.zeros((len(words), len(self.languages)), "f4")
        with np.errstate(over="ignore"):
            for rows, letters, size in _batches(_encoded(words), len(self.languages)):
                out[rows] = forward(v.found(letters), size, self.p)[np.arange(len(rows)), size]
        return out


class Scorer:
    """Scores texts and keeps the words it has met."""

    def __init__(self, model: LanguageModel):
        self.model, self.most = model, max(10_000, min(KEPT, (1 << 24) // max(1, len(model.languages))))
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), "f4")

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place, self.scores, new = {}, self.scores[:0], list(words)
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])

    def logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and how many words it has."""
        total, count = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), "i8")
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            self._learn({w for _, words in waiting for w in words})
            for i, words in waiting:
                total[i] += self.scores[[self.place[w] for w in words]].sum(0, dtype="f8")
            waiting.clear()

        for i, text in enumerate(texts):
            for words in words_of(text):
                if words:
                    waiting.append((i, words))
                    count[i] += len(words)
                    held += len(words)
                if held >= PART:
                    settle()
                    held = 0
        settle()
        return total, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, count = self.logs(texts)
        odds = total + self.model.prior
        best = odds.argmax(1)
        share = 1 / np.exp(odds - odds.max(1, keepdims=True)).sum(1)
        return [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, count, strict=True)], np.where(count > 0, share, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities out of expected counts, piece by language."""
    sums = counts.sum(0)
    own = np.divide(counts, sums, out=np.zeros_like(counts), where=sums > 0)
    total = own.sum()
    common = own.sum(1) / total if total else np.full(len(counts), 1 / len(counts))
    common = (1 - EVEN) * common + EVEN / len(counts)
    return ((1 - SHARED) * np.where(sums > 0, own, common[:, None]) + SHARED * common[:, None]).astype("f4")


def train(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """A model from ``docs(doc_id, text, lang)``; the caller leaves out what is not to be learned from."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    most = given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    seen = {r["lang"]: r["count"] for r in most}
    languages = sorted(seen)
    size = len(vocabulary(path).pieces)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((size, 0), "f4"), path)
    prior = np.log(np.array([seen[x] for x in languages], "f8") / sum(seen.values()))
    span = 1 << 30
    # LANGUAGES rows at most
    shares = spark.createDataFrame([(x, i, int(min(1.0, sample_docs / seen[x]) * span)) for i, x in enumerate(languages)], "lang string, language int, upto long")
    sample = given.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < F.col("upto")).select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices_of_bytes(batch, 1):
                seen: Counter = Counter()
                for language, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    for words in words_of(text):
                        seen.update((language, w) for w in words)
                if seen:
                    numbers, words = zip(*seen, strict=True)
                    yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], ["language", "word", "n"])

    words = durable(sample.mapInArrow(count, "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")))
    p = np.full((size, len(languages)), 1 / size, "f4")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def estimate(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, k = vocabulary(path), shared.value.shape[1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                number, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                keys, values = [], []
                with np.errstate(over="ignore"):
                    for rows, letters, length in _batches(_encoded(batch.column(1).to_pylist()), 2):
                        piece, column, c = expected(v.found(letters), length, shared.value, number[rows], weight[rows])
                        keys.append(piece.astype("i8") * k + column), values.append(c)
                key, where = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(where, np.concatenate(values))
                yield pa.record_batch([pa.array(key), pa.array(total)], ["key", "n"])

        found = words.mapInArrow(estimate, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(size * len(languages))
        counts[found["key"].to_numpy("i8")] = found["n"].to_numpy("f8")
        p = smoothed(counts.reshape(size, -1))
        shared.unpersist()
    return LanguageModel(languages, prior, p, path)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The input's columns with ``lang_pred, score``."""
    plain = docs.drop("lang_pred", "score")
    names = plain.columns
    text = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(shared.value)
        for batch in batches:
            for some in slices_of_bytes(batch, text):
                best, score = scorer.predict(some.column(text).to_pylist())
                yield pa.record_batch([*some.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return plain.mapInArrow(run, plain.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
