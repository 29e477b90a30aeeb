"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

A lexicon of words and word stems is learned from labelled texts; the features are its densities,
the nearness of second-person words to its hits, and rates of capitals, punctuation and obfuscation.
Lexicon and trees are fitted on a bounded sample of labelled rows (SAMPLE_ROWS), each weighted by the
rows of its label that it stands for; scoring reads every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm.boosting import BoostedTrees, Isotonic
from rastrel.llm.common import checkpoint, prepare, release, thin

#: Labelled rows that the model is fitted on at most, of each label; lexicon entries at most.
SAMPLE_ROWS, LEXICON = 6_000, 4_000
STEMS = (4, 5, 6)
#: Folds that lexicon, trees and calibration are cross-fitted by; columns of counts by fold and label.
FOLDS = 4
_COUNTS = [f"c{k}{y}" for k in range(FOLDS) for y in (0, 1)]
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|€", "oieastasile")
_INNER = re.compile(r"[\W_]+")
#: Stripped from both ends of a word.
AROUND = string.punctuation + "“”„‘’«»¿¡…–—"
NEAR = 4
FEATURES = (
    "log_words", "hits", "hit_density", "stem_hits", "stem_density", "weight", "weight_density", "best_weight", "disguised_hits", "disguised_rate",
    "second_person", "near_second_person", "near_rate", "capitals", "shouted", "punctuation", "exclamation", "repeats", "digits", "distinct_hits",
)


def bare(word: str) -> str:
    """The word without what stands around it, in lower case."""
    return word.lower().strip(AROUND)


def entries(word: str) -> list[str]:
    """The lexicon entries that a bare word can match: itself, and its first letters with a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def _octets(*groups: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer("".join(groups).encode(), dtype=np.uint8)] = True
    return out


# kinds of UTF-8 octets; all of a character beyond ASCII count as letters
_UPPER, _DIGIT = _octets(string.ascii_uppercase), _octets(string.digits)
_LETTER = _octets(string.ascii_letters) | (np.arange(256) >= 128)
_PUNCTUATION, _SIGN = _octets(string.punctuation), _octets(string.digits, "@$!|*.-")


class Features(dict):
    """Dense features by a lexicon of entry -> weight. As a dict: what it found out about words, as numbers of hits."""

    NOTHING, SECOND = 0, 1

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.kind, self.weight = [0, 0], [0.0, 0.0]  # by number: 1 word, 2 stem, 3 disguised

    def __missing__(self, raw: str) -> int:
        word = raw.strip(AROUND)
        kind, weight = self._look(word)
        if not kind and not raw.isalpha():
            plain = _INNER.sub("", raw.translate(DISGUISE))
            if plain != word:
                kind, weight = 3 * bool(self._look(plain)[0]), self._look(plain)[1]
        if kind:
            number = len(self.kind)
            self.kind.append(kind)
            self.weight.append(weight)
        else:
            number = self.SECOND if word in SECOND_PERSON else self.NOTHING
        self[raw] = number
        return number

    def _look(self, word: str) -> tuple[int, float]:
        if not word:
            return 0, 0.0
        stem = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
        exact = self.words.get(word, 0.0)
        return (1, max(exact, stem)) if exact else (2, stem) if stem else (0, 0.0)

    def of(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        words = (text or "").lower().split()
        n = len(words)
        if not n:
            return out
        if len(self) > 300_000:
            self.clear()
            self.kind, self.weight = [0, 0], [0.0, 0.0]
        codes = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=n)
        at = np.flatnonzero(codes > self.SECOND)
        kinds = [0, 0, 0, 0]
        total = best = near = distinct = 0.0
        if len(at):
            own, times = np.unique(codes[at], return_counts=True)
            for c, k in zip(own.tolist(), times.tolist(), strict=True):
                kinds[self.kind[c]] += k
                total += k * self.weight[c]
                best = max(best, self.weight[c])
            distinct = float(len(own))
            second = np.flatnonzero(codes == self.SECOND)
            if len(second):
                r = np.searchsorted(second, at)
                gap = np.minimum(np.abs(second[np.minimum(r, len(second) - 1)] - at), np.abs(second[np.maximum(r - 1, 0)] - at))
                near = float((gap <= NEAR).sum())
        o = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        counts = np.bincount(o, minlength=256)
        upper, letter = _UPPER[o], _LETTER[o]
        letters = max(1, int(counts[_LETTER].sum()))
        punctuation = int(counts[_PUNCTUATION].sum())
        mixed = int((letter[:-2] & _SIGN[o[1:-1]] & letter[2:]).sum())
        repeats = int((letter[2:] & (o[2:] == o[1:-1]) & (o[2:] == o[:-2])).sum())
        out[:] = (
            math.log1p(n), kinds[1], kinds[1] / n, kinds[2], kinds[2] / n, total, total / n, best, kinds[3], mixed / n,
            int((codes == self.SECOND).sum()) / n, near, near / n, counts[_UPPER].sum() / letters, int((upper[:-2] & upper[1:-1] & upper[2:]).sum()) / letters,
            punctuation / (letters + punctuation), counts[33] / n, repeats / letters, counts[_DIGIT].sum() / letters, distinct,
        )
        return out


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id, as text, modulo 3 is not 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, list[float]]:
    """(doc_id, text, y) of up to `rows` labelled rows of each label, the first in the order of a hash of the id; the rows that one of each label stands for."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training_rows(labels)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64("doc_id")
    picked = [thin(ids.where(F.col("y") == y), order, rows).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    few = picked[0].union(picked[1])
    many = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = [max(1.0, many.get(y, 0) / rows) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "y"), stands  # at most 2 * rows ids


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts of each fold hold each lexicon entry."""
    counts = [Counter() for _ in range(2 * FOLDS)]
    for batch in batches:
        for text, y, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = set()
            for w in set((text or "").split()):
                word = bare(w)
                if len(word) > 1:
                    own.update(entries(word))
            counts[2 * fold + y].update(own)
    keys = list(set().union(*counts))
    for a in range(0, len(keys), 50_000):
        part = keys[a : a + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), *[pa.array([c[k] for k in part], pa.int64()) for c in counts]], names=["entry", *_COUNTS])


def learn_lexicons(sample: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Entries far more frequent in toxic texts, with their log odds, a bounded number: from all folds but each in turn, and from all."""
    n = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    terms = checkpoint(
        sample.select("text", "y", "fold").mapInArrow(_terms, "entry string, " + ", ".join(f"{c} long" for c in _COUNTS))
        .groupBy("entry").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    )
    out = []
    for left in (*range(FOLDS), None):
        own = [k for k in range(FOLDS) if k != left]
        neg, pos = (sum(n.get((k, y), 0) for k in own) for y in (0, 1))
        if not pos or not neg:
            out.append({})
            continue
        held = [sum((F.col(f"c{k}{y}") for k in own[1:]), F.col(f"c{own[0]}{y}")) for y in (0, 1)]
        odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
        top = (
            terms.select("entry", held[1].alias("pos"), held[0].alias("neg")).where(F.col("pos") >= max(2, round(0.001 * pos)))
            .withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc("odds"), F.desc("pos"), "entry").limit(size).collect()
        )
        out.append({r["entry"]: float(r["odds"]) for r in top})
    return out


class Model:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, curve: Isotonic | None, base: float):
        self.lexicon, self.trees, self.curve, self.base = lexicon, trees, curve, base
        self.features: Features | None = None

    def __getstate__(self):
        return {**self.__dict__, "features": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.features is None:
            self.features = Features(self.lexicon)
        if self.trees is None:
            return np.full(len(texts), self.base)
        if not texts:
            return np.zeros(0)
        return self.curve.predict(self.trees.decision(np.stack([self.features.of(t) for t in texts])))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows of docs; with fewer than 2 rows of a label the score is constant.

    Cross-fitted at every size: a row's features come from a lexicon of the other folds' rows, so that its odds
    are not flattered, and the calibration uses scores of trees that were not fitted on the row. Rows of a label
    that has more than `rows` weigh more by as much, so scores are probabilities at the labels' own ratio
    however many rows there are.
    """
    prepare(docs.sparkSession)
    sample, stands = _sample(docs, labels, rows)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = checkpoint(sample.select("doc_id", "text", F.col("y").cast("int").alias("y"), fold.alias("fold")))
    *without, lexicon = learn_lexicons(sample)
    names = ["doc_id", "y", "fold", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Features(x) for x in without]
        for batch in batches:
            x = [own[k].of(t).tolist() for t, k in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=names)

    data = sample.mapInArrow(run, "doc_id long, y int, fold int, x array<double>").orderBy("doc_id").collect()  # at most 2 * rows short vectors
    y = np.array([r["y"] for r in data], dtype=float)
    weight = np.where(y == 1, stands[1], stands[0])
    rate = float(np.average(y, weights=weight)) if len(y) else 0.0
    if not len(y) or min(y.sum(), (1 - y).sum()) < 2:
        return Model(lexicon, None, None, rate)
    x = np.array([r["x"] for r in data])
    weight /= weight.mean()
    held = np.zeros(len(y))
    fold = np.array([r["fold"] for r in data])
    for k in np.unique(fold):
        rest = fold != k
        held[~rest] = BoostedTrees().fit(x[rest], y[rest], weight[rest]).decision(x[~rest]) if rest.any() else 0.0
    return Model(lexicon, BoostedTrees().fit(x, y, weight), Isotonic().fit(held, y, weight), rate)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs. Null text scores as empty; null ids stay; repeated rows stay; no other column is read."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                yield pa.record_batch([part.column(0), pa.array(model.score(part.column(1).to_pylist()))], names=["doc_id", "score"])
        model.features = None
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; all columns as they were, no shuffle."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) < threshold))
        model.features = None
        release()

    return docs.mapInArrow(run, docs.schema)
