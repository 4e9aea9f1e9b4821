"""Toxicity from class-conditional Kneser-Ney models.

Toxic and ordinary labelled documents each give a model of a word behind the
last: P(w | u) = (max(c(u, w) - D, 0) + B(u, w) + R P(w)) / Z(u). Counts of the
larger class are scaled to the size of the smaller, D is n1 / (n1 + 2 n2) of the
smaller one, and Z(u) makes probabilities add up to one, so a language that is
commoner in one class cancels out where its words follow each other. Words are
counted by the contexts they stand in (continuation counts), discounted likewise.

Rare expressions lean on counts that the classes share. A pair that either has
gets B(u, w), SHARED_PAIR counts tilted by how the class differs in the word;
SHARED_REST counts behind u go to words alone. A word has SHARED_WORD counts,
divided between the classes as words that begin alike are, and beginnings have
SHARED_STEM in both. So an expression too rare to tell the classes apart has
nearly the same probability in both, and one that a single class has stands
against the other's backoff alone.

A document's measure compares its likelihoods normalised by length: the log of
the mean over its tokens of the squared likelihood ratio, in which telling
tokens aren't drowned by the many that tell nothing. A rising logistic curve
calibrated on documents kept out of the counts turns it into a score. The
difference of the mean log-likelihoods, which is the limit of such power means,
and that of the best stretch are columns of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, labelled_sample, labelled_texts, only, slices, texts_of

#: Labelled documents that models and curve are fitted on, at most.
FIT_ROWS = 12_000
#: Of the labelled documents, one in so many calibrates the curve and isn't counted.
CALIBRATE = 4
#: Shared backoff counts of a word, a beginning, a pair, and behind a context of words alone.
SHARED_WORD, SHARED_STEM, SHARED_PAIR, SHARED_REST = 0.3, 3.0, 3.0, 5.0
#: Characters of a word's beginning.
STEM = 6
#: Tokens in the stretch that is compared on its own.
STRETCH = 5
#: Parts in which the counted pairs come to the driver.
PARTS = 16
#: Words kept in a task's table before it starts anew.
TABLE_WORDS = 300_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def token(word: str) -> str:
    """A word in lower case without punctuation around it; empty if nothing is left."""
    return word.strip(_EDGE).lower()


#: A fitted model: hashed words, beginnings, contexts and pairs with what each adds to a log ratio, and that of a new word.
Model = dict[str, tuple[np.ndarray, np.ndarray] | float]


def hashed(word: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    import xxhash

    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent tokens by class, summed over a batch before they are shuffled; words and beginnings as hashes."""
    for b in batches:
        n: dict[tuple[int, str, str], int] = {}
        for label, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            last = ""
            for w in filter(None, map(token, text.split())):
                key = (label, last, w)
                n[key] = n.get(key, 0) + 1
                last = w
        if n:
            label, last, word = zip(*n, strict=True)
            of = {w: hashed(w) for w in {*last, *word}}
            stem = {w: hashed(w[:STEM]) for w in set(word)}
            keys = [pa.array(map(h.__getitem__, w), pa.int64()) for h, w in ((of, last), (of, word), (stem, word))]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), *keys, pa.array(n.values(), pa.int64())], ["label", "last", "word", "stem", "n"])


def _paired(last: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a pair: the first hash turned by 21 bits, and the second."""
    h = last.view(np.uint64)
    return (((h << np.uint64(21)) | (h >> np.uint64(43))) ^ word.view(np.uint64)).view(np.int64)


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
    known, value = table
    if not len(known):
        return np.broadcast_to(missing, keys.shape).astype(float)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, value[at], missing)


class Comparer:
    """MEASURES of texts under two models."""

    def __init__(self, model: Model):
        self.model, self.empty = model, hashed("")
        self.start = float(_looked_up(model["contexts"], np.array([self.empty]), 0.0)[0])
        self._anew()

    def _anew(self) -> None:
        self.table: dict[str, int] = {}
        self.key, self.ratio, self.context = np.empty(0, np.int64), np.empty(0), np.empty(0)

    def learn(self, words: set[str]) -> None:
        if len(self.table) > TABLE_WORDS:
            self._anew()
        new = [(w, t) for w in words.difference(self.table) if (t := token(w))]
        self.table.update((w, -1) for w in words.difference(self.table))
        self.table.update((w, i) for i, (w, _) in enumerate(new, len(self.key)))
        key, stem = np.array([hashed(t) for _, t in new], np.int64), np.array([hashed(t[:STEM]) for _, t in new], np.int64)
        ratio = _looked_up(self.model["words"], key, _looked_up(self.model["stems"], stem, self.model["new"]))
        self.key, self.ratio = np.append(self.key, key), np.append(self.ratio, ratio)
        self.context = np.append(self.context, _looked_up(self.model["contexts"], key, 0.0))

    def ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log of the toxic over the ordinary probability of each token of the texts, and the text that it stands in."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        ids = np.fromiter(map(self.table.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        of = np.repeat(np.arange(len(texts)), [len(s) for s in split])[ids >= 0]
        ids = ids[ids >= 0]
        if not len(ids):
            return np.empty(0), of
        key, first = self.key[ids], np.r_[True, of[1:] != of[:-1]]
        last, ahead = np.where(first, self.empty, np.roll(key, 1)), np.where(first, self.start, np.roll(self.context[ids], 1))
        return _looked_up(self.model["pairs"], _paired(last, key), self.ratio[ids] + ahead), of

    def measures(self, texts: list[str]) -> np.ndarray:
        """A row for each text, length-normalised: the log mean of squared likelihood ratios, the mean log ratio, and that of the best stretch."""
        ratio, of = self.ratios(texts)
        out = np.zeros((len(texts), 3))
        if len(ratio):
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            text, n, total = of[start], np.diff(np.r_[start, len(of)]), np.add.reduceat(ratio, start)
            sums, end = np.cumsum(np.r_[0.0, ratio]), np.arange(len(ratio)) + STRETCH
            inside = np.flatnonzero((end <= len(ratio)) & (of[np.minimum(end, len(ratio)) - 1] == of))
            best = np.full(len(ratio), -np.inf)
            best[inside] = sums[inside + STRETCH] - sums[inside]
            best = np.where(n > STRETCH, np.maximum.reduceat(best, start), total)
            out[text] = np.column_stack((np.log(np.add.reduceat(np.exp(2 * ratio), start) / n), total / n, best / STRETCH))
        return out


MEASURES = ("measure", "mean", "stretch")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Constant and slope of a logistic curve, by Newton's method with a small penalty; the slope is never negative."""
    x, w = np.column_stack((np.ones(len(x)), x)), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(2), x.T @ (p - y) + 0.05 * w)
    if w[1] >= 0:
        return float(w[0]), float(w[1])
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 0.0


def _sizes(counts: list[np.ndarray]) -> tuple[list[float], float]:
    """How much the counts of each class are scaled to the size of the smaller one, and the smaller one's discount."""
    whole = [float(c.sum()) for c in counts]
    least = counts[int(whole[1] <= whole[0])]
    ones, twos = int((least == 1).sum()), int((least == 2).sum())
    return [min(whole) / max(w, 1) for w in whole], ones / max(ones + 2 * twos, 1)


def _fetched(pairs: DataFrame) -> tuple[np.ndarray, ...]:
    """last, word, n0 and n1 of a written table as arrays, by PARTS of the words, so the driver holds little twice."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for k in range(PARTS):
        part = pairs.where(F.pmod("word", F.lit(PARTS)) == k).select("last", "word", F.col("n0").cast("int"), F.col("n1").cast("int")).toArrow()
        for arrays, column in zip(found, part.columns, strict=True):
            arrays.append(column.to_numpy())
    return tuple(map(np.concatenate, found))


def fitted(pairs: DataFrame) -> Model | None:
    """The model of a written table of hashed pairs (last, word, stem of word, n0, n1); None unless both classes have some."""
    last, word, *n = _fetched(pairs)
    if min((int(x.sum()) for x in n), default=0) == 0:
        return None
    begins = pairs.groupBy("word").agg(F.min("stem").alias("stem")).toArrow()
    stem = begins.column("stem").to_numpy()[np.argsort(begins.column("word").to_numpy())]
    scale, discount = _sizes(n)
    words, of_word = np.unique(word, return_inverse=True)
    c = [np.bincount(of_word, x > 0) for x in n]
    size, word_discount = _sizes(c)
    c = [x * f for x, f in zip(c, size, strict=True)]
    rest = [float(np.minimum(x, word_discount).sum()) / len(words) + SHARED_WORD for x in c]
    stems, of_stem = np.unique(stem, return_inverse=True)
    begun = [np.bincount(of_stem, x) for x in c]
    shared = [(x + SHARED_STEM) / ((begun[0] + begun[1]) / 2 + SHARED_STEM) * r for x, r in zip(begun, rest, strict=True)]
    q = [np.maximum(x - word_discount, 0) + s[of_stem] for x, s in zip(c, shared, strict=True)]
    mean, alone = (q[0] + q[1]) / 2, SHARED_REST / (float(c[0].sum()) + SHARED_WORD * len(words))
    contexts, of_last = np.unique(last, return_inverse=True)
    p = [np.maximum(x * f - discount, 0) + (SHARED_PAIR * y / mean)[of_word] for x, f, y in zip(n, scale, q, strict=True)]
    z = [np.bincount(of_last, x) + SHARED_REST for x in p]
    p = [(x + (y * alone)[of_word]) / w[of_last] for x, y, w in zip(p, q, z, strict=True)]
    key = _paired(last, word)
    order = np.argsort(key)
    log_ratio = lambda a, b: np.log(a / b).astype(np.float32)
    return {
        "words": (words, log_ratio(q[1], q[0])), "stems": (stems, log_ratio(shared[1], shared[0])), "contexts": (contexts, log_ratio(z[0], z[1])),
        "pairs": (key[order], log_ratio(p[1], p[0])[order]), "new": float(np.log(rest[1] / rest[0])),
    }


def fit(docs: DataFrame, labels: DataFrame, where: str, limit: int = FIT_ROWS) -> tuple[Model | None, tuple[float, float]]:
    """The model and its curve. Without both classes in the counts there is no model and a constant score.

    Spark counts the pairs of the sample; the model holds every one of them and
    every word, at 12 bytes each.
    """
    sample = labelled_sample(labels, "toxic", limit, f"({where}) and label in (0, 1)").withColumn("kept_out", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CALIBRATE)) == 0)
    rows = cut(labelled_texts(docs, sample), "toxic-sample")
    pairs = cut(
        rows.where("not kept_out").select("label", "text").mapInArrow(_pairs, "label int, last long, word long, stem long, n long")
        .groupBy("last", "word").agg(F.min("stem").alias("stem"), *(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1))),
        "toxic-pairs",
    )
    model = fitted(pairs)
    out = measured(rows.where("kept_out"), model, ["label"]).orderBy("doc_id").select("measure", "label").toPandas()
    discard(rows, pairs)
    return model, curve(out["measure"].to_numpy(float), out["label"].to_numpy(float)) if len(out) else (-3.0, 1.0)


def measured(docs: DataFrame, model: Model | None, more: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # arrays alone, so executors need none of our classes to read it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(shared.value) if shared.value else None
        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts):
                found = comparer.measures(texts[x:y]) if comparer else np.zeros((y - x, len(MEASURES)))
                columns = [b.column(0), *(b.column(2 + i) for i in range(len(more)))]
                yield pa.RecordBatch.from_arrays([c.slice(x, y - x) for c in columns] + [pa.array(f) for f in found.T], ["doc_id", *more, *MEASURES])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, " + "".join(f"{m} int, " for m in more) + ", ".join(f"{m} double" for m in MEASURES))


def score_toxicity(docs: DataFrame, labels: DataFrame, where: str = "true", limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, measure, mean, stretch) of every whole text; score is the probability of the toxic label.

    labels: (doc_id, toxic) of which rows with `where` (a condition on doc_id)
    are learnt from, at most `limit`, those of smallest hashed id.

    A null or empty text has nothing to compare and gets the score of measure
    0. A null id stays null. Repeated rows give repeated rows; a document is
    learnt from once, as toxic if any of its labels says so; where rows share
    its id, from the text of the smallest hash. Without labels of both classes every
    score is the same. An empty table gives an empty one; columns other than
    those named are ignored.
    """
    docs = only(docs, id_col, text_col)
    model, (constant, slope) = fit(docs, labels, where, limit)
    z = F.lit(constant) + F.lit(slope) * F.col("measure")
    return measured(docs, model, []).withColumn("score", 1 / (1 + F.exp(-z)))
