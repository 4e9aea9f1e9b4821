"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed words and word shapes is shared by all
grades; ordered thresholds cut its score into grades (proportional odds). From
the cumulative probabilities come the expected grade and the tail probability
by which documents are selected. The model is fitted on a bounded labelled
sample; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, labelled_texts, only, slices, texts_of

#: Labelled documents that the model is fitted on, at most, and hashed features.
FIT_ROWS, DIMENSIONS = 8_000, 1 << 18
#: Words kept in a task's table before it starts anew.
TABLE_WORDS = 300_000
#: Full-batch steps, their size, and the weight of the squared norm.
STEPS, STEP, PENALTY = 150, 0.08, 2e-4

_WORDS, _DIGITS, _AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def _kind(run: re.Match) -> str:
    letters = run[0]
    return "A" if len(letters) > 1 and letters.isupper() else "a"


class Hasher:
    """Texts as sparse rows: each word's hash and its shape's, the latter also where the word repeats the one before."""

    def __init__(self):
        self.words: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        shape = _AGAIN.sub(r"\1\1", _DIGITS.sub("9", _WORDS.sub(_kind, word)))
        return zlib.crc32(word.lower().encode()) % DIMENSIONS, zlib.crc32(b"\0" + shape.encode()) % DIMENSIONS

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, feature and value of all entries; each row holds square roots of shares."""
        rows, cols, values = [], [], []
        if len(self.words) > TABLE_WORDS:
            self.words = {}
        table = self.words
        for i, text in enumerate(texts):
            words = text.split()
            if not words:
                continue
            for w in set(words).difference(table):
                table[w] = self._word(w)
            pairs = np.array([table[w] for w in words])
            again = pairs[1:][pairs[1:, 0] == pairs[:-1, 0], 1]
            ids, n = np.unique(np.concatenate((pairs.ravel(), again ^ 1)), return_counts=True)
            rows.append(np.full(len(ids), i))
            cols.append(ids)
            values.append(np.sqrt(n / len(words)))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class CumulativeLink:
    """P(grade <= k) = logistic(threshold_k - weights . text), with rising thresholds."""

    def __init__(self, grades: int, thresholds: np.ndarray, weights: np.ndarray):
        self.grades, self.thresholds, self.weights = grades, thresholds, weights.astype(np.float32)

    @classmethod
    def fit(cls, entries: tuple[np.ndarray, np.ndarray, np.ndarray], grade: np.ndarray, grades: int) -> CumulativeLink:
        """entries: of sparse rows, as Hasher gives them; grade: of each row."""
        r, c, v = entries
        n, k = len(grade), grades - 1
        # the first threshold, and logs of the gaps to the next: they stay in order whatever the step
        share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:k] / n, 0.01, 0.99)
        start = np.log(share / (1 - share))
        free = np.r_[start[:1], np.log(np.maximum(np.diff(start), 0.05))]
        weights = np.zeros(DIMENSIONS)
        m1, m2 = [np.zeros(k), np.zeros(DIMENSIONS)], [np.zeros(k), np.zeros(DIMENSIONS)]
        for step in range(1, STEPS + 1):
            cuts = np.cumsum(np.r_[free[:1], np.exp(free[1:])])
            score = np.bincount(r, v * weights[c], n)
            upper = np.where(grade < k, _logistic(cuts[np.minimum(grade, k - 1)] - score), 1.0)
            lower = np.where(grade > 0, _logistic(cuts[np.maximum(grade - 1, 0)] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
            g_cut = np.bincount(grade[grade < k], -up[grade < k], k) + np.bincount(grade[grade > 0] - 1, low[grade > 0], k)
            tail = np.cumsum(g_cut[::-1])[::-1]
            g = [np.r_[tail[:1], tail[1:] * np.exp(free[1:])], np.bincount(c, ((up - low)[r]) * v, DIMENSIONS) + PENALTY * weights]
            for j, x in enumerate((free, weights)):
                m1[j] = 0.9 * m1[j] + 0.1 * g[j]
                m2[j] = 0.99 * m2[j] + 0.01 * g[j] ** 2
                x -= STEP * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.99**step)) + 1e-7)
        return cls(grades, np.cumsum(np.r_[free[:1], np.exp(free[1:])]), weights)

    def tails(self, r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        score = np.bincount(r, v * self.weights[c], n)
        return _logistic(score[:, None] - self.thresholds)


def hashed(rows: DataFrame) -> DataFrame:
    """(doc_id, label, ids, values): labelled texts as sparse rows, which are smaller than long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            found = [hasher.rows([t])[1:] for t in texts_of(b.column(2))]
            ids, values = (pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float32())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, values], ["doc_id", "label", "ids", "values"])

    return rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ids array<int>, values array<float>")


def grade_documents(
    docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", grades: int = 3, keep_from: int = 1,
    least: float = 0.5, limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every whole text.

    ratings: (doc_id, grade_col) with grades 0 to grades - 1, at most `limit` of
    which are used (those of smallest hashed id). tail_probability: that the
    grade is keep_from or more; kept: that this is at least `least`.

    A null or empty text is scored by the thresholds alone. A null id stays
    null. Repeated rows give repeated rows; of repeated ratings of a document
    the largest holds; where rows share an id, the text of the smallest hash is
    learnt from; grades out of range or null take no part. With no rated
    document the three results are null, null and true, as nothing speaks
    against any. An empty table gives an empty one. Other columns are ignored.
    """
    docs = only(docs, id_col, text_col)
    sample = labelled_sample(ratings.select("doc_id", F.col(grade_col).alias("label")), "label", limit, f"label between 0 and {grades - 1}")
    rows = hashed(labelled_texts(docs, sample)).orderBy("doc_id").toPandas()
    model = None
    if len(rows):
        size = rows["ids"].map(len).to_numpy()
        entries = np.repeat(np.arange(len(rows)), size), np.concatenate(rows["ids"].to_list()), np.concatenate(rows["values"].to_list())
        model = CumulativeLink.fit(entries, rows["label"].to_numpy(), grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts):
                if model:
                    tails = model.tails(*hasher.rows(texts[x:y]), y - x)
                    found = [pa.array(tails.sum(1)), pa.array(tails[:, keep_from - 1]), pa.array(tails[:, keep_from - 1] >= least)]
                else:
                    found = [pa.nulls(y - x, pa.float64()), pa.nulls(y - x, pa.float64()), pa.array([True] * (y - x))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), *found], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
