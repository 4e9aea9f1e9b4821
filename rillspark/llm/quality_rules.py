"""Quality rules: an isolation forest over rule statistics.

Each text gives a row of rule statistics, measured as how far each lies outside
its range among labelled good documents. Trees that split random statistics at
random places are grown on labelled documents, among which bad ones are made
rare; a document that few splits set apart has short paths and is anomalous.
All labelled documents make the ranges, exact quantiles, and the score beyond
which a document goes, an exact rank; each tree is grown on a random draw from
all of them, as the method has it. Statistics are computed over every whole text
without a shuffle of texts; what is fitted on are rows of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.statistics import quantiles

from .common import cut, discard, only, slices

#: Trees, rows drawn for each, and the depth at which a tree ends.
TREES, TREE_ROWS, TREE_DEPTH = 100, 256, 8
#: Of a tree's rows, those drawn from bad documents: few, so that they are easy to set apart.
TREE_BAD = 8
#: Share of labelled good documents that calibration may give up.
GOOD_LOSS = 0.002
#: Share of good documents outside a statistic's usual range, on either side.
OUTSIDE = 0.003
#: Parts into which a range of scores is cut to find a rank.
PARTS = 4_096
SEED = 17

_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
#: Class of each byte: 0 other, 1 white space, 2 symbol, 3 upper case, 4 lower case, 5 digit, 6 other punctuation, 7 continuation.
_CLASS = np.zeros(256, np.uint8)
for _c, _of in ((6, range(33, 127)), (1, _SPACES), (2, _SYMBOLS), (3, range(65, 91)), (4, range(97, 123)), (5, range(48, 58)), (7, range(128, 192))):
    _CLASS[list(_of)] = _c

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_punct", "longest_word")
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "longest_word")


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words lie between ASCII white space, lines between line feeds."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    repeats, n = 0, len(words)
    if n > 3:
        index: dict[bytes, int] = {}
        ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        if len(index) < n:  # without a repeated word no window repeats
            pair = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
            _, which, often = np.unique(pair[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
            twice = np.zeros(n + 2, bool)
            twice[2:-2] = often[which] > 1  # at its window's last word
            repeats = int((twice[:-2] | twice[1:-1] | twice[2:])[-n:].sum())
    return (
        n, len(raw) - int(kinds[1] + kinds[7]), int(kinds[2]), len(lines) - len(set(lines)), repeats,
        len(lines), int(kinds[3]), int(kinds[4]), int(kinds[5]), int(kinds[6]), max(map(len, words), default=0),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS: shares and means, so that a text's length and language matter little."""
    words, chars, symbols, dup, repeats, lines, upper, lower, digits, punct, longest = counts.astype(float).T
    some = np.maximum(words, 1)
    return np.column_stack((
        np.log1p(chars / some), np.sqrt(symbols / some), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeats / some),
        upper / np.maximum(upper + lower, 1), np.sqrt(digits / np.maximum(chars, 1)), np.sqrt(punct / np.maximum(chars, 1)), np.log1p(longest),
    ))


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def told(good: np.ndarray, bad: np.ndarray | None) -> np.ndarray:
    """Which statistics take part, by the shares of good and of bad documents outside their ranges."""
    return np.ones(len(good), bool) if bad is None else bad >= 2 * good


def drawn_for_trees(of: np.ndarray, n: int, random: np.random.Generator) -> list[np.ndarray]:
    """For each tree n of the rows without replacement; no row for two trees where they suffice."""
    if len(of) >= TREES * n:
        return np.split(random.permutation(of)[: TREES * n], TREES)
    return [random.choice(of, n, replace=False) for _ in range(TREES)]


class IsolationForest:
    """Random trees as arrays: nodes of a tree in heap order, a leaf where the feature is -1.

    rows: FEATURES of labelled documents that trees are grown on; good: which of
    them are good. A statistic takes part only if bad documents leave its usual
    range at least twice as often as good ones, or if there are no bad ones to
    tell. usual: ends of the ranges and which statistics take part, if known of
    more rows than these. Trees share no rows where there are enough of them.
    """

    def __init__(self, rows: np.ndarray, good: np.ndarray, seed: int = SEED, usual: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        random, nodes = np.random.default_rng(seed), 2 ** (TREE_DEPTH + 1)
        self.low, self.high = usual[:2] if usual else np.quantile(rows[good], [OUTSIDE, 1 - OUTSIDE], axis=0)
        self.unit = np.maximum(self.high - self.low, 0.02)
        out = self.outside(rows) > 0
        tells = usual[2] if usual else told(out[good].mean(0), out[~good].mean(0) if (~good).any() else None)
        self.unit[~tells] = np.inf
        rows = self.outside(rows)
        self.feature = np.full((TREES, nodes), -1)
        self.split, self.path = np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
        some, other = np.flatnonzero(good), np.flatnonzero(~good)
        bad = min(TREE_BAD, len(other))
        drawn = min(TREE_ROWS - bad, len(some)) + bad
        of_some, of_other = drawn_for_trees(some, drawn - bad, random), drawn_for_trees(other, bad, random)
        for t in range(TREES):
            of = np.r_[of_some[t], of_other[t]]
            self._grow(t, 1, rows[of.astype(int)], 0, random)
        self.usual = max(float(_mean_path(np.array(drawn))), 1e-9)

    def outside(self, rows: np.ndarray) -> np.ndarray:
        """How far each statistic lies outside its usual range, on a log scale of range widths."""
        return np.log1p(np.maximum(0, np.maximum(rows - self.high, self.low - rows)) / self.unit)

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, random: np.random.Generator) -> None:
        low, high = rows.min(0), rows.max(0)
        able = np.flatnonzero(high > low)
        if depth == TREE_DEPTH or len(rows) < 2 or not len(able):
            self.path[t, node] = depth + float(_mean_path(np.array(len(rows))))
            return
        f = int(random.choice(able))
        at = random.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, at
        below = rows[:, f] <= at
        self._grow(t, 2 * node, rows[below], depth + 1, random)
        self._grow(t, 2 * node + 1, rows[~below], depth + 1, random)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row of FEATURES between 0 and 1: near 1 where paths are much shorter than usual."""
        rows = self.outside(rows)
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(TREE_DEPTH):
                f = feature[node]
                if (f < 0).all():
                    break
                node = np.where(f < 0, node, 2 * node + (rows[each, f] > split[node]))
            total += path[node]
        return 2.0 ** (-total / TREES / self.usual)


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The score above which a document goes.

    Of the thresholds that give up at most GOOD_LOSS of the good rows, the one
    with the largest share of bad rows above it; among equals the middle of the
    gap. Without bad rows, nothing that looks like the good rows goes.
    """
    keep = np.sort(scores[good])
    least = keep[min(len(keep) - 1, int(np.ceil(len(keep) * (1 - GOOD_LOSS))) - 1)]
    bad = scores[~good]
    above = bad[bad > least]
    return float((least + above.min()) / 2) if len(above) else float(keep[-1])


def statistics(docs: DataFrame, forest: IsolationForest | None = None, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS..., anomaly) of every whole text; anomaly is null without a forest. With `whole`, also the row."""
    return _measured(only(docs, id_col, text_col, whole), forest)


def _measured(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """(doc_id, COUNTS..., anomaly, ...) of docs (doc_id, text, ...)."""
    names = ["doc_id", *COUNTS, "anomaly", *docs.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for x, y in slices(texts):
                counts = np.array([text_counts(t) for t in texts[x:y]], np.int64)
                score = pa.array(forest.score(features(counts))) if forest else pa.nulls(y - x, pa.float64())
                rest = [c.slice(x, y - x) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), *map(pa.array, counts.T), score, *rest], names)

    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "anomaly double", *(f"{k} {v}" for k, v in docs.dtypes[2:])]))


def _table(b: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([b.column(x).to_numpy() for x in names])


def _scored(rows: DataFrame, forest: IsolationForest, counts: bool = True) -> DataFrame:
    """rows with COUNTS, or else with FEATURES, and the anomaly of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(_table(b, COUNTS)) if counts else _table(b, FEATURES)
            yield b.append_column("anomaly", pa.array(forest.score(x)))

    return rows.mapInArrow(run, ", ".join([*(f"{k} {v}" for k, v in rows.dtypes), "anomaly double"]))


def _labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, FEATURES...) of all labelled documents that the plain rules don't reject.

    Where labels repeat the largest holds, and where rows share an id the text
    of the smallest hash. counted: (doc_id, of_text, COUNTS...).
    """
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    ratings = ratings.groupBy("doc_id").agg((F.max("label") >= 1).alias("good"))
    one = counted.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("of_text", *COUNTS)).alias("x"))
    rows = one.join(ratings, "doc_id").select("doc_id", "good", "x.*").drop("of_text").where(~base_failed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *map(pa.array, features(_table(b, COUNTS)).T)], ["doc_id", "good", *FEATURES])

    return rows.mapInArrow(run, ", ".join(["doc_id long", "good boolean", *(f"{c} double" for c in FEATURES)]))


def ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the usual range of each of FEATURES among good rows, and which of FEATURES take part, over all rows."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(FEATURES))))
    found = quantiles(rows.where("good").select(each.alias("x")).select("x.*"), ["feature"], "value", {"low": OUTSIDE, "high": 1 - OUTSIDE}, digits=30)
    low, high = np.array([(r["low"], r["high"]) for r in sorted(found.collect())]).T
    out = (F.avg(((F.col(c) < a.item()) | (F.col(c) > b.item())).cast("double")) for c, a, b in zip(FEATURES, low, high, strict=True))
    shares = {r[0]: np.array(r[1:]) for r in rows.groupBy("good").agg(*out).collect()}
    return low, high, told(shares[True], shares.get(False))


def ranked(scores: DataFrame, rank: int) -> float:
    """The value of a rank (from 0) among the values of `anomaly`: the range that holds it is cut into parts until one value is left."""
    low, high = scores.agg(F.min("anomaly"), F.max("anomaly")).first()
    while low < high:
        part = F.least(F.floor((F.col("anomaly") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        inside = scores.where(F.col("anomaly").between(low, high)).groupBy(part.alias("part"))
        for _, n, low, high in inside.agg(F.count("*"), F.min("anomaly"), F.max("anomaly")).orderBy("part").collect():  # noqa: B007
            if rank < n:
                break
            rank -= n
    return low


def threshold(scores: DataFrame, n: int) -> float:
    """What calibrate() gives, of a table (anomaly, good) with n good rows."""
    keep = scores.where("good")
    least = ranked(keep, min(n - 1, int(np.ceil(n * (1 - GOOD_LOSS))) - 1))
    above = scores.where(~F.col("good") & (F.col("anomaly") > least)).agg(F.min("anomaly")).first()[0]
    return float(keep.agg(F.max("anomaly")).first()[0] if above is None else (least + above) / 2)


def base_failed() -> F.Column:
    """The plain rules: under 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(counted: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """The forest and its threshold, from all labelled documents (quality 1 good, 0 bad). counted: (doc_id, of_text, COUNTS...).

    Documents that the plain rules reject take no part. None if fewer than two
    good documents remain. To the driver come the rows that trees are grown on,
    at most TREE_ROWS for each tree: those of smallest hashed id.
    """
    rows = cut(_labelled(counted, labels), "rule-rows")
    good, bad = rows.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if good < 2:
        discard(rows)
        return None
    usual = ranges(rows)
    place = F.xxhash64("doc_id")
    grown = []
    for of, m, n in ((rows.where("good"), good, TREES * TREE_ROWS), (rows.where("not good"), bad, TREES * TREE_BAD)):
        # each task sends its first n rows, so no more than about twice as many take part
        first = of.where(place <= F.lit((min(max(m, 1), 2 * n) << 64) // max(m, 1) - (1 << 63) - 1)).orderBy(place, "doc_id").limit(n)
        grown.append(first.select(*FEATURES).toPandas().to_numpy(float))
    forest = IsolationForest(np.concatenate(grown), np.arange(sum(map(len, grown))) < len(grown[0]), usual=usual)
    scores = cut(_scored(rows, forest, counts=False).select("anomaly", "good"), "rule-scores")
    most = threshold(scores, good)
    discard(rows, scores)
    return forest, most


def apply_rules(docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, COUNTS..., anomaly, base_failed, kept) of every document.

    kept: not rejected by the plain rules, and no anomaly. docs needs doc_id and
    text, labels needs doc_id and quality; other columns are ignored, but with
    `whole` each row comes back in a struct `row`.

    A null or empty text has no words, fails the plain rules and is not kept. A
    null id stays null. Repeated rows give repeated rows. Without labelled good
    documents (an empty labels table, say) only the plain rules decide, and
    anomaly is null. An empty table gives an empty one.
    """
    of_text = F.xxhash64(F.coalesce("text", F.lit("")))
    counted = cut(_measured(only(docs, "doc_id", "text").withColumn("of_text", of_text), None).drop("anomaly"), "rule-statistics")
    forest, most = fit(counted, labels) or (None, 0.0)
    calm = F.coalesce(F.col("anomaly") <= F.lit(most), F.lit(True))
    if whole:  # rows are read again, which costs less than to write them
        discard(counted)
        found = statistics(docs, forest, whole)
    else:
        found = (_scored(counted, forest) if forest else counted.withColumn("anomaly", F.lit(None).cast("double"))).drop("of_text")
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & calm)
