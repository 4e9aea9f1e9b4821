"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over
domains, so a document that mixes domains counts in part towards each. Rates
(how often a document is taken) then follow from nonnegative least squares: the
squared distance of expected domain totals from their targets, plus a small
pull of every rate towards one. Projected gradient steps solve it over the
distributed rows: gradients add up to one number for each domain, a row's rate
is what they give for its posterior, projected on the rates that are allowed,
and a step needs only the totals of the rows, so no rates are kept, moved or lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, slices, texts_of

#: Labelled documents that the classifier is fitted on, at most; its hashed features; words in a task's table.
FIT_ROWS, DIMENSIONS, TABLE_WORDS = 6_000, 1 << 16, 300_000
#: Steps at most, the gradient (as a share of all tokens) at which they end, and the weight of the pull to rate one.
STEPS, NEAR, PULL = 60, 1e-6, 1e-6
#: Words that are classified together, and what smooths their counts.
STRETCH, SMOOTH = 20, 0.5


class DomainModel:
    """Multinomial naive Bayes over hashed words, applied to stretches of a text: one that mixes domains keeps a soft posterior."""

    def __init__(self, domains: list[str], counts: np.ndarray, rows: np.ndarray):
        self.domains = domains
        p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * DIMENSIONS)
        self.word = np.log(p).T.astype(np.float32)  # a row for each feature
        self.prior = np.log((rows + 1) / (rows.sum() + len(domains)))


class Words:
    """Hashed words of texts, through a table of the words met so far."""

    def __init__(self):
        self.table: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if len(self.table) > TABLE_WORDS:
            self.table = {}
        for w in set(words).difference(self.table):
            self.table[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % DIMENSIONS
        return np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))


def fit(docs: DataFrame, labelled: DataFrame, limit: int = FIT_ROWS) -> DomainModel | None:
    """The classifier, from at most `limit` labelled documents (those of smallest hashed id). labelled: (doc_id, domain).

    A document that is repeated counts once, and once for each of its texts if rows share its id.
    """
    named = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna()
    sample = named.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            n: dict[str, int] = {}
            for domain, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                sums[domain] = sums.get(domain, 0) + np.bincount(words.of(text), minlength=DIMENSIONS)
                n[domain] = n.get(domain, 0) + 1
            for d, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([d] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[n[d], c[at]])], ["domain", "feature", "n"])

    # at most DIMENSIONS + 1 sums for each domain
    found = rows.select("domain", "text").mapInArrow(run, "domain string, feature long, n long").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    domains = sorted(found["domain"].unique())
    counts = np.zeros((len(domains), DIMENSIONS + 1))
    counts[found["domain"].map(domains.index), found["feature"]] = found["n"]  # feature -1: the last column
    return DomainModel(domains, counts[:, :-1], counts[:, -1])


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """docs without text but with n_tokens and mass array<double>: each text's words, and these shared out over the domains."""
    # arrays alone, so executors need none of our classes to read it
    shared, at = docs.sparkSession.sparkContext.broadcast((model.word, model.prior)), docs.columns.index("text")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word, prior), words = shared.value, Words()
        for b in batches:
            texts = texts_of(b.column(at))
            for x, y in slices(texts):
                n, mass = [], []
                for t in texts[x:y]:
                    ids = words.of(t)
                    n.append(len(ids))
                    if len(ids):
                        starts = np.arange(0, len(ids), STRETCH)
                        z = np.add.reduceat(word[ids], starts, axis=0) + prior
                        p = np.exp(z - z.max(1, keepdims=True))
                        p *= (np.diff(np.r_[starts, len(ids)]) / p.sum(1))[:, None]
                        mass.append(p.sum(0).tolist())
                    else:
                        mass.append([0.0] * len(prior))
                rest = [c.slice(x, y - x) for i, c in enumerate(b.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(mass, pa.list_(pa.float64()))], [*names, "n_tokens", "mass"])

    return docs.mapInArrow(run, "".join(f"`{k}` {v}, " for k, v in docs.dtypes if k != "text") + "n_tokens long, mass array<double>")


def _free(pulled: np.ndarray) -> Column:
    """A row's rate before it is projected on the rates allowed: one, and what the gradients so far give for its posterior."""
    return F.lit(1.0) + sum(F.get("mass", F.lit(i)) * F.lit(float(v)) for i, v in enumerate(pulled)) / F.greatest("n_tokens", F.lit(1))


def fit_rates(masses: DataFrame, targets: list[float], least_rate: float | None = 1.0) -> tuple[Column, dict]:
    """The rate of each row as a column over `mass` and `n_tokens`, and what the fit reached.

    targets: weights of the domains, in their order. With least_rate no rate is
    lower, and token totals are scaled so that targets ask no domain for fewer
    tokens than that gives; with None the total stays and rates go down to 0.
    The dict holds totals, targets, steps, and residual: the largest miss of a
    domain as a share of all tokens.

    Least squares over rates r of rows with masses m and n tokens, with
    w = PULL * (mean square of masses): |sum r m - target|^2 / w + sum n (r - 1)^2.
    Gradients g add up to r = max(least, 1 + g m / n); a step is the gradient
    in the metric of the rows that the bound doesn't hold, halved until it
    raises the dual objective, the sum of whose rows comes with the totals.
    """
    k, low = len(targets), least_rate or 0.0
    mass = [F.get("mass", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(pulled: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """In one pass the token totals at these rates, the products of masses over the rows that are free to move, and the rows' share of the dual objective."""
        free, n = _free(pulled), F.greatest("n_tokens", F.lit(1))
        rate = F.greatest(free, F.lit(low))
        products = (F.sum(F.when(free >= low, mass[i] * mass[j] / n)) for i, j in pairs)
        row = [x or 0.0 for x in masses.agg(*(F.sum(rate * m) for m in mass), *products, F.sum(n * (rate * (free - 1) - (rate - 1) * (rate - 1) / 2))).first()]
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k:], strict=False):
            gram[i, j] = gram[j, i] = v
        return np.array(row[:k], float), gram, row[-1]

    at, want = np.zeros(k), np.array(targets, float)
    got, gram, rows = sums(at)
    total = got.sum()
    if total <= 0 or want.sum() <= 0:
        return F.lit(1.0), {"totals": got, "targets": got, "steps": 0, "residual": 0.0}
    want = want / want.sum() * (total if least_rate is None else max(h / w for h, w in zip(got, want / want.sum(), strict=True) if w > 0) * least_rate)
    pull, length, steps = PULL * np.trace(gram) / k, 1.0, 0
    while steps < STEPS:
        slope = want - got - pull * at
        if np.abs(slope).max() <= NEAR * want.sum():
            break
        steps += 1
        step = np.linalg.solve(gram + pull * np.eye(k), slope)
        trial = at + length * step
        to, free, value = sums(trial)
        gain = want @ (trial - at) - pull / 2 * (trial @ trial - at @ at) - value + rows
        if gain >= 1e-4 * length * (slope @ step):
            at, got, gram, rows, length = trial, to, free, value, 1.0
        else:
            length /= 2
    return F.greatest(_free(at), F.lit(low)), {"totals": got, "targets": want, "steps": steps, "residual": float(np.abs(got - want).max() / want.sum())}


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least_rate: float | None = 1.0,
    id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_ROWS, whole: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies, residual) of every document.

    labelled: (doc_id, domain). targets: weights by domain; a domain without a
    weight is asked for nothing. rate: how often the document is to be taken;
    copies: that as a whole number, the rest of a rate being drawn by a hash of
    id and text, so that expected totals match; residual: the share of all
    tokens by which the fitted totals miss their targets at most.

    A null or empty text has no tokens, rate one and one copy, and a null
    domain. A null id stays null and its text is drawn like any other. Repeated
    rows have equal rates. Without labelled documents every rate is one. An
    empty table gives an empty one; other columns are ignored, but with `whole`
    each row comes back in a struct `row`.
    """
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    docs = only(docs, id_col, text_col, whole).withColumn("draw", draw)
    model = fit(docs.select("doc_id", "text"), labelled, limit) or DomainModel([""], np.zeros((1, DIMENSIONS)), np.zeros(1))
    masses = cut(posteriors(docs.select("doc_id", "draw", "text"), model), "mixing-masses")
    rate, reached = F.lit(1.0), {"residual": 0.0}
    if model.domains != [""]:
        rate, reached = fit_rates(masses, [targets.get(d, 0.0) for d in model.domains], least_rate)
    # only whole rows are read and classified again, which costs less than a shuffle of their texts
    out = (posteriors(docs, model) if whole else masses).withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(1.0))
    some, best = (F.col("n_tokens") > 0) & F.lit(model.domains != [""]), F.array_max("mass")
    names = F.array(*(F.lit(d) for d in model.domains))
    return out.select(
        "doc_id", "n_tokens", F.when(some, F.element_at(names, F.array_position("mass", best).cast("int"))).alias("domain"), F.when(some, best / F.col("n_tokens")).alias("posterior"),
        "rate", (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"), F.lit(reached["residual"]).alias("residual"), *["row"] * whole,
    )
