"""Fitted operators: counts against brute force, held-out accuracy, odd inputs."""

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rillspark.llm import mixing, ordinal_quality, quality_rules, toxicity
from rillspark.llm.common import labelled_texts, table
from rillspark.llm.queries import labelled_languages, op5_mixing, op10_toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, 5, "a"), (None, "some words of a text " * 20, 5, "b"), (2, "", 5, None), (3, "x" * 300_000, None, "a"), (4, "word " * 100, 1, "a"), (4, "word " * 100, 1, "a"), (5, "%%% *** ###", 1, "c"), (6, "퟿ é " * 70, 2, "d")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_words int, kept string")


def slow_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_against_brute_force(spark):
    docs = table(spark, SF, "documents").limit(300).unionByName(odd(spark).select("doc_id", "text"), allowMissingColumns=True).select("doc_id", "text").collect()
    for r in docs:
        assert quality_rules.text_counts(r.text or "")[:5] == slow_counts(r.text or "")


def test_rules_keep_good_documents_and_reject_bad_ones(spark):
    large = "/root/testdata/sf0.1"  # thresholds that give up 2 good documents in 1,000 need some thousands of labels
    labels = table(spark, large, "labels")
    even = F.col("doc_id") % 2 == 0
    got = quality_rules.apply_rules(table(spark, large, "documents"), labels.where(even)).join(labels.where(~even), "doc_id").toPandas()
    rest = got[~got["base_failed"]]
    assert rest[rest["quality"] == 1]["kept"].mean() >= 0.99
    assert (~rest[rest["quality"] == 0]["kept"]).mean() >= 0.5


def test_rules_on_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.apply_rules(odd(spark), table(spark, SF, "labels").limit(0)).collect()), key=repr)
    assert got == sorted([(1, 0, True, False), (None, 100, True, False), (2, 0, True, False), (3, 1, True, False), (4, 100, True, False), (4, 100, True, False), (5, 3, True, False), (6, 140, True, False)], key=repr)
    assert quality_rules.apply_rules(odd(spark).limit(0), table(spark, SF, "labels")).isEmpty()


def test_grades_separate_held_out_documents(spark):
    labels = table(spark, SF, "labels")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    even = F.col("doc_id") % 2 == 0
    got = ordinal_quality.grade_documents(table(spark, SF, "documents"), ratings.where(even)).join(labels.where(~even), "doc_id").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() >= 0.97 and (~got[got["quality"] == 0]["kept"]).mean() >= 0.6
    assert got[got["quality"] == 1]["expected_grade"].mean() > got[got["quality"] == 0]["expected_grade"].mean() + 0.5


def test_grades_on_odd_rows(spark):
    ratings = spark.createDataFrame([(4, 2), (5, 0), (6, 1), (6, None), (4, 9), (None, 1)], "doc_id long, grade int")
    got = ordinal_quality.grade_documents(odd(spark), ratings).collect()
    assert len(got) == len(ODD) and all(0 <= r.expected_grade <= 2 for r in got)
    assert {(r.expected_grade, r.kept) for r in ordinal_quality.grade_documents(odd(spark), ratings.limit(0)).collect()} == {(None, True)}
    assert ordinal_quality.grade_documents(odd(spark).limit(0), ratings).isEmpty()


def test_grades_from_plain_sums(spark):
    """Expected grades and tails of texts from their words alone; a column named label is no rating."""
    words = ["good", "fine", "poor", "BAD!!", "x9x9", "so"]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, 12)), int(rng.integers(0, 3)), 7, "z") for i in range(60)]
    rows = [(i, t, min(2, t.count("good") // 2), a, b) for i, t, _, a, b in rows]
    docs, ratings = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 99, "z") for r in rows], "doc_id long, grade int, label int, text string")
    got = {r.doc_id: r for r in ordinal_quality.grade_documents(docs, ratings).collect()}
    hasher = ordinal_quality.Hasher()
    entries = hasher.rows([t for _, t, *_ in rows])
    m = ordinal_quality.CumulativeLink.fit(entries, np.array([r[2] for r in rows]), 3)
    for i, text, *_ in rows:
        share = Counter()
        w = text.split()
        for j, x in enumerate(w):
            word, shape = hasher.words[x]
            share[word] += 1
            share[shape] += 1
            if j and hasher.words[w[j - 1]][0] == word:
                share[shape ^ 1] += 1
        score = sum(float(m.weights[f]) * (n / len(w)) ** 0.5 for f, n in share.items())
        tails = [1 / (1 + np.exp(t - score)) for t in m.thresholds]
        assert np.isclose(got[i].expected_grade, sum(tails), atol=2e-3) and np.isclose(got[i].tail_probability, tails[0], atol=2e-3)
        assert got[i].kept == (got[i].tail_probability >= 0.5)


def test_forest_paths_against_walks():
    """Scores from walks down every tree, node by node."""
    rng = np.random.default_rng(6)
    rows, good = rng.normal(size=(400, 8)) + 3, np.arange(400) % 10 > 0
    rows[~good] += rng.choice([0, 6], (40, 8))
    forest = quality_rules.IsolationForest(rows, good)
    outside = forest.outside(rows)
    for i in (0, 3, 10, 50, 399):
        total = 0.0
        for t in range(quality_rules.TREES):
            node = 1
            while forest.feature[t, node] >= 0:
                node = 2 * node + int(outside[i, forest.feature[t, node]] > forest.split[t, node])
            total += forest.path[t, node]
        assert np.isclose(forest.score(rows[i : i + 1])[0], 2 ** (-total / quality_rules.TREES / forest.usual))
    score = forest.score(rows)
    assert score[~good].mean() > score[good].mean()
    most = quality_rules.calibrate(score, good)
    assert (score[good] > most).mean() <= quality_rules.GOOD_LOSS + 1 / good.sum()


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 80)
    rows = ordinal_quality.Hasher().rows([" ".join(["good"] * g + ["bad"] * (3 - g) + ["word"]) for g in grade])
    m = ordinal_quality.CumulativeLink.fit(rows, grade, 4)
    assert (np.diff(m.thresholds) > 0).all()
    assert np.abs(m.tails(*rows, 80).sum(1) - grade).mean() < 0.5


def test_toxicity_of_held_out_documents(spark):
    got = op10_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() >= 0.96
    assert got[got["toxic"] == 1]["predicted"].mean() >= 0.9 and got[got["toxic"] == 0]["predicted"].mean() <= 0.01


def textbook(pair):
    """Plain interpolated bigrams of both classes as functions of (last, word), from counts of pairs; and their words by context."""
    n = [sum(c.values()) for c in pair]
    f = [min(n) / x for x in n]
    small = int(n[1] <= n[0])
    ones = lambda c: sum(v == 1 for v in c.values()) / max(sum(v == 1 for v in c.values()) + 2 * sum(v == 2 for v in c.values()), 1)
    cont = [Counter(w for _, w in c) for c in pair]
    m = [sum(c.values()) for c in cont]
    g, small_word = [min(m) / x for x in m], int(m[1] <= m[0])
    big_d, d = ones(pair[small]), ones(cont[small_word])
    words = sorted({*cont[0], *cont[1]})
    off = [sum(min(c[w] * g[k], d) for w in words) / len(words) + toxicity.SHARED_WORD for k, c in enumerate(cont)]

    def stem(k, w):
        x = [sum(c[v] * g[j] for v in words if v[: toxicity.STEM] == w[: toxicity.STEM]) for j, c in enumerate(cont)]
        return (x[k] + toxicity.SHARED_STEM) / (sum(x) / 2 + toxicity.SHARED_STEM) * off[k]

    own = {w: [max(cont[k][w] * g[k] - d, 0) + stem(k, w) for k in (0, 1)] for w in words}
    q = lambda w: own.get(w) or [stem(0, w), stem(1, w)]
    behind = {}
    for c in pair:
        for u, w in c:
            behind.setdefault(u, set()).add(w)
    total = min(m) + toxicity.SHARED_WORD * len(words)

    def p(k, u, w):
        alone = q(w)[k] / total
        if u not in behind:
            return alone
        held = {v: max(pair[k][u, v] * f[k] - big_d, 0) + toxicity.SHARED_PAIR * q(v)[k] / (sum(q(v)) / 2) for v in behind[u]}
        return (held.get(w, 0) + toxicity.SHARED_REST * alone) / (sum(held.values()) + toxicity.SHARED_REST)

    return p, behind


def test_likelihoods_against_a_textbook_model(spark):
    """Ratios of words, pairs and contexts, a fixed toxic phrase of ordinary words, and the measure; probabilities add up to one."""
    rng = np.random.default_rng(2)
    common = [f"w{i}" for i in range(30)] + ["silver", "goat", "beginnings", "beginner"]
    rows = []
    for i in range(300):
        words, toxic = [str(w) for w in rng.choice(common, 25)], int(i % 4 == 0)
        if toxic:
            words[5:5] = ["silver", "goat"]
        rows.append((i, " ".join(words).replace("silver w", "silver, w"), toxic))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    kept_out = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(toxicity.CALIBRATE)) == 0).collect()}
    pair = [Counter(), Counter()]
    for i, text, toxic in rows:
        if i not in kept_out:
            t = [toxicity.token(w) for w in text.split()]
            pair[toxic].update(zip(["", *t], t, strict=False))
    p, behind = textbook(pair)
    every = {w for ws in behind.values() for w in ws}
    assert all(abs(sum(p(k, u, w) for w in every) - 1) < 0.02 for u in ("w1", "silver", "unknown") for k in (0, 1))
    model, (_, slope) = toxicity.fit(docs, labels, "true")
    comparer = toxicity.Comparer(model)
    for text in ("silver goat w1", "w1 silver", "unknown goat", "w3 w3 unknown", "beginning w2", "goat beginners of w7", "-- w1, -"):
        t = [w for w in map(toxicity.token, text.split()) if w]
        want = [np.log(p(1, *e) / p(0, *e)) for e in zip(["", *t], t, strict=False)]
        assert np.allclose(comparer.ratios([text])[0], want, atol=1e-5)
        measure, mean, _ = comparer.measures([text])[0]
        assert np.isclose(mean, np.mean(want), atol=1e-5) and np.isclose(measure, np.log(np.mean(np.exp(2 * np.array(want)))), atol=1e-4)
    several = ["silver goat w1", "", "w3", "- -", "w1 w2 w3 w4 w5 w6 silver goat w8", "w1 w2 w3 w4 w5"]
    alone = np.concatenate([comparer.measures([t]) for t in several])
    assert np.allclose(comparer.measures(several), alone) and not alone[[1, 3]].any()
    r = comparer.ratios([several[4]])[0]
    assert np.isclose(alone[4, 2], max(r[i : i + toxicity.STRETCH].mean() for i in range(len(r) - toxicity.STRETCH + 1)))
    assert slope > 0 and comparer.ratios(["silver goat"])[0][1] > 1 > abs(comparer.ratios(["goat"])[0][0])
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert np.mean([scored[i] > 0.5 for i in kept_out if rows[i][2]]) > 0.9 and np.mean([scored[i] > 0.5 for i in kept_out if not rows[i][2]]) < 0.1


def test_hashes_are_those_of_spark(spark):
    words = ["", "a", "née", "漢字" * 20, "x" * 100]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", F.xxhash64("a").alias("h")).collect():
        assert toxicity.hashed(r.a) == r.h
    keys = np.array([toxicity.hashed(w) for w in words], np.int64)
    assert len({int(toxicity._paired(keys[i : i + 1], keys[j : j + 1])[0]) for i in range(5) for j in range(5)}) == 25


def test_an_id_on_many_rows_is_learnt_from_once(spark):
    docs = spark.range(5_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    sample = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int")
    assert [tuple(r)[::2] for r in labelled_texts(docs, sample).collect()] == [(7, 1)]


def test_a_context_of_one_class_counts(spark):
    docs = spark.createDataFrame([(i, f"plain words {'of every kind' if i % 2 else 'vile'} thing") for i in range(40)], "doc_id long, text string")
    model, _ = toxicity.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int"), "true")
    assert toxicity.Comparer(model).ratios(["vile thing"])[0][1] > 0.5


def test_toxicity_on_odd_rows(spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in toxicity.score_toxicity(odd(spark), labels.limit(0)).collect()}) == 1
    assert toxicity.score_toxicity(odd(spark).limit(0), labels).isEmpty()


def test_mixture_reaches_its_targets(spark):
    targets = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    docs, labelled = table(spark, SF, "documents"), labelled_languages(spark, SF)
    got = mixing.mix(docs, labelled, targets).toPandas()
    assert len(got) == docs.count() and (got["rate"] >= 1).all() and (got["copies"] >= 1).all()
    model = mixing.fit(docs.select("doc_id", "text"), labelled)
    masses = mixing.posteriors(docs.select("text"), model).select("n_tokens", "mass")
    _, fitted = mixing.fit_rates(masses, [targets[d] for d in model.domains])
    assert np.abs(fitted["totals"] - fitted["targets"]).max() <= 1e-4 * fitted["targets"].sum()
    _, down = mixing.fit_rates(masses, [targets[d] for d in model.domains], None)
    assert np.isclose(down["targets"].sum(), masses.agg(F.sum("n_tokens")).first()[0])
    assert np.abs(down["totals"] - down["targets"]).max() <= 1e-4 * down["targets"].sum()
    true = got.merge(docs.select("doc_id", "lang").toPandas())
    assert (true["domain"] == true["lang"]).mean() >= 0.95


def dense_rates(m, n, want, low):
    """The least squares of fit_rates by trying every set of rows that the bound holds."""
    w = mixing.PULL * np.trace((m.T / n) @ m) / m.shape[1]
    best = (np.inf, None)
    for held in itertools.product((False, True), repeat=len(n)):
        h = np.array(held)
        r = np.full(len(n), low)
        if not h.all():
            a = m[~h] @ m[~h].T / w + np.diag(n[~h])
            r[~h] = np.linalg.solve(a, m[~h] @ (want - r[h] @ m[h]) / w + n[~h])
        if (r >= low - 1e-9).all():
            best = min(best, (((r @ m - want) ** 2).sum() / w + (n * (r - 1) ** 2).sum(), r.tolist()))
    return np.array(best[1])


def test_rates_equal_dense_least_squares(spark):
    rng = np.random.default_rng(3)
    for low, case in itertools.product((None, 1.0), range(3)):
        n = rng.integers(5, 60, 7)
        m = rng.dirichlet([0.4] * 3, 7) * n[:, None]
        df = spark.createDataFrame([(i, int(x), v.tolist()) for i, (x, v) in enumerate(zip(n, m, strict=True))], "i int, n_tokens long, mass array<double>")
        rate, fitted = mixing.fit_rates(df, [(0.5, 0.3, 0.2), (0.1, 0.1, 0.8), (1.0, 0.0, 0.0)][case], low)
        got = np.array([r.rate for r in df.withColumn("rate", rate).orderBy("i").collect()])
        assert np.allclose(got, dense_rates(m, n.astype(float), fitted["targets"], low or 0.0), rtol=1e-3, atol=1e-3)


def test_residual_of_the_registered_mixture(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        residual = op5_mixing(spark, sf).select("residual").first()[0]
        assert residual <= 1e-4


def test_mixture_on_odd_rows(spark):
    labelled = spark.createDataFrame([(4, "a"), (5, "b"), (6, None), (None, "a")], "doc_id long, domain string")
    got = mixing.mix(odd(spark), labelled, {"a": 1.0, "b": 1.0}).collect()
    assert len(got) == len(ODD) and all(r.rate == 1.0 and r.copies == 1 for r in got if r.doc_id in (1, 2))
    assert {r.rate for r in mixing.mix(odd(spark), labelled.limit(0), {"a": 1.0}).collect()} == {1.0}
    assert mixing.mix(odd(spark).limit(0), labelled, {"a": 1.0}).isEmpty()


def test_rules_learn_from_every_labelled_document(spark):
    """Ranges, the statistics that take part and the threshold, against plain sums over more labelled rows than a sample would hold."""
    rng = np.random.default_rng(9)
    n = 24_000
    words = np.array(["".join(rng.choice(list("abcdefgXY019,."), rng.integers(2, 12))) for _ in range(3_000)])
    texts, bad = [" ".join(w) for w in words[rng.integers(0, len(words), (n, 52))]], rng.random(n) < 0.1
    texts = [t.upper() + " ###" * int(k) if b else t for t, b, k in zip(texts, bad, rng.integers(0, 9, n), strict=True)]
    docs = spark.createDataFrame(list(zip(range(n), texts, strict=True)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    got = quality_rules.apply_rules(docs, labels).toPandas().sort_values("doc_id")
    known, good = ~got["base_failed"].to_numpy(), ~bad
    assert known.sum() > 20_000
    score = got["anomaly"].to_numpy()
    most = quality_rules.calibrate(score[known], good[known])
    assert got["kept"].tolist() == (known & (score <= most)).tolist()
    x = quality_rules.features(got[list(quality_rules.COUNTS)].to_numpy())[known]
    rows = spark.createDataFrame([(*map(float, r), bool(g)) for r, g in zip(x, good[known], strict=True)], [*quality_rules.FEATURES, "good"])
    low, high, tells = quality_rules.ranges(rows)
    plain = quality_rules.IsolationForest(x, good[known])
    assert np.allclose(low, plain.low, atol=1e-12) and np.allclose(high, plain.high, atol=1e-12) and tells.tolist() == np.isfinite(plain.unit).tolist()


def test_ranks_of_scores(spark):
    rng = np.random.default_rng(4)
    score, good = np.round(rng.random(3_000) ** 8, 4), rng.random(3_000) < 0.8
    df = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good, strict=True)], "anomaly double, good boolean")
    for k in (0, 1, 1_500, 2_998, 2_999):
        assert quality_rules.ranked(df, k) == np.sort(score)[k]
    assert quality_rules.threshold(df, int(good.sum())) == quality_rules.calibrate(score, good)
    assert quality_rules.threshold(df.where("good"), int(good.sum())) == quality_rules.calibrate(score[good], good[good])
