"""Components against brute force over shingle sets; blocks; odd rows; the pipeline's stage."""

import random

import corpus_pipeline
import numpy as np
from xxhash import xxh64_intdigest

from rillspark.llm import resemblance
from rillspark.llm.simhash import SEED, majority

SF = "/root/testdata/sf0.001"


def roots(texts, words=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def copies(seed):
    """Texts with copies of copies that share between a half and all of their shingles, and a passage that many hold."""
    rng = random.Random(seed)
    words, passage = [f"w{i}" for i in range(3_000)], " ".join(f"p{i}" for i in range(30)).split()
    texts = [None, "", " \n", "one", "one two", "One TWO", "a b c d e", "A b c d e f"]
    for k in range(20):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 300))] + passage * (k % 2)
        texts.append(" ".join(t))
        for _ in range(rng.randrange(8)):
            t = [*t]
            for _ in range(rng.randrange(1, 2 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    return texts + [texts[9]] * 5


def test_components_against_brute_force(spark, monkeypatch):
    texts = copies(3)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, key string")
    want = list(enumerate(roots(texts)))
    assert len({r for _, r in want}) < len(set(texts)) - 20
    assert sorted(tuple(r) for r in resemblance.resembling(df).select("doc_id", "component_id").collect()) == want
    monkeypatch.setattr(resemblance, "BLOCK", 2)
    monkeypatch.setattr(resemblance, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in resemblance.resembling(df).select("doc_id", "component_id").collect()) == want


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "quite other words here")], "doc_id long, text string")
    got = sorted((tuple(r) for r in resemblance.resembling(df).select("doc_id", "component_id").collect()), key=repr)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None)], key=repr)
    assert resemblance.resembling(df.limit(0)).isEmpty()


def test_stage_drops_near_copies_beyond_three_bits(spark):
    texts = copies(5)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(set(roots(texts)))


def test_bitmaps_never_rule_out_what_is_alike():
    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 3, 60, 70, 300, 900, 1_000):
        base = rng.integers(-(2**62), 2**62, n)
        sets += [np.unique(np.r_[base[rng.random(n) > cut], rng.integers(-(2**62), 2**62, n // 12)]) for cut in (0, 0.05, 0.1, 0.3)]
    bits, size = [resemblance.bitmap(x) for x in sets], np.array([len(x) for x in sets])
    other = ~np.eye(len(sets), dtype=bool)
    has = resemblance.possible_partner(bits, size, other, 0.8)
    real = [any(resemblance.alike(x, y, 0.8) for j, y in enumerate(sets) if i != j) for i, x in enumerate(sets)]
    assert all(h for h, r in zip(has, real, strict=True) if r) and 0 < sum(real) and sum(has) < len(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            n = min(len(bits[i]), len(bits[j]))
            most = resemblance.most_alike(resemblance.folded([bits[i]], n), resemblance.folded([bits[j]], n), size[i : i + 1], size[j : j + 1])[0]
            assert most >= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) - 1e-9


def chain(seed):
    """A text and what is left of it without its end or its beginning: in a prefix no shingle is in all three, as those of the middle come late."""
    rng, w, n = random.Random(seed), [], 100
    while len(w) < n + 4:
        w.append(f"v{rng.randrange(10**9)}")
        late = 15 <= len(w) - 5 < n - 15
        while len(w) >= 5 and (xxh64_intdigest(" ".join(w[-5:]).encode(), SEED) < 1 << 63) != late:
            w[-1] = f"v{rng.randrange(10**9)}"
    return [" ".join(w), " ".join(w[:-15]), " ".join(w[15:])]


def test_buckets_of_two_sets_are_compared(spark, monkeypatch):
    """A set that meets two others apart from each other is linked to both."""
    monkeypatch.setattr(resemblance, "LOOK", 1 << 40)  # no shingle counts as common

    def fits(texts):
        whole, *parts = sets = [resemblance.shingle_set(t, 5, xxh64_intdigest) for t in texts]
        name = [np.uint64(xxh64_intdigest(s.tobytes(), SEED)).view(np.int64) for s in sets]
        apart = [((majority(whole.view(np.uint64)) ^ majority(p.view(np.uint64))) % (1 << 64)).bit_count() for p in parts]
        return name[0] == max(name) and min(apart) > resemblance.RADIUS

    texts = next(t for t in map(chain, range(1_000)) if fits(t))
    assert roots(texts) == [0, 0, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in resemblance.resembling(df).select("doc_id", "component_id").collect()) == [(0, 0), (1, 0), (2, 0)]
