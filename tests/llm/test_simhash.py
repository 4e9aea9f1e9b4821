"""Fingerprints and components against brute force; the covering property."""

import random
import re

import numpy as np
import xxhash

from rillspark.llm import simhash
from rillspark.operators.components import components


def slow_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.masks(3)]
    assert len(masks) == 15
    for _ in range(3_000):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flip & m == 0 for m in masks)


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Straße", "É", "x" * 500]
    texts = [None, "", " \n", "one", "one two", "One TWO", "a b c", "ÄB C d"]
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.randrange(3, 400))]
        texts.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            t = [*t]
            t[rng.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
    texts += [texts[10]] * 40 + [" ".join(words * 3_000)]
    prints = [slow_fingerprint(t) for t in texts]
    want = [(i, f, r) for i, (f, r) in enumerate(zip(prints, roots(prints), strict=True))]
    df = spark.createDataFrame([(i, t, 0, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, fingerprint int, key string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == want


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for _ in range(150)})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"))
    assert all((r.a ^ r.b).bit_count() <= 3 for r in links.collect())
    got = {r.node: r.root for r in components(links, "test").collect()}
    assert [got.get(p, p) for p in prints] == [prints[r] for r in roots(prints)]


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "quite other words here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).isEmpty()
