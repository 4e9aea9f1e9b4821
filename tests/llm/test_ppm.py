"""PPM against a plain version with dictionaries; probabilities sum to one."""

import collections
import math
import zlib

from pyspark.sql import functions as F

from rillspark.llm import ppm

K = ppm.ORDER


def slow(docs, train):
    low = lambda t: (t or "").encode().lower()
    counts = [collections.defaultdict(collections.Counter) for _ in range(K + 1)]
    words, ends = collections.Counter(), 0
    for i, t in docs:
        if train(i):
            ends += 1
            words.update(low(t).split())
            s = [257] * K + list(low(t)) + [256]
            for p in range(K, len(s)):
                for k in range(K + 1):
                    counts[k][tuple(s[p - k : p])][s[p]] += 1

    def log_p(context, symbol):
        escaped, out = 0.0, set()
        for k in range(K, -1, -1):
            c = {x: n for x, n in counts[k].get(context[K - k :], {}).items() if x not in out}
            if not c:
                continue
            n = sum(c.values())
            if symbol in c:
                return escaped + math.log10((2 * c[symbol] - 1) / (2 * n))
            escaped += math.log10(len(c) / (2 * n))
            out |= set(c)
        return escaped - math.log10(257 - len(out))

    total, kinds = sum(words.values()) + ends, len(words) + (ends > 0)
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    found = []
    for i, t in docs:
        w, s = low(t).split(), [257] * K + list(low(t)) + [256]
        score = sum(log_p(tuple(s[p - K : p]), s[p]) for p in range(K, len(s)))
        found.append((i, len(w) + 1, sum(words[x] > 0 for x in w) + (ends > 0), total, sum(base(words[x]) for x in w) + base(ends), score))
    return found, log_p


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


DOCS = [(1, "The cat sat on the mat."), (2, "the CAT sat\non the hat"), (3, ""), (4, None), (5, "zebra \x00 quiz é漢"), (6, "the cat " * 4_000), (7, "mat mat"), (7, "mat mat"), (8, "x"), (9, "unseen thing"), (10, "a b"), (None, "the cat")]


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 0, "w") for i, t in docs], "doc_id long, text string, block int, words string")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.score_documents(df, train).collect()), key=repr)
    want = sorted(slow(docs, lambda i: i is not None and not held(i))[0], key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert all(math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-6) for x, y in zip(a[4:], b[4:], strict=True))


def test_against_plain_version(spark):
    check(spark, DOCS)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(ppm, "MERGE", 3)
    check(spark, DOCS)


def test_shares_of_the_trie_move_in_proportion_to_requests(spark, monkeypatch):
    moved, plain = [], ppm.requests

    def watched(asked, models):
        groups = plain(asked, models)
        own = models.select("shard", F.expr("octet_length(codes) + octet_length(p) + octet_length(words) + octet_length(m)").alias("own"))
        moved.append(tuple(groups.join(own, "shard").agg(F.sum(F.col("groups") * F.col("own")), F.sum("own")).first()) + asked.agg(F.sum(F.expr("octet_length(codes) + octet_length(words)"))).first()[:1])
        return groups

    monkeypatch.setattr(ppm, "requests", watched)
    for size in (20_000, 2_000):  # more blocks, same input: each share moves once
        monkeypatch.setattr(ppm, "BLOCK_BYTES", size)
        check(spark, DOCS)
        assert moved[-1][0] == moved[-1][1]
    monkeypatch.setattr(ppm, "GROUP_BYTES", 10)  # requests beyond a task's bytes: copies, but no more bytes than are asked
    check(spark, DOCS)
    assert moved[-1][1] <= moved[-1][0] <= moved[-1][1] + moved[-1][2]


def test_nothing_to_learn_from_and_empty(spark):
    check(spark, [(i, "abc") for i in range(40) if held(i)])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score_documents(df, F.lit(True)).isEmpty()


def test_probabilities_sum_to_one():
    _, log_p = slow(DOCS, lambda i: i is not None)
    for context in [(257,) * K, tuple(b"e cat"), tuple(b"zzzzz")]:
        assert math.isclose(sum(10 ** log_p(context, s) for s in range(257)), 1.0)
