"""Spans against plain regular expressions; disclosure by co-occurrence; sanitised texts."""

import re
import time

from rillspark.llm import pii
from rillspark.llm.pii import KINDS, listed, sanitise
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if not i % 2 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) < 256 for p in value.split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group()))


TEXTS = [
    None, "", "mail a.b@c.de, x@y and q@r.s.t_u@v.w é😀 z%z@a-b.c-d.", "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 99999999999.1.1.1 1.2.3",
    "cards 4111111111111111 4111-1111 1111 1111 4111  1111 1111 1111 41111111111111111111111 4111111111111112 5 4111111111111111", "+1 (017) 555-7713, +12 3, +1234567890123456 +49.30.1234567.",
    "1 " * 40_000, "a" * 50_000 + "@b.c", "9" * 60_000, "x@" * 5_000, "+1" + "(" * 20_000, "1.1.1.1." * 500, "4111111111111111" * 2, "4111111111111111-", "-4111111111111111", "é4111111111111111é",
]


def test_spans_equal_plain_expressions(spark):
    df = spark.createDataFrame([(i, t, 0, "k", "m") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int, key string, marks string")
    got = {r.doc_id: r.found for r in sanitise(df).select("doc_id", listed(F.col("spans")).alias("found")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_words_that_reveal_an_entity_go(spark):
    filler = ["the report was long and dull", "nobody read the other page", "an entirely different page here", "some more lines of the text"]
    rows = [(i, f"{filler[i % 4]} number {chr(97 + i % 26) * 3}") for i in range(200)]
    rows += [(500 + i, f"{filler[i]} Zebulon wrote from z@acme.org to the office {'abcd'[i] * 4}") for i in range(4)]
    rows += [(600, "a note of Quentin q@acme.org"), (601, "a note of Quentin q@acme.org"), (None, "Zebulon alone")]
    # one signature line, worded alike in different texts; and a rare word in lower case beside a single value
    rows += [(700 + i, f"{filler[i]} {'efgh'[i] * 5}\nregards, Ottokar o@acme.org") for i in range(4)] + [(800, "seen with quixotry k@acme.org")]
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(500, 504):
        assert "Zebulon" in [s.value for s in got[i].terms] and "the" not in [s.value for s in got[i].terms]
        assert "z@acme.org" not in got[i].sanitised and "[EMAIL]" in got[i].sanitised and "Zebulon" not in got[i].sanitised
        assert "Ottokar" in [s.value for s in got[i + 200].terms] and "Ottokar" not in got[i + 200].sanitised
    assert got[600].sanitised == got[601].sanitised == "a note of  [EMAIL]"  # a name seen once gives its value away
    assert got[800].sanitised == "seen with quixotry [EMAIL]"  # one text, however often copied, is no evidence for other words
    assert got[None].sanitised == "Zebulon alone" and got[3].sanitised == rows[3][1]


def test_empty_table(spark):
    assert sanitise(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_shares_against_brute_force(spark, monkeypatch):
    """Every share from plain counts over distinct texts."""
    import math

    from rillspark.llm import pii
    from rillspark.llm.pii import LEAST_TEXTS, RARE_TEXTS, base_spans, disclosures, evidence

    names = ["anna", "bert", "Carl", "dora"]
    texts = [f"{'xy'[i % 2]} word{chr(97 + i % 5)} {names[i % 4]} u{i % 7}@a.org and Said {names[i % 3]}" for i in range(40)] + [f"plain {n} text" for n in names] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("spans", base_spans(F.col("text")))
    got = {(r.entity, r.term): r.share for r in disclosures(docs, generalise=0.1).collect()}
    kept = set(texts)
    low = {t: set(re.findall(r"[^\W\d_]{2,}", t.lower())) for t in kept}
    near, name = {}, {}
    for t in kept:
        for m in re.finditer(PLAIN["email"], t):
            e = f"email:{m.group().lower()}"
            around = re.sub(r"\S*[@0-9]\S*", " ", t[: m.start()] + " \n " + t[m.end() :])
            for w in set(re.findall(r"[^\W\d_]{2,}", around.lower())):
                near.setdefault((e, w), set()).add(t)
                capital = re.search(rf"\b{w.capitalize()}\b", around)
                name[e, w] = name.get((e, w), False) or bool(capital)
    mentions = {e: {t for t in kept if e.split(":")[1] in t.lower()} for e, _ in near}
    want = {}
    for (e, w), b in near.items():
        t = sum(w in x for x in low.values())
        if len(b) >= LEAST_TEXTS or (name[e, w] and t <= RARE_TEXTS):
            share = math.log(len(kept) * len(b) / (len(mentions[e]) * max(t, len(b)))) / math.log(max(len(kept) / len(mentions[e]), 2))
            if share >= 0.1:
                want[e, w] = share
    assert got.keys() == want.keys() and len(want) > 5
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert {(r.entity, r.term): r.share for r in disclosures(docs, generalise=0.1).collect()} == got
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    n = {r.entity: r.n_terms for r in evidence(docs.select("text"), 0.1).collect()}
    assert n == {e: sum(k[0] == e for k in want) for e in mentions}


def test_contexts_hold_whole_words_across_lines(spark):
    """A line break inside the context, and words that begin or end where it does."""
    far = "x" * 3
    text = f"{'word ' * 9}Wolfeschlegelstein {'and so ' * 6}bob@acme.org and then\nthe quick brown fox jumps over the lazy dog Featherstonehaugh stays {far}"
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(F.transform(pii.base_spans(F.col("text")), lambda s: pii._context(F.col("text"), s))).alias("c"))
    terms = {w.term for r in df.collect() for w in r.c}
    assert {"wolfeschlegelstein", "featherstonehaugh", "then"} <= terms and not {"fe", "feather", "stein"} & terms


def test_spans_of_a_text_with_many_values(spark):
    n = 20_000
    text = " ".join(f"née{i}@acme.org" for i in range(n))
    start = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first().s
    at = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s.start, s.end) for s in got] == at and len(got) == n and time.time() - start < 60
