"""PII: information-theoretic sanitisation, in DataFrame functions alone.

Four kinds of personal data are found by pattern. Each value found is a
protected entity. Over the whole corpus, the words around an entity are counted
with it and by themselves: the pointwise mutual information of word and entity,
as a share of the entity's own information, says how much of the entity the
word gives away. Words beyond the thresholds are generalised or removed from
the documents that mention the entity; the values themselves always go.

Evidence is counted in distinct texts, so copies of a text are one witness. A
word needs LEAST_TEXTS of them beside the entity, or fewer if it looks like a
name and no more than RARE_TEXTS texts of the whole corpus hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only

#: Characters of context on either side of a value.
CONTEXT = 60
#: Distinct texts in which a word must stand by an entity, and those that may hold a name-like word that has fewer.
LEAST_TEXTS, RARE_TEXTS = 2, 3
#: Elements of an array that are copied together in running sums, and characters that a context reaches on to end a word.
RUN, WORD_END = 256, 40
#: Shares of an entity's information from which a word is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Rows up to which a side is broadcast; a row is a word or a hash with a few words.
BROADCAST_ROWS = 100_000

#: By kind: the pattern. Possessive loops and look-around keep the leftmost matches and make the search linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with 16 to 19 of them: other chains fail, and fail whole
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a pattern holds; cheap to look for, and most texts hold none of it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
_WORD = r"\p{L}[\p{L}\p{M}]+"
#: What may be a name: a word with a capital.
_NAME = r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]+"


def _bound(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _summed(steps: Column, step, start: Column) -> Column:
    """All results of a running sum over an array, in runs of RUN, so none is copied more than RUN times.

    step: (sum so far, element) to (next sum, result); start: the first sum.
    """

    def run(at: Column, part: Column) -> Column:
        def one(x: Column, e: Column) -> Column:
            then, made = step(x["at"], e)
            return F.struct(then.alias("at"), F.array_append(x["made"], made).alias("made"))

        none = F.filter(F.transform(F.slice(part, 1, 1), lambda e: step(start, e)[1]), lambda _: F.lit(False))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("made")), one)

    def whole(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int"))), lambda i: F.slice(s, i * RUN + 1, RUN))
        none = F.filter(F.transform(F.slice(s, 1, 1), lambda e: F.array(step(start, e)[1])), lambda _: F.lit(False))
        join = lambda x, part: _bound(run(x["at"], part), lambda r: F.struct(r["at"].alias("at"), F.array_append(x["made"], r["made"]).alias("made")))
        return F.flatten(F.aggregate(parts, F.struct(start.alias("at"), none.alias("made")), join)["made"])

    return _bound(steps, whole)


def _all(text: Column, pattern: Column, kind: str) -> Column:
    """All matches in order, as structs of kind, start, end (code points, end exclusive) and value."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + x["size"], F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))

    hint = F.lit(HINTS[kind]) if kind in HINTS else pattern
    return F.when(F.contains(text, hint) if kind == "email" else F.regexp_like(text, hint), _summed(steps, step, F.lit(0))).otherwise(none)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 4) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") < 256))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of personal data, by kind as listed, then by start."""

    def found(kind: str, pattern: str) -> Column:
        return F.filter(_all(text, F.lit(pattern), kind), lambda s: _valid(kind, s["value"]))

    return F.concat(*(found(k, p) for k, p in PATTERNS.items()))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _context(text: Column, span: Column) -> Column:
    """The different words around a span, whole, as structs of term, in lower case, and name: whether it looks like one.

    What other patterns' values hold is left out.
    """
    reach = CONTEXT + WORD_END
    left = F.regexp_extract(F.substring(text, F.greatest(span["start"] - reach, F.lit(0)) + 1, F.least(span["start"], F.lit(reach))), rf"(?s)\S*.{{0,{CONTEXT}}}$", 0)
    right = F.regexp_extract(F.substring(text, span["end"] + 1, F.lit(reach)), rf"(?s)^.{{0,{CONTEXT}}}\S*", 0)
    # only words longer than that are still cut, and left out
    left = F.when((F.length(left) == reach) & (span["start"] > reach), F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.when(F.length(right) == reach, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    around = F.regexp_replace(F.concat(left, F.lit(" \n "), right), r"\S*[@0-9]\S*", " ")
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(around, F.lit(pattern), F.lit(0)), F.lower))
    names = found(_NAME)
    return F.transform(found(_WORD), lambda w: F.struct(w.alias("term"), F.array_contains(names, w).alias("name")))


def entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def disclosures(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share): terms that give away at least the share `generalise` of an entity's information.

    docs: (text, spans). With N distinct texts, of which e mention the entity,
    t the term, and b both near each other, the share is
    log(N b / (e t)) / log(N / e).
    """
    key = F.xxhash64("text", F.lit(17))
    near = cut(
        docs.where(F.size("spans") > 0)
        .select(key.alias("key"), F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), _context(F.col("text"), s).alias("words"))))).alias("m"))
        .select("key", "m.entity", F.explode_outer("m.words").alias("w"))
        .groupBy("key", "entity", F.col("w.term").alias("term")).agg(F.max("w.name").alias("name")),
        "pii-contexts",
    )
    # a text that has an entity has a row for it, with a null term if no word is near
    whole = near.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("e"))
    pairs = near.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("b"), F.max("name").alias("name"))
    pairs = cut(pairs.where((F.col("b") >= LEAST_TEXTS) | F.col("name")).join(whole, "entity"), "pii-pairs")
    terms = pairs.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return pairs.select("entity", "term", F.lit(1.0).alias("share"))
    texts = cut(docs.groupBy(key.alias("key")).agg(F.count("*").alias("copies")), "pii-texts")
    n, copied = texts.count(), texts.where("copies > 1")
    keyed = docs.select(key.alias("key"), "text")
    if copied.count() <= BROADCAST_ROWS:  # each copy counts for its share, so sums need no rows moved
        keyed = keyed.join(F.broadcast(copied), "key", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    else:
        keyed = keyed.dropDuplicates(["key"]).select("text", F.lit(1.0).alias("part"))
    words = keyed.select("part", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("term"))
    if n_terms <= BROADCAST_ROWS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    used = words.groupBy("term").agg(F.round(F.sum("part"), 3).alias("t"))
    share = F.log(n * F.col("b") / (F.col("e") * F.greatest("t", "b"))) / F.log(F.greatest(n / F.col("e"), F.lit(2.0)))
    told = pairs.join(used, "term").where((F.col("b") >= LEAST_TEXTS) | (F.col("t") <= RARE_TEXTS))
    return cut(told.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise), "pii-terms")


def evidence(docs: DataFrame, generalise: float = GENERALISE, text_col: str = "text") -> DataFrame:
    """(entity, n_terms) of every entity: how many terms give it away; 0 where the corpus holds no evidence."""
    docs = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    every = docs.select(F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).distinct()
    n = disclosures(docs, generalise).groupBy("entity").agg(F.count("*").alias("n_terms"))
    return every.join(n, "entity", "left").select("entity", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced. spans: structs with start, end and by, in order of start."""

    def step(at: Column, s: Column) -> Column:
        more = F.array_append(at["parts"], F.concat(F.substring(text, at["at"] + 1, s["start"] - at["at"]), s["by"]))
        return F.struct(F.greatest(at["at"], s["end"]).alias("at"), F.when(s["start"] >= at["at"], more).otherwise(at["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    return F.aggregate(spans, start, step, lambda at: F.concat(F.array_join(at["parts"], ""), F.substring(text, at["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, whole: bool = False) -> DataFrame:
    """(doc_id, text, spans, terms, sanitised) of every whole text.

    spans: the personal data, as structs of kind, start, end and value, by kind
    (email, ip, card, phone) and start. terms: spans of kind `term` for words
    that disclose an entity of the same document. sanitised: the text with
    values replaced by their kind in brackets, terms from the share
    `generalise` on by [WORD] or, in capitals, [NAME], and from `remove` on
    taken out.

    A null text is empty. A null id stays null. Repeated rows give repeated
    rows; copies of a text count once as evidence. An empty table gives an
    empty one; other columns are ignored, but with `whole` each row comes back
    in a struct `row`.
    """
    docs = only(docs, id_col, text_col, whole).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("spans", base_spans(F.col("text")))
    found = disclosures(docs, generalise)
    # what to mark depends on the text alone
    of_text = F.when(F.size("spans") > 0, F.sha2("text", 256))
    held = docs.where(F.size("spans") > 0).select(of_text.alias("key"), F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    marks = cut(
        held.join(found, "entity").groupBy("key", "term").agg(F.max("share").alias("share"))
        .groupBy("key").agg(F.collect_list(F.struct("term", "share")).alias("marks")),
        "pii-marks",
    )
    if marks.count() <= BROADCAST_ROWS:
        out = docs.withColumn("key", of_text).join(F.broadcast(marks), "key", "left")
    else:  # documents without personal data need no partner
        out = docs.where(F.size("spans") > 0).withColumn("key", of_text).join(marks, "key", "left")
        out = out.unionByName(docs.where(F.size("spans") == 0), allowMissingColumns=True)
    inside = r"(?![\p{L}\p{M}])"
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join(F.transform("marks", lambda m: m["term"]), "|"), F.lit(f"){inside}"))
    terms = F.filter(_all(F.col("text"), pattern, "term"), lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    out = out.withColumn("terms", F.when(F.col("marks").isNotNull(), terms).otherwise(none))

    def by(s: Column) -> Column:
        gone = F.exists("marks", lambda m: (m["term"] == F.lower(s["value"])) & (m["share"] >= remove))
        named = F.when(gone, F.lit("")).when(F.regexp_like(s["value"], F.lit(r"^\p{Lu}")), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        return F.when(s["kind"] == "term", named).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    both = F.array_sort(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by"))))
    return out.withColumn("sanitised", F.when(F.size("spans") > 0, _replaced(F.col("text"), both)).otherwise(F.col("text"))).select("doc_id", "text", "spans", "terms", "sanitised", *["row"] * whole)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
