"""Language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie of order ORDER, held as counts of
(ORDER + 1)-grams of symbols from which all shorter contexts follow. A symbol
not seen in a context escapes to the next shorter one (method D: every distinct
symbol gives half a count to the escape), where symbols of the longer context
are excluded; below the empty context the unseen symbols share what is left. Texts end in an
end symbol, so the probabilities of all texts sum to one.

Nothing of the model passes whole through the driver or a task. Documents are
dealt into blocks of about BLOCK_BYTES. A block lists its distinct grams and
words once, as packed and compressed lists split into shards by a gram's two
nearest context symbols (or a word's hash). Pairs of symbols so common that
they would fill a shard are split by the third symbol. Lists of a shard are
merged in a tree, MERGE at a time, into the shard's share of the trie. It holds
all contexts of two symbols (three for split pairs) and more; counts of shorter
ones are shared: 257 ** 2 pairs at most, and 257 symbols after each split pair,
of which there are at most twice as many as shards. Each block then gets the
probabilities of its own grams and the counts of its own words back, and its
texts are scored by those. A shard's share of the trie goes to one task, or,
where blocks ask it for more than GROUP_BYTES, to as many as its requests fill:
copies of the trie never move more bytes than the requests, which grow with the
input.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, slices, texts_of

ORDER = 5
BLOCK_BYTES = 16_000_000
#: Shards are as many as blocks between these bounds; lists merged at a time.
LEAST_SHARDS, MOST_SHARDS, MERGE = 32, 4_096, 64
#: Bytes of requests that a shard's share of the trie answers in one task, unless the share is larger.
GROUP_BYTES = 32_000_000
#: Symbols: bytes, the end of a text, and what stands before its start (never predicted).
END, BEFORE, WIDTH = 256, 257, 9
SYMBOLS = 257


def grams(text: bytes) -> np.ndarray:
    """The text's (ORDER + 1)-grams, one for each byte and one for the end; the newest symbol lies in the lowest bits."""
    s = np.full(len(text) + ORDER + 1, BEFORE, np.int64)
    s[ORDER:-1] = np.frombuffer(text, np.uint8)
    s[-1] = END
    code = np.zeros(len(text) + 1, np.int64)
    for k in range(ORDER + 1):
        code = (code << WIDTH) | s[k : k + len(code)]
    return code


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def pack(values: np.ndarray) -> bytes:
    """Integers, compressed; sorted ones take few bytes each."""
    return zlib.compress(np.diff(values.astype(np.int64), prepend=0).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no white space, so a space separates them."""
    return zlib.compress(b" ".join(words), 1)


def unpack_words(packed: bytes) -> list[bytes]:
    return zlib.decompress(packed).split()


_LISTS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("codes", pa.binary()), ("n", pa.binary()), ("words", pa.binary()), ("m", pa.binary())])
_LISTS_SQL = "part int, shard int, codes binary, n binary, words binary, m binary"
#: Shards that hold the counts of pairs of symbols, and those of symbols after split pairs.
PAIRS, TRIPLES = -1, -2


def newest(code: np.ndarray, symbols: int) -> np.ndarray:
    return code & (1 << WIDTH * symbols) - 1


def _shard(code: np.ndarray, shards: int, split: np.ndarray) -> np.ndarray:
    """By the two symbols before the newest one, and by three where those are a split pair."""
    pair = newest(code >> WIDTH, 2)
    return (np.where(np.isin(pair, split), newest(code >> WIDTH, 3), pair) * 2654435761 >> 9) % shards


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bytes stand side by side, by task; a line break counts between texts."""
    n = np.zeros(1 << 16, np.int64)
    for b in batches:
        texts = texts_of(b.column(0))
        for x, y in slices(texts, 1_000_000):
            raw = np.frombuffer(b"\n".join(map(lowered, texts[x:y])), np.uint8).astype(np.int64)
            n += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])


def common_pairs(docs: DataFrame, shards: int) -> np.ndarray:
    """Pairs of symbols that would hold more than half of a shard's even share, ascending: at most 2 * shards."""
    n = docs.select("text").mapInArrow(_adjacent, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pair = n["pair"].to_numpy(np.int64)[n["n"].to_numpy(float) * 2 * shards > n["n"].sum()]
    return np.sort(pair >> 8 << WIDTH | pair & 255)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    code, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(where, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


def _lists(group: pa.Table, shards: int, split: np.ndarray) -> pa.Table:
    """The lists of a block: its grams and words, with their counts in its training documents, by shard."""
    block = group.column("block")[0].as_py()
    texts, train = group.column("text").to_pylist(), group.column("train").to_pylist()
    none = np.zeros(0, np.int64)
    found, words, other = [(none, none)], Counter(), set()
    for a, b in slices(["" if t is None else t for t in texts], 1_000_000):
        raw = [lowered(t) for t in texts[a:b]]
        for learnt in (True, False):
            mine = [r for r, t in zip(raw, train[a:b], strict=True) if t is learnt]
            if mine:
                code, n = np.unique(np.concatenate([grams(r) for r in mine]), return_counts=True)
                found.append((code, n if learnt else np.zeros_like(n)))
                for r in mine:
                    words.update(r.split()) if learnt else other.update(r.split())
    code, n = _summed(found)
    names = [*words, *(other - words.keys())]
    m = np.array([*words.values(), *[0] * (len(names) - len(words))], np.int64)
    of, at = _shard(code, shards, split), np.fromiter((zlib.crc32(w) % shards for w in names), np.int64, len(names))
    by, by_word = np.argsort(of, kind="stable"), np.argsort(at, kind="stable")
    ends, word_ends = (np.searchsorted(x, np.arange(shards + 1)) for x in (of[by], at[by_word]))
    rows, some = [], np.flatnonzero((np.diff(ends) > 0) | (np.diff(word_ends) > 0))
    for k in some.tolist():
        mine, w = by[ends[k] : ends[k + 1]], by_word[word_ends[k] : word_ends[k + 1]]
        rows.append((block, k, pack(code[mine]), pack(n[mine]), pack_words([names[i] for i in w.tolist()]), pack(m[w])))
    pair, triple = _summed([(newest(code, 2), n)]), np.isin(newest(code >> WIDTH, 2), split)
    for k, (c, x) in ((PAIRS, pair), (TRIPLES, _summed([(newest(code[triple], 3), n[triple])]))):
        rows.append((block, k, pack(c), pack(x), pack_words([]), pack(none)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LISTS, strict=True)], schema=_LISTS)


def _merged(key: tuple, group: pa.Table) -> pa.Table:
    """Several lists of a shard as one; grams and words without a count stay, as they are to get probabilities."""
    code, n = _summed([(unpack(c), unpack(k)) for c, k in zip(group.column("codes").to_pylist(), group.column("n").to_pylist(), strict=True)])
    words: Counter[bytes] = Counter()
    for w, m in zip(group.column("words").to_pylist(), group.column("m").to_pylist(), strict=True):
        words.update(dict(zip(unpack_words(w), unpack(m).tolist(), strict=True)))
    rows = [[key[0].as_py()], [key[1].as_py()], [pack(code)], [pack(n)], [pack_words(list(words))], [pack(np.array(list(words.values()), np.int64))]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _LISTS, strict=True)], schema=_LISTS)


def merged(lists: DataFrame, parts: int) -> DataFrame:
    """One list for each shard, by merging MERGE lists at a time."""
    while parts > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / MERGE).cast("int")).groupBy("part", "shard").applyInArrow(_merged, _LISTS_SQL)
        parts = -(-parts // MERGE)
    return lists


class Counts:
    """Counts of one order: grams in order, their counts, and for each context its sums."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, lower: Counts | None, symbols: int):
        self.gram, self.n = _summed([(gram, n)]) if len(gram) else (gram, n)
        self.context, where = np.unique(self.gram >> WIDTH, return_inverse=True)
        less = lower.of(self.gram & (1 << WIDTH * (symbols - 1)) - 1) if lower else np.zeros(len(self.gram))
        # symbols seen in the context, distinct ones, and how often those were seen one order below
        self.total, self.kinds, self.below = (np.bincount(where, w, len(self.context)) for w in (self.n, None, less))

    @staticmethod
    def _find(keys: np.ndarray, values: list[np.ndarray], wanted: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(wanted)) for _ in values]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return [np.where(hit, v[at], 0.0) for v in values]

    def of(self, gram: np.ndarray) -> np.ndarray:
        return self._find(self.gram, [self.n], gram)[0]

    def around(self, context: np.ndarray) -> list[np.ndarray]:
        return self._find(self.context, [self.total, self.kinds, self.below], context)


def probabilities(code: np.ndarray, n: np.ndarray, pairs: tuple, triples: tuple, split: np.ndarray) -> np.ndarray:
    """log10 probability of the newest symbol of each gram after the others.

    code, n: grams in order with their counts in training texts, all those of
    some contexts of two symbols, or of three where the two nearest are a split
    pair; grams with n = 0 get their probability too. pairs, triples: (codes,
    counts) of all pairs of symbols, and of all symbols after split pairs.
    """
    before = newest(code >> WIDTH, 2)
    own, here = ~np.isin(before, split), np.isin(triples[0] >> WIDTH, before)
    shorter = {0: pairs, 1: pairs, 2: (np.r_[code[own], triples[0][here]], np.r_[n[own], triples[1][here]])}
    orders: list[Counts] = []
    for k in range(ORDER + 1):
        gram, count = shorter.get(k, (code, n))
        gram = newest(gram[count > 0], k + 1)
        orders.append(Counts(gram, count[count > 0], orders[-1] if orders else None, k + 1))
    p, escaped = np.full(len(code), np.nan), np.zeros(len(code))
    above_d, above_x = np.zeros(len(code)), np.zeros(len(code))
    for k in range(ORDER, -1, -1):
        gram = newest(code, k + 1)
        seen, (total, kinds, below) = orders[k].of(gram), orders[k].around(gram >> WIDTH)
        left, d = np.maximum(total - above_x, 1), kinds - above_d
        p = np.where(np.isnan(p) & (seen > 0), escaped + np.log10(np.maximum(2 * seen - 1, 1) / (2 * left)), p)
        escaped = escaped + np.where(d > 0, np.log10(np.maximum(d, 1) / (2 * left)), 0.0)
        above_d, above_x = kinds, below
    return np.where(np.isnan(p), escaped - np.log10(np.maximum(SYMBOLS - above_d, 1)), p)


def requests(asked: DataFrame, models: DataFrame) -> DataFrame:
    """(shard, groups int): tasks that answer a shard's requests, one for each GROUP_BYTES of them or each size of its share of the trie, if that is more."""
    size = lambda *names: sum(F.octet_length(c) for c in names)
    of = models.select("shard", size("codes", "p", "words", "m").alias("own"))
    each = asked.groupBy("shard").agg(F.sum(size("codes", "words")).alias("asked")).join(of, "shard")
    return each.select("shard", F.greatest(F.ceil(F.col("asked") / F.greatest("own", F.lit(GROUP_BYTES))), F.lit(1)).cast("int").alias("groups"))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    train: a condition on doc_id; where it holds, the model learns from the
    text. score: log10 probability of the text (A-Z in lower case) and its end
    under the byte model; base_score: that of its words and one end token under
    smoothed word counts.

    A null or empty text has the end alone and is learnt from like any other. A
    null id stays null and is not learnt from. Repeated rows are learnt from
    and scored each. With nothing to learn from, all symbols are equally likely
    and counts are 0. An empty table gives an empty one; other columns are
    ignored. Texts of any length are scored whole.
    """
    docs = only(docs, id_col, text_col).select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size, learnt = docs.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, blocks))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    split = common_pairs(docs, shards)
    lists = cut(docs.groupBy("block").applyInArrow(lambda group: _lists(group, shards, split), _LISTS_SQL), "ppm-lists")

    # as many counts at most as the module's docstring says, sent once to each worker
    short = {r["shard"]: (r["codes"], r["n"]) for r in merged(lists.where(F.col("shard") < 0), blocks).collect()}
    shared = docs.sparkSession.sparkContext.broadcast([short.get(k, (pack(np.zeros(0, np.int64)),) * 2) for k in (PAIRS, TRIPLES)])

    def model(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        code, n, m = unpack(row["codes"]), unpack(row["n"]), unpack(row["m"])
        p = probabilities(code, n, *(tuple(map(unpack, x)) for x in shared.value), split).astype(np.float32)
        return pa.table({"shard": pa.array([row["shard"]], pa.int32()), "codes": [row["codes"]], "p": [p.tobytes()], "words": [row["words"]], "m": [row["m"]], "tokens": [int(m.sum())], "kinds": [int((m > 0).sum())]})

    whole = merged(lists.where(F.col("shard") >= 0), blocks)
    models = cut(whole.groupBy("shard").applyInArrow(model, "shard int, codes binary, p binary, words binary, m binary, tokens long, kinds long"), "ppm-models")
    sums = models.agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = (sums[0] or 0) + learnt, (sums[1] or 0) + (learnt > 0)

    def answer(key: tuple, asking: pa.Table, of: pa.Table) -> pa.Table:
        """For the lists of some blocks in a shard: the probabilities of their grams and the counts of their words."""
        rows = []
        if of.num_rows:
            it = of.to_pylist()[0]
            code, p = unpack(it["codes"]), np.frombuffer(it["p"], np.float32)
            count = dict(zip(unpack_words(it["words"]), unpack(it["m"]).tolist(), strict=True))
            for block, codes, words in zip(*(asking.column(c).to_pylist() for c in ("part", "codes", "words")), strict=True):
                c = np.array([count[w] for w in unpack_words(words)], np.int64)
                rows.append((block, codes, p[np.searchsorted(code, unpack(codes))].tobytes(), words, pack(c)))
        out = zip(*rows, strict=True) if rows else [[]] * 5
        kinds_of = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table(dict(zip(("block", "codes", "p", "words", "m"), (pa.array(c, t) for c, t in zip(out, kinds_of, strict=True)), strict=True)))

    asked = lists.where(F.col("shard") >= 0).select(F.col("part"), "shard", "codes", "words")
    spread = models.select("shard", "codes", "p", "words", "m")
    groups = requests(asked, spread)
    asked = asked.join(F.broadcast(groups), "shard").withColumn("group", F.pmod(F.hash("part"), F.col("groups")))
    spread = spread.join(F.broadcast(groups), "shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    answers = asked.drop("groups").groupBy("shard", "group").cogroup(spread.drop("groups").groupBy("shard", "group")).applyInArrow(answer, "block int, codes binary, p binary, words binary, m binary")

    known_end, norm = learnt > 0, tokens + 0.5 * (kinds + 1)
    end_score = math.log10((learnt + 0.5) / norm)

    def run(key: tuple, group: pa.Table, own: pa.Table) -> pa.Table:
        code = np.concatenate([unpack(c) for c in own.column("codes").to_pylist()])
        chance = np.concatenate([np.frombuffer(p, np.float32) for p in own.column("p").to_pylist()]).astype(float)
        order = np.argsort(code)
        code, chance, count = code[order], chance[order], {}
        for w, m in zip(own.column("words").to_pylist(), own.column("m").to_pylist(), strict=True):
            count.update(zip(unpack_words(w), unpack(m).tolist(), strict=True))
        rows = []
        for i, text in zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True):
            raw = lowered(text)
            words = raw.split()
            c = np.fromiter(map(count.__getitem__, words), float, len(words))
            plain = float(np.log10((c + 0.5) / norm).sum()) + end_score
            score = sum(float(chance[np.searchsorted(code, np.sort(g))].sum()) for g in np.array_split(grams(raw), 1 + len(raw) // 1_000_000))
            rows.append((i, len(words) + 1, int((c > 0).sum()) + known_end, plain, score))
        i, n, known, plain, score = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table({
            "doc_id": pa.array(i, pa.int64()), "train": group.column("train"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([tokens] * len(i), pa.int64()), "base_score": pa.array(plain, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
