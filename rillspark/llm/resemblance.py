"""SimHash near-duplicates whose links are verified: those of a resemblance (Jaccard similarity) of shingle sets.

Covering tables over fingerprints of the sets give pairs that differ in few
bits. At a resemblance of 0.8 fingerprints mostly lie 4 to 15 bits apart, for
which covering tables would be too many or too crowded, so what they leave
apart is found exactly: under one order of all shingles, two sets of
resemblance s or more share one of their first n - ceil(s n) + 1 shingles
(prefix filtering), so all such pairs meet in a bucket. Common shingles come
last in the order, which keeps buckets small and plays no part in the result.

Each set is first compared with its pairs from the covering tables and with one
of the smallest sets of its buckets, the one that bitmaps show to be the most
alike. Buckets whose sets are then still in several components are compared in
pairs of blocks. Pairs of which bitmaps of the sets show that they share too
little are left out; every link is a pair whose resemblance was computed from
both whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.components import components

from .common import cut, discard, only, slices, texts_of
from .simhash import SEED, majority, near_links

#: Bits in which fingerprints of pairs from the covering tables differ at most.
RADIUS = 3
#: Sets in a block; a bucket with more is compared block by block.
BLOCK = 256
#: Shingles that are ordered by how common they are, and the share of documents they are looked for in.
COMMON, LOOK = 200_000, 4
#: Bits of a bitmap for each shingle of its set, about, and at least; bitmaps have a power of two of them.
BITS_EACH, LEAST_BITS = 4, 256
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000


def shingle_set(text: str, words: int, hash64) -> np.ndarray:
    """Hashes of the different shingles, ascending. Texts with fewer words than a shingle are one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.array([], np.int64)
    shingles = set(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((hash64(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def prefix(found: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order: those not in common (ascending) by hash, then the common ones by rank."""
    if not len(found):
        return found
    take = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, rank[at], -1), kind="stable")]
    return found[:take]


def bitmap(found: np.ndarray) -> bytes:
    bits = np.zeros(max(LEAST_BITS, 1 << (BITS_EACH * len(found) - 1).bit_length()), bool)
    bits[found & (len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def folded(bitmaps: list[bytes], length: int) -> np.ndarray:
    """A row of 64-bit words for each bitmap of at least `length` bytes, as if it had that length."""
    return np.array([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, length // 8), axis=0) for x in bitmaps]).reshape(-1, length // 8)


def most_alike(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The largest resemblance that pairs can have: a bit that one set alone has is a shingle that the other lacks. Bitmaps are rows of 64-bit words."""
    most = np.minimum(size_a - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), size_b - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return most / np.maximum(size_a + size_b - most, 1)


def possible_partner(bits: list[bytes], size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """For each row of `other` (which rows may be its partner) whether bitmaps leave it one."""
    length, has = np.array([len(x) for x in bits]), np.zeros(len(bits), bool)
    for l in np.unique(length).tolist():
        at = np.flatnonzero(length >= l)
        rows = folded([bits[i] for i in at.tolist()], l)
        for k in np.flatnonzero(length[at] == l).tolist():
            x = at[k]
            near = (most_alike(rows, rows[k], size[at], size[x]) >= similarity - 1e-9) & other[x, at]
            has[at[near]] = True
            has[x] |= near.any()
    return has


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur more than once in a slice of texts, ascending, and their ranks from the least common on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = texts_of(b.column(0))
            for x, y in slices(texts):
                found, n = np.unique(np.concatenate([shingle_set(t, words, xxh64_intdigest) for t in texts[x:y]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1], pa.int64())], ["shingle", "n"])

    looked = docs.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(LOOK)) == 0).select("text")
    n = looked.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = n.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    found = rows["shingle"].to_numpy(np.int64)
    by_hash = np.argsort(found)
    return found[by_hash], len(found) - by_hash


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, set, of_text, fingerprint, size, bits, prefix): set names the shingle set, of_text the text."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts):
                sets = [shingle_set(t, words, xxh64_intdigest) for t in texts[x:y]]
                names = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                lists = pa.array([prefix(s, similarity, *shared.value) for s in sets], pa.list_(pa.int64()))
                prints = pa.array([majority(s.view(np.uint64)) for s in sets], pa.int64())
                sizes, bits = pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(names), b.column(2).slice(x, y - x), prints, sizes, bits, lists], ["doc_id", "set", "of_text", "fingerprint", "size", "bits", "prefix"])

    return docs.select("doc_id", "text", "of_text").mapInArrow(run, "doc_id long, set long, of_text long, fingerprint long, size long, bits binary, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set, shingles) of the wanted (set, of_text): the hashes as 64-bit integers, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts):
                found = pa.array([shingle_set(t, words, xxh64_intdigest).tobytes() for t in texts[x:y]], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), found], ["set", "shingles"])

    few = wanted.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(wanted) if few else wanted, "of_text").select("set", "text", "of_text")
    return found.dropDuplicates(["set"]).select("set", "text").mapInArrow(run, "set long, shingles binary")


def _possible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) that bitmaps do not rule out, for each b the one that can be the most alike. maps: (set, size, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (size_a, size_b), (of_a, of_b) = (b.column(i).to_numpy() for i in (2, 3)), (b.column(i).to_pylist() for i in (4, 5))
            length = np.array([min(len(x), len(y)) for x, y in zip(of_a, of_b, strict=True)], np.int64)
            most = np.zeros(b.num_rows)
            for l in np.unique(length).tolist():
                at = np.flatnonzero(length == l)
                most[at] = most_alike(folded([of_a[i] for i in at.tolist()], l), folded([of_b[i] for i in at.tolist()], l), size_a[at], size_b[at])
            yield b.select(["a", "b"]).append_column("most", pa.array(most)).filter(pa.array(most >= similarity - 1e-9))

    left, right = (maps.select(F.col("set").alias(k), F.col("size").alias(f"size_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, most double")
    return found.groupBy("b").agg(F.max(F.struct("most", "a")).alias("x")).select("x.a", "b")


def _members(met: DataFrame, similarity: float) -> DataFrame:
    """Of the members of groups, those with a partner in another component that bitmaps do not rule out.

    met: (key, i, j, side, set, root, size, bits) by group; comes back without size and bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            kept = list(group)
            side, root, size = (np.array([r[k] for r in kept], np.int64) for k in (3, 5, 6))
            other = (root[:, None] != root) & ((i == j) | (side[:, None] != side))
            has = possible_partner([r[7] for r in kept], size, other, similarity)
            if has.any():
                columns = zip(*(r[:6] for r, h in zip(kept, has, strict=True) if h), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "i", "j", "side", "set", "root"])

    group = ["key", "i", "j"]
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "key long, i int, j int, side int, set long, root long")


def _covered(each: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints differ in at most RADIUS bits, enough of them to connect all that do. each: (set, fingerprint)."""
    first = cut(each.groupBy("fingerprint").agg(F.min("set").alias("first")), "distinct-fingerprints")
    same = each.join(first, "fingerprint").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    links = near_links(first.select("fingerprint"), RADIUS)
    left, right = (first.select(F.col("fingerprint").alias(k), F.col("first").alias(f"set_{k}")) for k in "ab")
    return same.unionByName(links.join(left, "a").join(right, "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [alike(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (sets.select(F.col("set").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _forest(left: list[tuple], right: list[tuple] | None, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs alike within left, or else between left and right. Members: (set, root, shingles)."""
    both = left + (right or [])
    root = {r: r for _, r, _ in both}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, (a, ra, of_a) in enumerate(left):
        for b, rb, of_b in right if right is not None else left[i + 1 :]:
            x, y = find(ra), find(rb)
            if x != y and alike(of_a, of_b, similarity):
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _compared(met: DataFrame, similarity: float) -> DataFrame:
    """met: (key, i, j, side, set, root, shingles) by group, with the sets of blocks i and j of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            members = [(side, (name, root, np.frombuffer(shingles, np.int64))) for _, _, _, side, name, root, shingles in group]
            if i == j:
                links = _forest([m for _, m in members], None, similarity)
            else:
                links = _forest([m for side, m in members if side == i], [m for side, m in members if side == j], similarity)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    group = ["key", "i", "j"]
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def resembling(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, of_text, component, component_id) of every whole text.

    Documents whose sets of shingles have a Jaccard similarity of `similarity`
    or more are linked, all of them; component_id is the smallest id that links
    reach, itself included. component names the component, of_text the text (a
    hash), so that rows that share an id are told apart.

    Null texts are empty, and empty texts are alike. A null id stays null and
    names no component; a component without any id has a null component_id.
    Repeated rows give repeated rows in one component. An empty table gives an
    empty one; other columns are ignored.
    """
    docs = only(docs, id_col, text_col).withColumn("of_text", F.xxhash64("text"))
    prints = cut(_prefixes(docs, words, similarity), "shingle-prefixes")
    each = cut(prints.groupBy("set").agg(F.min("doc_id").alias("first"), F.min("of_text").alias("of_text"), F.any_value("fingerprint").alias("fingerprint")), "distinct-sets")
    keyed = prints.select("set", F.explode("prefix").alias("key"))
    crowd = keyed.groupBy("key").agg(F.min("set").alias("hub"), F.max("set").alias("last")).where("hub < last").select("key", "hub")
    raw = cut(keyed.join(crowd, "key").select("key", "set", "hub").distinct(), "shared-prefixes")
    # buckets of the same sets count once
    sized = raw.groupBy("key", "hub").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(7))).alias("y"))
    sized = sized.groupBy("n", "hub", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    met = cut(raw.join(sized, "key"), "resemblance-buckets")
    some = met.select("set").distinct()
    maps = cut(prints.select("set", "size", "bits").join(some, "set", "left_semi").dropDuplicates(["set"]), "resemblance-bitmaps")

    def whole(names: DataFrame) -> DataFrame:
        return cut(_sets(docs, names.distinct().join(each.select("set", "of_text"), "set"), words), "shingle-sets")

    pairs = met.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()
    pairs = cut(_possible(pairs, maps, similarity).unionByName(_covered(each.select("set", "fingerprint"))).distinct(), "hub-pairs")
    hub_sets = whole(pairs.select(F.explode(F.array("a", "b")).alias("set")))
    hub_links = cut(_verified(pairs, hub_sets, similarity), "hub-links")
    rooted = components(hub_links, "hub-links").withColumnRenamed("node", "set")
    split = cut(met.join(rooted, "set", "left").withColumn("root", F.coalesce("root", "set")), "rooted-buckets")
    discard(raw, met, pairs, hub_sets)
    several = split.groupBy("key").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = (
        split.join(several, "key", "left_semi").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "set", "root")
    )
    possible = cut(_members(rest.join(maps, "set").select("key", "i", "j", "side", "set", "root", "size", "bits"), similarity), "possible-members")
    # groups of the same members count once
    member = [F.bit_xor(F.xxhash64("set", "side", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    once = possible.groupBy("key", "i", "j").agg(F.count("*").alias("n"), *member).groupBy("i", "j", "n", "x1", "x2").agg(F.min("key").alias("key"))
    rest = cut(possible.join(once.select("key", "i", "j"), ["key", "i", "j"], "left_semi"), "distinct-members")
    sets = whole(rest.select("set"))
    links = cut(_compared(rest.join(sets, "set").select("key", "i", "j", "side", "set", "root", "shingles"), similarity), "resemblance-links")
    rooted = each.select("set", "first").join(components(links.unionByName(hub_links), "resemblance-links").withColumnRenamed("node", "set"), "set", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = cut(prints.join(rooted.join(least, "root").select("set", "root", "component_id"), "set").select("doc_id", "of_text", F.col("root").alias("component"), "component_id"), "resemblance")
    discard(prints, each, maps, split, possible, rest, sets, links, hub_links)
    return found
