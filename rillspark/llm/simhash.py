"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text has a 64-bit fingerprint. For radius r each bit position carries one
of 2^(r+1) - 1 nonzero codes, and for every nonzero vector there is a table
whose mask holds the positions with an odd inner product of code and vector.
Any r positions leave some vector orthogonal to all their codes, so two
fingerprints that differ in those positions alone agree under that mask: every
pair within the radius meets in some table.

Equal fingerprints count once. Buckets with many fingerprints are compared in
pairs of blocks, so no group grows without bound; each comparison gives the
links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.components import components

from .common import cut, only, slices, texts_of

BITS, SEED = 64, 42
#: Fingerprints in a block; a bucket with more is compared block by block.
BLOCK = 512


def masks(radius: int) -> list[int]:
    """Masks of the covering tables as signed longs, one for each nonzero vector of radius + 1 bits."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    unsigned = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (m >> 63 << 64) for m in unsigned]


def fingerprint(text: str, words: int, hash64) -> int:
    """Fingerprint as a signed long. Texts with fewer words than a shingle are one shingle; without a word it is 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return majority(np.array([hash64(s, SEED) for s in shingles], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit hashes, as a signed long; 0 without any."""
    n = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        n += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts):
                found = pa.array([fingerprint(t, words, xxh64_intdigest) for t in texts[x:y]], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), found], ["doc_id", "fingerprint"])

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the near pairs within left, or else between left and right."""
    other = left if right is None else right
    # bits of signed numbers would be counted in their absolute values
    a, b = np.nonzero(np.bitwise_count((left[:, None] ^ other[None, :]).view(np.uint64)) <= radius)
    if right is None:
        a, b = a[a < b], b[a < b]
    both = np.concatenate((left, right)) if right is not None else left
    if right is not None:
        b = b + len(left)
    root = list(range(len(both)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return [(int(both[x]), int(both[y])) for x, y in out]


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) of fingerprints at most `radius` bits apart: a subset of the near pairs that connects what they connect.

    prints: distinct (fingerprint long).
    """
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))))
    keyed = prints.select("fingerprint", F.explode(tables).alias("at")).select("fingerprint", "at.*")
    crowd = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    met = (
        keyed.join(crowd, ["t", "key"]).withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in [*batches, None]:
            rows = np.array([c.to_numpy() for c in b.columns], np.int64) if b is not None and b.num_rows else None
            if rows is not None and rest is not None:
                rows = np.concatenate((rest, rows), axis=1)
            if rows is None:
                if b is not None or rest is None:
                    continue
                rows = rest
            starts = np.flatnonzero(np.r_[True, (np.diff(rows[:4], axis=1) != 0).any(0)])
            ends = np.r_[starts[1:], rows.shape[1]]
            if b is not None:  # the last group may go on
                rest = rows[:, starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            links = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                prints = rows[5, s:e]
                if rows[2, s] == rows[3, s]:
                    links += _forest(prints, None, radius)
                else:
                    first = rows[4, s:e] == rows[2, s]
                    links += _forest(prints[first], prints[~first], radius)
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    group = ["t", "key", "i", "j"]
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every whole text.

    Documents whose fingerprints differ in at most `radius` bits are linked;
    component_id is the smallest id that links reach, itself included. With
    `similarity`, documents are linked whose sets of shingles have a Jaccard
    similarity of that or more, all of them and no others: candidates of the
    covering tables are verified on whole texts, and what fingerprints leave
    too far apart is completed exactly (see resemblance.py, which also says
    what comes back then).

    Null and empty texts have fingerprint 0 and are linked like any other. A
    null id stays null and names no component; a component without any id has a
    null component_id. Repeated rows give repeated rows in one component. An
    empty table gives an empty one; other columns are ignored.
    """
    if similarity is not None:
        from .resemblance import resembling

        return resembling(docs, words, similarity, id_col, text_col)
    prints = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    each = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    rooted = each.join(components(near_links(each.select("fingerprint"), radius), "simhash-links").withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")
