"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME_UNITS code
points each, beside the number of units that lie before each frame. A cut finds
its frame in these counts, so only the frames that a cut falls into are ever
decompressed and made into two; all others change place as they are. Digests
and texts stream the ordered frames, one at a time. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices, texts_of

#: Code points in a frame.
FRAME_UNITS = 16_384
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Order of the parts (0 prefix, 1 suffix, 2 middle) in each form.
ORDER = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
_FRAMES = pa.list_(pa.struct([("before", pa.int64()), ("data", pa.binary())]))
_FRAMES_SQL = "array<struct<before: bigint, data: binary>>"

Frame = tuple[int, bytes]  # units in it, compressed text


class FrameStore:
    """Makes, cuts and reads frames."""

    def __init__(self, units: int = FRAME_UNITS, level: int = 1):
        import zstandard

        self.units = units
        self.pack, self.unpack = zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress

    def frames(self, text: str) -> list[Frame]:
        parts = (text[i : i + self.units] for i in range(0, len(text), self.units))
        return [(len(p), self.pack(p.encode())) for p in parts]

    def text(self, frame: Frame) -> str:
        return self.unpack(frame[1]).decode()

    def span(self, frames: list[Frame], before: list[int], start: int, end: int) -> list[Frame]:
        """Frames of the units from start to end; those cut through are decompressed, the others taken as they are."""
        out: list[Frame] = []
        k = max(bisect_right(before, start) - 1, 0)
        while k < len(frames) and before[k] < end:
            a, b = max(start - before[k], 0), min(end - before[k], frames[k][0])
            if (a, b) == (0, frames[k][0]):
                out.append(frames[k])
            elif a < b:
                out += self.frames(self.text(frames[k])[a:b])
            k += 1
        return out

    def arranged(self, frames: list[Frame], form: str, cuts: tuple[int, int], marks: tuple) -> list[Frame]:
        """Frames of the output: each part behind its mark, in the order of the form."""
        if form == "plain":
            return frames
        before, n = starts(frames), sum(u for u, _ in frames)
        at = {0: (0, cuts[0]), 1: (cuts[1], n), 2: cuts}
        return [f for part in ORDER[form] for f in (*self.frames(marks[part]), *self.span(frames, before, *at[part]))]

    def stream(self, frames: Iterable[Frame]) -> Iterator[str]:
        for f in frames:
            yield self.text(f)

    def marked_at(self, frames: list[Frame], marks: Iterable[str]) -> list[int]:
        """Where each of the marks first stands behind the one before it, from a stream that keeps a mark less one unit of what it has read."""
        left, found, end, tail = list(marks), [], 0, ""
        for part in self.stream(frames):
            window, base, at = tail + part, end - len(tail), 0
            while left and (hit := window.find(left[0], at)) >= 0:
                found.append(base + hit)
                at = hit + len(left.pop(0))
            end += len(part)
            tail = window[max(at, len(window) - max(map(len, left), default=1) + 1) :]
        return found

    def restored(self, frames: list[Frame], form: str, marks: tuple) -> list[Frame]:
        """Frames of the text that an output was made from."""
        if form == "plain":
            return frames
        before, n = starts(frames), sum(u for u, _ in frames)
        at = self.marked_at(frames, (marks[p] for p in ORDER[form]))
        of = {p: (a + len(marks[p]), b) for p, a, b in zip(ORDER[form], at, [*at[1:], n], strict=True)}
        return [f for p in (0, 2, 1) for f in self.span(frames, before, *of[p])]

    def digest(self, frames: list[Frame]) -> str:
        h = hashlib.sha256()
        for f in frames:
            h.update(self.unpack(f[1]))
        return h.hexdigest()


def starts(frames: list[Frame]) -> list[int]:
    """Units before each frame."""
    out, n = [], 0
    for u, _ in frames:
        out.append(n)
        n += u
    return out


def drawn(doc_id: int | None, n: int, salt: str, cut_percent: int, spm_percent: int) -> tuple[str, tuple[int, int]]:
    """Form and cuts of a text of n units, from the hash of its id."""
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if h3 % 100 >= cut_percent:
        return "plain", (0, 0)
    return "spm" if h4 % 100 < spm_percent else "psm", (min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1)))


def _column(rows: list[list[Frame]]) -> pa.Array:
    return pa.array([[{"before": b, "data": d} for b, (_, d) in zip(starts(r), r, strict=True)] for r in rows], _FRAMES)


def _rows(column: pa.Array, n: pa.Array) -> Iterator[list[Frame]]:
    """The frames of each row; the last one ends at n."""
    for row, units in zip(column.to_pylist(), n.to_pylist(), strict=True):
        ends = [*(f["before"] for f in row[1:]), units][: len(row)]
        yield [(e - f["before"], f["data"]) for f, e in zip(row, ends, strict=True)]


def frame_documents(docs: DataFrame, marks: tuple = MARKS, units: int = FRAME_UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, marked, frames) of every whole text: n code points in frames, and whether one of the marks stands in it.

    Null and empty texts have no frames. A null id stays null, repeated rows
    give repeated rows, an empty table gives an empty one; other columns are
    ignored whatever they are called. A task holds the rows of one batch, and
    beyond the rows themselves one frame uncompressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = FrameStore(units)
        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts):
                rows = texts[x:y]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array([len(t) for t in rows], pa.int64()), pa.array([any(m in t for m in marks) for t in rows], pa.bool_()), _column([store.frames(t) for t in rows])],
                    ["doc_id", "n", "marked", "frames"],
                )

    return only(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n long, marked boolean, frames {_FRAMES_SQL}")


def fill_in_middle(framed: DataFrame, salt: str = "1:", cut_percent: int = 90, spm_percent: int = 20, marks: tuple = MARKS, units: int = FRAME_UNITS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, n_output, frames) of a table that frame_documents() made.

    form: plain (the text as it is: empty ones, those with a mark in them, and
    100 - cut_percent in 100), spm (spm_percent of the others: suffix, prefix,
    middle) or psm (prefix, suffix, middle). Form and cuts follow from the
    SHA-256 of salt and id alone (a null id counts as an empty string), so rows
    of one id and length are cut alike. frames: the n_output code points of the
    output. Counts are null where the form is plain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = FrameStore(units)
        for b in batches:
            ids, n, marked = (b.column(i).to_pylist() for i in range(3))
            forms = [("plain", (0, 0)) if m or not k else drawn(i, k, salt, cut_percent, spm_percent) for i, k, m in zip(ids, n, marked, strict=True)]
            out = [store.arranged(f, form, cuts, marks) for f, (form, cuts) in zip(_rows(b.column(3), b.column(1)), forms, strict=True)]
            cut = [None if form == "plain" else c for form, c in forms]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([f for f, _ in forms], pa.string()), pa.array([c and c[0] for c in cut], pa.int64()),
                    pa.array([c and c[1] - c[0] for c in cut], pa.int64()), pa.array([sum(u for u, _ in f) for f in out], pa.int64()), _column(out),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_output", "frames"],
            )

    return framed.select("doc_id", "n", "marked", "frames").mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, n_output long, frames {_FRAMES_SQL}")


def with_digests(moved: DataFrame, marks: tuple = MARKS, units: int = FRAME_UNITS) -> DataFrame:
    """What fill_in_middle() gives but its frames, with output_sha256 of the output and restored_sha256 of the text rebuilt from output and form."""
    kept = [c for c in moved.columns if c != "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = FrameStore(units)
        for b in batches:
            out, back = [], []
            for frames, form in zip(_rows(b.column("frames"), b.column("n_output")), b.column("form").to_pylist(), strict=True):
                out.append(store.digest(frames))
                back.append(store.digest(store.restored(frames, form, marks)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string()), pa.array(back, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    schema = ", ".join(f"{c} {t}" for c, t in moved.select(kept).dtypes)
    return moved.mapInArrow(run, f"{schema}, output_sha256 string, restored_sha256 string")


def with_texts(moved: DataFrame, marks: tuple = MARKS, units: int = FRAME_UNITS) -> DataFrame:
    """(doc_id, form, output, restored): the output, and the text rebuilt from output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = FrameStore(units)
        for b in batches:
            forms, frames = b.column(1).to_pylist(), list(_rows(b.column(3), b.column(2)))
            out = ["".join(store.stream(f)) for f in frames]
            back = ["".join(store.stream(store.restored(f, form, marks))) for f, form in zip(frames, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(back, pa.string())], ["doc_id", "form", "output", "restored"])

    return moved.select("doc_id", "form", "n_output", "frames").mapInArrow(run, "doc_id long, form string, output string, restored string")
