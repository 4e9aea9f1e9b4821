"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece holds a white-space marker behind another character, merges
never cross the place where a marker begins. A text then falls into chunks
(markers and what follows up to the next), each distinct chunk is segmented
once, and a text's ids are its chunks' ids joined by position. A task keeps the
table for the texts it reads, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, pieces, slices, texts_of

#: Chunks kept in a task's table before it starts anew.
TABLE_CHUNKS = 300_000
#: Bytes of texts that a task works on together: their chunks take some thirty times as much.
PIECE_BYTES = 1 << 18
#: Chunks given to the library in one call.
RUN_CHUNKS = 1_000
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkCodec:
    """Encodes and decodes whole texts with one model."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces cross white-space markers: chunks would not be independent")
        if self.sp.normalize(" AÄ  Ａ\n") not in (f"{MARK}{MARK}AÄ{MARK}{MARK}Ａ\n",):
            raise ValueError("the model normalises texts: chunks of the raw text would differ")
        surface = []
        for i, p in enumerate(pieces):
            if self.sp.is_byte(i):
                surface.append(bytes([int(p[3:-1], 16)]))
            elif self.sp.is_control(i):
                surface.append(b"")
            elif self.sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(p.replace(MARK, " ").encode())
        self.surface = surface
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        #: A marker alone, as at the end of a text; the library adds none to an empty text.
        self.mark = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()
        self.chunks: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        """Segments new chunks. The library puts one marker in front of what it is given.

        Chunks with one marker go in runs to the library: as no merge crosses a
        marker, the pieces that begin with one show where each chunk's ids begin.
        """
        plain, rest = [], []
        for c in new:
            (rest if len(c) < 2 or c[1] == MARK else plain).append(c)
        for i in range(0, len(plain), RUN_CHUNKS):
            run = plain[i : i + RUN_CHUNKS]
            ids = np.array(self.sp.encode("".join(run)[1:], num_threads=1), "<u4")
            at = [*(4 * np.flatnonzero(self.marked[ids])).tolist(), 4 * len(ids)]
            packed = ids.tobytes()
            self.chunks.update(zip(run, map(packed.__getitem__, map(slice, at, at[1:])), strict=True))
        for c in rest:
            self.chunks[c] = np.array(self.sp.encode(c[1:]), "<u4").tobytes() if c != MARK else self.mark

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text between begin and end, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in slices(texts):
            split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[a:b]]
            if len(self.chunks) > TABLE_CHUNKS:
                self.chunks = {}
            self._learn(set().union(*split) - self.chunks.keys())
            get = self.chunks.__getitem__
            out += [self.begin + b"".join(map(get, s)) + self.end for s in split]
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: pieces' surfaces joined, without the marker that encoding put in front."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str, decode: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) of every whole text.

    ids: with begin and end, packed as little-endian unsigned 32-bit integers,
    the form in which training shards hold them. decoded: what these ids decode
    to, null unless asked for. model: a SentencePiece file at this path on every
    executor; one whose pieces cross markers, or which normalises, is refused.

    Null and empty texts give begin and end alone and decode to an empty text.
    A null id stays null, repeated rows give repeated rows, an empty table gives
    an empty one; other columns are ignored whatever they are called. Texts of
    any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for b in batches:
            for part in pieces(b, 1, PIECE_BYTES):
                ids = codec.encode(texts_of(part.column(1)))
                text = [codec.decode(i) for i in ids] if decode else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids) as encode_documents() packs them; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for b in batches:
            text = [codec.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
