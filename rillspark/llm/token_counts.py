"""Token counts by rank-synchronous array merging.

A task splits its texts into words, keeps a table of the words it has met, and
counts the tokens of new words together: all their pre-tokens lie in one flat
array of symbols with sequence numbers beside it (a ragged batch). In every
round each sequence applies its pair of lowest rank, everywhere it occurs, and
sequences without a known pair leave with their count of symbols. There is no
shuffle, and memory is bounded by a slice of texts and the word table's limit.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, texts_of

#: Words kept in a task's table before it starts anew.
TABLE_WORDS = 400_000
_NONE = np.iinfo(np.int64).max
#: Unicode White_Space, which separates words.
_SPACE = "\t-\r\x20\x85\xa0  -     　"
#: The pattern of the byte-level pre-tokenizer where the file leaves it to the library (fixed value).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class ArrayBpe:
    """Ranked merges over ragged symbol arrays."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.size = len(vocab)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int64), made[order]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty pre-token."""
        out = np.zeros(len(tokens), np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        sym, ends = self.first[raw], np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        seq = np.repeat(np.arange(len(tokens)), size)
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[start, len(seq)])
            code = np.full(len(sym), -1, np.int64)
            code[:-1] = np.where(seq[:-1] == seq[1:], sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            rank = np.where(self.code[at] == code, self.rank[at], _NONE)
            least = np.minimum.reduceat(rank, start)
            out[seq[start[least == _NONE]]] = length[least == _NONE]
            each = np.repeat(least, length)
            hit = np.flatnonzero((rank == each) & (each != _NONE))
            if len(hit):  # in a run of overlapping hits every second one applies
                begins = np.r_[True, np.diff(hit) != 1]
                run = hit[np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))]
                hit = hit[(hit - run) % 2 == 0]
                sym[hit] = self.made[at[hit]]
            keep = each != _NONE
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class WordCounter:
    """Token counts of whole texts, through a table of the words met so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bpe = ArrayBpe(spec["model"])
        parts = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = {p["type"] for p in parts}
        if not {"NFC", "Replace", "Lowercase"} <= kinds:
            raise ValueError("only vocabularies that drop white space are counted word by word")
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", _SPACE) if splits else _BYTE_LEVEL)
        self.space = regex.compile(f"[{_SPACE}]+")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.words: dict[str, int] = {"": 0}

    def _split(self, text: str) -> list[str]:
        """Words between white space. str.split() takes four separators as white space that Unicode does not."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.space.split(text)
        return text.split()

    def _pieces(self, part: str) -> list[bytes]:
        """The pre-tokens of a word."""
        if not part.isascii():
            # lower case goes character by character, so a final sigma is no special case
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        return [part.encode()] if part.isalpha() else [t.encode() for t in self.pattern.findall(part)]

    def learn(self, words: set[str]) -> None:
        new = list(words - self.words.keys())
        pieces, extra = [], {}
        with_special = {w for s in self.specials for w in new if s in w}
        for w in new:
            if w in with_special:
                parts = self.special.split(w)
                extra[w] = len(parts) // 2
                pieces.append([t for p in parts[::2] for t in self._pieces(p)])
            else:
                pieces.append(self._pieces(w))
        distinct = {t: i for i, t in enumerate({t for p in pieces for t in p})}
        counts = self.bpe.count(list(distinct)).tolist() if distinct else []
        for w, p in zip(new, pieces, strict=True):
            self.words[w] = counts[distinct[p[0]]] if len(p) == 1 else sum(counts[distinct[t]] for t in p)
        for w, n in extra.items():
            self.words[w] += n

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in slices(texts):
            split = [self._split(t) for t in texts[a:b]]
            if len(self.words) > TABLE_WORDS:
                self.words = {"": 0}
            self.learn(set().union(*split))
            get = self.words.__getitem__
            out += [sum(map(get, s)) for s in split]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text.

    tokenizer: a vocabulary file in JSON, of the kind that lower-cases and
    drops white space; it must lie at this path on every executor.

    Null and empty texts have 0 bytes and 0 tokens. A null id stays null.
    Repeated rows give repeated rows, an empty table gives an empty one, and
    columns other than the two named are ignored whatever they are called.
    Special strings inside a text count as one token each. Texts of any length
    are counted whole.
    """
    docs = only(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(tokenizer)
        for b in batches:
            n = counter.count(texts_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", n_bytes, "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
