"""Token counts and SentencePiece coding against the libraries."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from rillspark.llm import sentence_pieces
from rillspark.llm.sentence_pieces import decode_documents, encode_documents
from rillspark.llm.token_counts import count_tokens

TEXTS = [
    None, "", " ", "  a  b\n\n\tc ", "ΑΣ ΣΑΣ Σ", "it's they'RE 'll x'd 123 ½ a1b2", "<|endoftext|>", "a<|startoftext|>b <|END|> c<|endoftext|>", "İstanbul ŞÀ é ﬁ",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaa bbb " * 3, "x" * 20_000, "漢字 かな 😀😀 👩‍👩‍👧", "a\x1cb\x85c d　e f", "﻿abc \x00 z", "ÅÅ ▁▁ a▁b ▁", "'s't're", "ab" * 5_000,
    "the " * 30_000, "<s> </s> <unk> <0x41>", "same", "same",
]


def docs(spark, texts=TEXTS):
    clash = [(None if i == 3 else i, t, i, "x", [i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(clash, "doc_id long, text string, n_tokens int, ids string, row array<int>")


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = count_tokens(docs(spark), path).collect()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert sorted((r.doc_id if r.doc_id is not None else 3, r.n_tokens, r.n_bytes) for r in got) == [(i, n, len((t or "").encode())) for i, (n, t) in enumerate(zip(want, TEXTS, strict=True))]


def test_ids_and_texts_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in encode_documents(docs(spark), path).collect():
        ids = sp.encode(TEXTS[3 if r.doc_id is None else r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids)


def test_decoding_alone(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = encode_documents(docs(spark), path, decode=False)
    assert e.where("decoded is not null").isEmpty()
    back = {r.doc_id: r.text for r in decode_documents(e.where("doc_id in (4, 9, 11)"), path).collect()}
    assert back == {i: TEXTS[i] for i in (4, 9, 11)}


def test_empty_tables(spark):
    none = docs(spark, TEXTS[:1]).limit(0)
    assert count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).isEmpty()
    assert encode_documents(none, public_tokenizers.path("piece_bpe_32k.model")).isEmpty()


def test_a_task_holds_few_texts_at_a_time(monkeypatch):
    """Pieces of a batch come back in turn, none with more bytes of texts than asked for and one text."""
    held = {}
    docs = SimpleNamespace(mapInArrow=lambda run, schema: held.update(run=run))
    monkeypatch.setattr(sentence_pieces, "only", lambda *_: docs)
    encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", *(f"text {i} " * 100 for i in range(2_000)), "é" * 400_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(held["run"]([batch, batch.slice(0, 0), batch.slice(5, 1)]))
    assert [t for b in out for t in b.column(2).to_pylist()] == [*(t or "" for t in texts), texts[5]]
    assert [i for b in out for i in b.column(0).to_pylist()] == [*range(len(texts)), 5]
    sizes = [[len(t.encode()) for t in b.column(2).to_pylist()] for b in out]
    assert len(out) > 5 and all(sum(s) - max(s) <= sentence_pieces.PIECE_BYTES for s in sizes)
