"""Fill-in-middle against plain slicing, through frames smaller than the texts."""

import hashlib

import duckdb
import pytest

from rillspark.llm import fill_middle as fm
from rillspark.llm import queries

TEXTS = [None, "", "a", "ab", "<P>x", "a <M> b", "x<S", "<" * 40, "<P" * 30, "<S<M<P" * 20, "née 漢字 😀" * 30, "\x00 nul", "long " * 40_000, "same", "same"] + ["t" * k for k in range(60)]


def plain(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def docs(spark):
    rows = [(None if i == 10 else i, t, i, "x", [i]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, form string, frames array<int>")


@pytest.mark.parametrize("units", [1, 3, 7, fm.FRAME_UNITS])
def test_outputs_equal_slicing_whatever_the_frames(spark, units):
    moved = fm.fill_in_middle(fm.frame_documents(docs(spark), units=units), units=units)
    got = {r.doc_id: r for r in fm.with_texts(moved, units=units).collect()}
    digests = {r.doc_id: r for r in fm.with_digests(moved, units=units).collect()}
    forms = set()
    for i, t in enumerate(TEXTS):
        i = None if i == 10 else i
        form, a, m, out = plain(i, t)
        forms.add(form)
        assert (got[i].form, got[i].output, got[i].restored) == (form, out, t or "")
        d = digests[i]
        assert (d.n, d.form, d.prefix_chars, d.middle_chars, d.n_output) == (len(t or ""), form, a, m, len(out))
        assert d.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and d.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert forms == {"plain", "psm", "spm"}


def test_only_frames_with_a_cut_are_read():
    store, read = fm.FrameStore(10), []
    frames = store.frames("0123456789" * 9)
    store.text = lambda f, text=store.text: read.append(f) or text(f)
    kept = store.span(frames, fm.starts(frames), 15, 77)
    assert "".join(map(fm.FrameStore(10).text, kept)) == ("0123456789" * 9)[15:77] and len(read) == 2


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    df = queries.op13_fill_middle(spark, "/root/testdata/sf0.001")
    want = con.sql(f"select {', '.join(df.columns)} from ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_an_empty_table(spark):
    assert fm.with_digests(fm.fill_in_middle(fm.frame_documents(docs(spark).limit(0)))).isEmpty()
