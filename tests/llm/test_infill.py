"""Fill-in-middle against an arrangement of whole strings."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_operators import empty, frame, made

from tracetide.llm import infill


def arranged(doc, text, seed=1, rate=90, spm_rate=20):
    """(n, form, prefix, middle, suffix, output) of one text, from the definition."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not units or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, None, text or ""
    spm = h4 % 100 < spm_rate
    return len(units), "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = made(60, 3) | {100: "a<", 101: "<P", 102: "x<S>y", 103: "<" * 40, 104: "Z" * 500, 105: "日本" * 70 + "q" * 90 + "é", 106: "<S<P<M" * 30, 107: "\n", 108: "\U0001f600" * 9, 109: "a b " * 60 + "<M>"}


@pytest.mark.parametrize("size", [4, 7, 64, infill.FRAME])
def test_forms_and_texts_do_not_depend_on_the_frames(spark, size):
    df = frame(spark, TEXTS)
    filled = infill.fill_in_middle(infill.store_frames(df, frame_bytes=size))
    texts = {r.doc_id: r.output for r in infill.output_texts(filled).collect()}
    rows = {r.doc_id: r for r in infill.digests(filled).collect()}
    assert set(rows) == set(TEXTS) and {r.form for r in rows.values()} == {"plain", "psm", "spm"}
    for d, text in TEXTS.items():
        n, form, p, m, _, out = arranged(d, text)
        r = rows[d]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m)), d
        assert texts[d] == out and r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_untouched_frames_are_taken_over(spark):
    text = {0: "".join(f"w{k} " for k in range(4000))}
    store = infill.store_frames(frame(spark, text), frame_bytes=512)
    one, two = store.first(), infill.fill_in_middle(store, rate=100).first()
    cut = lambda blob, ends: {bytes(blob[a:b]) for a, b in zip([0, *ends], ends, strict=False)}
    old, new = cut(one.blob, one.ends), cut(two.frames, two.ends)
    assert len(one.ends) == -(-len(text[0]) // 512) and len(old - new) <= 2
    assert one.units[-1] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text[0])) and one.chars[-1] == len(text[0])


def test_parts_whose_marks_lie_across_chunks():
    out = b"<P>a<<S>b<S<M>c<"
    for k in range(1, len(out)):
        got = {"prefix": b"", "suffix": b"", "middle": b""}
        for part, chunk in infill.parts("psm", [out[i : i + k] for i in range(0, len(out), k)]):
            got[part] += chunk
        assert got == {"prefix": b"a<", "suffix": b"b<S", "middle": b"c<"}


def test_odd_rows(spark):
    """Null ids, repeated rows, no rows, a share of 0 or 100 %, columns of the same names."""
    assert infill.digests(infill.fill_in_middle(infill.store_frames(empty(spark)))).count() == 0
    df = frame(spark, {1: "one two three", 2: None}).withColumn("doc_id", F.when(F.col("doc_id") == 1, 1)).withColumn("n", F.lit("x")).withColumn("blob", F.lit(1))
    df = df.union(df)
    rows = infill.digests(infill.fill_in_middle(infill.store_frames(df))).collect()
    assert len(rows) == 4 and len(set(rows)) == 2 and [r.form for r in rows if r.n == 0] == ["plain"] * 2
    assert {r.form for r in infill.fill_in_middle(infill.store_frames(frame(spark, TEXTS)), rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(infill.store_frames(frame(spark, TEXTS)), rate=100, spm_rate=100).where("n > 0 and doc_id < 100").collect()} == {"spm"}
    null = frame(spark, {0: "a b"}).withColumn("doc_id", F.lit(None).cast("long"))
    assert infill.digests(infill.fill_in_middle(infill.store_frames(null))).first().output_sha256 == hashlib.sha256(arranged(None, "a b")[5].encode()).hexdigest()
