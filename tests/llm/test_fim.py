"""Seekable texts and the fill-in-the-middle transformation against plain strings."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_operators import odd_docs
from tidemark.llm import fim


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    t = text or ""
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, len(t), "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return doc_id, len(t), "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


@pytest.mark.parametrize("frame", [7, fim.FRAME])
def test_equals_plain_strings(spark, frame):
    docs = odd_docs(spark, [(100 + i, "Zß😀 " * (i % 37) + "x" * i, "s") for i in range(150)]
                    + [(300, "has <S> inside", "s"), (301, "<P", "s"), (302, "<M><", "s")])
    out = fim.fill_in_middle(docs, frame)
    back = fim.text_sha256(fim.restore(F.col("output"), F.col("form")))
    got = out.withColumn("a", fim.text_sha256(F.col("output"))).withColumn("b", back).collect()
    want = [(*brute(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.a, r.b) for r in got))) == sorted(
        map(repr, ((*w[:5], sha(w[5]), sha(w[6])) for w in want)))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(odd_docs(spark).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab<>PSMé😀", max_size=60), st.integers(1, 9), st.data())
def test_frames(text, frame, data):
    codec = fim.Codec(frame=frame)
    s = fim.Seekable.unpack(codec.store(text).pack())
    assert "".join(codec.stream(s)) == text and len(s) == len(text)
    a, b = sorted(data.draw(st.tuples(*[st.integers(0, len(text))] * 2)))
    part = fim.Seekable()
    codec.move(part, s, a, b)
    assert "".join(codec.stream(part)) == text[a:b]
    assert codec.find(s, ["<P>", "a"]) == {m: text.index(m) for m in ("<P>", "a") if m in text}
    if not any(m in text for m in fim.MARKERS) and text:
        # no marker arises where a text meets one: markers begin with '<' and have none behind it
        for form in (fim.PSM, fim.SPM):
            out = codec.rearrange(s, form, (a, b))
            assert "".join(codec.stream(codec.restore(out, form))) == text


def test_only_cut_frames_are_opened():
    codec = fim.Codec(frame=10)
    s = codec.store("abcdefghij" * 100)
    opened = []
    codec.text = lambda f, inner=codec.text: opened.append(1) or inner(f)
    codec.rearrange(s, fim.PSM, (105, 707))
    assert len(opened) == 4   # each cut frame serves the two parts that it touches
