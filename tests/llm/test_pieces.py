"""Encoding against the sentencepiece library: ids, spans, normalisation and decoded texts."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from test_operators import ODD, SF, odd_docs
from tidemark.llm import pieces
from tidemark.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "▁", "the", " th", "é", "\n", "\t", "́", "漢", "😀", "\x07", "x", "ing", ".", ",",
            "<s>", "</s>", "<unk>", "<0x41>", "ö", "ж", "\0", "Ａ", "ﬁ", "　", "①", "㍿"]


def texts(n=700, seed=3):
    rnd = random.Random(seed)
    out = [t for t in ODD if t is not None] + ["a" * 3000, " " * 2000, "the" * 900, "▁▁a ▁ b", "﻿a​ b"]
    out += ["".join(rnd.choices(ALPHABET, k=rnd.randrange(40))) for _ in range(n)]
    planes = [(1, 0x250), (0x250, 0xD800), (0xE000, 0x110000)]
    return out + ["".join(chr(rnd.randrange(*rnd.choice(planes))) for _ in range(rnd.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return pieces.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_spans_equal_the_librarys(encoder, library):
    every = texts()
    for text, (ids, begins, ends) in zip(every, encoder(every)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        spans = list(zip(np.frombuffer(begins, "<u8").tolist(), np.frombuffer(ends, "<u8").tolist()))
        size = len(text.encode())
        assert spans[0] == (0, 0) and spans[-1] == (size, size)
        assert spans[1:-1] == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_spans_cover_the_text(encoder):
    for text, (_, begins, ends) in zip(texts(100), encoder(texts(100))):
        b, e = np.frombuffer(begins, "<u8").astype(int), np.frombuffer(ends, "<u8").astype(int)
        assert (b[1:] >= e[:-1]).all() or len(b) == 2
        assert (e - b).sum() == len(text.encode())


def test_merges_together_and_alone_agree(encoder):
    parts = sorted({p for t in texts() for p in encoder.parts.findall(t.replace(" ", "▁")) if encoder.usual.fullmatch(p)})
    together = encoder.merges.together(parts)
    for p, ids in zip(parts, together):
        assert np.frombuffer(ids, "<u4").tolist() == [encoder.scores[q][1] for q in encoder.merges.alone(p)]


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    some = texts(100)
    assert list(encoder(some)) == [r for t in some for r in encoder([t])]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_compiled_maps_of_the_library(rule, squeeze, prefix):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze,
                                                   add_dummy_prefix=prefix, escape_whitespaces=True)
    spec = dict(pieces._fields(dict(pieces._fields(theirs.serialized_model_proto()))[pieces.NORMALIZER]))
    mine = pieces.Normalizer(spec.get(2, b""), prefix, squeeze, True)
    for text in texts(150, 8):
        want, places = theirs.normalize(text, with_offsets=True)
        norm, source = mine(text)
        assert norm.decode() == want
        chars = np.cumsum([0, *(len(c.encode()) for c in want)])
        raw = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert source[chars].tolist() == raw[list(places)].tolist()


def test_other_models_are_refused(encoder):
    with pytest.raises(ValueError):
        pieces.Encoder(b"")


def test_operator_on_odd_rows_and_whole_texts(spark, library):
    docs = odd_docs(spark).unionByName(table(spark, SF, "documents"), allowMissingColumns=True)
    enc = pieces.encode(docs, PATH)
    got = enc.withColumn("back", pieces.decode(F.col("ids"), enc, PATH)).collect()
    want = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(want)
    expect = sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in
                    ((i, str(library.encode(t, add_bos=True, add_eos=True)) +
                      library.decode(library.encode(t, add_bos=True, add_eos=True))) for i, t in want))
    assert sorted((str(r.doc_id), hashlib.sha256(
        (str(np.frombuffer(r.ids, "<u4").tolist()) + r.back).encode()).hexdigest()) for r in got) == expect
    assert all(len(r.begins) == len(r.ends) == 2 * len(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)
    assert pieces.encode(docs.limit(0), PATH).count() == 0
