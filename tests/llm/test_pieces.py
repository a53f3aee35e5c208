"""Encoding into pieces and decoding against the library, spans against the texts."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\nb", " lead", "trail ", "two  spaces", "\n\n", "▁x", "▁", " ", "tab\tx", "日本語 text", "🙂🙂 ☃\n☃", "a b", "\x00z", "<s>hi</s><0x41><unk>", "ﬁ ½ é é", "a" * 5000, "x " * 3000, "​﻿", "‮אבג"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def parts():
    m = pieces.read_model(PATH).check(PATH)
    return m, pieces.Normalizer(m), pieces.Pieces(m, 50), pieces.Decoder(m)


def check(text, library, parts):
    m, normalizer, merged, decoder = parts
    [(ids, begins, ends)] = pieces.encode_texts([text.encode()], normalizer, merged)
    want = library.encode(text)
    assert ids.tolist() == want
    assert decoder.decode(ids) == library.decode(want).encode()
    raw, at = text.encode(), 0
    for i, a, b in zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True):
        assert a == at and b >= a  # spans follow each other without gaps
        at = b
        surface = decoder.surface[i]
        assert raw[a:b].replace(pieces.SPACE_BYTES, b" ") in (surface, surface[1:])
    assert at == len(raw)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁aeinrst.,☃")), max_size=60))
def test_any_text(library, parts, text):
    check(text, library, parts)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, parts, text):
    check(text, library, parts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260), st.sampled_from([28705, 259, 13])), max_size=12))
def test_decodes_any_ids(library, parts, ids):
    assert parts[3].decode(ids) == library.decode(ids).encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_follows_compiled_maps(rule):
    """The library's own compiled maps: same result, and each byte's source begins where the library says."""
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normalizer(pieces.read_normalizer(n.serialized_normalizer_spec(), pieces.Model()))

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t　ﬁ½ガＡ́é①")), max_size=30))
    def same(text):
        want, places = n.normalize(text, with_offsets=True)
        out, begins, ends = own.normalize(text.encode())
        assert out.decode() == want
        starts = [begins[len(want[:i].encode())] for i in range(len(want))]
        assert [len(text.encode()[:a].decode()) for a in starts] == places[: len(want)]
        assert all(a <= b for a, b in zip(begins, ends, strict=True))

    same()


def test_operator(docs, library):
    df = docs.select("doc_id", "text", "n_words", F.lit(5).alias("ids"), F.lit("d").alias("decoded")).unionByName(docs.sparkSession.createDataFrame([(100 + i, t, 1, 5, "d") for i, t in enumerate(ODD)], "doc_id long, text string, n_words int, ids int, decoded string"))
    encoded = pieces.encode(df, keep=("doc_id", "text", "ids", "decoded"))
    assert encoded.columns == ["doc_id", "text", "input_ids", "decoded", "ids", "begins", "ends"]
    rows = pieces.decode(encoded, keep=("text", "ids", "input_ids", "decoded")).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        assert (r.input_ids, r.input_decoded) == (5, "d")
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0
    assert [r.decoded for r in pieces.decode(df.sparkSession.createDataFrame([(1, None), (2, [None, 264])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == ["", "a"]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = pieces.op13_sentencepieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.spanned_bytes) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len(texts[r.doc_id].encode()))
