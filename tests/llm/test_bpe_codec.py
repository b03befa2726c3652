import base64
import hashlib

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from claimworks.llm import bpe_codec

TEXTS = ["", " ", "  ", "a  \nb", "x \x1cy a", "a   b ", "a\n b\n\n c", "\nq \nq r", "don't I'LL", "é́▁ _▁ ß漢字\x00\x01 <|endoftext|>", "a" * 20000]


@pytest.fixture(scope="module")
def theirs():
    with open(public_tokenizers.path(bpe_codec.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_round_trip(theirs, text):
    ids = bpe_codec.codec().encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert bpe_codec.codec().decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1\n\t.'sé漢 \x85")), max_size=30))
def test_any_text(text):
    ids = bpe_codec.codec().encode(text)
    with open(public_tokenizers.path(bpe_codec.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)} if not hasattr(test_any_text, "enc") else None
    if ranks:
        test_any_text.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids == test_any_text.enc.encode_ordinary(text)


def test_table(spark):
    rows = [(1, None), (2, "to be"), (2, "to be"), (None, "")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, ids string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe_codec.digests(df).collect())
    assert got == [(0, 0, hashlib.sha256(b"").hexdigest()), (1, 0, hashlib.sha256(b"").hexdigest()), *[(2, 2, hashlib.sha256(b"to be").hexdigest())] * 2]
    back = bpe_codec.decode(bpe_codec.encode(df)).collect()
    assert sorted(bytes(r.content) for r in back) == [b"", b"", b"to be", b"to be"]
    assert bpe_codec.digests(df.limit(0)).count() == 0


def test_query(spark, sf_dir, theirs):
    """The registered query's columns for every document, by another library's ids."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in bpe_codec.op8_byte_bpe(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = theirs.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want


def test_long_words_are_not_kept():
    c = bpe_codec.codec()
    c.encode("short " + "x" * 5000 + " " + "y" * 5000)
    assert " short" in c._known or "short" in c._known or "\nshort" in c._known
    assert max(map(len, c._known)) <= bpe_codec.LONG
