import hashlib

import public_tokenizers
import tiktoken
from helpers import AWKWARD, documents
from hypothesis import given, settings, strategies as st
from sondage.llm.byte_bpe import compiled, decode, digests, encode, read_ranks, words_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
COMPILED = compiled(PATTERN)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'st1. \n\t\r\x1c\x1f\x85\xa0 é<|>"), st.characters(codec="utf-8")), max_size=30))
def test_words_cut_no_match(text):
    words = words_of(text, COMPILED)
    assert "".join(words) == text
    assert [i for w in words for i in MODEL.encode_ordinary(w)] == MODEL.encode_ordinary(text)


def test_encode_and_decode_round_trip(spark):
    rows = AWKWARD + [(100 + k, f"word{k}  it's <|endoftext|> é{k}\n\n  end ") for k in range(50)]
    got = decode(encode(documents(spark, rows), PATH, PATTERN), PATH).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), MODEL.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), r.token_ids, bytes(r.decoded)) for r in got) == want


def test_digests(spark):
    rows = [(1, "some text"), (2, None)]
    got = {r.doc_id: r for r in digests(documents(spark, rows), PATH, PATTERN).collect()}
    ids = MODEL.encode_ordinary("some text")
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert encode(documents(spark, AWKWARD).limit(0), PATH, PATTERN).count() == 0
