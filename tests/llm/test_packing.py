import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings, strategies as st
from sondage.llm.packing import Packer, WordTokenizer, pack, token_pieces
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc'stéßΣσİ \n\t\x1c\xa0　.,<|>12"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizer_s(text):
    tokenizer = test_ids_are_the_tokenizer_s.__dict__.setdefault("t", (WordTokenizer(PATH), Tokenizer.from_file(PATH)))
    assert np.frombuffer(tokenizer[0].ids([text])[0], "<u4").tolist() == tokenizer[1].encode(text, add_special_tokens=False).ids


def test_words_of_the_vocabulary(words):
    own = [k.removesuffix("</w>") for k in Tokenizer.from_file(PATH).get_vocab() if k.endswith("</w>")][:4000]
    own += ["<|endoftext|>", "a<|endoftext|>b", "don't", "'S'T"]
    own = [w for w in own if w.split()]
    assert [words.encode([w])[0] for w in own] == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(own, add_special_tokens=False)]


def test_pieces_and_packing(spark):
    rows = AWKWARD + [(100 + k, "word " * (k * 37 % 900)) for k in range(200)]
    docs = documents(spark, rows)
    tokenizer = Tokenizer.from_file(PATH)
    got = pack(token_pieces(docs, PATH, capacity=512, with_ids=True), capacity=512, shard_items=64).collect()
    per_doc = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.token_ids, "<u4")
        assert len(ids) == r.length <= 512 and zlib.crc32(r.token_ids) == r.ids_crc32
        per_doc[r.doc_id].append(r)
    for i, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in per_doc[i]), key=lambda r: r.piece)
        if i in (None, 2):
            continue
        assert [x for r in mine for x in np.frombuffer(r.token_ids, "<u4").tolist()] == want
        assert [r.start for r in mine] == list(range(0, len(want), 512))
    assert len(per_doc[2]) == 2 and len(per_doc[None]) == 2
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.03 * -(-total // 512) + 1


def test_empty_table(spark):
    assert pack(token_pieces(documents(spark, AWKWARD).limit(0), PATH)).count() == 0


def test_crossover_keeps_every_item_and_the_capacity():
    rng = np.random.default_rng(3)
    packer = Packer(rng.integers(1, 400, 500), 512, 1)
    best = packer.evolve([], 4, 6)
    for where in best:
        assert (where >= 0).all() and np.bincount(where, packer.lengths).max() <= 512
    assert packer.score(best[0]) >= packer.score(packer.first(0.0)) - 1e-12


def test_leftovers_of_all_shards_meet(spark):
    """2,005 items of 2,400 and 2,005 of 1,600 tokens go two by two; each shard alone holds uneven numbers of them."""
    pieces = spark.range(4010).selectExpr("id", "case when id % 2 = 0 then 2400 else 1600 end as length", "map('k', id) as `a.b`")
    got = pack(pieces, shard_items=256)
    assert got.columns == ["id", "length", "a.b", "sequence_id", "offset"]
    assert got.select("sequence_id").distinct().count() <= 2006 and got.count() == 4010
