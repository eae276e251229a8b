import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings, strategies as st
from sondage.llm import token_files
from sondage.llm.token_files import BLOCK, COUNTS, FileReader, FileWriter, decode, encode, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 49_407), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1)), max_size=700))
def test_codec_round_trip(ids):
    values = np.array(ids, np.uint64)
    words, escapes = encode(values)
    assert decode(words, escapes, len(ids)).tolist() == ids
    assert len(escapes) == sum(i >= 1 << 60 for i in ids)


def test_words_take_as_many_ids_as_they_can():
    assert [len(encode(np.full(480, v, np.uint64))[0]) for v in (0, 1, 3, 49_407)] == [2, 8, 16, 160]
    words, _ = encode(np.arange(10_000).astype(np.uint64) % 50_000)
    assert COUNTS[(words >> np.uint64(60)).astype(int)].sum() >= 10_000


def test_a_file_of_many_blocks(tmp_path):
    from pyarrow import fs

    rng, disk, name = np.random.default_rng(2), fs.LocalFileSystem(), str(tmp_path / "x.ids")
    docs = [rng.integers(0, 1 << 63, n).astype("<u8") >> np.uint64(int(rng.integers(0, 63))) for n in (0, 3, BLOCK - 3, 1, 5 * BLOCK, 0, 17)]
    writer = FileWriter(disk.open_output_stream(name))
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k - 4, ids)
    writer.close()
    with disk.open_input_file(name) as source:
        file = FileReader(source)
        assert file.doc_ids.tolist() == [-4, -3, -2, 0, 0, 1, 2] and file.none.tolist() == [k == 3 for k in range(7)]
        for k in (6, 0, 4, 2, 1, 5, 3):
            assert np.concatenate([*file.ids(k), np.zeros(0, np.uint64)]).tolist() == docs[k].tolist()
        assert len(file.blocks) == -(-sum(map(len, docs)) // BLOCK)


def brute(rows):
    from tokenizers import Tokenizer

    model, out, at = Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        out.append((i, at, len(ids), raw, zlib.crc32(raw)))
        at += len(ids)
    return out


def test_written_and_read_back(spark, tmp_path):
    rows = [*AWKWARD, *((k * 7 % 1000, f"Word {k} and naïve 日本 <|endoftext|>") for k in range(1000)), *((4_000, "same id") for _ in range(600))]
    docs = documents(spark, rows).repartition(5)
    write_tokens(docs, f"file:{tmp_path}/t", PATH, parts=6)
    got = [tuple(r) for r in read_tokens(spark, f"file:{tmp_path}/t").collect()]
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(sorted(got, key=lambda r: r[1]), sorted(got, key=lambda r: r[1])[1:], strict=False))
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in brute(rows))
    files = json.load(open(tmp_path / "t/manifest.json"))["files"]
    assert len(files) >= 5 and max(f["docs"] for f in files) < 700  # the id that a third of the rows have is in several files
    only = read_tokens(spark, f"file:{tmp_path}/t", "ids_crc32 long, doc_id long")
    assert sorted((str(r.doc_id), r.ids_crc32) for r in only.collect()) == sorted((str(r[0]), r[4]) for r in brute(rows))


def test_the_query_against_brute_force(spark, sf):
    got = sorted(tuple(r) for r in token_files.query_op13(spark, sf).collect())
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got == [(i, at, n, crc) for i, at, n, _, crc in brute(rows)]


@pytest.mark.parametrize("texts,parts", [([], 3), ([(None, None)], 1), ([(None, "a"), (None, "b c")] * 30, 4)])
def test_few_rows_and_null_ids(spark, tmp_path, texts, parts):
    docs = documents(spark, texts) if texts else documents(spark, [(1, "x")]).where("false")
    write_tokens(docs, str(tmp_path / "t"), PATH, parts=parts)
    got = sorted(tuple(r) for r in read_tokens(spark, str(tmp_path / "t"), "start long, n_tokens long").collect())
    assert len(got) == len(texts) and [s for s, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]


def test_a_task_that_ran_twice_leaves_one_file_that_counts(spark, tmp_path):
    docs = documents(spark, [(k, f"text {k}") for k in range(20)])
    write_tokens(docs, str(tmp_path / "t"), PATH, parts=2)
    (tmp_path / "t/stray.ids").write_bytes(b"left by a lost task")
    assert read_tokens(spark, str(tmp_path / "t")).count() == 20
