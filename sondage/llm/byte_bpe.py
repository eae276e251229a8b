"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A word is a stretch that begins at a space and holds one or more whole matches
of the pre-token pattern. Texts are exploded into words with their positions in
blocks: a block keeps each distinct word once and its documents as arrays of
word numbers, the array index being the position. One exchange deals the
distinct words of all blocks by hash, so that one task meets all copies of a
word and encodes it once, and brings each block's documents to the task that
will reassemble them. Ids are joined back to their block by block and number,
and documents are reassembled by position. Decoding looks every id up in the
table of token bytes.

A block is numbered from rows in a fixed order, so that a task that is run
again after a loss deals the same numbers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sondage.llm._common import bites, col, map_rows, pack_bytes, pack_ints, pack_ranks, pack_strings, tasks_for, text_or_empty, unpack_bytes, unpack_ints, unpack_ranks, unpack_strings

#: A block is closed when it holds so many distinct words or so many words in all.
BLOCK_DISTINCT, BLOCK_WORDS = 800_000, 8_000_000
#: Documents travel together in parcels of about so many words, which compress better than single ones.
PARCEL_WORDS = 100_000
#: Groups that words are dealt into at most, and words that a task remembers before it starts anew.
MOST_GROUPS, REMEMBERED = 2048, 1_000_000
#: White space before a space that is not followed by a word: there, splitting at spaces would cut a match.
UNSAFE = re.compile(r"\s (?!\S)")
OTHER_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")  # re and the pattern's library may differ on these

#: Unicode's white space, for which libraries' \\s may differ.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

WIRE = "dest int, home int, block string, rank int, number long, ids binary, data binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def compiled(pattern: str):
    """The pre-token pattern with white space spelled out."""
    import regex

    out, within, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACES if within and two == r"\s" else f"[{'^' * (two == chr(92) + 'S')}{SPACES}]")
            at += 2
            continue
        if two[0] == "\\":
            out.append(two)
            at += 2
            continue
        within = two[0] == "[" or (within and two[0] != "]")
        out.append(two[0])
        at += 1
    return regex.compile("".join(out))


def words_of(text: str, pattern) -> list[str]:
    """The text in words; joined they are the text, and no match of the pattern spans two."""
    if not text:
        return []
    if UNSAFE.search(text) or any(c in text for c in OTHER_SPACE):
        return pattern.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


def _keys(keys: list, lengths: list[int], kind) -> bytes:
    """Document keys and their numbers of words, as they travel."""
    sink = pa.BufferOutputStream()
    rows = pa.record_batch([pa.array(keys, kind), pa.array(lengths, pa.int64())], names=["key", "n"])
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return pack_bytes(sink.getvalue().to_pybytes())


def _blocks(pattern_text: str, tasks: int, groups: int, kind):
    """Arrow batches of (row number, text) to wire rows: a block's words by hash group, and its documents."""

    def run(batches):
        from pyspark import TaskContext

        pattern, part, count = compiled(pattern_text), TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        docs: list[tuple[object, np.ndarray]] = []
        total = 0

        def close():
            nonlocal known, docs, total, count
            if not docs:
                return
            block, home, words = f"{part}-{count}", (part + count) % tasks, [w.encode() for w in known]
            flat = np.concatenate([d for _, d in docs])
            by = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # frequent words get small numbers
            renumbered = np.empty(len(words), np.uint32)
            renumbered[by] = np.arange(len(words), dtype=np.uint32)
            group = np.fromiter((zlib.crc32(w) % groups for w in words), np.int64, len(words))[by]
            order = np.argsort(group, kind="stable")
            rows, cuts = [], np.flatnonzero(np.diff(group[order], prepend=-1))
            for numbers in np.split(order, cuts[1:]) if len(words) else ():
                rows.append((int(group[numbers[0]]), home, block, 0, int(group[numbers[0]]), pack_ints(np.diff(numbers, prepend=0)), pack_strings([words[by[i]] for i in numbers])))
            at, ends = 0, np.cumsum([len(seq) for _, seq in docs])
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PARCEL_WORDS)))
                keys = _keys([key for key, _ in docs[at:to]], [len(seq) for _, seq in docs[at:to]], kind)
                rows.append((home, home, block, 1, at, keys, pack_ranks(renumbered[np.concatenate([seq for _, seq in docs[at:to]])])))
                at = to
                if len(rows) >= 64:
                    yield _wire(rows)
                    rows = []
            if rows:
                yield _wire(rows)
            known, docs, total, count = {}, [], 0, count + 1

        for batch in bites(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text, pattern)
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                seq = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                docs.append((key, seq))
                total += len(seq)
                if total >= BLOCK_WORDS or len(known) >= BLOCK_DISTINCT:
                    yield from close()
        yield from close()

    return run


def _wire(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["dest", "home", "block", "rank", "number", "ids", "data"])


def _encoder(path: str, pattern_text: str):
    """Word rows get ids in place of words, each distinct word encoded once in its task, and go to their block's home."""

    def run(batches):
        import tiktoken

        model = tiktoken.Encoding("ranks", pat_str=pattern_text, mergeable_ranks=read_ranks(path), special_tokens={})
        known: dict[bytes, bytes] = {}
        for batch in bites(batches, 64):
            rows = []
            for _, home, block, rank, number, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rank:
                    continue
                parts = []
                if len(known) > REMEMBERED:  # bounds the task's memory; a word may then be encoded again
                    known.clear()
                for word in unpack_strings(data):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(model.encode_ordinary(word.decode()), "<u4").tobytes()
                    parts.append(got)
                lens = pack_ints(np.fromiter((len(p) // 4 for p in parts), np.uint32, len(parts)))
                rows.append((home, home, block, rank, number, ids, len(lens).to_bytes(4, "little") + lens + pack_ints(np.frombuffer(b"".join(parts), "<u4"))))
            if rows:
                yield _wire(rows)

    return run


def _assembled(words: pa.Table, docs: pa.Table):
    """(keys, their ids) of a block's documents, parcel by parcel."""
    pieces = []
    for ids, data in zip(words.column("ids").to_pylist(), words.column("data").to_pylist(), strict=True):
        n = int.from_bytes(data[:4], "little")
        pieces.append((np.cumsum(unpack_ints(ids), dtype=np.int64), unpack_ints(data[4 : 4 + n]).astype(np.int64), unpack_ints(data[4 + n :])))
    numbers, lens = (np.concatenate([p[k] for p in pieces] or [np.zeros(0, np.int64)]) for k in (0, 1))
    flat = np.concatenate([p[2] for p in pieces] or [np.zeros(0, np.uint32)])
    size = int(numbers.max()) + 1 if len(numbers) else 0
    start, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    start[numbers], length[numbers] = np.cumsum(lens) - lens, lens
    for ids, data in zip(docs.column("ids"), docs.column("data"), strict=True):
        every, at, out = unpack_ranks(data.as_py()), 0, []
        rows = pa.ipc.open_stream(unpack_bytes(ids.as_py())).read_next_batch()
        for k in rows.column(1).to_pylist():
            seq, at = every[at : at + k], at + k
            n = length[seq]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(start[seq] - (ends - n), n) + np.arange(int(ends[-1]) if k else 0)])
        yield rows.column(0), out


def _reassembled(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, make, schema) -> DataFrame:
    """``make(words, documents)`` of every block, a table by ``schema``."""
    rows = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    tasks = tasks_for(rows)
    groups = min(tasks, MOST_GROUPS)
    wire = rows.sortWithinPartitions("id", "text").mapInArrow(_blocks(pattern, tasks, groups, to_arrow_type(rows.schema[0].dataType)), WIRE)
    dealt = wire.repartitionById(tasks, F.col("dest"))
    words = dealt.mapInArrow(_encoder(path, pattern), WIRE).repartitionById(tasks, F.col("dest"))
    # both sides read the first exchange: nothing of this filter, nor any choice of columns, may be pushed below it
    there = dealt.where("rank = 1 OR monotonically_increasing_id() < 0")
    return words.groupBy("dest", "block").cogroup(there.groupBy("dest", "block")).applyInArrow(make, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``token_ids``, an array of int.

    Null texts count as empty and have no ids; repeated and null ids are
    documents of their own; an empty table gives an empty result; whole texts
    are read; extra columns are not.
    """
    schema = docs.select(col(id_col), F.lit(None).cast("array<int>").alias("token_ids")).schema
    kind = to_arrow_type(schema[0].dataType)
    arrow = pa.schema([pa.field(id_col, kind), pa.field("token_ids", pa.list_(pa.int32()))])

    def make(words, there):
        got = [pa.record_batch([keys, pa.array([ids.astype(np.int32) for ids in every], pa.list_(pa.int32()))], schema=arrow) for keys, every in _assembled(words, there)]
        return pa.Table.from_batches(got, arrow)

    return _reassembled(docs, path, pattern, id_col, text_col, make, schema)


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; the table's size is the vocabulary's, whatever the corpus."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for raw, rank in ranks.items():
        table[rank] = raw
    return table


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids in turn; null ids give null.

    Rows and other columns, of any name, stay; an empty table gives an empty result.
    """
    at = encoded.columns.index(ids_col)

    def run(batches):
        table = token_bytes(path)
        for batch in bites(batches):
            got = [None if ids is None else b"".join(map(table.__getitem__, ids)) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, "decoded"])

    return map_rows(encoded, run, decoded="binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of ``encode`` and then ``decode``, taken where documents are reassembled; rows as ``encode`` has them."""
    schema = docs.select(col(id_col), *(F.lit(None).cast(kind).alias(name) for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")))).schema
    arrow = pa.schema([pa.field(id_col, to_arrow_type(schema[0].dataType)), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())])
    held: dict = {}  # in a worker: the table of token bytes, read once

    def make(words, there):
        if not held:
            held["bytes"] = token_bytes(path)
            held["shown"] = [str(i) for i in range(len(held["bytes"]))]
        got = []
        for keys, every in _assembled(words, there):
            rows = []
            for ids in map(np.ndarray.tolist, every):
                text = b"".join(map(held["bytes"].__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(" ".join(map(held["shown"].__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            got.append(pa.record_batch([keys, *(pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True))], schema=arrow))
        return pa.Table.from_batches(got, arrow)

    return _reassembled(docs, path, pattern, id_col, text_col, make, schema)


def query_op4(spark, sf_dir: str) -> DataFrame:
    """``digests`` of every whole text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
