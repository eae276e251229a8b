"""Token ids in files of word-aligned codes, as a data source that Spark writes and reads.

A 64-bit word holds a selector in its upper four bits and as many ids as have
room in the other sixty: 240 zeros, 60 of one bit, 30 of two, up to one of
sixty. A larger id is an escape: its word names the place in the block's list
of whole numbers. Ids go into blocks of 65,536, each of which is decoded on its
own, selector by selector, in arrays.

A file is blocks one after another, then a table of the blocks (where each
begins, its words, escapes and first id), a table of documents (id, first id),
and their sizes. A task writes one file under a name of its own; the manifest,
put in place last by renaming, lists the files of finished tasks in order of
their documents. So a task that is run again leaves nothing that is read, and
readers see all of a write or nothing.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sondage.llm._common import bites, col, shared_folder, tasks_for, text_or_empty
from sondage.llm.packing import word_tokenizer

#: Ids per word and bits per id, by selector; selector 0 is an escape.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids in a block.
BLOCK = 1 << 16
MAGIC = b"ids-s8b1"
#: The widths of all numbers of 16 bits.
_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _WIDTHS[ids.astype(np.int64)]
    high = ids >> np.uint64(32)
    whole = lambda x: np.frexp(x.astype(np.float64))[1]
    return np.where(high > 0, 32 + whole(high), whole(ids & np.uint64(0xFFFFFFFF))).astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit ids: at each place the selector that takes the most ids."""
    n, ids = len(ids), ids.astype(np.uint64)
    # the widest of as many ids as a selector takes, from each place on; past the end there is room for any
    widest = {1: np.concatenate([widths(ids), np.zeros(int(COUNTS.max()), np.int8)])}
    selector = np.zeros(n, np.int8)
    for s in range(15, 0, -1):  # ever more ids of ever fewer bits
        count, known = int(COUNTS[s]), max(widest)
        while known < count:
            step = min(known, count - known)
            last = widest[known]
            widest[known + step] = np.maximum(last[:-step], last[step:])
            known += step
        np.copyto(selector, s, where=widest[count][:n] <= BITS[s])
    take, at, starts = COUNTS[selector].astype(np.uint8).tobytes(), 0, []
    while at < n:
        starts.append(at)
        at += take[at]
    starts = np.array(starts, np.int64)
    padded = np.concatenate([ids, np.zeros(int(COUNTS.max()), np.uint64)])
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s and BITS[s]:
            first, packed = starts[rows], padded[starts[rows]]
            for lane in range(1, int(COUNTS[s])):
                packed |= padded[first + lane] << np.uint64(lane * int(BITS[s]))
            words[rows] |= packed
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, ids[starts[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == 0:
            out[starts[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            lanes = np.arange(COUNTS[s])
            out[starts[rows][:, None] + lanes] = words[rows][:, None] >> (lanes * BITS[s]).astype(np.uint64) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]


def _place(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path, and the path there."""
    return files.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    """A finished file: enough to find the place of its ids, whatever its size."""

    name: str
    part: int
    ids: int
    docs: int


def narrowed(ids: bytes) -> bytes:
    """Ids of four bytes in two where all are small enough, after a sign of their width."""
    values = np.frombuffer(ids, "<u4")
    return b"\x02" + values.astype("<u2").tobytes() if len(values) and int(values.max()) < 1 << 16 else b"\x04" + ids


def widened(raw) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


class FileWriter:
    """Writes one file: blocks as they fill, the tables at the end."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.held, self.waiting, self.count = [], 0, 0
        self.blocks, self.docs = [], []

    def add(self, doc_id: int | None, values: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.count + self.waiting))
        self.held.append(values)
        self.waiting += len(values)
        if self.waiting >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        at = 0
        while len(values) - at >= BLOCK or (last and at < len(values)):
            words, escapes = encode(values[at : at + BLOCK])
            self.blocks.append((self.at, len(words), len(escapes), self.count))
            raw = words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
            self.out.write(raw)
            self.at += len(raw)
            n = min(BLOCK, len(values) - at)
            at, self.count = at + n, self.count + n
        self.held, self.waiting = [values[at:].copy()], len(values) - at

    def close(self) -> None:
        self.flush(True)
        blocks = np.array(self.blocks, "<i8").reshape(-1, 4)
        ids, none, first = (np.array([d[k] for d in self.docs], kind) for k, kind in enumerate(("<i8", "u1", "<i8")))
        self.out.write(blocks.tobytes() + ids.tobytes() + none.tobytes() + first.tobytes())
        self.out.write(struct.pack("<4q", self.at, len(blocks), len(ids), self.count) + MAGIC)
        self.out.close()


class FileReader:
    """One file: its tables, and the ids of any of its documents."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = source.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError("not a file of token ids")
        at, blocks, docs, self.count = struct.unpack("<4q", tail[:32])
        raw = source.read_at(32 * blocks + 17 * docs, at)
        self.blocks = np.frombuffer(raw, "<i8", 4 * blocks).reshape(-1, 4)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 32 * blocks)
        self.none = np.frombuffer(raw, "u1", docs, 32 * blocks + 8 * docs).astype(bool)
        self.first = np.r_[np.frombuffer(raw, "<i8", docs, 32 * blocks + 9 * docs), self.count]
        self.held = -1, None

    def block(self, number: int) -> np.ndarray:
        if self.held[0] != number:
            at, words, escapes, first = self.blocks[number].tolist()
            raw = np.frombuffer(self.source.read_at(8 * (words + escapes), at), "<u8")
            self.held = number, decode(raw[:words], raw[words:], min(BLOCK, self.count - first))
        return self.held[1]

    def ids(self, doc: int):
        """The ids of a document, a block's part at a time."""
        at, end = int(self.first[doc]), int(self.first[doc + 1])
        while at < end:
            number = at // BLOCK
            part = self.block(number)[at - number * BLOCK : end - number * BLOCK]
            yield part
            at += len(part)


class TokenFiles(DataSource):
    """``spark.read.format("token_files")``: doc_id, start, n_tokens, ids; a schema may name some of these, and ids_crc32.

    ``ids`` are little-endian unsigned numbers of ``width`` (4 or 8) bytes, as
    they were written; ``start`` counts the ids of all documents before.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite):
        return TokenFilesWriter(self.options["path"], int(self.options.get("width", "4")))

    def reader(self, schema):
        return TokenFilesReader(self.options["path"], [f.name for f in schema.fields], int(self.options.get("task_ids", str(1 << 24))))


class TokenFilesWriter(DataSourceArrowWriter):
    """Takes (part, doc_id, ids after a sign of their width), sorted in each task; parts are in the order of documents. A write replaces what was there."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator):
        disk, base = _place(self.path)
        disk.create_dir(base, recursive=True)
        name, part, writer = f"{uuid.uuid4().hex}.ids", TaskContext.get().partitionId(), None
        for batch in iterator:
            for batch in bites([batch]):
                if writer is None and batch.num_rows:
                    part = batch.column(0)[0].as_py()
                    writer = FileWriter(disk.open_output_stream(f"{base}/{name}"))
                for doc_id, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    writer.add(doc_id, widened(ids))
        if writer is None:
            return Written("", part, 0, 0)
        writer.close()
        return Written(name, part, writer.count, len(writer.docs))

    def commit(self, messages):
        disk, base = _place(self.path)
        disk.create_dir(base, recursive=True)
        done = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.part)
        manifest = {"width": self.width, "files": [{"name": m.name, "ids": m.ids, "docs": m.docs} for m in done]}
        new = f"{base}/{uuid.uuid4().hex}.tmp"
        with disk.open_output_stream(new) as out:
            out.write(json.dumps(manifest).encode())
        disk.move(new, f"{base}/manifest.json")

    def abort(self, messages):
        disk, base = _place(self.path)
        for m in messages:
            if m is not None and m.name:
                disk.delete_file(f"{base}/{m.name}")


@dataclass
class Stretch(InputPartition):
    """Documents ``begin`` to ``end`` of a file whose ids have ``before`` ids before them."""

    name: str
    before: int
    begin: int
    end: int
    width: int


class TokenFilesReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], task_ids: int):
        self.path, self.names, self.task_ids = path, names, task_ids

    def partitions(self):
        disk, base = _place(self.path)
        with disk.open_input_stream(f"{base}/manifest.json") as f:
            manifest = json.loads(f.read())
        out, before = [], 0
        for file in manifest["files"]:
            pieces = max(1, min(file["docs"], -(-file["ids"] // self.task_ids)))
            cuts = [file["docs"] * k // pieces for k in range(pieces + 1)]
            out += [Stretch(file["name"], before, a, b, manifest["width"]) for a, b in zip(cuts, cuts[1:], strict=False)]
            before += file["ids"]
        return out or [Stretch("", 0, 0, 0, manifest["width"])]

    def read(self, partition):
        if not partition.name:
            return
        disk, base = _place(self.path)
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "ids_crc32": pa.int64()}
        with disk.open_input_file(f"{base}/{partition.name}") as source:
            file, kind = FileReader(source), f"<u{partition.width}"
            begin, size, out = partition.begin, 0, []
            for doc in range(partition.begin, partition.end):
                if "ids" in self.names or "ids_crc32" in self.names:
                    parts, crc = [], 0
                    for part in file.ids(doc):
                        raw = part.astype(kind).tobytes()
                        crc = zlib.crc32(raw, crc)
                        if "ids" in self.names:
                            parts.append(raw)
                            size += len(raw)
                    out.append((b"".join(parts), crc))
                size += 40
                if size > 8 << 20 or doc + 1 == partition.end:
                    here = slice(begin, doc + 1)
                    values = {
                        "doc_id": lambda: pa.array(file.doc_ids[here], pa.int64(), mask=file.none[here]), "start": lambda: pa.array(file.first[here] + partition.before),
                        "n_tokens": lambda: pa.array(np.diff(file.first[begin : doc + 2])), "ids": lambda: pa.array([x for x, _ in out], pa.binary()), "ids_crc32": lambda: pa.array([c for _, c in out], pa.int64()),
                    }
                    yield pa.RecordBatch.from_arrays([values[n]() for n in self.names], schema=pa.schema([(n, kinds[n]) for n in self.names]))
                    begin, size, out = doc + 1, 0, []


def _ranges(docs: DataFrame, id_col: str, parts: int) -> tuple[int, list[int]]:
    """(parts for rows without id, ids at which the others are cut into ``parts``); an id that many rows have is there more than once."""
    steps = [k / parts for k in range(1, parts)] or [0.5]
    known = col(id_col).cast("long")
    r = docs.select(F.count("*").alias("n"), F.count(known).alias("known"), F.percentile_approx(known, steps, max(10_000, 20 * parts)).alias("cuts")).first()
    return -(-parts * (r.n - r.known) // max(1, r.n)), (r.cuts or []) if parts > 1 else []


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, parts: int | None = None) -> DataFrame:
    """(part, doc_id, ids): whole texts' ids and ``end_id``, narrowed, in ascending order of id over the parts and in each.

    Only the ids of words are exchanged. Rows of equal id follow each other in
    the order in which the table is read; where an id has more rows than a part
    takes, these are dealt to several parts in that order. Rows without an id
    come first, in as many parts as their share of all rows asks for.
    """
    parts = parts or tasks_for(docs)
    none, cuts = _ranges(docs, id_col, parts)
    cuts = np.array(cuts, np.int64)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    tasks = rows._jdf.toJavaRDD().getNumPartitions()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, place, at = word_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        deal = lambda low, high: low + (high - low + 1) * min(place, tasks - 1) // tasks
        for batch in bites(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else None
            if ids is not None:
                low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
                # an id equal to several cuts spans the parts between them; one equal to a single cut belongs below it
                part = none + np.where(high - low > 1, deal(low, high), low)
            else:
                part = []
                for i in batch.column(0).to_pylist():
                    low, high = (0, 0) if i is None else (int(np.searchsorted(cuts, i, "left")), int(np.searchsorted(cuts, i, "right")))
                    part.append(deal(0, max(0, none - 1)) if i is None else none + (deal(low, high) if high - low > 1 else low))
            texts = [narrowed(x + end) for x in words.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(range(at, at + batch.num_rows), pa.int64()), pa.array([place] * batch.num_rows, pa.int32()), batch.column(0), pa.array(texts, pa.binary())], names=["part", "row", "task", "doc_id", "ids"])
            at += batch.num_rows

    found = rows.mapInArrow(run, "part int, row long, task int, doc_id long, ids binary")
    return found.repartitionById(none + parts, F.col("part")).sortWithinPartitions("part", "doc_id", "task", "row").select("part", "doc_id", "ids")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, parts: int | None = None) -> None:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending order of document.

    A null text is empty: its end id alone. Ids are longs; a null id comes
    before all others, repeated ones follow each other in the table's order.
    Very long texts go over as many blocks as they need. An empty table makes
    a manifest without files; extra columns are not read.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    encoded(docs, tokenizer, id_col, text_col, end_id, parts).write.format("token_files").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, columns: str = "doc_id long, start long, n_tokens long, ids binary") -> DataFrame:
    """The rows of ``columns`` for every document, read from the files at ``path``; no files make no rows."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").schema(columns).load(path)


def query_op13(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token files and read back; nulls and the rest as in ``write_tokens``."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long")
