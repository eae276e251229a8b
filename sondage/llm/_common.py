"""What the corpus operators share: stored intermediates, batches and small codecs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that a Python worker turns into objects at once; Spark itself bounds the bytes of an Arrow batch.
BITE_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediates that the driver and all executors see.

    The session names it in ``spark.checkpoint.dir``; only where none is named
    (tests) a folder of this process is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isEmpty():
        return now.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster, name a folder that all executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="sondage-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder; the lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bites(batches: Iterable[pa.RecordBatch], rows: int = BITE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; the session's setting stays as it is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def quoted(name: str) -> str:
    """A column's name as ``F.col`` and schemas take it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``r`` beside the columns ``more``: no name can clash with ours."""
    return df.select(F.struct(*map(col, df.columns)).alias("r") if df.columns else F.lit(None).alias("r"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, run, **more: str) -> DataFrame:
    """``df`` through a function of Arrow batches that keeps its columns, whatever their names, and adds ``more``, by name and type."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    schema = plain.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in more.items()]).schema
    return plain.mapInArrow(run, schema).toDF(*df.columns, *more)


def tasks_for(df: DataFrame, task_bytes: int = 64 << 20) -> int:
    """Tasks for an exchange of ``df``: the session's number, or more by the input's bytes as its plan knows them."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(df.sparkSession), known // task_bytes if known < 1 << 60 else 0)


def text_or_empty(name: str = "text"):
    return F.coalesce(col(name), F.lit(""))


def columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def batch_of(schema: pa.Schema, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def pack_bytes(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack_bytes(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw, max_output_size=0) if raw else b""


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes, compressed; small numbers get short."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pack_bytes(planes.tobytes())


def unpack_ints(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack_bytes(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_ranks(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, mostly small: one byte each, and further bytes only for those that need them."""
    streams, rest = [], values.astype("<u4")
    small = np.minimum(rest, 255).astype(np.uint8)
    rest = rest[rest >= 255]
    streams.append(small)
    middle = np.minimum(rest >> 8, 255).astype(np.uint8)
    streams += [middle, (rest & 255).astype(np.uint8)]
    streams.append((rest[rest >> 8 >= 255] >> 8).astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel())
    packed = [pack_bytes(np.ascontiguousarray(x).tobytes()) for x in streams]
    return b"".join(len(x).to_bytes(4, "little") for x in packed) + b"".join(packed)


def unpack_ranks(raw: bytes) -> np.ndarray:
    sizes, at, streams = [int.from_bytes(raw[4 * k : 4 * k + 4], "little") for k in range(4)], 16, []
    for n in sizes:
        streams.append(np.frombuffer(unpack_bytes(raw[at : at + n]), np.uint8))
        at += n
    out, high = streams[0].astype("<u4"), streams[1].astype("<u4")
    high[high == 255] = np.ascontiguousarray(streams[3].reshape(4, -1).T).view("<u4").ravel()
    out[out == 255] = (high << 8) | streams[2]
    return out


def pack_strings(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    head = pack_ints(lens)
    return len(head).to_bytes(4, "little") + head + pack_bytes(b"".join(words))


def unpack_strings(raw: bytes) -> Iterator[bytes]:
    n = int.from_bytes(raw[:4], "little")
    lens, body, at = unpack_ints(raw[4 : 4 + n]), unpack_bytes(raw[4 + n :]), 0
    for k in lens.tolist():
        yield body[at : at + k]
        at += k
