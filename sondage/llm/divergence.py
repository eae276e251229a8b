"""Audit of how far the sources of a language diverge in the words that they use.

Counts of terms are summed per task before they are exchanged. The terms that
a language keeps are dealt into chunks of its vocabulary and numbered there,
and a group's counts are packed, chunk by chunk. A task takes one tile: two
blocks of groups of a language. It is sent the vectors of both blocks, goes
over the chunks in turn, and adds up the submatrix of its pairs. What a task
holds is one chunk of two blocks, however large vocabulary and corpus are; a
long vocabulary is cut into stripes whose submatrices are added.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.llm._common import bites, col, pack_bytes, partitions, stored, unpack_bytes

#: Smoothed shares are whole numbers of this part.
UNIT = 1_000_000_000
#: Bytes of UTF-8 text that are not in a term become spaces, and A to Z lower case: letters beyond ASCII stay as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Terms that a task counts before it sends the counts on; bytes of a text that are split at once.
HELD, SPLIT = 400_000, 1 << 22


def _parts(text: bytes):
    """The text's terms in lists of bounded length."""
    text = text.translate(_TABLE)
    at = 0
    while len(text) - at > SPLIT:
        end = text.find(b" ", at + SPLIT)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _partial(batches):
    """(lang, source, term, n, d): occurrences and documents of terms as far as a task has counted; an empty term stands for the group."""
    names = ["lang", "source", "term", "n", "d"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def emit():
        for (lang, source), (n, d) in held.items():
            terms = list(d)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                values = ([lang] * len(some), [source] * len(some), some, [n[t] for t in some], [d[t] for t in some])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
        held.clear()

    for batch in bites(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            own = set()
            for terms in _parts(text):
                n.update(terms)
                own.update(terms)
            d.update(own)
            d[b""] += 1
        if sum(len(d) for _, d in held.values()) > HELD:
            yield from emit()
    yield from emit()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term; nulls count as ''.

    The row of a group whose term is empty has its number of documents in ``d``.
    """
    empty = lambda name: F.coalesce(col(name).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_partial, "lang string, source string, term binary, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _kept(counts: DataFrame, min_docs: int, chunk_terms: int) -> DataFrame:
    """(lang, term, total, chunk, at, v, lang_n, chunks): kept terms, dealt into chunks by hash and numbered in each."""
    kept = stored(counts.where(F.octet_length("term") > 0).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    # a language may hold most terms: it is joined and numbered in many tasks
    salts = partitions(counts.sparkSession)
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = (
        kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
        .withColumn("chunks", F.ceil(F.col("v") / chunk_terms).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("term", F.lit(1)), F.col("chunks")).cast("int"))
    )
    return dealt.repartition("lang", "chunk").withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)


def smoothed(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 v)), exactly, however large the counts."""
    up, down = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * v).cast("decimal(20,0)")
    return 1 + F.call_function("div", up, down)


def smoothed_counts(n: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The same of arrays, whose ``down`` is below 2**63 / 1000: three digits of the quotient at a time."""
    if n.size and int(n.max()) + 2 < (1 << 63) // UNIT:
        return 1 + UNIT * (n + 2) // down
    rest = n + 2
    out = rest // down
    for _ in range(3):
        rest = rest % down * 1000
        out = out * 1000 + rest // down
    return 1 + out


def _packed(rows: DataFrame) -> DataFrame:
    """Vectors packed: their numbers and counts, compressed."""

    def run(batches):
        for batch in bites(batches):
            out = []
            for v in batch.column(3):
                flat = v.values
                out.append(pack_bytes(flat.field("at").to_numpy().astype("<i4").tobytes() + flat.field("n").to_numpy().astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["lang", "g", "chunk", "vector"])

    return rows.mapInArrow(run, "lang string, g int, chunk int, vector binary")


class Tile:
    """The submatrix of two blocks of groups."""

    def __init__(self, lang: str, blocks: tuple[int, int], size: int):
        self.lang, self.blocks, self.size = lang, blocks, size
        self.groups: dict[int, tuple[str, int]] = {}  # source, smoothing's denominator
        self.sums, self.chunk, self.counts = None, 0, {}

    def close_chunk(self) -> None:
        """Adds the chunk that has been read to the sums."""
        if self.sums is None:
            self.sides = [sorted(g for g in self.groups if g // self.size == b) for b in self.blocks]
            self.sums = np.zeros(tuple(map(len, self.sides)), np.int64)
        if self.chunk:
            a, b = (self.shares(side) for side in self.sides)
            for k in range(len(a)):
                self.sums[k] += ((a[k] - b) ** 2 // (a[k] + b)).sum(1)
        self.chunk, self.counts = 0, {}

    def shares(self, side: list[int]) -> np.ndarray:
        n = np.zeros((len(side), self.chunk), np.int64)
        for k, g in enumerate(side):
            if g in self.counts:
                at, own = self.counts[g]
                n[k, at] = own
        return smoothed_counts(n, np.array([[self.groups[g][1]] for g in side], np.int64).reshape(-1, 1))

    def rows(self):
        self.close_chunk()
        for i, a in enumerate(self.sides[0]):
            for j, b in enumerate(self.sides[1]):
                if a < b:
                    yield self.lang, self.groups[a][0], self.groups[b][0], int(self.sums[i, j])


def _tiles(groups: DataFrame, chunks: DataFrame, vectors: DataFrame, size: int, stripe_chunks: int) -> DataFrame:
    """(lang, a, b, value): each pair of sources once, with the sum over all kept terms.

    A tile's rows come in this order: its groups (chunk -1), then for every
    chunk its length and the vectors of the groups that have terms there.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.floor(F.col("g") / size).cast("int")
    here = lambda df, *more: df.select("*", block.alias("block")).select("*", other.alias("o")).select("lang", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), *more)
    nothing = F.lit(None)
    stripe = F.floor(F.col("chunk") / stripe_chunks).cast("int").alias("stripe")
    stripes = F.greatest(F.lit(1), F.ceil(F.col("chunks") / stripe_chunks).cast("int"))
    of_groups = here(groups.withColumn("stripe", F.explode(F.sequence(F.lit(0), stripes - 1))), "stripe", F.lit(-1).alias("chunk"), F.lit(0).alias("kind"), "g", "source", F.greatest(F.lit(1).cast("long"), F.col("n") + 2 * F.col("v")).alias("number"), nothing.cast("binary").alias("vector"))
    of_chunks = (
        chunks.select("*", other.alias("a")).select("*", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)).alias("b"))
        .select("lang", "a", "b", stripe, "chunk", F.lit(1).alias("kind"), nothing.cast("int").alias("g"), nothing.cast("string").alias("source"), F.col("terms").alias("number"), nothing.cast("binary").alias("vector"))
    )
    of_vectors = here(vectors, stripe, "chunk", F.lit(2).alias("kind"), "g", nothing.cast("string").alias("source"), nothing.cast("long").alias("number"), "vector")
    key = ["lang", "a", "b", "stripe"]
    sent = of_groups.unionByName(of_chunks).unionByName(of_vectors).repartition(*key).sortWithinPartitions(*key, "chunk", "kind", "g")

    def run(batches):
        tile, last = None, None
        schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
        done = lambda: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(list(zip(*tile.rows(), strict=True)) or [[]] * 4, schema, strict=True)], schema=schema)
        for batch in bites(batches):
            for lang, a, b, stripe, _, kind, g, source, number, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, a, b, stripe) != last:
                    if tile:
                        yield done()
                    tile, last = Tile(lang, (a, b), size), (lang, a, b, stripe)
                if kind == 0:
                    tile.groups[g] = source, number
                elif kind == 1:
                    tile.close_chunk()
                    tile.chunk = number
                else:
                    raw = unpack_bytes(vector)
                    k = len(raw) // 12
                    tile.counts[g] = np.frombuffer(raw, "<i4", k), np.frombuffer(raw, "<i8", k, 4 * k)
        if tile:
            yield done()

    return sent.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, block_groups: int = 8, chunk_terms: int = 16_384, stripe_chunks: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources differ from each other, and in which terms from their language.

    Part ``pair``: every other source of the language with the divergence of
    the two, summed over all terms that the language keeps (those in at least
    ``min_docs`` of its documents); part ``term``: the ``top`` terms that the
    source uses more than its language does. Ranks go by value, then item in
    UTF-8 order. All arithmetic is exact. Null texts, languages and sources
    count as empty strings; repeated rows count each; very long texts are
    counted in pieces; a group without terms, and a language that keeps none
    (all its pairs have value 0), stay; an empty table gives an empty result;
    extra columns are not read.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col))
    kept = stored(_kept(counts, min_docs, chunk_terms))
    held = stored(counts.where(F.octet_length("term") > 0).select("lang", "source", "term", "n").join(kept.select("lang", "term", "total", "chunk", "at"), ["lang", "term"]))
    per_lang = kept.groupBy("lang").agg(F.first("v").alias("v"), F.first("lang_n").alias("lang_n"), F.first("chunks").alias("chunks"))
    of_lang = Window.partitionBy("lang")  # a row per source: the result has the square of it
    groups = stored(
        counts.where(F.octet_length("term") == 0).select("lang", "source").join(held.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(per_lang, "lang", "left")
        .fillna(0, ["n", "v", "lang_n", "chunks"]).withColumn("g", F.row_number().over(of_lang.orderBy("source")) - 1)
        .withColumn("blocks", F.ceil(F.count("*").over(of_lang) / block_groups).cast("int"))
    )
    placed = held.join(groups.select("lang", "source", "g", "blocks"), ["lang", "source"])
    vectors = _packed(placed.groupBy("lang", "g", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("vector")).select("lang", "g", "chunk", "vector"))
    blocks = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    chunks = kept.groupBy("lang", "chunk").agg(F.count("*").alias("terms")).join(blocks, "lang")
    pairs = _tiles(groups, chunks, vectors.join(blocks, "lang"), block_groups, stripe_chunks)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pair = pairs.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    p, q = smoothed(F.col("n"), F.col("own"), F.col("v")), smoothed(F.col("total"), F.col("lang_n"), F.col("v"))
    shares = held.join(groups.select("lang", "source", F.col("n").alias("own"), "v", "lang_n"), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    term = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def query_op11(spark, sf_dir: str) -> DataFrame:
    """``divergence`` over all ``documents``; nulls and the rest as there."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total) AS n FROM kept GROUP BY 1),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
dense AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gn.n, 0) + 2 * v.v) AS p, 1 + {UNIT}::HUGEINT * (k.total + 2) // (v.n + 2 * v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 10
"""
