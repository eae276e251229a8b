"""Best-fit packing of token pieces into fixed-length sequences.

Pieces are packed by a grouping genetic algorithm. Items are dealt into shards
of bounded size; each shard is evolved on several islands at once. A crossover
takes well-filled bins of one parent whole, removes the other parent's bins
that hold the same items, and best-fits what was displaced. After each round
every island sends its elite to the next island of its shard. The bins that are
filled least are opened and their items packed again, in fewer and fewer
shards, so that what is left over does not grow with the number of shards.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sondage.llm._common import batch_of, bites, col, columns, partitions, quoted, stored, text_or_empty, whole_rows

#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 700_000
#: White space to str.split() and not to the tokenizer; and signs of special tokens.
ASCII_SEPARATORS, SPECIAL = ("\x1c", "\x1d", "\x1e", "\x1f"), "<|"
#: Up to here all libraries agree on what is a letter, whatever their Unicode version.
LATIN = "\u024f"
#: What the tokenizer takes for white space, and its pre-tokens, as its file has them.
NOT_SPACE = r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = b"\xff"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, from remembered words.

    Its pre-tokens never span white space, so the ids of a text are those of
    its words in turn. Words are remembered as little-endian 32-bit ids. For a
    BPE whose ids follow the order of its merges, words are merged by rank: a
    pre-token's bytes and a byte that marks its end, which no UTF-8 text holds.
    Any other tokenizer, and any word beyond Latin letters or with signs of
    special tokens, goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}
        self.not_space, self.pre_token = regex.compile(NOT_SPACE), regex.compile(PRE_TOKEN)
        self.merge = _merges(path)

    def words(self, text: str) -> list[str]:
        if any(c in text for c in ASCII_SEPARATORS):
            return self.not_space.findall(text)
        return text.split()

    def encode(self, words: list[str]) -> list[list[int]]:
        if self.merge is None:
            return [e.ids for e in self.model.encode_batch(words, add_special_tokens=False)]
        out = []
        for w in words:
            if SPECIAL in w or (not w.isascii() and max(w) > LATIN):
                out.append(self.model.encode(w, add_special_tokens=False).ids)
                continue
            low = unicodedata.normalize("NFC", w).lower()
            parts = [low] if low.isalpha() else self.pre_token.findall(low)
            out.append(self.merge(parts[0].encode() + END) if len(parts) == 1 else [i for p in parts for i in self.merge(p.encode() + END)])
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split).difference(self.known)) if split else []
        for word, found in zip(new, self.encode(new), strict=True):
            self.known[word] = array("I", found).tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a worker, with the words that it remembers from one task to the next."""
    return WordTokenizer(path)


def _merges(path: str):
    """A function from a pre-token's bytes and ``END`` to ids; None where the file isn't of that kind."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
    split = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])]
    vocabulary, first = model["vocab"], 512
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or split[:1] != [PRE_TOKEN] or model.get("end_of_word_suffix") != "</w>" or any(vocabulary[p] != first + k for k, p in enumerate(pairs)):
        return None
    import tiktoken

    byte = _byte_signs()
    ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + END * t.endswith("</w>"): k for t, k in vocabulary.items() if k < first + len(pairs)}
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ``token_ids``.

    A document is its ids and ``end_id``; only longer ones than ``capacity``
    are cut. A null text is empty: one piece, the end id. Rows with a null or
    repeated id are documents of their own. Extra columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{quoted(id_col)} {kind}, piece int, start long, length long, ids_crc32 long" + ", token_ids binary" * with_ids
    arrow = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.binary())] * with_ids)
    step, end = 4 * capacity, np.array([end_id], "<u4").tobytes()

    def cut(batches):
        words = word_tokenizer(tokenizer)
        for batch in bites(batches):
            out, at = [[] for _ in arrow], []
            for k, ids in enumerate(words.ids(batch.column(1).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    at.append(k)
                    for x, v in zip(out, (piece, start // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        x.append(v)
            got = batch_of(arrow, out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *got.columns], names=[id_col, *arrow.names])

    return docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, schema)


class Packer:
    """The genetic algorithm over one shard. A solution is an array: the bin of each item."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, np.random.default_rng(seed)

    def fill(self, order: np.ndarray, bins: list[int], where: np.ndarray) -> None:
        """Best-fits the items of ``order`` into ``bins`` (room left), opening bins as needed."""
        mask, rooms = 0, {}
        for b, room in enumerate(bins):
            if room:
                mask |= 1 << room
                rooms.setdefault(room, []).append(b)
        lengths = self.lengths[order].tolist()
        for item, need in zip(order.tolist(), lengths, strict=True):
            fits = mask >> need
            if fits:
                room = need + (fits & -fits).bit_length() - 1
                same = rooms[room]
                b = same.pop()
                if not same:
                    mask &= ~(1 << room)
            else:
                room, b = self.capacity, len(bins)
                bins.append(room)
            where[item] = b
            room -= need
            bins[b] = room
            if room:
                mask |= 1 << room
                rooms.setdefault(room, []).append(b)

    def first(self, noise: float) -> np.ndarray:
        """Best fit by decreasing length, the lengths disturbed by ``noise``."""
        keys = self.lengths * (1 + noise * self.rng.standard_normal(len(self.lengths)))
        where = np.zeros(len(self.lengths), np.int32)
        self.fill(np.argsort(-keys, kind="stable"), [], where)
        return where

    def score(self, where: np.ndarray) -> float:
        """Mean squared fill of the bins: higher with fewer and fuller ones."""
        fills = np.bincount(where, self.lengths)
        return float(np.mean((fills / self.capacity) ** 2)) if len(fills) else 1.0

    def cross(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """Some of the giver's well-filled bins whole; the taker's untouched bins; the rest best-fitted."""
        fills = np.bincount(giver, self.lengths)
        well = np.flatnonzero(fills >= np.median(fills))
        chosen = np.zeros(len(fills), bool)
        chosen[self.rng.choice(well, max(1, len(well) // 3), replace=False)] = True
        injected = chosen[giver]
        hit = np.zeros(int(taker.max()) + 1, bool)
        hit[taker[injected]] = True
        stays = ~hit[taker] & ~injected
        # poorly filled bins of the taker are opened too, so that there is something to improve
        room = np.bincount(taker, self.lengths)
        weak = (room < self.capacity) & (self.rng.random(len(room)) < 0.05)
        stays &= ~weak[taker]
        where = np.full(len(giver), -1, np.int64)
        where[injected] = giver[injected]
        where[stays] = taker[stays] + len(fills)
        placed = where >= 0
        _, where[placed] = np.unique(where[placed], return_inverse=True)
        n = int(where.max()) + 1
        used = np.bincount(where[placed], self.lengths[placed], n)
        loose = np.flatnonzero(~placed)
        out = where.astype(np.int32)
        self.fill(loose[np.argsort(-self.lengths[loose], kind="stable")], [int(self.capacity - u) for u in used], out)
        return out

    def evolve(self, population: list[np.ndarray], size: int, generations: int) -> list[np.ndarray]:
        """The population, best first."""
        if not population:
            population = [self.first(0.0)] + [self.first(0.02 * k) for k in range(1, size)]
        ranked = sorted(((self.score(p), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))[:size]
        for g in range(generations):
            if len(ranked) < 2 or len(self.lengths) < 2:
                break
            a, b = self.rng.choice(len(ranked), 2, replace=False)
            child = self.cross(ranked[a][2], ranked[b][2])
            ranked = sorted([*ranked, (self.score(child), size + g, child)], key=lambda x: (-x[0], x[1]))[:size]
        return [p for _, _, p in ranked]


def _shard_rows(items: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the numbers and lengths of its items, by number, as bytes."""
    dealt = items.select(F.pmod(F.xxhash64("__uid"), F.lit(shards)).cast("int").alias("shard"), "__uid", F.col("length").cast("int").alias("length"))

    def gather(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for s in np.unique(shard := batch.column(0).to_numpy()):
                at = shard == s
                held.setdefault(int(s), []).append((batch.column(1).to_numpy()[at], batch.column(2).to_numpy()[at]))
        for s, parts in held.items():
            uid, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(uid)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([uid[by].astype("<i8").tobytes()], pa.binary()), pa.array([n[by].astype("<i4").tobytes()], pa.binary())], names=["shard", "uids", "lengths"])

    tasks = min(shards, 4 * partitions(items.sparkSession))
    return dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).mapInArrow(gather, "shard int, uids binary, lengths binary")


def _evolved(items: DataFrame, shards: int, capacity: int, islands: int, rounds: int, population: int, generations: int) -> DataFrame:
    """Items with ``shard``, ``bin``, ``offset`` and the bin's fill ``used``."""
    spark = items.sparkSession
    tasks = min(shards * islands, 4 * partitions(spark))
    sent = "shard int, island int, lengths binary, solution binary, fitness double"
    rows = _shard_rows(items, shards)
    state = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("solutions"))

    def live(number):
        def run(batches):
            for batch in batches:
                for shard, island, lengths, solutions in zip(*columns(batch), strict=True):
                    known = np.frombuffer(lengths, "<i4")
                    packer = Packer(known, capacity, seed=1_000_003 * number + 1009 * shard + island)
                    best = packer.evolve([np.frombuffer(zlib.decompress(x), "<i4").astype(np.int32) for x in solutions], population, generations)
                    kept = [(shard, island, lengths, zlib.compress(p.astype("<i4").tobytes(), 1), packer.score(p)) for p in best]
                    if number + 1 < rounds:  # the elite goes to the next island
                        kept.append((shard, (island + 1) % islands, None, *kept[0][3:]))
                    else:
                        kept = kept[:1]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*kept, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["shard", "island", "lengths", "solution", "fitness"])

        return run

    for number in range(rounds):
        out = state.repartitionById(tasks, F.pmod(F.col("shard") * islands + F.col("island"), F.lit(tasks)).cast("int")).mapInArrow(live(number), sent)
        if number + 1 < rounds:
            state = out.groupBy("shard", "island").agg(F.max("lengths").alias("lengths"), F.sort_array(F.collect_set("solution")).alias("solutions"))
    best = out.groupBy("shard").agg(F.max(F.struct("fitness", "island", "solution", "lengths")).alias("b")).select("shard", "b.solution", "b.lengths")

    def spread(batches):
        for batch in batches:
            for shard, uids, lengths, solution in zip(*columns(batch), strict=True):
                uid, n = np.frombuffer(uids, "<i8"), np.frombuffer(lengths, "<i4").astype(np.int64)
                where = np.frombuffer(zlib.decompress(solution), "<i4")
                by = np.lexsort((uid, where))
                ends = np.cumsum(n[by])
                first = np.flatnonzero(np.r_[True, np.diff(where[by]) > 0])
                begin = np.repeat(ends[first] - n[by][first], np.diff(np.r_[first, len(by)]))
                used = np.bincount(where, n)[where[by]]
                yield pa.RecordBatch.from_arrays([pa.array(uid[by]), pa.array(np.full(len(by), shard, np.int32)), pa.array(where[by].astype(np.int32)), pa.array((ends - n[by] - begin).astype(np.int64)), pa.array(used.astype(np.int64)), pa.array(n[by].astype(np.int64))], names=["__uid", "shard", "bin", "offset", "used", "length"])

    return rows.select("shard", "uids").join(best, "shard").select("shard", "uids", "lengths", "solution").mapInArrow(spread, "__uid long, shard int, bin int, offset long, used long, length long")


def _opened(found: DataFrame, capacity: int, well_filled: float, most: int) -> tuple[Column, int, bool] | None:
    """Which bins to open: (a condition on ``found``, their items, whether fewer bins could hold these items).

    Those of the least fill, below ``well_filled``, that hold at most ``most``
    items; of the bins with the fill at which that is reached, a part by hash.
    """
    fills = found.where(F.col("used") < well_filled * capacity).groupBy("used").agg(F.count("*").alias("n"), F.count_distinct("shard", "bin").alias("bins"), F.sum("length").alias("tokens"))
    items = bins = tokens = 0
    for r in sorted(fills.collect()):  # a row per fill, of which there are fewer than ``capacity``
        part = min(1.0, (most - items) / r.n)
        items, bins, tokens, last = items + part * r.n, bins + part * r.bins, tokens + part * r.tokens, r.used
        if part < 1:
            share = F.pmod(F.xxhash64("shard", "bin", F.lit(3)), F.lit(1 << 20)) < int(part * (1 << 20))
            return (F.col("used") < last) | ((F.col("used") == last) & share), int(items), True
    if not items:
        return None
    return F.col("used") < well_filled * capacity, int(items), bins > -(-tokens // capacity)


def pack(pieces: DataFrame, capacity: int = 4096, shard_items: int = 16_384, islands: int = 3, rounds: int = 2, population: int = 3, generations: int = 4, well_filled: float = 0.995) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own. A level packs its items in shards
    of about ``shard_items``; then the bins of least fill, up to half of the
    level's items, are opened and packed again in half as many shards, and so
    on until one shard holds them all, or no bin is filled below
    ``well_filled``, or the opened bins are as few as their tokens allow. So
    what is left over in a shard meets what is left over in all others. Every
    piece is packed once and ``offset`` has no gaps; ties go by number. Repeated
    rows and null ids are pieces of their own. An empty table gives an empty
    result. Other columns stay, whatever their names and types.
    """
    numbered = stored(whole_rows(pieces, F.col("length"), F.monotonically_increasing_id().alias("__uid")))
    full = numbered.where(F.col("length") == capacity).select("__uid", (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, done, level = numbered.where(F.col("length") < capacity).select("__uid", "length"), [full], 0
    n = items.count()
    while n:
        shards = -(-n // shard_items)
        found = stored(_evolved(items, shards, capacity, islands, rounds, population, generations))
        number = F.lit(level << 56) + F.shiftleft(F.col("shard").cast("long"), 24) + F.col("bin")
        opened = _opened(found, capacity, well_filled, n // 2) if shards > 1 else None
        again = opened[0] if opened and opened[2] else F.lit(False)
        done.append(found.where(~again).select("__uid", number.alias("sequence_id"), "offset"))
        items, n, level = found.where(again).select("__uid", "length"), opened[1] if opened and opened[2] else 0, level + 1
    placed = done[0]
    for other in done[1:]:
        placed = placed.unionByName(other)
    return numbered.join(placed, "__uid").select("r.*", "sequence_id", "offset")


def query_op1(spark, sf_dir: str) -> DataFrame:
    """All pieces of all ``documents``, packed."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
