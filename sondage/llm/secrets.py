"""Secret scans by a recursive decoding worklist.

A text is a layer. Every layer is scanned; every encoded stretch in it (URL
escapes, Unicode escapes, base64, compressed data inside base64) is decoded to
a further layer, which goes to the worklist, until nothing decodes to anything
new. A decoded layer keeps, for each of its characters, the stretch of the
original text that it came from, so whatever is found inside is reported at
its place in the original. An equal text is not scanned again, but what was
found in it is reported at every place where it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sondage.llm._common import batch_of, bites, col, map_rows, quoted, text_or_empty
from sondage.llm._inflate import inflated_kinds

#: The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What an assignment's key is made of, as a cheap test for the scan above.
KEYS = ("passw", "secret", "token", "apikey", "api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Line breaks, also as they are written in strings, within base64 that is wrapped.
BREAK = re.compile(r"[ \t]*(?:(?:\\+r)?\\+n|\\+r|\r?\n|\r)[ \t]*")
LINE = re.compile(r"[A-Za-z0-9+/]+")
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{16}}|[A-Za-z0-9+/_-]++{BREAK.pattern})[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)*+={{0,2}}")
#: What no secret is shorter than, so that no shorter stretch of readable bytes matters.
READABLE = re.compile(rb"[\t\n\r -~]{12,}")
PLAIN = frozenset(bytes((c,)) for c in (9, 10, 13, *range(32, 127)))
#: How compressed data starts: zstd, gzip, or a header of zlib's without a dictionary.
ZLIB = [bytes((c, f)) for c in range(8, 128, 16) for f in range(256) if not f & 32 and (c << 8 | f) % 31 == 0]
MAGIC = re.compile(b"|".join(re.escape(x) for x in (b"\x28\xb5\x2f\xfd", b"\x1f\x8b\x08", *ZLIB)), re.DOTALL)
#: Escapes of an escape's own first sign, so many that undoing them one at a time would take the square of their number.
NESTED = re.compile(r"%(?:25){9,}|\\(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}){9,}|&(?:#0{0,4}38;|#x0{0,4}26;){9,}")
#: How many of them are left.
LEFT = 8
LINKS = re.compile(r"25|u005[cC]|x5[cC]|u\{0*5[cC]\}|#0*38;|#x0*26;")


def found(text: str) -> list[tuple[int, str, int]]:
    """The secrets of one layer as (start, kind, end), leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _utf8(raw: bytes) -> str | None:
    """The text in ``raw`` if it is mostly readable text."""
    text = raw.decode("utf-8", "replace")
    odd = sum(c == "�" or (c < " " and c not in "\t\n\r") for c in text)
    return text if text and odd <= len(text) // 10 else None


def _escapes(text: str, starts, ends, pattern, decode):
    """The whole text with escapes undone in place, and each character's stretch of the original."""
    out, first, last, at = [], [], [], 0
    for m in pattern.finditer(text):
        got = decode(m)
        if got is None:
            continue
        out += [text[at : m.start()], got]
        first += [starts[at : m.start()], np.full(len(got), starts[m.start()])]
        last += [ends[at : m.start()], np.full(len(got), ends[m.end() - 1])]
        at = m.end()
    if not out:
        return None
    out.append(text[at:])
    return "".join(out), np.concatenate([*first, starts[at:]]), np.concatenate([*last, ends[at:]])


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


def _code_point(m: re.Match) -> str | None:
    digits = next(g for g in m.groups() if g)
    number = int(digits, 10 if m.group(5) else 16)
    return chr(number) if number < 0xD800 or 0xE000 <= number < 0x110000 else None


def _zipped(raw: bytes):
    """Compressed stretches that start anywhere in the bytes, as (start, end, kinds of the secrets within).

    All of a stretch has one place, so only the kinds found in it are kept; it is read as it is inflated.
    """
    view, at = memoryview(raw), 0
    for m in MAGIC.finditer(raw):
        if m.start() < at:
            continue
        kinds, used, any_ = inflated_kinds(view[m.start() :])
        if any_:
            yield m.start(), m.start() + used if used else len(raw), kinds
            at = m.start() + (used or 0)


def _bytes(run: str) -> bytes:
    """What base64 letters decode to, however many; a last letter that is one too many is left out."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _ends(run: str, after: str) -> bool:
    """Whether what is encoded in base64 ends with the run: all of it is readable, and what the next letters make isn't."""
    run, after = (x.replace("-", "+").replace("_", "/") for x in (run, after))
    return len(run) % 4 == 0 and all(LINE.fullmatch(x) for x in (run, after)) and bool(READABLE.fullmatch(_bytes(run))) and _bytes(after)[:1] not in PLAIN


def _pieces(text: str, cuts: list[int]):
    """A readable stretch, cut at those line ends that no secret and nothing encoded goes over, as (start, end, text)."""
    at, cuts = 0, [c for c in cuts if 0 < c < len(text)]
    if cuts:
        within = np.zeros(len(text) + 1, bool)
        for m in BASE64.finditer(text):
            within[m.start() + 1 : m.end()] = True
            a = m.start()
            for c in cuts[bisect_right(cuts, a) : bisect_left(cuts, m.end())]:
                if _ends(text[a:c], text[c : min(c + 4, m.end())]):
                    within[c], a = False, c
        for a, b in [(a, b) for a, _, b in found(text)] + [m.span() for pattern in (URL, UNICODE) for m in pattern.finditer(text)]:
            within[a + 1 : b] = True
        for c in cuts:
            if not within[c]:
                yield at, c, text[at:c]
                at = c
    yield at, len(text), text[at:]


def _base64(text: str):
    """Decoded stretches of a layer, as (start, end, text), or the kinds within in place of a text that was inflated.

    A run goes on over line breaks and may start or end with letters that
    aren't part of what is encoded, so it is read at all four alignments, and
    of what it decodes to each readable or compressed stretch counts. Lines
    that have nothing in common are stretches of their own, and a line that is
    readable but for a few bytes counts as a whole.
    """
    for m in BASE64.finditer(text):
        if m.end() - m.start() < 16:
            continue
        flat = BREAK.sub(lambda x: " " * len(x.group()), m.group().rstrip("=").replace("-", "+").replace("_", "/"))
        lines = [(x.start(), x.end()) for x in LINE.finditer(flat)]
        run, length, whole, parts = flat.replace(" ", ""), len(flat), [], []
        if len(run) < 16:
            continue
        breaks = list(accumulate(b - a for a, b in lines))[:-1]
        ends = lambda b: m.end() if b == length else m.start() + b
        for a, b in lines:
            if b - a >= 16 and not READABLE.fullmatch(raw := _bytes(flat[a:b])) and (got := _utf8(raw)):
                whole.append((m.start() + a, ends(b), got))
        for shift in range(4):
            raw = _bytes(run[shift:])
            parts += [(shift, a, b, len(raw), got) for a, b, got in _zipped(raw) if got]
            cuts = [(b - shift) // 4 * 3 for b in breaks if b > shift and (b - shift) % 4 == 0]
            for x in READABLE.finditer(raw):
                parts += [(shift, x.start() + a, x.start() + b, len(raw), got) for a, b, got in _pieces(x.group().decode("ascii"), [c - x.start() for c in cuts])]
        yield from whole
        if parts:
            place = np.concatenate([np.arange(a, b) for a, b in lines])
        for shift, a, b, n, got in parts:
            first, last = m.start() + int(place[shift + a * 4 // 3]), ends(length if b == n else int(place[shift + (b * 8 - 1) // 6]) + 1)
            if isinstance(got, frozenset) or not any(x <= first and last <= y and got in outer for x, y, outer in whole):
                yield first, last, got


def _digest(text: str, *places) -> bytes:
    state = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16)
    for x in places:
        state.update(b"\xff" + np.ascontiguousarray(x, np.int64).tobytes())
    return state.digest()


def _shortened(m: re.Match) -> str:
    """Escapes nested deeply, nested less deeply: the layers between say nothing else."""
    links = LINKS.findall(m.group())
    return m.group()[0] + "".join(links[-LEFT:])


def _unescaped(layer: str, starts, ends):
    """The layers that undoing one sort of escape in a layer makes."""
    if any(c in layer for c in ("%2525", "\\", "&#")) and (got := _escapes(layer, starts, ends, NESTED, _shortened)):
        yield got
        return
    if "%" in layer and (got := _escapes(layer, starts, ends, URL, _percent)):
        yield got
    if ("\\" in layer or "&#" in layer) and (got := _escapes(layer, starts, ends, UNICODE, _code_point)):
        yield got


def layers(text: str):
    """The text and all that undoing escapes makes of it, each once per mapping, as (text, first, last)."""
    own = np.arange(len(text)), np.arange(1, len(text) + 1)
    seen, work = {_digest(text, *own)}, [(text, *own)]
    while work:
        layer = work.pop()
        yield layer
        for new in _unescaped(*layer):
            if (digest := _digest(*new)) not in seen:
                seen.add(digest)
                work.append(new)


def kinds_within(text: str) -> set[str]:
    """The kinds of secrets in a decoded stretch and in all that it decodes to; all of it has one place."""
    kinds, seen, work = set(), {_digest(text)}, [text]
    while work:
        layer = work.pop()
        kinds |= {kind for _, kind, _ in found(layer)}
        nowhere = np.zeros(len(layer), np.int64)
        for new in [*(x[0] for x in _unescaped(layer, nowhere, nowhere)), *(x[2] for x in _base64(layer))]:
            if isinstance(new, frozenset):
                kinds |= new
            elif (digest := _digest(new)) not in seen:
                seen.add(digest)
                work.append(new)
    return kinds


def scan(text: str) -> tuple[list, list]:
    """(base spans, all spans) of a text, each (start, kind, end) in its own code points."""
    base, more, known = found(text), set(), {}
    for k, (layer, starts, ends) in enumerate(layers(text)):
        if k:
            more |= {(int(starts[a:b].min()), kind, int(ends[a:b].max())) for a, kind, b in found(layer)}
        for a, b, got in _base64(layer):
            kinds = got
            if isinstance(got, str):
                digest = _digest(got)
                if digest not in known:
                    known[digest] = kinds_within(got)
                kinds = known[digest]
            if kinds:
                first, last = int(starts[a:b].min()), int(ends[a:b].max())
                more |= {(first, kind, last) for kind in kinds}
    inner = more.difference(base)
    return base, sorted([*base, *inner], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by a mark of its kind; spans that touch are one."""
    out, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        out += [text[at : max(start, at)], f"[{kind} removed]" if start >= at else ""]
        at = end
    return "".join([*out, text[at:]])


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, spans of the text itself and of all layers.

    Null texts count as empty and have no spans; repeated or null ids are rows
    of their own; an empty table gives an empty result. Whole texts are read.
    Kinds are listed in the order of ``KINDS`` where spans start together.
    """
    schema = f"{quoted(id_col)} {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.string()), ("e", pa.string())])

    def run(batches):
        for batch in bites(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = scan(text)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            got = batch_of(arrow, list(zip(*rows, strict=True)) or [[]] * 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *got.columns], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by a mark; rows, order of columns and other values stay.

    A text without secrets, and a null text, stays as it is; where the text
    changes, ``chars_col`` is set to its new length in code points. An empty
    table gives an empty result; columns of any name and type stay.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in bites(batches):
            cols, texts = list(batch.columns), batch.column(at).to_pylist()
            new = [t if t is None or not (s := scan(t)[1]) else redact(t, s) for t in texts]
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                old = cols[length].to_pylist()
                cols[length] = pa.array([o if a is b else len(a) for o, a, b in zip(old, new, texts, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_rows(docs, run)


def query_op5(spark, sf_dir: str) -> DataFrame:
    """``find_secrets`` over every whole text of ``documents``."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
