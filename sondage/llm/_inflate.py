"""Kinds of secrets in inflated data of any length, read once, in bounded memory.

All of a compressed stretch has one place in its text, so what matters is which
kinds of secrets it holds. Data flow through a tree of small readers: inflated
bytes become text; a text undoes its escapes into a text below it, hands base64
to decoders, and readable or compressed stretches of these open readers below.
Each keeps what is unfinished where a piece ends (half an escape, a key whose
value is still to come, a run of base64 however long), so nothing is cut.
"""

from __future__ import annotations

import base64
import codecs
import re
import zlib

import zstandard

#: Text that is looked at together; a run of base64 longer than half of it is decoded as it comes.
TOGETHER = 1 << 20
#: Compressed bytes that are fed, and inflated bytes that are taken, at once.
FED, TAKEN = 1 << 14, 1 << 18
#: Spaces of which more say nothing: any number of them may stand around a key's sign.
SPACES = re.compile(r" {17,}")
#: Text before a piece in which a match may begin: the longest key, signs, and spaces that are left.
CONTEXT = 128
#: What may become an escape when more follows.
HALF = re.compile(r"(?:%[0-9A-Fa-f]?|\\(?:u(?:\{[0-9A-Fa-f]{0,6}|[0-9A-Fa-f]{0,3})|x[0-9A-Fa-f]?)?|&(?:#(?:x[0-9A-Fa-f]{0,6}|[0-9]{0,7}))?)\Z")
#: A run of base64 that reaches the end of what is known, or may.
OPEN_END = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_\-=\s\\nr]{0,64}\Z")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
#: All that is left may be a line break within a run, or the beginning of one.
HALF_BREAK = re.compile(r"[ \t]*(?:\\*r?\\*n?|\r?\n?)[ \t]*\Z")
READABLE = re.compile(rb"[\t\n\r -~]+")
#: What no secret is shorter than.
SHORTEST = 12
#: A compressed stretch whose beginning is that of so many around it holds itself: a cycle.
CYCLE, BEGINNING = 16, 4096
#: The number of kinds of secrets.
ALL = 3


class Text:
    """A text that comes in pieces; what it holds is added to ``found``."""

    def __init__(self, found: set, around: tuple = ()):
        self.found, self.around = found, around
        self.held, self.before, self.half, self.below, self.run = "", "", "", None, None

    def feed(self, text: str) -> None:
        self.held += text
        while len(self.held) >= TOGETHER:
            held, self.held = self.held[:TOGETHER], self.held[TOGETHER:]
            self.held = self._piece(held, False) + self.held

    def close(self) -> None:
        left = self._piece(self.held, True)
        assert not left
        self.held = ""
        if self.run:
            self.run.close()
        if self.below:
            self.below.feed(self.half)
            self.below.close()

    def _piece(self, text: str, last: bool) -> str:
        """Reads a piece; returns what has to be read again together with what follows."""
        from sondage.llm import secrets

        text = SPACES.sub(" " * 16, text)
        if self.run:
            at = self._run_on(text)
            self._read(text[:at], secrets, False)
            text = text[at:]
            if self.run and not last:
                return text
        if last or not (m := OPEN_END.search(text, max(0, len(text) - 4096))):
            self._read(text, secrets, True)
            return ""
        begin = min([m.start(), *(r.start() for r in secrets.BASE64.finditer(text) if r.end() > m.start())])
        self._read(text[:begin], secrets, True)
        if len(text) - begin <= TOGETHER // 2:
            return text[begin:]
        self.run = Run(self.found, self.around)
        at = begin + self._run_on(text[begin:])
        self._read(text[begin:at], secrets, False)
        return text[at:]

    def _run_on(self, text: str) -> int:
        """Feeds the open run and says where it ends, or how far it is known; a break is part of it as long as letters follow."""
        from sondage.llm.secrets import BREAK

        at = 0
        while m := LETTERS.match(text, at):
            self.run.feed(m.group())
            at = m.end()
            if (m := BREAK.match(text, at)) and LETTERS.match(text, m.end()):
                at = m.end()
        if not HALF_BREAK.match(text, at):
            if at or not ((m := BREAK.match(text)) and LETTERS.match(text, m.end())):
                self.run.close()
                self.run = None
            else:
                return m.end() + self._run_on(text[m.end() :])
        return at

    def _read(self, text: str, secrets, decode: bool) -> None:
        """What a piece holds as it is, in escapes and, unless that is being decoded, in base64."""
        self.found |= {kind for _, kind, _ in secrets.found(self.before + text)}
        earlier = self.before[: len(self.before) - len(self.half)]
        escaped = secrets.NESTED.sub(secrets._shortened, self.half + text)
        cut = m.start() if (m := HALF.search(escaped, max(0, len(escaped) - 16))) else len(escaped)
        escaped, self.half = escaped[:cut], escaped[cut:]
        plain = secrets.URL.sub(secrets._percent, escaped) if "%" in escaped else escaped
        if "\\" in plain or "&#" in plain:
            plain = secrets.UNICODE.sub(lambda m: m.group() if (c := secrets._code_point(m)) is None else c, plain)
        if self.below is None and plain != escaped:
            self.below = Text(self.found, self.around)
            plain = earlier + plain
        if self.below:
            self.below.feed(plain)
        if decode:
            for _, _, got in secrets._base64(text):
                self.found |= got if isinstance(got, frozenset) else secrets.kinds_within(got)
        self.before = (self.before + text)[-CONTEXT:]


class Run:
    """A run of base64, decoded at all four alignments as it comes."""

    def __init__(self, found: set, around: tuple):
        self.left, self.skip, self.out = [""] * 4, [0, 1, 2, 3], [Bytes(found, around) for _ in range(4)]

    def feed(self, letters: str) -> None:
        letters = letters.replace("-", "+").replace("_", "/")
        for shift in range(4):
            drop = min(self.skip[shift], len(letters))
            self.skip[shift] -= drop
            now = self.left[shift] + letters[drop:]
            whole = len(now) & ~3
            self.out[shift].feed(base64.b64decode(now[:whole]))
            self.left[shift] = now[whole:]

    def close(self) -> None:
        for left, out in zip(self.left, self.out, strict=True):
            left = left[: len(left) - (len(left) % 4 == 1)]
            out.feed(base64.b64decode(left + "=" * (-len(left) % 4)))
            out.close()


class Bytes:
    """Bytes in which readable stretches and compressed data may begin anywhere."""

    def __init__(self, found: set, around: tuple, readable: bool = True):
        self.found, self.around, self.readable = found, around, readable
        self.held, self.tail, self.text, self.inner = b"", b"", None, []

    def feed(self, raw: bytes) -> None:
        from sondage.llm.secrets import MAGIC

        if not raw:
            return
        for one in self.inner:
            one.feed(raw)
        known = self.tail + raw
        for m in MAGIC.finditer(known):
            if m.end() > len(self.tail):
                one = Inflater(self.found, known[m.start() : m.start() + 4], self.around)
                one.feed(known[m.start() :])
                self.inner.append(one)
        self.inner = [one for one in self.inner if one.alive]
        self.tail = known[-3:]
        if self.readable:
            self._read(self.held + raw)

    def _read(self, data: bytes) -> None:
        """Hands on readable stretches; the last one stays open, or is held while it is short."""
        self.held = b""
        if self.text:
            m = READABLE.match(data)
            self.text.feed(m.group().decode("ascii") if m else "")
            if m and m.end() == len(data):
                return
            self.text.close()
            self.text, data = None, data[m.end() if m else 0 :]
        for m in READABLE.finditer(data):
            open_ = m.end() == len(data)
            if m.end() - m.start() >= SHORTEST:
                text = Text(self.found, self.around)
                text.feed(m.group().decode("ascii"))
                if open_:
                    self.text = text
                else:
                    text.close()
            elif open_:
                self.held = m.group()

    def close(self) -> None:
        for one in self.inner:
            one.close()
        if self.text:
            self.text.close()
        self.inner, self.text = [], None


class Inflater:
    """Compressed data from their first byte on; ``used`` is how many bytes there are of them once they have ended."""

    def __init__(self, found: set, magic: bytes, around: tuple = ()):
        self.zstd = magic.startswith(b"\x28\xb5\x2f\xfd")
        self.engine = zstandard.ZstdDecompressor().decompressobj() if self.zstd else zlib.decompressobj(47)
        self.found, self.around, self.began = found, around, b""
        self.alive, self.any, self.used, self.fed = True, False, None, 0
        self.letters, self.text, self.bytes = codecs.getincrementaldecoder("utf-8")("replace"), None, None

    def feed(self, raw) -> None:
        raw = memoryview(raw)
        if len(self.began) < BEGINNING:
            self.began += bytes(raw[: BEGINNING - len(self.began)])
        step = FED >> 4 if self.zstd else FED
        for at in range(0, len(raw), step):
            if not self.alive:
                return
            part = raw[at : at + step]
            self.fed += len(part)
            try:
                for got in self._inflated(part):
                    self._out(got)
            except (zlib.error, zstandard.ZstdError):
                self.close()
                return
            if self.engine.eof:
                self.used = self.fed - len(self.engine.unused_data)
                self.close()

    def _inflated(self, part):
        if self.zstd:
            yield self.engine.decompress(part)
            return
        while part and not self.engine.eof:
            yield self.engine.decompress(part, TAKEN)
            part = self.engine.unconsumed_tail

    def _out(self, got: bytes) -> None:
        if not got:
            return
        if not self.any:
            beginning = self.began
            self.any, around = True, (*self.around, beginning)
            self.text = Text(self.found, around)
            if sum(beginning.startswith(b) or b.startswith(beginning) for b in self.around) < CYCLE:
                self.bytes = Bytes(self.found, around, readable=False)
        if len(self.found) < ALL:  # else only where the data end matters
            self.text.feed(self.letters.decode(got))
            if self.bytes:
                self.bytes.feed(got)

    def close(self) -> None:
        if self.alive and self.any:
            self.text.feed(self.letters.decode(b"", True))
            self.text.close()
            if self.bytes:
                self.bytes.close()
        self.alive = False


def inflated_kinds(raw, found: set | None = None) -> tuple[frozenset, int | None, bool]:
    """(kinds, bytes used if the data end, whether anything was inflated) of compressed data that start with ``raw``."""
    found = set() if found is None else found
    one = Inflater(found, bytes(raw[:4]))
    for at in range(0, len(raw), FED):
        one.feed(raw[at : at + FED])
        if not one.alive:
            break
    one.close()
    return frozenset(found), one.used, one.any
