"""The contract language: files of blocks to rows of contracts, and typed tables of the common kinds.

    kind identity {
      key value value ...
      key { nested block }
      from -> [to, to]
    }

Values are words, numbers, strings, ranges (``3..9``), references (``Kind:Name``)
and lists in brackets; ``//`` opens a comment. A statement ends with its line,
unless a list is open.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"""(?P<space>[ \t\r]+|//[^\n]*)|(?P<line>\n)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<range>\d+\.\.\d+)|(?P<arrow>->)|(?P<sign>[{}\[\],])|(?P<word>[^\s{}\[\],"]+)""")
CONTRACT = "path string, kind string, identity string, origin_source string, origin_section string, origin_start int, origin_end int, line_start int, line_end int, body string, error string"


class ContractError(ValueError):
    """A file that doesn't follow the language; the message has the line."""


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise ContractError(f"line {line}: unexpected {text[at]!r}")
        if m.lastgroup == "line":
            out.append(("line", "\n", line))
            line += 1
        elif m.lastgroup != "space":
            out.append((m.lastgroup, m.group(), line))
        at = m.end()
    return [*out, ("line", "\n", line), ("end", "", line)]


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self):
        return self.tokens[self.at]

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self):
        while self.peek()[0] == "line":
            self.at += 1

    def fail(self, wanted: str):
        kind, text, line = self.peek()
        raise ContractError(f"line {line}: expected {wanted}, found {'the end' if kind == 'end' else repr(text)}")

    def value(self):
        kind, text, _ = self.peek()
        if text == "[" and kind == "sign":
            self.next()
            items = []
            while True:
                self.skip()
                if self.peek()[1] == "]":
                    self.next()
                    return items
                items.append(self.value())
                self.skip()
                if self.peek()[1] == ",":
                    self.next()
                elif self.peek()[1] != "]":
                    self.fail("',' or ']'")
        if kind == "string":
            return json.loads(self.next()[1])
        if kind == "range":
            a, b = self.next()[1].split("..")
            return {"from": int(a), "to": int(b)}
        if kind in ("word", "arrow"):
            text = self.next()[1]
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text
        return self.fail("a value")

    def block(self) -> list[dict]:
        """Statements up to the closing brace, each with its values and, if it has one, its block."""
        out = []
        while True:
            self.skip()
            if self.peek()[1] == "}" and self.peek()[0] == "sign":
                self.next()
                return out
            if self.peek()[0] == "end":
                self.fail("'}'")
            line, values, inner = self.peek()[2], [], None
            while self.peek()[0] not in ("line", "end") and self.peek()[1] != "}":
                if self.peek()[1] == "{":
                    self.next()
                    inner = self.block()
                    break
                values.append(self.value())
            out.append({"line": line, "values": values} | ({"block": inner} if inner is not None else {}))

    def contracts(self):
        while True:
            self.skip()
            if self.peek()[0] == "end":
                return
            if self.peek()[0] != "word":
                self.fail("a kind")
            _, kind, line = self.next()
            identity = []
            while self.peek()[1] != "{":
                if self.peek()[0] not in ("word", "string"):
                    self.fail("an identity or '{'")
                identity.append(str(self.value()))
            self.next()
            body = self.block()
            yield kind, " ".join(identity), line, self.tokens[self.at - 1][2], body


def parse_contracts(text: str) -> list[tuple[str, str, int, int, list[dict]]]:
    """(kind, identity, first line, last line, statements) of each block."""
    return list(_Reader(text).contracts())


def read_contracts(files: DataFrame) -> DataFrame:
    """One row per contract of the files (path, text); a file that can't be read gives one row with its error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    for kind, identity, first, last, body in parse_contracts(text or ""):
                        origin = next((s["values"][1:] for s in body if s["values"][:1] == ["origin"]), [])
                        lines = next((v for v in origin if isinstance(v, dict)), {})
                        words = [v for v in origin if isinstance(v, str)]
                        rest = [s for s in body if s["values"][:1] != ["origin"]]
                        rows.append((path, kind, identity, *(words + [None, None])[:2], lines.get("from"), lines.get("to"), first, last, json.dumps(rest, ensure_ascii=False), None))
                except ContractError as e:
                    rows.append((path, None, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTRACT.split(", ")], dtype=object)

    return files.select("path", "text").mapInPandas(run, CONTRACT)


def _statements(contracts: DataFrame, kind: str) -> DataFrame:
    body = F.from_json("body", "array<struct<line:int,values:array<string>,block:array<struct<line:int,values:array<string>>>>>")
    return contracts.where(F.col("kind") == kind).select("identity", F.explode(body).alias("s")).select("identity", F.element_at("s.values", 1).alias("key"), F.col("s.values").alias("values"), F.col("s.block").alias("block"))


def _list(text) -> F.col:
    """A JSON list, or a single value, as an array."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))


def enums(contracts: DataFrame) -> DataFrame:
    """(name, values)"""
    return _statements(contracts, "enum").where("key = 'values'").select(F.col("identity").alias("name"), _list(F.element_at("values", 2)).alias("values"))


def transitions(contracts: DataFrame) -> DataFrame:
    """(entity, from, to) of the state machines."""
    steps = _statements(contracts, "state-machine").where("key = 'transitions'").select(F.col("identity").alias("entity"), F.explode("block").alias("b"))
    return steps.select("entity", F.element_at("b.values", 1).alias("from"), F.explode(_list(F.element_at("b.values", 3))).alias("to"))


def properties(contracts: DataFrame, kind: str) -> DataFrame:
    """(identity, key, value): the plain statements of a kind, first value only."""
    return _statements(contracts, kind).where(F.col("block").isNull()).select("identity", "key", F.try_element_at("values", F.lit(2)).alias("value"))


def references(contracts: DataFrame) -> DataFrame:
    """(identity, ref): what contracts refer to, as ``Kind:Name`` anywhere in their bodies."""
    return contracts.where("body is not null").select("identity", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r'"([A-Z]\w*:[A-Za-z_][\w.]*)"'), F.lit(1)))).alias("ref"))
