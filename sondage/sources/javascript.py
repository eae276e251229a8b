"""Facts of JavaScript and TypeScript files: imports, exports, functions, classes, calls, requests, routes and mounts.

A file is read by its signs, not by a full grammar: comments, strings, templates
and regular expressions are found first and blanked, brackets are paired, and
what remains is searched for declarations. A file that ends inside a string or
with unpaired brackets still gives what could be read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FACTS = "path string, kind string, name string, detail string, line_start int, line_end int, exported boolean, is_async boolean, params int, owner string"
#: Words before a bracket that call nothing, and words after which a slash begins a pattern.
NOT_CALLS = frozenset("if for while switch catch function return typeof await new void delete in of do else throw case with yield import super constructor async".split())
BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new do else yield await instanceof".split())
CLIENTS, VERBS = ("axios", "http", "https", "got", "ky", "request", "superagent", "client", "api"), ("get", "post", "put", "patch", "delete", "head", "options")
ROUTERS = re.compile(r"^(app|server|fastify|api|[\w$]*[rR]outer|[\w$]*[rR]outes)$")
#: What may stand in for a path's ending, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")

NAME = r"[A-Za-z_$][\w$]*"
IMPORT = re.compile(rf"\bimport\s+(?:type\s+)?([\w$*{{}},\s]+?)\s*\bfrom\s*['\"]|\bimport\s*\(?\s*(?=['\"])['\"]|(?:\b(?:const|let|var)\s+({NAME}|\{{[^{{}}]*\}})\s*=\s*)?\brequire\s*\(\s*['\"]")
EXPORT = re.compile(rf"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+({NAME})|\bexport\s+(?:type\s+)?\{{([^{{}}]*)\}}(?:\s*from\s*(['\"]))?|\bexport\s*\*(?:\s*as\s+({NAME}))?\s*from\s*(['\"])|\bexport\s+(default)\b")
FUNCTION = re.compile(rf"(\basync\s+)?\bfunction\s*\*?\s*({NAME})\s*(?:<[^()]*>)?\s*\(")
ARROW = re.compile(rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=;]+)?=\s*(async\b\s*)?(?:(?:<[^()]*>)?\(|({NAME})\s*=>|function\b\s*\*?\s*(?:{NAME})?\s*\()")
CLASS = re.compile(rf"\bclass\s+({NAME})(?:\s+extends\s+([\w$.]+))?[^{{;]*\{{")
METHOD = re.compile(rf"(?<![\w$.])((?:(?:public|private|protected|static|override|abstract|readonly|async|get|set)\s+)*)\*?\s*(#?{NAME})\s*(?:<[^()]*>)?\(")
CALL = re.compile(rf"(?<![\w$.#])((?:this\s*\??\.\s*)?#?{NAME}(?:\s*\??\.\s*#?{NAME})*)\s*(?:<[\w\s,.\[\]|]*>)?\s*(?:\?\.\s*)?\(")


class Source:
    """One file: its text, the same with strings and comments blanked, and the pairs of its brackets."""

    def __init__(self, text: str):
        self.text, self.strings = text, {}
        self.plain = self._blanked()
        self.pair, open_ = {}, []
        for m in re.finditer(r"[()\[\]{}]", self.plain):
            if m.group() in "([{":
                open_.append(m.start())
            elif open_ and self.plain[open_[-1]] + m.group() in ("()", "[]", "{}"):
                self.pair[open_.pop()] = m.start()
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1

    def _blanked(self) -> str:
        text, out, at, last, n = self.text, [], 0, "", len(self.text)
        holes: list[int] = []  # templates that are open, by the braces open inside their holes
        while at < n:
            c, two, end = text[at], text[at : at + 2], at + 1
            if two == "//" or two == "/*":
                end = text.find("\n" if two == "//" else "*/", at + 2)
                end = n if end < 0 else end + (2 if two == "/*" else 0)
                out.append(re.sub(r"[^\n]", " ", text[at:end]))
            elif c in "'\"":
                while end < n and text[end] != c and text[end] != "\n":
                    end += 2 if text[end] == "\\" else 1
                self.strings[at] = re.sub(r"\\(.)", r"\1", text[at + 1 : end])
                end = min(end + (text[end : end + 1] == c), n)
                out.append(c + re.sub(r"[^\n]", " ", text[at + 1 : end]))
                last = "x"
            elif c == "`" or (c == "}" and holes and holes[-1] == 0):
                if c == "}":
                    holes.pop()
                else:
                    self.strings[at] = self._template(at)
                while end < n and text[end] != "`" and text[end : end + 2] != "${":
                    end += 2 if text[end] == "\\" else 1
                hole = text[end : end + 2] == "${"
                if hole:
                    holes.append(0)
                end = min(end + (2 if hole else 1), n)
                inside = re.sub(r"[^\n]", " ", text[at + 1 : end])
                out.append(("'" if c == "`" else " ") + inside)
                last = "(" if hole else "x"
            elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%<>~^" or last in BEFORE_PATTERN):
                within = False
                while end < n and text[end] != "\n" and (text[end] != "/" or within):
                    within = text[end] == "[" or (within and text[end] != "]")
                    end += 2 if text[end] == "\\" else 1
                if text[end : end + 1] == "/":
                    out.append(re.sub(r"[^\n]", " ", text[at : end + 1]))
                    end, last = end + 1, "x"
                else:  # no end on its line: a division
                    out.append(c)
                    end, last = at + 1, c
            elif c.isalnum() or c in "_$":
                while end < n and (text[end].isalnum() or text[end] in "_$"):
                    end += 1
                last = text[at:end]
                out.append(last)
            else:
                if holes and c in "{}":
                    holes[-1] += 1 if c == "{" else -1
                last = last if c.isspace() else c
                out.append(c)
            at = end
        return "".join(out)

    def _template(self, at: int) -> str:
        """A template's text, its holes as parameters."""
        found = re.match(r"`((?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}]*\})*)", self.text[at:])
        return re.sub(r"\$\{\s*([^{}]*?)\s*\}", lambda m: ":" + (re.findall(r"[\w$]+", m[1].partition("(")[0]) or ["x"])[-1], found[1]) if found else ""

    def string_at(self, at: int) -> str | None:
        """The string that begins at or after a place, with nothing but white space between."""
        while at < len(self.plain) and self.plain[at].isspace() and at not in self.strings:
            at += 1
        return self.strings.get(at)

    def params(self, opening: int) -> int:
        inside, deep, n = self.plain[opening + 1 : self.pair.get(opening, opening)], 0, 0
        for c in inside:
            deep += (c in "([{<") - (c in ")]}>")
            n += c == "," and deep == 0
        return n + 1 - inside.rstrip().endswith(",") if inside.strip() else 0

    def body(self, opening: int, arrow: bool = False) -> tuple[int, bool] | None:
        """Where what stands after a parameter list ends, and whether it is a body in braces; None if there is none."""
        if (after := self.pair.get(opening)) is None:
            return None
        m = re.compile(r"\s*(?::(?:[^{}=;()]|\{[^{}]*\}(?=\s*(?:=>|\{)))*?)?\s*(?:(=>)\s*(\{)?|(\{))").match(self.plain, after + 1)
        if m and (m[2] or (m[3] and not arrow)):
            return self.pair.get(m.end() - 1, len(self.plain) - 1), True
        if m and m[1]:
            end = re.compile(r"[;\n]").search(self.plain, m.end())
            return (end.start() if end else len(self.plain)) - 1, False
        return None


def _bound(clause: str) -> list[tuple[str, str]]:
    """(name there, name here) of an import or export clause."""
    out = []
    named = re.search(r"\{([^{}]*)\}", clause)
    for part in (named[1] if named else "").split(","):
        words = re.sub(r"\btype\s+(?=\w)", "", part).replace(":", " as ").split()
        if words:
            out.append((words[0], words[-1]))
    for part in re.sub(r"\{[^{}]*\}", "", clause).split(","):
        words = part.split()
        if words:
            out.append(("*" if words[0] == "*" else "default", words[-1]))
    return out


def facts_of(path: str, text: str) -> list[tuple]:
    """The facts of one file, in order of kind and place."""
    s, out = Source(text), []
    p = s.plain

    def put(kind, name, detail, at, end=None, exported=None, is_async=None, params=None, owner=None):
        out.append((path, kind, name, detail, s.line(at), s.line(at if end is None else end), exported, is_async, params, owner))

    exported = set()
    for m in EXPORT.finditer(p):
        if m[1]:
            exported.add(m[1])
            put("export", m[1], None, m.start())
        elif m[2] is not None:
            source = s.string_at(m.end() - 1) if m[3] else None
            for there, here in _bound("{" + m[2] + "}"):
                exported.add(there)
                put("export", here, source, m.start())
        elif m[5]:
            put("export", m[4] or "*", s.string_at(m.end() - 1), m.start())
        else:
            put("export", "default", None, m.start())
    for m in IMPORT.finditer(p):
        source = s.string_at(m.end() - 1)
        bound = _bound(m[1] or (m[2] or "").replace(":", " as ")) if m[1] or m[2] else [("*", "")]
        for there, _ in bound if source else ():
            put("import", there, source, m.start())
    declared = set()
    for m in FUNCTION.finditer(p):
        declared.add(m.end() - 1)
        if end := s.body(m.end() - 1):
            put("function", m[2], None, m.start(), end[0], m[2] in exported, bool(m[1]), s.params(m.end() - 1))
    for m in ARROW.finditer(p):
        opening = m.end() - 1
        if m[3]:
            brace = re.compile(r"\s*\{").match(p, m.end())
            stop = re.compile(r"[;\n]|$").search(p, m.end())
            put("function", m[1], None, m.start(), s.pair.get(brace.end() - 1, len(p) - 1) if brace else stop.start() - 1, m[1] in exported, bool(m[2]), 1)
        elif end := s.body(opening, arrow="function" not in m.group()):
            put("function", m[1], None, m.start(), end[0], m[1] in exported, bool(m[2]), s.params(opening))
    for m in CLASS.finditer(p):
        close = s.pair.get(m.end() - 1, len(p))
        put("class", m[1], m[2], m.start(), close, m[1] in exported)
        at = m.end()
        while at < close and (x := METHOD.search(p, at, close)):
            skip = re.compile(r"[({\[]").search(p, at, x.end() - 1)
            if skip:  # what stands in brackets before it is a part of something else
                at = s.pair.get(skip.start(), skip.start()) + 1
                continue
            end = s.body(x.end() - 1)
            if end and end[1] and x[2] not in NOT_CALLS - {"constructor", "delete", "of", "do"}:
                declared.add(x.end() - 1)
                put("method", x[2], None, x.start(2), end[0], m[1] in exported, "async" in x[1].split(), s.params(x.end() - 1), m[1])
                at = end[0] + 1
            else:
                at = s.pair.get(x.end() - 1, x.end()) + 1
    for m in CALL.finditer(p):
        callee, opening = re.sub(r"[\s?]", "", m[1]), m.end() - 1
        first, last = callee.split(".")[0], callee.split(".")[-1]
        if opening in declared or callee in NOT_CALLS:
            continue
        put("call", callee, None, m.start())
        told, verb = s.string_at(opening + 1), last.lower()
        inside = (opening, s.pair.get(opening, opening))
        if callee == "fetch" and told is not None:
            method = re.compile(r"\bmethod\s*:\s*(?=['\"])").search(p, *inside)
            put("request", (s.string_at(method.end()) if method else "GET").upper(), told, m.start())
        elif verb in VERBS and told and "." in callee and ROUTERS.match(callee.split(".")[-2]) and told.startswith("/"):
            put("route", verb.upper(), told, m.start())
        elif verb in VERBS and told and "." in callee and (first in CLIENTS or callee.split(".")[-2] in CLIENTS):
            put("request", verb.upper(), told, m.start())
        elif verb == "use" and told and told.startswith("/") and "." in callee:
            router = re.findall(rf"({NAME})\s*(?:\(|$|,)", p[opening + 1 : inside[1]].rstrip())
            put("mount", router[-1] if router else None, told, m.start())
    return out


def read_javascript(files: DataFrame) -> DataFrame:
    """The facts of every JavaScript and TypeScript file (path, text), each read in its own partition; nothing is shuffled."""
    kinds = (pa.string(),) * 4 + (pa.int32(),) * 2 + (pa.bool_(),) * 2 + (pa.int32(), pa.string())
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := facts_of(path, text or ""):
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.where(F.col("path").rlike(r"\.([cm]?[jt]s|[jt]sx)$")).select("path", "text").mapInArrow(run, FACTS)


def import_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, name): imports by relative path that name a file, as it is or with an ending, the first that is one."""
    asked = facts.where("kind = 'import' and detail rlike '^\\\\.{1,2}(/|$)'").select(F.col("path").alias("source"), "detail", "name").distinct()
    here = F.slice(F.split("source", "/"), F.lit(1), F.size(F.split("source", "/")) - 1)
    walk = F.aggregate(
        F.split("detail", "/"), here,
        lambda at, part: F.when(part.isin("", "."), at).when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(part))),
    )
    plain = asked.withColumn("base", F.array_join(walk, "/"))
    whole = F.regexp_replace("base", r"\.[cm]?js$", "")  # modules may name what they are compiled to
    tried = [F.concat("base", F.lit(e)) for e in ENDINGS] + [F.concat(whole, F.lit(e)) for e in (".ts", ".tsx")]
    each = plain.select("source", "detail", "name", F.posexplode(F.array(*tried)).alias("k", "target"))
    hit = each.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("source", "detail", "name").agg(F.min_by("target", "k").alias("target")).select("source", "target", "name")
