"""The JavaScript and TypeScript reader on files whose facts are written by hand."""

from hypothesis import given, settings, strategies as st
from sondage.sources.javascript import Source, facts_of, import_targets, read_javascript

TEXT = r'''// import x from "no";
import React, { useState as use, type Props } from './react';
import * as path from "path";
import "./side.css";
const { a, b: c } = require('../lib');
export const limit = 3, re = /[/"'`]+\/(/g;
/* function no() {} */
export async function load(id: string, { deep = 1 }: Opts = {}): Promise<Item[]> {
  const res = await fetch(`/api/items/${id}?x=${use(1)}`, { method: 'post' });
  return res.json().map((x) => x.id);
}
const add = (x: number, y = 2): number => x + y;
const twice = async n => { return add(n, n); };
export default class Store extends Base<Item> {
  private items = new Map();
  constructor(private readonly db: Db) { super(); }
  async find(id) { if (id) { return this.db.query("function no() { call() }"); } }
  static of<T>(x: T) { return new Store(x); }
}
export { add as plus, twice };
export * from './other';
router.get('/items/:id', async (req, res) => res.send(limit / 2 / 3));
app.use('/api', auth, itemRouter);
axios.delete("http://stock:80/x/" + limit);
'''


def of(kind, rows):
    return [r for r in rows if r[1] == kind]


def test_facts():
    rows = facts_of("src/a.ts", TEXT)
    assert [(r[2], r[3], r[4]) for r in of("import", rows)] == [("useState", "./react", 2), ("Props", "./react", 2), ("default", "./react", 2), ("*", "path", 3), ("*", "./side.css", 4), ("a", "../lib", 5), ("b", "../lib", 5)]
    assert [(r[2], r[3]) for r in of("export", rows)] == [("limit", None), ("load", None), ("Store", None), ("plus", None), ("twice", None), ("*", "./other")]
    assert sorted((r[2], r[4], r[5], r[6], r[7], r[8]) for r in of("function", rows)) == [("add", 12, 12, True, False, 2), ("load", 8, 11, True, True, 2), ("twice", 13, 13, True, True, 1)]
    assert [(r[2], r[3], r[4], r[5]) for r in of("class", rows)] == [("Store", "Base", 14, 19)]
    assert [(r[2], r[7], r[8], r[9]) for r in of("method", rows)] == [("constructor", False, 1, "Store"), ("find", True, 1, "Store"), ("of", False, 1, "Store")]
    calls = [r[2] for r in of("call", rows)]
    assert {"fetch", "use", "res.json", "add", "this.db.query", "router.get", "res.send", "app.use", "axios.delete", "Map", "Store"} <= set(calls) and not {"no", "call", "if", "super", "find"} & set(calls)
    assert [(r[2], r[3]) for r in of("request", rows)] == [("POST", "/api/items/:id?x=:use"), ("DELETE", "http://stock:80/x/")]
    assert [(r[2], r[3]) for r in of("route", rows)] == [("GET", "/items/:id")] and [(r[2], r[3]) for r in of("mount", rows)] == [("itemRouter", "/api")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["`", "${", "}", "{", "(", ")", "/", "//", "/*", "*/", "'", '"', "\\", "\n", "x", " ", "=>", "class A ", "function f", "import ", " from ", "export ", "="]), max_size=30))
def test_any_text_is_read(parts):
    text = "".join(parts)
    source = Source(text)
    assert len(source.plain) == len(text) and source.plain.count("\n") == text.count("\n")
    facts_of("a.js", text)


def test_targets(spark):
    rows = [("src/a.ts", TEXT), ("src/react.tsx", "export default 1"), ("src/other/index.js", ""), ("lib.js", "module.exports = 1"), ("src/b.mts", "import { z } from './a.js';\nimport q from './none';"), ("x.py", "import os"), ("n.ts", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = sorted(map(tuple, import_targets(read_javascript(files), files).collect()))
    assert got == [("src/a.ts", "lib.js", "a"), ("src/a.ts", "lib.js", "b"), ("src/a.ts", "src/react.tsx", "Props"), ("src/a.ts", "src/react.tsx", "default"), ("src/a.ts", "src/react.tsx", "useState"), ("src/b.mts", "src/a.ts", "z")]
