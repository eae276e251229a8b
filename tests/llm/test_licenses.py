from helpers import AWKWARD
from pyspark.sql import functions as F
from sondage.llm import licence_texts as T
from sondage.llm.licenses import TEMPLATES, license_scan, telling, template_tokens, vocabulary

SCHEMA = "doc_id long, text string, path string, license string, dir string"


def scan(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return {r.doc_id: r for r in license_scan(docs, F.col("path")).collect()}


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "some prose\nReleased under the MIT License.\nmore prose " + "word " * 50, "a/b/c.txt"),
        (2, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"),
        (3, "no notice at all", "a/b/d.txt"), (4, "no notice either", "z/q.txt"), (5, "nothing", "a/x/y/deep.txt"),
        (6, "This work is licensed under the GNU General Public License, version 3.", "a/x/COPYING"), (7, "nothing", None),
        (8, "we talk about a license now and then and of other things", "z/r.txt"), (9, None, "a/n.txt"),
    ]
    got = scan(spark, rows)
    assert (got[1].license, got[1].origin, got[1].score) == ("MIT", "header", 1.0)
    assert (got[2].license, got[2].origin) == ("Apache-2.0", "file") and (got[6].license, got[6].origin) == ("GPL-3.0", "file")
    assert (got[3].license, got[3].origin, got[3].from_dir) == ("Apache-2.0", "inherited", "a")
    assert (got[5].license, got[5].from_dir) == ("GPL-3.0", "a/x") and got[9].license == "Apache-2.0"
    assert got[4].license is None and got[7].license is None and got[8].license is None


def wrapped(text, width=70, mark="# "):
    import textwrap

    return "\n".join(mark + line if line else mark.rstrip() for part in text.split("\n") for line in [*textwrap.wrap(part, width), ""])


def test_every_template_finds_itself(spark):
    """Alone, wrapped in a comment, and between lines of code."""
    names = dict(enumerate(name for name, _ in TEMPLATES))
    code = "import os\n\ndef main():\n    return os.getcwd()\n" * 60
    got = scan(spark, [(k, text, f"p{k}/f") for k, (_, text) in enumerate(TEMPLATES)] + [(1000 + k, wrapped(text) + "\n" + code, f"q{k}/f") for k, (_, text) in enumerate(TEMPLATES)])
    assert {k: got[k].license for k in names} == names == {k: got[1000 + k].license for k in names}
    assert all(got[k].origin == "file" and got[1000 + k].origin == "header" for k in names)


def test_a_repository(spark):
    """Whole licence files, with title and holder, and files that inherit from the nearest of them."""
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(T.MIT_GRANT, 78, "") + "\n" + wrapped(T.MIT_DISCLAIMER, 78, "")
    bsd = "Copyright (c) 1999, The Holders. All rights reserved.\n\n" + wrapped(f"{T.BSD_TWO}\n{T.BSD_THIRD}\n{T.BSD_DISCLAIMER}", 72, "")
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + "      Some body of terms that goes on for long about many things.\n" * 60
    code = "int main(void) { return 0; }\n" * 10
    rows = [
        (1, mit, "repo/LICENSE"), (2, code, "repo/src/main.c"), (3, bsd, "repo/vendor/x/COPYING.txt"), (4, code, "repo/vendor/x/lib/deep/a.c"), (5, code, "repo/vendor/y/b.c"),
        (6, apache, "other/LICENSE.md"), (7, code, "other/a/b.c"), (8, wrapped(T.APACHE_HEADER, 60, " * ") + "\n" + code, "repo/src/odd.c"), (9, mit[mit.index("Permission"):], "third/notes"),
        (10, code, "third/c.c"), (11, code, "fourth/c.c"), (12, "// SPDX-License-Identifier: MPL-2.0\n" + code, "repo/m.c"), (13, code, "LICENSE"),
    ]
    got = {k: (r.license, r.origin, r.from_dir) for k, r in scan(spark, rows).items()}
    assert got == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "repo"), 3: ("BSD-3-Clause", "file", None), 4: ("BSD-3-Clause", "inherited", "repo/vendor/x"), 5: ("MIT", "inherited", "repo"),
        6: ("Apache-2.0", "file", None), 7: ("Apache-2.0", "inherited", "other"), 8: ("Apache-2.0", "header", None), 9: ("MIT", "file", None),
        10: ("MIT", "inherited", "third"), 11: (None, None, None), 12: ("MPL-2.0", "header", None), 13: (None, None, None),
    }


def test_repeated_ids_are_rows_of_their_own(spark):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(None, notice, "a/f", "x", "y"), (None, "hello world", "b/f", "x", "y"), (5, notice, "c/f", "x", "y"), (5, "other text", "d/f", "x", "y")], SCHEMA)
    got = sorted(((str(r.doc_id), str(r.license), str(r.origin)) for r in license_scan(docs, F.col("path")).collect()))
    assert got == [("5", "MIT", "file"), ("5", "None", "None"), ("None", "MIT", "file"), ("None", "None", "None")]


def test_the_telling_words_lose_nothing():
    """Any part of a template's words that is close enough holds one of them."""
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    idf = {t: 1 + 9 * rng.random() for t in vocabulary()}
    words = set(telling(idf, 0.75))
    for _, own in template_tokens():
        whole = {t: c * idf[t] for t, c in Counter(own).items()}
        rest = {t: w for t, w in whole.items() if t not in words}
        assert math.sqrt(sum(w * w for w in rest.values())) < 0.75 * math.sqrt(sum(w * w for w in whole.values()))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "a/f", "x", "y")], SCHEMA)
    plan = license_scan(docs, F.col("path"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEval"))


def test_awkward_rows_and_empty(spark):
    rows = [(i, t, "d/f") for i, t in AWKWARD]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert license_scan(docs, F.col("path")).count() == len(rows)
    assert license_scan(docs.limit(0), F.col("path")).count() == 0
