"""Types found through namespaces, aliases, visibility and the nearness of projects."""

from sondage.operators import symbols


def test_each_way_of_naming_a_type(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = t([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C"), ("n1", None)], "file string, project string")
    types = t([("Own", "X.Y", "a2", "internal"), ("Up", "X", "b1", "public"), ("Hidden", "X", "b1", "internal"), ("Part", "X", "a2", "public"), ("Part", "X", "b1", "public"), ("Both", "U", "b1", "public"), ("Both", "V", "c1", "public"),
               ("Same", "U", "c1", "public"), ("Same", "V", "c1", "public"), ("Glob", "G", "c1", "public"), ("Free", "", "n1", "internal"), ("Out", "Z", "c1", "public"), ("Stat", "S", "b1", "public"), ("Unseen", "W", "b1", "public")], "name string, namespace string, file string, visibility string")
    declared = t([("a1", "X.Y")], "file string, namespace string")
    usings = t([("a1", "U", None, False, False), ("a1", "V", None, False, False), ("a2", "G", None, False, True), ("a1", "Z.Out", "Alias", False, False), ("a1", "Z", "Zed", False, False), ("a1", "S.Stat", None, True, False)], "file string, target string, alias string, is_static boolean, is_global boolean")
    names = ["Own", "Up", "Hidden", "Part", "Both", "Same", "Glob", "Free", "Alias", "Zed.Out", "Alias.Inner.More", "X.Y.Own", "X.Part.In", "W.Unseen", "Unseen", "No.Such", "Nothing"]
    refs = t([("a1", n) for n in names] + [("a1", "Up"), ("c1", "Own"), ("c1", "Up")], "file string, name string")
    near = t([("A", "B"), ("A", "B")], "project string, referenced string")
    found = symbols.resolved(types, files, declared, usings, refs, near)
    got = {}
    for r in found.collect():
        got.setdefault((r.file, r.name), set()).add((r.target, r.type))
    assert got == {
        ("a1", "Own"): {("a2", "Own")}, ("a1", "Up"): {("b1", "Up")}, ("a1", "Part"): {("a2", "Part"), ("b1", "Part")}, ("a1", "Both"): {("b1", "Both")}, ("a1", "Glob"): {("c1", "Glob")}, ("a1", "Free"): {("n1", "Free")},
        ("a1", "Alias"): {("c1", "Out")}, ("a1", "Zed.Out"): {("c1", "Out")}, ("a1", "Alias.Inner.More"): {("c1", "Out")}, ("a1", "X.Y.Own"): {("a2", "Own")}, ("a1", "X.Part.In"): {("a2", "Part"), ("b1", "Part")}, ("a1", "W.Unseen"): {("b1", "Unseen")}, ("a1", "S.Stat"): {("b1", "Stat")},
    }
    edges = {(r.source, r.target): r.names for r in symbols.symbol_edges(found).collect()}
    assert edges["a1", "b1"] == ["Both", "Part", "Stat", "Unseen", "Up"] and edges["a1", "c1"] == ["Glob", "Out"]
    assert symbols.resolved(types.limit(0), files, declared, usings.limit(0), refs, near).count() == 0


def test_names_that_many_files_declare_are_ranked_by_project(spark):
    from pyspark.sql import functions as F

    files = [(f"t{k}", "A" if k % 2 else None) for k in range(100)] + [("x", "A"), ("y", "B")]
    types = [("T", "N", f"t{k}", "internal" if k % 4 == 1 else "public") for k in range(100)] + [("T", "M", "t1", "public")]
    seen = spark.createDataFrame([("x", "T", "N", "A"), ("y", "T", "N", "B")], "file string, name string, namespace string, a string")
    f, t = spark.createDataFrame(files, "file string, project string"), spark.createDataFrame(types, "name string, namespace string, file string, visibility string")
    refs, near = spark.createDataFrame([("x", "T"), ("y", "T")], "file string, name string"), spark.createDataFrame([], "project string, referenced string")
    placed = t.join(f, "file").select(F.col("name").alias("type"), "namespace", F.col("file").alias("target"), "visibility", F.col("project").alias("b"))
    assert symbols.candidates(seen, placed, near, F.lit(True)).count() == 6
    usings = spark.createDataFrame([("x", "N", None, False, False), ("y", "N", None, False, False)], "file string, target string, alias string, is_static boolean, is_global boolean")
    got = symbols.resolved(t, f, spark.createDataFrame([], "file string, namespace string"), usings, refs, near).collect()
    want = {("x", "T", f"t{k}", "T") for k in range(100)} | {("y", "T", f"t{k}", "T") for k in range(100) if k % 4 != 1}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
