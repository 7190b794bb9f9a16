import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import with_slug
from tidemark.sources.files import asset_references, asset_trace, handoffs, markdown_metadata, registered_projects, scan, target_folders
from tidemark.sources.frontmatter import mapping
from tidemark.sources.globs import braces, excluded, glob_pattern, ignore_pattern

#: A glob, a path, and whether it fits as of the configuration and as of an ignore file.
GLOBS = [
    ("*.cs", "a.cs", True, True), ("*.cs", "x/a.cs", False, True), ("**/*.cs", "a.cs", True, True), ("**/*.cs", "x/y/a.cs", True, True), ("x/**", "x/y/a", True, True), ("x/**", "x", False, False), ("x/**/a", "x/a", True, True),
    ("x/**/a", "x/p/q/a", True, True), ("x/*/a", "x/p/q/a", False, False), ("x", "x/y", False, True), ("y", "x/y/z", False, True), ("x/", "x/y", False, True), ("x/", "x", False, False), ("/x", "x", True, True), ("/x", "p/x", False, False),
    ("{a,b}/*.md", "b/x.md", True, True), ("{a,b}/*.md", "c/x.md", False, False), ("*.{cs,js{,x}}", "q.jsx", True, True), ("*.{cs,js{,x}}", "q.json", False, False), ("{x}", "x", False, True), ("{x}", "{x}", True, False),
    ("v{1..3}.txt", "v2.txt", True, None), ("v{1..3}.txt", "v4.txt", False, None), ("v{08..10}", "v09", True, None), ("{c..a}", "b", True, None), ("[ab].cs", "a.cs", True, True), ("[!ab].cs", "a.cs", False, False), ("[^ab].cs", "c.cs", True, True),
    ("[a-c]x", "bx", True, True), ("a[!x]b", "a/b", False, False), ("[]]x", "]x", True, True), ("[x", "[x", True, True), ("[[:digit:]]x", "7x", True, True), ("[[:digit:]]x", "dx", False, False), ("a?c", "abc", True, True), ("a?c", "a/c", False, False),
    ("*", ".hidden", True, True), ("*/x", "/x", False, False), ("@(a|b).cs", "b.cs", True, None), ("+(ab).cs", "abab.cs", True, None), ("?(a)b", "b", True, None), ("*(a|b)c", "abac", True, None), ("!x", "x", False, True), ("!x", "y", True, False),
    ("#x", "#x", False, True), ("a\\b.cs", "a/b.cs", True, True), ("a.b+c", "a.b+c", True, True), ("a.b", "axb", False, False), ("src/**/gen/*.g.cs", "src/p/gen/x.g.cs", True, True), ("**", "a/b", True, True), ("a**b", "axyb", True, True), ("a**b", "a/b", False, False),
]


def test_globs(spark):
    """Both dialects, in the JVM that reads them."""
    table = spark.createDataFrame([(i, p) for i, (_, p, _, _) in enumerate(GLOBS)], "i int, p string")
    for pattern, k in ((glob_pattern, 2), (ignore_pattern, 3)):
        fits = F.lit(None)
        for i, (g, *_) in enumerate(GLOBS):
            fits = F.when(F.col("i") == i, F.col("p").rlike(pattern(g))).otherwise(fits)
        got = {r["i"]: r["f"] for r in table.select("i", fits.alias("f")).collect()}
        assert [(g, p, got[i]) for i, (g, p, *_) in enumerate(GLOBS) if GLOBS[i][k] is not None] == [(g, p, w[k - 2]) for g, p, *w in GLOBS if w[k - 2] is not None]
    paths = spark.createDataFrame([("x/gen/a.cs",), ("a.cs",), ("y/b.txt",)], "path string")
    assert [r["path"] for r in paths.where(~excluded("path", ["gen", "*.txt"])).collect()] == ["a.cs"] and paths.where(excluded("path", [])).count() == 0
    assert braces("a{b,{c,d}}e") == ["abe", "ace", "ade"] and braces("{a") == ["{a"] and braces("{}") == ["{}"]
    with pytest.raises(ValueError):
        braces("{1..999}{1..999}")


def test_scan_limits(spark, tmp_path):
    for i in range(4):
        (tmp_path / "src" / "gen").mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / f"{i}.cs").write_text("x")
        (tmp_path / "src" / "gen" / f"{i}.cs").write_text("x")
    assert scan(spark, str(tmp_path), code=["src", "nowhere"], excludes=["gen/", "src/{2,3}.cs"]).count() == 2
    with pytest.raises(ValueError):
        scan(spark, str(tmp_path), code=["src"], most=7)
    assert scan(spark, str(tmp_path), code=["src"], most=8).count() == 8
    for outside in ("../x", "/x", "a/../../x", "C:\\x"):
        with pytest.raises(ValueError):
            scan(spark, str(tmp_path), code=[outside])
    assert target_folders(["src/", "./lib", "a/../b"], ["src", "docs"]) == ["src", "lib", "b", "docs"]


FRONT = [
    ("title: A note", "A note"), ("title: 'it''s'", "it's"), ('title: "a\\tb \\u00e9\\n"  # c', "a\tb é\n"), ("title: plain # comment", "plain"), ("title: a#b", "a#b"), ("title: http://x.y/z", "http://x.y/z"), ("title: |\n  one\n  two\n", "one\ntwo\n"),
    ("title: |-\n  one\n\n  two", "one\n\ntwo"), ("title: >\n  one\n  two\n\n  three\nx: 1", "one two\nthree\n"), ("title: >-\n  a\n    b\n  c", "a\n  b\nc"), ("title: two\n  lines here", "two lines here"), ('title: "two\n  lines"', "two lines"),
    ("title:\n  below", "below"), ("title: 12", None), ("title: true", None), ("title: ~", None), ("title:", None), ("title: [a, b]", None), ("title:\n  - a\n  - b", None), ("title:\n- a\nx: y", None), ("title:\n  k: v", None), ("title: 1.5e3", None),
    ("x: y\n# c\n\n\"title\": q", "q"), ("- a\n- title: x", None), ("title: a\ntitle: b", None), ("title: a: b", None), ("title: 'open", None), ("just text", None), ("title: !!str tagged", "tagged"), ("tags: [a]\ntitle: ok", "ok"), ("title: 2024-01-02", "2024-01-02"),
]


@pytest.mark.parametrize("text, title", FRONT)
def test_front_matter(text, title):
    assert mapping(text).get("title") == title


def test_metadata_of_notes(spark):
    rows = [("a", "---\ntitle: >\n  Two\n  lines\ndate: '2024-05-06'\n---\n# Other"), ("b", "---\r\ntitle: 7\r\ndate: 2024-05-06\r\n---\r\n# Seven ##"), ("c", "---\n---\n# H"), ("d", " ---\ntitle: x\n---\n"), ("e", "\ufeff---\ntitle: marked\n---"), ("f", "---\ntitle: x\ndate: 2024-05-06\n"), ("g", "---\ntitle: x: y\n---\ntext")]
    got = markdown_metadata(spark.createDataFrame(rows, "label string, text string"))
    assert got.columns == ["label", "text", "title", "date"]
    assert {r["label"]: (r["title"], r["date"]) for r in got.collect()} == {"a": ("Two lines", "2024-05-06"), "b": ("Seven", "2024-05-06"), "c": ("H", None), "d": ("d", None), "e": ("marked", None), "f": ("f", None), "g": ("g", None)}


def test_slugs_of_other_scripts(spark):
    rows = spark.createDataFrame([(1, "Café Ünï"), (2, "ＡＢＣ １２"), (3, "plain One"), (4, "한글"), (5, None), (6, "Café Ünï"), (7, "ﬁn²")], "i int, name string")
    got = {r["i"]: r["slug"] for r in with_slug(rows, "name").collect()}
    assert got == {1: "cafe_u_ni", 2: "abc_12", 3: "plain_one", 4: "project", 5: None, 6: "cafe_u_ni", 7: "fin2"}
    assert re.fullmatch("[a-z_]+", got[1])


def test_registered_notes(spark, tmp_path):
    """Notes count in folders with a marker, under the names of notes, and not below those folders."""
    for name, marker in {"one-a": " /work/One/ \n", "two": "", "three": None, "Four": "/work/four", "five": "C:\\Work\\Five"}.items():
        (tmp_path / name / "below").mkdir(parents=True)
        if marker is not None:
            (tmp_path / name / ".project-path").write_text(marker)
        for note in ("plan_1.md", "Plan.md", "old.MD", "x.txt", "below/in.md"):
            (tmp_path / name / note).write_text(f"# {note}")
    projects = registered_projects(spark, str(tmp_path))
    assert sorted(map(tuple, projects.collect())) == [("five", "C:\\Work\\Five", "c:/work/five"), ("one-a", "/work/One/", "/work/one")]
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {(r["document_id"], r["project_path"], r["title"]) for r in handoffs(spark, root, projects).collect()}
        assert got == {(f"{s}/{label}", p, f"{label}{end}") for s, p in (("one-a", "/work/One/"), ("five", "C:\\Work\\Five")) for label, end in (("plan_1", ".md"), ("old", ".MD"))}
    assert registered_projects(spark, f"{tmp_path}/nowhere").count() == 0


def test_asset_dependencies_and_trace(spark):
    g, h = "0123456789abcdef" * 2, "f" * 32
    rows = [("A/x.prefab", f"q\n guid: {g}\n guid: {h}"), ("A/Y.asset.meta", f"guid: {g.upper()}\n"), ("A/Y.asset", "q"), ("B/x.unity", f"guid: {g}"), ("C/e.asset", None)]
    assets = spark.createDataFrame(rows, "path string, text string")
    known = spark.createDataFrame([("A/x.prefab", "C/e.asset"), ("A/x.prefab", "C/e.asset"), ("C/e.asset", "gone.asset"), ("other", "A/Y.asset"), ("B/x.unity", None)], "path string, target string")
    edges = asset_references(assets, known)
    uses, line = {("A/x.prefab", "A/Y.asset", "references", 2), ("A/x.prefab", f"unresolved:{h}", "references", 3), ("B/x.unity", "A/Y.asset", "references", 1)}, lambda x: {(r["from_id"], r["to_id"], r["relation"], r["ev_line"]) for r in x.collect()}
    more = {("A/x.prefab", "C/e.asset", "asset_database_dependency", 1), ("C/e.asset", "unresolved:gone.asset", "asset_database_dependency", 1)}
    assert line(edges) == uses | more and edges.count() == 5 and line(asset_references(assets)) == uses
    to_y = {e for e in uses if e[1] == "A/Y.asset"}
    for symbol in ("a\\y.ASSET", "y", g, "Y.asset"):
        assert line(asset_trace(assets, edges, symbol, "callers")) == to_y
    assert line(asset_trace(assets, edges, "X")) == {e for e in uses | more if e[0] != "C/e.asset"} and asset_trace(assets, edges, "x", limit=1).count() == 2
    assert line(asset_trace(assets, edges, "e", "callers")) == {e for e in more if e[1] == "C/e.asset"}
    with pytest.raises(ValueError):
        asset_trace(assets, edges, "nothing")
