"""Operators on small fixtures: brute force, invariants and edges."""

import json
import math
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import descriptors, identifiers, javadoc, text, tolerant, urls, versions
from quern.operators import chunks, graph, index, quality, rank, snippets, vectors
from quern.sources import crawl, formats, java, markup, store, tables
from quern.streaming import incremental, windows

words = st.lists(st.sampled_from("alpha beta. gamma! delta? eps\n\nzeta naïve 漢字 ".split(" ") + ["x" * 30, ""]), max_size=400).map(" ".join)


@given(words, st.integers(120, 400))
@settings(max_examples=60, deadline=None)
def test_windows_cover_and_advance(body, size):
    pieces = chunks.windows(body, size)
    assert all(len(p) >= chunks.LEAST or len(body) <= size for p in pieces)
    for p in pieces:
        assert p in body
    if len(body) > size:
        at = -1
        for p in pieces:
            found = body.find(p, at + 1)
            assert found > at
            at = found


def test_windows_long_token():
    body = "word " * 300 + "y" * 2500 + " tail of the text, long enough to be kept as a piece, that ends here."
    pieces = chunks.windows(body)
    assert any("y" * 2500 in p for p in pieces)
    assert pieces[-1].endswith("ends here.")


def test_truncate(spark):
    cases = {"short": "short", "One sentence here. Another one follows": "One sentence here.", "aaaa bbbb cccc dddd eeee ffff gggg": "aaaa bbbb cccc dddd eeee...", "x" * 50: "x" * 50, None: None, "": "", "First part\n\nsecond part that goes on": "First part"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["c"] for r in rows.select("t", text.truncate(F.col("t"), 25).alias("c")).collect()} == cases
    blank = spark.createDataFrame([("Long enough first part\n\nsecond",)], "t string").select(text.truncate(F.col("t"), 28)).first()[0]
    assert blank == "Long enough first part"
    codes = {"int a = 1; int b = 2; int c = 3;": "int a = 1; int b = 2;\n// ...", "short;": "short;", "a; " + "b" * 40: "a; " + "b" * 21 + "\n// ...", None: None}
    rows = spark.createDataFrame([(t,) for t in codes], "t string")
    assert {r["t"]: r["c"] for r in rows.select("t", text.truncate_code(F.col("t"), 24).alias("c")).collect()} == codes


def test_chunks_of_pages(spark):
    blocks = "array<struct<language: string, code: string, caption: string>>"
    pages = spark.createDataFrame([(1, "T", "c" * 1200), (2, None, None), (3, "S", "text")], "document_id bigint, title string, content string")
    body = "A body of more than fifty characters, so that it is kept as a chunk. "
    rows = [(11, 1, "H", body, [("java", "x();", "cap"), ("java", None, None)], 2), (10, 1, None, body.upper(), None, 1), (10, 1, None, body.upper(), None, 1), (12, 1, "Tiny", "small", [], 3), (13, 9, "Orphan", body, None, 1), (14, None, "Null", body, None, 1), (15, 3, "Tiny", "x", None, None)]
    sections = spark.createDataFrame(rows, f"section_id bigint, document_id bigint, heading string, content string, code_blocks {blocks}, order_num int")
    got = [tuple(r)[:5] for r in chunks.chunk(pages, sections).orderBy("document_id", "order_num").collect()]
    assert got == [
        (1, "title", "T\n\n" + "c" * 1000, None, 0), (1, "section", body.upper().strip(), "", 1), (1, "code", "H\ncap\nx();", "H", 2), (1, "section", f"H\n\n{body.strip()}", "H", 3),
        (2, "title", "\n\n", None, 0), (2, "full", "", None, 1), (3, "title", "S\n\ntext", None, 0),
    ]
    assert chunks.chunk(pages.limit(0), sections).count() == 0 and chunks.chunk(pages, sections.limit(0)).count() == 6


def test_bodies_and_canonical_sections(spark):
    blocks = "array<struct<language: string, code: string, caption: string>>"
    rows = [(1, 1, "A", "same text that is long enough", [("java", "code1", None)], 1), (2, 1, "B", "same text that is long enough", [("java", "code2", None)], 2), (3, 1, "B", "same text that is long enough", [], 3), (4, 1, "B", "same text that is long enough", [], 4), (5, 1, "C", "", None, 5), (6, 2, "A", "same text that is long enough", None, None)]
    rows = [(i, d, h, c.replace("same", "Same"), b, o) for i, d, h, c, b, o in rows]
    df = spark.createDataFrame(rows, f"section_id bigint, document_id bigint, heading string, content string, code_blocks {blocks}, order_num int")
    text_ = "Same text that is long enough"
    got = {(r["section_id"], r["place"]): r["body"] for r in chunks.unique_bodies(df).collect()}
    assert got == {(1, 0): text_, (2, 1): f"{text_}\n\ncode2", (3, 2): f"B\n\n{text_}", (5, 4): "C", (6, 0): text_}
    many = spark.createDataFrame([(i, 1, f"H{i % 30}", f"Body number {i % 40} of some length", i) for i in range(60)] + [(99, 1, "X", "lower case starts no body, however long", 0)], "section_id bigint, document_id bigint, heading string, content string, order_num int")
    many = many.withColumn("content", F.concat(F.upper(F.substring("content", 1, 1)), F.substring("content", 2, 1000)))
    kept, heads, bodies = [], set(), set()
    for i in [0, 99, *range(1, 60)]:
        h, b = (f"H{i % 30}", i % 40) if i != 99 else ("X", "x")
        if h not in heads and b not in bodies:
            heads.add(h), bodies.add(b), kept.append(i)
    assert [r["section_id"] for r in chunks.canonical_sections(many).orderBy("place").collect()] == kept
    assert chunks.canonical_sections(many, 3).count() == 3


def _score(name, query, more=()):
    """The rules of the score, one after the other, by hand."""

    def distance(a, b):
        table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return table[len(a), len(b)]

    alike = lambda a, b: 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0
    cut = lambda s: [w for w in re.split(r"[_\-\s]+", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s)).lower()) if w]

    def close(t, w):
        rules = [(t == w, 1.0), (t.startswith(w), max(0.75, 0.9 - 0.02 * abs(len(t) - len(w)))), (len(t) >= 3 and w.startswith(t), max(0.65, 0.8 - 0.03 * abs(len(t) - len(w)))), (len(w) >= 3 and w in t, 0.7), (len(t) >= 3 and t in w, 0.6)]
        floor = next(v for k, v in ((6, 0.65), (4, 0.7), (0, 0.75)) if min(len(t), len(w)) >= k)
        return next((v for ok, v in [*rules, (alike(t, w) >= floor, 0.7 * alike(t, w))] if ok), 0.0)

    if not name:
        return 0
    whole, low = re.sub(r"[\s_\-]", "", query.lower()), name.lower()
    base, own = [w for w in cut(query) if len(w) > 1], cut(name)
    asked = [(w, 1.0) for w in base] + [(w, 0.6) for w in more if w not in base]
    points = [(max((close(t, w) for t in own), default=0.0), k) for w, k in asked]
    b, n, total = max(len(base), 1), max(len(asked), 1), sum(v * k for v, k in points)
    exact, sure, part = (sum(v >= x for v, _ in points) for x in (0.95, 0.75, 0.55))
    loose = any(0.3 < v < 0.55 for v, _ in points)
    if low == whole:
        out = 100
    elif whole and low.startswith(whole):
        out = min(95, 85 + max(0, 10 - (len(name) - len(query))))
    elif alike(low, whole) >= 0.75:
        out = min(90, math.floor(50 + 40 * alike(low, whole) + 0.5))
    else:
        out = 0
        if asked and (exact == b or sure >= 0.8 * b):
            out = 75 + 15 * total / n + 5 * ("".join(base) in low) + 10 * bool(own and base and own[0] == base[0])
        elif asked and sure >= 0.7 * b:
            out = 55 + 20 * total / n
        elif asked and part >= 0.5 * b:
            out = 40 + 20 * total / n
        elif loose or total > 0.3:
            out = 20 + 30 * total / n
        out += (5 if len(name) < 15 else -5 if len(name) > 40 else 0) if out else 0
        if len(whole) >= 3 and whole in low:
            out = max(out, 55 + 20 * len(whole) / len(name))
    hidden = name.startswith(("_", "lambda$", "access$")) or "$" in name[1:]
    return max(0, min(100, math.floor(out - 25 * hidden + 0.5)))


@pytest.mark.parametrize("query, more", [("get tank", ()), ("fluidTank", ("vessel", "fl")), ("xy", ()), ("", ("tank",)), ("a", ()), ("registry_handler", ("reg",))])
def test_fuzzy_score(spark, query, more):
    random.seed(len(query))
    parts = ["get", "Tank", "tank", "Fluid", "Fluids", "_", "$", "Registry", "Handlr", "handler", "Reg", "vessel", "x", "XY", "lambda$", "Tenk", "Long" * 11, "3"]
    names = ["", None, "getTank", "_getTank", "lambda$0", "fluidTank"] + ["".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(400)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = {r["id"]: r["score"] for r in identifiers.fuzzy(rows, "name", query, more).collect()}
    assert {i: (names[i], got[i]) for i in got} == {i: (n, _score(n, query, more)) for i, n in enumerate(names)}


def test_versions(spark):
    rows = spark.createDataFrame([("1.9",), ("1.21",), ("1.21.11",), ("26.2",), ("unknown",), (None,)], "v string")
    got = [r[0] for r in rows.where(versions.well_shaped(F.col("v"))).orderBy(versions.sort_key(F.col("v"))).collect()]
    assert got == ["1.9", "1.21", "1.21.11", "26.2"]
    assert [r[0] for r in rows.where(versions.exact_or_child(F.col("v"), "1.21")).collect()] == ["1.21", "1.21.11"]
    names = spark.createDataFrame([("1.12.2",), ("1.13-pre4",), ("20w14a",), ("1.16-rc1",)], "v string")
    assert [r[0] for r in names.where(versions.is_release(F.col("v"))).collect()] == ["1.12.2"]
    assert versions.bump("v1.2.3", "minor") == "1.3.0"


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(urls.glob(g), p))
    assert hit("**/*.java", "a/b/C.java") and hit("**/*.java", "C.java") and not hit("*.java", "a/C.java")
    assert hit("src/?.txt", "src/a.txt") and not hit("src/?.txt", "src/ab.txt")


def test_descriptors():
    assert descriptors.of_java_type("java.util.List<String>[]") == "[Ljava/util/List;"
    assert descriptors.of_java_type("int[][]") == "[[I"
    assert descriptors.remap("(La/B;I)La/C;", {"a/B": "x/Y"}) == "(Lx/Y;I)La/C;"


def test_javadoc():
    p = javadoc.parse("/**\n * Uses e.g. a {@link Tank#fill tank}. More.\n * @since 1.2\n * @deprecated use\n *   other\n */")
    assert p == {"body": "Uses e.g. a Tank.fill tank. More.", "summary": "Uses e.g. a Tank.fill tank.", "deprecated": "use other", "since": "1.2"}
    assert javadoc.parse(None)["body"] is None


def test_tolerant_json():
    assert tolerant.extract('Sure: {"a": 1,} done') == {"a": 1}
    assert tolerant.extract("[1]") is None and tolerant.extract(None) is None and tolerant.extract('"x"') is None
    assert tolerant.strings([" a ", "", 3, "b"], 1) == ["a"] and tolerant.strings("x") == ["x"]
    assert tolerant.unit(7) == 1.0 and tolerant.unit("x") == 0.5 and tolerant.unit(True) == 0.5


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "fox red"), (3, None), (4, ""), (5, "Red Fox"), (6, "red red fox fox")], "id int, t string")
    i = index.build(docs, "id", F.col("t"), str(tmp_path / "i"), 4)
    ids = lambda e: sorted(r["id"] for r in index.search(i, e).collect())
    assert ids(index.Phrase(("red", "fox"))) == [1, 5, 6] and ids(index.Phrase(("red", "red", "fox", "fox"))) == [6]
    assert ids(index.And((index.Term("red"), index.Term("fox")))) == [1, 2, 5, 6]
    assert ids(index.Term("ru", prefix=True)) == ids(index.Term("run", prefix=True)) == [1] and ids(index.Term("nothing")) == []
    assert ids(index.Or((index.Term("runs"), index.Phrase(("fox", "red"))))) == [1, 2]
    assert {r["term"]: (r["df"], r["cf"]) for r in i.terms.collect()} == {"red": (4, 5), "fox": (4, 5), "runs": (1, 1)}
    plan = index.search(i, index.Term("runs"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:80]
    empty = index.build(docs.limit(0), "id", F.col("t"), str(tmp_path / "e"), 2)
    assert index.search(empty, index.Term("red")).count() == 0


def test_query_plans():
    p = index.plan
    assert p(["creative", "tab"]) == index.Or((index.Phrase(("creative", "tab")), index.And((index.Term("creative"), index.Term("tab")))))
    assert isinstance(p(["one", "two", "three", "four"]).parts[1], index.Or) and p(["tank"]) == index.Term("tank")
    assert p(["a", "b"]).parts[1] == index.Or((index.Term("a"), index.Term("b")))
    assert p(["tank"], ["fluid handler", "vessel"]).parts[1:] == (index.Phrase(("fluid", "handler")), index.Term("vessel"))
    assert index.parse("The Creative-tab, in a TAB!", frozenset(["the", "in"])) == ["creative", "tab"]
    assert index.siblings(["vessel"], {"tank": ["vessel", "cask"], "x": ["y"]}) == ["tank", "cask"] and index.siblings(["tank"], {"tank": ["vessel"]}) == ["vessel"]


def test_batch_against_single_queries(spark, tmp_path):
    random.seed(2)
    docs = spark.createDataFrame([(k, " ".join(random.choices("ab bc cd de ef fg gh".split(), k=random.randint(0, 9)))) for k in range(80)], "id bigint, t string")
    i = index.build(docs, "id", F.col("t"), str(tmp_path / "b"), 4)
    asked = [(1, "ab cd"), (2, "gh gh none"), (3, "none"), (4, None)]
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in index.batch(i, spark.createDataFrame(asked, "query_id bigint, text string"), 5).collect()}
    want = {}
    for q, e in ((1, index.Or((index.Term("ab"), index.Term("cd")))), (2, index.Term("gh"))):
        found = sorted(((-round(r["score"], 6), r["id"]) for r in index.search(i, e).collect()))[:5]
        want |= {(q, n): (k, -s) for n, (s, k) in enumerate(found, 1)}
    assert got == want


def test_postings_delta(spark):
    old = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, t string")
    new = spark.createDataFrame([(2, "d"), (1, None)], "id int, t string")
    got = incremental.postings_delta(index.postings(old, "id", F.col("t")), new, "id", "t").select("term", "id").collect()
    assert [tuple(r) for r in got] == [("d", 2)]


def test_vectors_against_brute_force(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None), (62, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    asked = df.where("id in (3, 5)").selectExpr("id as query_id", "v")
    got = {(r["query_id"], r["id"]) for r in vectors.top_k(df, asked, "id", "v", 5, block=1).collect()}
    brute = df.alias("a").crossJoin(asked.alias("q")).where("a.id <> query_id").select("query_id", "id", vectors.cosine(F.col("a.v"), F.col("q.v")).alias("s")).where("s is not null")
    want = set()
    for q in (3, 5):
        want |= {(q, r["id"]) for r in sorted(brute.where(f"query_id = {q}").collect(), key=lambda r: (-round(r["s"], 6), r["id"]))[:5]}
    assert got == want
    assert vectors.top_k(df.limit(0), asked, "id", "v", 5).count() == 0
    assert vectors.top_k(df, asked.limit(0), "id", "v", 5).count() == 0


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([(1, ["red", "fox", "red"]), (2, []), (3, None)], "id int, words array<string>")
    got = {r["id"]: r["embedding"] for r in vectors.hashed(rows, F.col("words"), ["id"], 16).collect()}
    assert got[1] == pytest.approx(vectors.hash_vector(["red", "fox", "red"], 16)) and sum(x * x for x in got[1]) == pytest.approx(1)
    assert got[2] == got[3] == [0.0] * 16


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "node int, parent int")
    got = {(r["node"], r["ancestor"]) for r in graph.closure(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}
    assert graph.closure(edges.limit(0)).count() == 0


def test_relations_against_brute_force(spark):
    random.seed(2)
    rows = [(i, random.choice("ab"), random.choice("xy"), random.choice("pqr"), round(random.random(), 1), random.randrange(50)) for i in range(40)]
    got = {(r["source"], r["target"], r["priority"]) for r in graph.relations(spark.createDataFrame(rows, "id int, owner string, place string, pattern string, quality double, line int")).collect()}
    want = set()
    for a in rows:
        found = []
        for b in rows:
            p = 3 if a[1:3] == b[1:3] else 2 if a[3] == b[3] else 1 if a[1] == b[1] else 0
            if a[0] != b[0] and p:
                found.append((-p, -b[4], abs(a[5] - b[5]), b[0], p))
        want |= {(a[0], x[3], x[4]) for x in sorted(found)[:6]}
    assert got == want


def test_interleave_and_quota(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "l string, i int")
    got = [tuple(r) for r in rank.interleave(rows, "l", [F.asc("i")], 6).select("l", "i").collect()]
    assert got == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2), ("a", 3)]
    few, many = spark.range(2).withColumnRenamed("id", "i"), spark.range(100, 130).withColumnRenamed("id", "i")
    assert rank.quota_merge(few, many, ["i"], 9).groupBy("list").count().orderBy("list").collect()[1]["count"] == 7
    assert rank.quota_merge(many, few, ["i"], 9).count() == 9


def test_directory_spread():
    # (path, index, rank): directories a and b/c, of which b/c has the better head
    items = [(f"a/{n}.java", i, (0, i)) for i, n in enumerate("ppppqq")] + [("b/c/z.java", 6, (-1, 6)), ("b/c/z.java", 7, (0, 7))]
    assert snippets.directory_spread(items, 4) == [0, 4, 6, 7]  # turns: 6, p0, 7, q4
    assert snippets.directory_spread(items, 20) == list(range(8))
    assert snippets.directory_spread([("f", i, (0, i)) for i in range(10)], 5) == [0, 1, 2, 3, 4]  # three, then the rest without the limit
    assert snippets.directory_spread([("f", i, (-i, i)) for i in range(10)], 4) == [6, 7, 8, 9]
    assert snippets.directory_order({"x": (2,), "x/y": (5,), "x/z": (1,), "x/z/w": (0,), "": (9,)}) == ["", "x", "x/z", "x/y", "x/z/w"]
    assert snippets.directory_order({}) == []


def test_spread_directories(spark):
    rows = [("r", f"src/{'generated' if i % 2 else 'main'}/F{i % 4}.java", i, i + (1 if i % 5 == 0 else 9), ["m"] * (i % 3)) for i in range(40)] + [(None, "a.java", 1, 9, [])]
    df = spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int, markers array<string>")
    got = snippets.spread_directories(df, 6).collect()
    assert sum(r["repo"] is None for r in got) == 1 and len(got) == 7
    main = [r for r in got if r["repo"] and "main" in r["path"]]
    assert len(main) == 3 and all(r["end_line"] - r["start_line"] > 1 for r in main)


def test_regions():
    code = 'class A {\n  // no { here\n  int x = 1;\n  void a(\n    int b) {\n    s("}");\n  }\n  int f() { return 1; }\n}'
    assert [(a, b, s) for a, b, s, _ in snippets.regions(code)] == [(4, 7, "void a( int b)"), (8, 8, "int f()")]
    assert snippets.regions("") == [] and snippets.regions("} } {") == []


def test_java_parse():
    code = "package p;\n/** Doc. */\npublic class A<T> {\n  private int n = f(1);\n  @Override public void go(int a) throws E { if (a) { x(); } }\n  A() {}\n  interface B { String s(); }\n"
    got = [(f, w, n) for f, _, _, w, n, _, _, _ in java.parse(code)]
    assert got == [("p.A", "class", "A"), ("p.A", "field", "n"), ("p.A", "method", "go"), ("p.A", "constructor", "A"), ("p.A.B", "interface", "B"), ("p.A.B", "method", "s")]
    assert java.parse(None) == [] and java.parse("}}}") == []


def test_markup():
    title, parts = markup.parse_html("<html><title>t</title><nav>menu</nav><h1>Top</h1><p>One<p>two<h2>Next</h2><figcaption>cap</figcaption><pre><code class='language-java'>int a;</code></pre></html>")
    assert title == "Top" and [p["heading"] for p in parts] == ["Top", "Next"]
    assert parts[1]["code_blocks"] == [{"language": "java", "code": "int a;", "caption": "cap"}] and "menu" not in parts[0]["content"]
    title, parts = markup.parse_markdown('---\ntitle: "T"\n---\nintro **bold**\n# H\n```js title="x"\nlet a\n```\n[l](u)')
    assert title == "T" and parts[0]["content"] == "intro bold" and parts[1]["code_blocks"][0]["caption"] == "x" and parts[1]["content"] == "l"
    assert markup.parse_html(None) == (None, []) and markup.parse_markdown("") == (None, [])


def test_quality_gates(spark):
    rows = spark.createDataFrame([(1, "a​"), (1, None), (2, "b")], "k int, v string")
    assert quality.zero_width(rows, ["v"]).collect()[0]["bad"] == 1
    assert quality.nulls(rows, ["v"]).collect()[0]["bad"] == 1
    assert [r["k"] for r in quality.duplicates(rows, ["k"]).collect()] == [1]
    assert not quality.unique(rows, "k").collect()[0][0]
    assert quality.orphans(rows, "k", spark.createDataFrame([(1,)], "p int"), "p").count() == 1
    with pytest.raises(quality.QualityError):
        quality.gate("x", 1)
    quality.gate("x", 0)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert not s.has("documents") and s.read("documents").count() == 0
    s.publish({"t": spark.range(3)}, pin="1")
    first = s.manifest()["tables"]["t"]["folder"]
    s.publish({"t": spark.range(5)})
    assert s.read("t").count() == 5 and s.manifest()["facts"] == {"pin": "1"} and incremental.up_to_date(s.manifest(), {"pin": "1"})
    with pytest.raises(Exception):
        s.publish({"u": spark.range(2), "t": spark.range(1).select(F.raise_error(F.lit("no")))})
    assert s.read("t").count() == 5 and not s.has("u")
    assert s.vacuum() == [] and first in s.vacuum(0)
    assert s.read("t").count() == 5 and s.verify() == [] and s.has("t", "id") and not s.has("t", "x") and s.fact("pin") == "1" and s.fact("none") is None
    entry = s.manifest()["tables"]["t"]
    assert entry["rows"] == 5 and entry["bytes"] > 0 and len(entry["sha256"]) == 64
    spark.range(7).write.mode("append").parquet(f"file://{tmp_path}/s/{entry['folder']}")
    assert set(s.verify()) == {"t: rows", "t: bytes", "t: sha256"}
    (tmp_path / "s/manifest.json").write_text("[broken")
    assert s.manifest()["tables"] == {} and s.fact("schema_version") is None and not s.has("t")


def test_store_parts(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/p")
    rows = spark.range(20).withColumn("part", (F.col("id") % 4).cast("int"))
    s.publish_parts({"t": rows}, 4)
    assert s.read("t").count() == 20 and {r["id"] % 4 for r in s.part("t", [1, 3]).collect()} == {1, 3}
    before = s.manifest()["tables"]["t"]["parts"]
    s.publish_parts({"t": rows.where("id = 2")}, 4, [2, 3])
    after = s.manifest()["tables"]["t"]["parts"]
    assert after["0"] == before["0"] and after["2"] != before["2"] and "3" not in after
    assert sorted(r["id"] for r in s.read("t").collect()) == [0, 1, 2, 4, 5, 8, 9, 12, 13, 16, 17]


def test_pins_and_tags(spark):
    known = spark.createDataFrame([("a", "1", None), ("b", "1", "x")], "k string, pin string, v string")
    wanted = spark.createDataFrame([("a", "1", None), ("b", "2", "x"), ("c", "1", "x")], "k string, pin string, v string")
    assert {r["k"]: r["skip"] for r in incremental.pins(known, wanted, ["k"], ["pin", "v"]).collect()} == {"a": True, "b": False, "c": False}
    tags, bridge = store.tag_tables(spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y", " "]), (3, None)], "id int, t array<string>"), "id", "t")
    names = {r["id"]: r["name"] for r in tags.collect()}
    assert {(r["example_id"], names[r["tag_id"]]) for r in bridge.collect()} == {(1, "x"), (1, "y"), (2, "y")}


def test_supertypes_through_inherited_members(spark):
    """A name only visible through a supertype of an enclosing type, found in a second round."""
    known = spark.createDataFrame([("p.Base",), ("p.Base.Builder",), ("p.Outer",), ("p.Outer.Inner",), ("p.Outer.Inner.Deep",), ("p.Base.Builder.Part",)], "fqn string")
    schema = "ref_id int, owner string, raw string, package string, enclosing array<string>, explicit map<string,string>, wildcards array<string>"
    refs = spark.createDataFrame([
        (1, "p.Outer", "Base", "p", ["p.Outer"], None, None), (2, "p.Outer.Inner", "Builder<T>", "p", ["p.Outer.Inner", "p.Outer"], None, None),
        (3, "p.Outer.Inner.Deep", "Part", "p", ["p.Outer.Inner.Deep", "p.Outer.Inner", "p.Outer"], None, None), (4, "p.Outer", "Lost", "p", ["p.Outer"], None, None),
        (5, "p.Outer", "Base", "q", ["p.Outer"], {"Base": "far.Base"}, ["p"]), (6, "p.Outer", "Base.Builder", "q", ["p.Outer"], None, ["p"]), (7, "p.Outer", "a[b", "p", ["p.Outer"], None, None),
    ], schema)
    got = {r["ref_id"]: r["target"] for r in graph.resolve_supertypes(refs, known).collect()}
    assert got == {1: "p.Base", 2: "p.Base.Builder", 3: "p.Base.Builder.Part", 4: None, 5: None, 6: "p.Base.Builder", 7: None}


def test_exit_codes():
    assert [quality.exit_code(*x) for x in ((0, 0, 0), (1, 1, 1), (0, 2, 1), (0, 0, 9))] == [0, 3, 4, 5]


def test_upsert_number_cache(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert {(r["k"], r["v"]) for r in store.upsert(old, new, ["k"], "o").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    got = store.numbered(spark.range(100).selectExpr("id * 7 % 100 as x"), ["x"]).collect()
    assert sorted((r["x"], r["id"]) for r in got) == [(i, i + 1) for i in range(100)]
    hits, misses = store.cached(spark.createDataFrame([("h", 1), ("h", 2)], "k string, version int"), spark.createDataFrame([("h", 1, "r")], "k string, version int, r string"), ["k", "version"])
    assert hits.count() == 1 and misses.count() == 1


def test_formats(spark, tmp_path):
    (tmp_path / "m.tsrg").write_text("tsrg2 a b\na/A x/X\n\tf g\n\tm (I)V n\nb/B y/Y\n\th i\n")
    got = [tuple(r) for r in formats.tsrg(formats.texts(spark, str(tmp_path / "m.tsrg"))).collect()]
    got = [r[1:] for r in got]
    assert ("a/A", "x/X", "method", "m", "n", "(I)V", False, None) in got and ("b/B", "y/Y", "field", "h", "i", None, False, None) in got
    (tmp_path / "v2.tsrg").write_text("tsrg2 a b c\na/A x/X 1\n\tf I g\n\tm (I)V n\n\t\tstatic\n\t\t0 o p\n\tk ()V l\n")
    got = {tuple(r)[3:] for r in formats.tsrg(formats.texts(spark, str(tmp_path / "v2.tsrg"))).collect()}
    assert {("field", "f", "g", "I", False, None), ("method", "m", "n", "(I)V", True, None), ("parameter", "m", "p", "(I)V", False, 0), ("method", "k", "l", "()V", False, None)} <= got and len(got) == 5
    (tmp_path / "p.txt").write_text("# c\nnet.A -> a:\n    int x -> b\n    1:2:void go(int,float) -> c\n")
    got = [tuple(r) for r in formats.proguard(formats.texts(spark, str(tmp_path / "p.txt"))).collect()]
    assert ("net.A", "a", "method", "void", "go", "(int,float)", "c") in got and ("net.A", "a", "field", "int", "x", "", "b") in got
    (tmp_path / "n.csv").write_bytes(b'searge,name,side,desc\r\nf1,a,0,"x, ""y"""\r\nf1,b,0,z\r\n,c,0,z\r\n')
    rows = formats.csv(spark, str(tmp_path / "n.csv"), "searge string, name string, side int, desc string")
    assert rows.first()["desc"] == 'x, "y"'
    assert [tuple(r) for r in formats.names(rows, "name").collect()] == [("f1", "b", "z")]
    tokens = spark.createDataFrame([("p_1", "x", 1), ("p_1", "y", 2), ("", "z", 3), ("p_2", "", 4)], "param string, name string, n int")
    assert [tuple(r) for r in formats.parameter_names(tokens, "n").collect()] == [("p_1", "y")]
    (tmp_path / "c.txt").write_text("# head\n\n12 own (I)V # tail\n13 other ()V\n")
    assert [tuple(r) for r in formats.sidecar(spark.read.text(str(tmp_path / "c.txt")), ["id", "owner", "desc"]).collect()] == [("12", "own", "(I)V"), ("13", "other", "()V")]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>u1</loc><priority>0.5</priority></url><url><loc>u2</loc></url></urlset>")
    assert {r["loc"] for r in formats.sitemap(spark, str(tmp_path / "s.xml")).collect()} == {"u1", "u2"}
    line = spark.createDataFrame([("https://a/b2024-01-02T03:04:05Zhttps://c/d2024-01-03T00:00:00Z",)], "value string")
    assert {r["loc"] for r in formats.sitemap_text(line).collect()} == {"https://a/b", "https://c/d"}
    (tmp_path / "j.json").write_text(json.dumps({"classes": [{"name": "A", "methods": [{"name": "m", "descriptor": "()V", "parameters": [{"index": 1, "name": "p"}]}]}]}))
    got = [tuple(r)[:6] for r in formats.documented_names(formats.texts(spark, str(tmp_path / "j.json"))).collect()]
    assert got == [("class", "A", "A", None, None, None), ("method", "A", "m", "()V", None, None), ("parameter", "A", "m", "()V", 1, "p")]
    listing = spark.createDataFrame([('<version>1.2</version><a href="1.3/">x</a>',)], "value string")
    assert {r[0] for r in formats.release_list(listing).collect()} == {"1.2", "1.3"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("top/a/A.java", "class A {}")
        z.writestr("top/a/package-info.java", "x")
    assert [tuple(r)[1:] for r in formats.archive(spark, str(tmp_path / "z.zip")).collect()] == [("a/A.java", "class A {}")]
    with pytest.raises(quality.QualityError):
        formats.archive(spark, str(tmp_path / "z.zip"), least=5)
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.yaml").write_text("topic: t\nentries:\n - {from: a}\n")
    (tmp_path / "y/b.yaml").write_text("topic: [unclosed")
    got = formats.topics(spark, str(tmp_path / "y")).collect()
    assert {(r["topic"], r["error"] is None) for r in got} == {("t", True), (None, False)}
    assert formats.topics(spark, str(tmp_path / "none")).count() == 0


def test_index_stream(spark, tmp_path):
    schema = "id bigint, text string, indexed_at timestamp"
    for i, rows in enumerate(([(1, "a b"), (2, "c")], [(2, "c"), (1, "z"), (3, None)])):
        spark.createDataFrame([(k, t) for k, t in rows], "id bigint, text string").withColumn("indexed_at", F.lit(f"2024-01-0{i + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = store.Store(spark, f"file://{tmp_path}/s")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        incremental.index_stream(stream, s, str(tmp_path / "cp")).awaitTermination()
    assert {(r["term"], r["id"]) for r in s.read("postings").collect()} == {("z", 1), ("c", 2)}
    assert s.read("docs").count() == 3


def test_event_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.limit(300).coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.sql(f"select * from {name}")

    assert run(windows.counts(read(), "1 hour"), "w1", "complete").agg(F.sum("n")).first()[0] == 300
    assert run(windows.once(read()), "w2", "append").count() == 300
    assert run(windows.running_totals(read()), "w3", "update").agg(F.sum("n")).first()[0] == 300
    assert run(windows.sessions(read()), "w4", "complete").agg(F.sum("n")).first()[0] == 300


def test_crawl(spark):
    urls = spark.createDataFrame([(f"https://h{i % 3}.example/{'fail' if i % 5 == 4 else 'gone' if i % 5 == 3 else 'ok'}/{i}",) for i in range(20)] + [(None,), ("https://h0.example/ok/0",)], "url string")

    def fetch(url):
        if "/fail/" in url:
            raise OSError("no answer")
        return (404, "x") if "/gone/" in url else (200, url[-1])

    got = {r["url"]: r for r in crawl.crawl(urls, fetch, workers=2, delay=0.0, attempts=2).collect()}
    assert len(got) == 20 and all((r["body"] is not None) == ("/ok/" in u) and r["attempts"] == (2 if "/fail/" in u else 1) for u, r in got.items())
    assert crawl.crawl(urls.limit(0), fetch).count() == 0


def test_install_refuses_what_does_not_verify(spark, tmp_path):
    release, live = store.Store(spark, f"file://{tmp_path}/r"), store.Store(spark, f"file://{tmp_path}/l")
    live.publish({"t": spark.range(1)})
    with pytest.raises(ValueError):
        crawl.install(release, live)
    release.publish({"t": spark.range(4)})
    spark.range(1).write.mode("append").parquet(f"file://{tmp_path}/r/{release.manifest()['tables']['t']['folder']}")
    with pytest.raises(ValueError):
        crawl.install(release, live)
    assert live.read("t").count() == 1
    with pytest.raises(KeyError, match="a://b"):
        crawl.read_static(crawl.static_documents(spark, {"a://b": "x"}), "a://c")


def test_derived_tables_follow_their_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    made = []

    def make(rows):
        made.append(1)
        return rows.selectExpr("id * 2 as twice")

    read = lambda: sorted(r[0] for r in tables.derived(spark, path, "twice", make).collect())
    assert read() == read() == [0, 2, 4] and len(made) == 1
    spark.range(5, 6).write.mode("append").parquet(path)
    assert read() == [0, 2, 4, 10] and len(made) == 2
    first = index.declared(spark, path, "id", F.col("id").cast("string"), "ids")
    assert first == index.declared(spark, path, "id", F.col("id").cast("string"), "ids") and {r["id"] for r in index.search(first, index.Term("5")).collect()} == {5}


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quern import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.workspace(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
