import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, chunking, citations, diff, graph, history, parsing, plan, ranking, scan, search
from quarry.streaming.watch import bursts

CHUNK = "id long, file_path string, language string, name string, chunk_type string, parent string, content string, start_line int, end_line int"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(
        [
            (1, "src/cart.rs", "rust", "Cart", "struct", None, "struct Cart {}", 1, 40), (2, "src/cart.rs", "rust", "total", "function", "Cart", "fn total() { tax() }", 10, 20),
            (3, "src/tax.rs", "rust", "tax", "function", None, "fn tax() { rate() }", 1, 9), (4, "src/rate.rs", "rust", "rate", "function", None, "fn rate() {}", 1, 3),
            (5, "src/cart.rs", "rust", "cart.rs", "module", None, "Module: src/cart.rs", 1, 1), (6, "src/main.rs", "rust", "main", "function", None, "fn main() { total() }", 1, 5),
        ],
        CHUNK,
    )


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([("tax", "src/cart.rs", 12, "call"), ("rate", "src/tax.rs", 2, "call"), ("total", "src/main.rs", 3, "call"), ("total", "src/main.rs", 3, "call"), ("total", "src/cart.rs", 15, "call"), ("Cart", "src/main.rs", 1, "import")], "symbol_name string, file_path string, line int, kind string")


def test_plan(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3"), (None, "9"), ("d", "4")], "path string, content_hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", None), ("gone", "7")], "path string, content_hash string")
    p = plan.plan_index(now, old)
    assert rows(p) == [("a", "new"), ("b", "unchanged"), ("c", "changed"), ("d", "changed"), ("gone", "removed")]
    assert plan.plan_counts(p).first() == (1, 2, 1, 1, True)
    assert rows(plan.files_to_index(p)) == [("a",), ("c",), ("d",)]
    empty = now.limit(0)
    assert plan.plan_counts(plan.plan_index(empty, empty)).first() == (0, 0, 0, 0, False)


def test_replace_and_remove(spark, chunks):
    fresh = spark.createDataFrame([(9, "src/tax.rs", "rust", "tax2", "function", None, "x", 1, 2)], CHUNK)
    assert {r[0] for r in rows(plan.replace_rows(chunks, fresh), "id")} == {1, 2, 4, 5, 6, 9}
    gone = spark.createDataFrame([("src/cart.rs",), ("src/cart.rs",)], "path string")
    assert {r[0] for r in rows(plan.remove_files(chunks, gone), "id")} == {3, 4, 6}
    assert plan.untracked(chunks, gone).count() == 3 and plan.tracked_only(chunks, gone).count() == 3


def test_scan(spark):
    f = spark.createDataFrame([("a.rs", "x"), ("b.rs", None), ("gcp-credentials.json", "{}"), ("c.py", "k = 'AKIA" + "A" * 16 + "'"), ("d.md", "y" * 5000), (".env", "z"), (None, "q")], "relative_path string, content string")
    got = {r.relative_path: r.skip_reason for r in scan.scan(f, 4096).collect()}
    assert got == {"a.rs": None, "b.rs": "unreadable", "gcp-credentials.json": "looks like it holds credentials", "c.py": "looks like it holds an AWS access key", "d.md": "4 KB, over the 4 KB limit"}
    assert {r.relative_path: r.skip_reason for r in scan.scan(f, 4096, True).collect()}["c.py"] is None


@pytest.mark.parametrize("n", [0, 1, 5, 6, 29, 30, 31, 55, 56, 130])
def test_line_windows(spark, n):
    text = "\n".join(f"l{k}" for k in range(n))
    f = spark.createDataFrame([("a.py", text, 1), (None, "x", 2), ("n.py", None, 3)], "relative_path string, content string, start_line int")
    got = sorted((r.start_line, r.end_line) for r in chunking.line_windows(f).collect())
    want, s = [], 0
    while s < n:
        want.append((s + 1, min(s + 30, n)))
        if s + 30 >= n:
            break
        s += 25
    assert got == want


def test_budget():
    rng = random.Random(1)
    for _ in range(40):
        text = "\n".join(rng.choice("aé漢") * rng.randrange(0, 900) for _ in range(rng.randrange(1, 30)))
        pieces = chunking.fit_budget("f", text, 7, 1000)
        assert all(len(c.encode()) <= 1000 for _, c, _, _ in pieces)
        assert pieces[0][2] == 7 and pieces[-1][3] == 7 + text.count("\n")
        assert all(b[2] - a[3] in (0, 1) for a, b in zip(pieces, pieces[1:]))
        bodies = [c if k == 0 else c.split("\n", 2)[2] for k, (_, c, _, _) in enumerate(pieces)]
        whole = bodies[0] + "".join(("" if a[3] == b[2] else "\n") + x for a, b, x in zip(pieces, pieces[1:], bodies[1:]))
        assert whole == text
    assert chunking.fit_budget("f", "x", 1) == [("f", "x", 1, 1)]
    assert [c[0] for c in chunking.fit_budget("m", "y" * 7000, 1)] == ["m-part-1-1"] * 3
    assert chunking.cut_bytes("éé", 3) == "é"


def test_graph(spark, chunks, refs):
    wanted = spark.createDataFrame([("Cart::total",), ("tax",), ("none",), ("Other::total",)], "symbol string")
    assert rows(graph.find_definitions(chunks, wanted), "symbol", "id") == [("Cart::total", 2), ("tax", 3)]
    assert graph.find_references(refs, wanted, True).where("symbol = 'Cart::total'").count() == 3
    e = graph.enclosing(refs.withColumn("symbol", F.lit("clash")), chunks)
    assert rows(e.where("line = 12"), "symbol", "symbol_id") == [("Cart::total", 2)]
    assert rows(e.where("kind = 'import'"), "symbol") == [("main",)]
    lost = spark.createDataFrame([("src/none.rs", 3), (None, 1), ("src/cart.rs", None)], "file_path string, line int")
    assert rows(graph.enclosing(lost, chunks), "symbol") == [(None,)] * 3
    ranges = spark.createDataFrame([(1, "src/cart.rs", 18, 30)], "range_id int, file_path string, start_line int, end_line int")
    assert rows(graph.symbols_in_range(ranges, chunks), "symbol_id") == [(1,), (2,)]
    assert rows(graph.file_lengths(chunks)) == [("src/cart.rs", 40), ("src/main.rs", 5), ("src/rate.rs", 3), ("src/tax.rs", 9)]


def test_interval_join_against_brute_force(spark):
    rng = random.Random(3)
    cs = [(i, f"f{rng.randrange(4)}", "x", f"n{i}", "function", None, "", a := rng.randrange(1, 60), a + rng.randrange(0, 30)) for i in range(120)]
    ps = [(f"f{rng.randrange(5)}", rng.randrange(1, 90)) for _ in range(200)]
    got = {(r.file_path, r.line): r.symbol_id for r in graph.enclosing(spark.createDataFrame(ps, "file_path string, line int"), spark.createDataFrame(cs, CHUNK)).collect()}
    for f, n in ps:
        held = [(c[8] - c[7], c[0]) for c in cs if c[1] == f and c[7] <= n <= c[8]]
        assert got[(f, n)] == (min(held)[1] if held else None)


def test_expansion_and_impact(spark, chunks, refs):
    results = spark.createDataFrame([(1, 1, 2, "src/cart.rs", 10, 20)], "query_id long, rank int, id long, file_path string, start_line int, end_line int")
    assert rows(graph.definitions_called_by(results, chunks, refs)) == [(1, 3, 1)]  # total calls itself and tax; total is a result already
    hunks = spark.createDataFrame([(0, 0, "src/cart.rs", 1, 1, 12, 0), (0, 1, "src/rate.rs", 1, 1, 2, 1)], "diff_id int, hunk_no int, file_path string, old_start int, old_count int, new_start int, new_count int")
    assert rows(graph.impacted_callers(hunks, chunks, refs), "symbol", "file_path", "line", "caller") == [("Cart::total", "src/main.rs", 3, "main"), ("rate", "src/tax.rs", 2, "tax")]
    left = graph.without_changed_code(chunks, hunks)
    assert {r.id for r in left.collect()} == {3, 6}


def test_bm25_against_sqlite(spark):
    rng = random.Random(5)
    vocabulary = "cart total tax rate invoice parsing parser parse loaded loading loads user_id naïve mapping".split()
    docs = [(i, f"src/{rng.choice(vocabulary)}.rs", "", rng.choice(vocabulary), "function", None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))), 1, 2) for i in range(1, 61)]
    asked = ["where is the cart total parsed", "loading user_id mapping", "invoice invoice tax"]
    c = spark.createDataFrame(docs, CHUNK)
    got = bm25.bm25(c, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 1000)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(name, content, file_path, tokenize = 'porter unicode61 remove_diacritics 0')")
    db.executemany("INSERT INTO t(rowid, name, content, file_path) VALUES (?, ?, ?, ?)", [(d[0], d[3], d[6], d[1]) for d in docs])
    mine = {(r.query_id, r.id): r.score for r in got.collect()}
    from quarry.functions.text import keyword_query

    for k, q in enumerate(asked):
        match = spark.createDataFrame([(q,)], "x string").select(keyword_query(F.col("x")).alias("q")).first().q
        want = dict(db.execute("SELECT rowid, -bm25(t, 10.0, 1.0, 2.0) FROM t WHERE t MATCH ?", (match,)).fetchall())
        assert {i for q_, i in mine if q_ == k} == set(want)
        assert all(abs(mine[(k, i)] - s) < 1e-9 for i, s in want.items())


def test_bm25_edges(spark, chunks):
    q = spark.createDataFrame([(1, None), (2, "?"), (3, "the")], "query_id long, text string")
    assert bm25.bm25(chunks, q).count() == 0
    assert bm25.bm25(chunks.limit(0), spark.createDataFrame([(1, "cart")], "query_id long, text string")).count() == 0


def test_ranking(spark):
    r = lambda *x: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(x)], "query_id long, id long, rank int")
    fused = ranking.fuse([r(10, 20, 30), r(40, 20)], 3)
    assert [(x.id, x.rank) for x in fused.orderBy("rank").collect()] == [(20, 1), (10, 2), (40, 3)]
    v = spark.createDataFrame([(1, "src/a.rs", [1.0, 0.0]), (2, "tests/test_a.rs", [1.0, 0.0]), (3, "b", [-1.0, 0.0]), (4, "c", [0.0, 0.0]), (5, "d", [1.0]), (6, "e", None)], "id long, file_path string, embedding array<float>")
    fit = v.where("id <> 5")
    assert rows(ranking.score_all(fit, [2.0, 0.0])) == [(1, 1.0), (2, 0.8), (3, 0.0)]
    with pytest.raises(Exception, match="other dimensions"):
        ranking.score_all(v, [2.0, 0.0]).collect()
    assert [x.id for x in ranking.top_k(ranking.score_all(fit, [2.0, 0.0]), 2).collect()] == [1, 2]
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    got = ranking.block_top_k(q, v, 2, 2)
    assert [(x.query_id, x.id, x.rank) for x in got.orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]
    reply = spark.createDataFrame([(1, "3, 1")], "query_id long, reply string")
    assert [x.id for x in ranking.apply_rerank(r(10, 20, 30), reply, 3).orderBy("rank").collect()] == [30, 10, 20]
    assert [x.id for x in ranking.apply_rerank(r(10, 20), reply.limit(0), 2).orderBy("rank").collect()] == [10, 20]
    assert ranking.candidate_count(5, True) == 15 and ranking.candidate_count(9, False) == 9
    m = spark.createDataFrame([(1, "a", 1, 0.5, False), (1, "b", 2, 0.9, True), (1, "b", 3, 0.7, False), (1, "b", 4, 0.8, True), (1, "c", 5, 0.1, True)], "query_id long, project string, id long, score double, found_via_calls boolean")
    assert [x.id for x in ranking.merge_workspace(m, 1).orderBy("rank").collect()] == [3, 2, 4]


def test_hybrid(spark, chunks, refs):
    c = chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float"), (F.col("id") / 10).cast("float")))
    q = spark.createDataFrame([(1, "cart total", [1.0, 0.2])], "query_id long, text string, embedding array<float>")
    hits = search.hybrid_search(c, refs, q, 2, 2)
    assert hits.where("not found_via_calls").count() == 2 and hits.where("found_via_calls").count() <= 2
    assert search.matched_keywords(hits, c, q).where("id = 2").first().matched_keywords == ["cart", "total"]


def test_citations(spark, chunks):
    a = spark.createDataFrame([(1, "see src/cart.rs:12 and src/cart.rs:99, also src/none.rs:1"), (2, None)], "id long, answer string")
    assert rows(citations.verify(a, chunks), "path", "line", "verified") == [("src/cart.rs", 12, True), ("src/cart.rs", 99, False), ("src/none.rs", 1, False)]


DIFF = """diff --git a/src/a.rs b/src/a.rs
index 1..2 100644
--- a/src/a.rs
+++ b/src/a.rs
@@ -1,3 +1,3 @@ fn x
 one
--- two
+++ zwei
 three
@@ -9 +9,2 @@
-x
+y
+z
\\ No newline at end of file
diff --git a/old.rs b/new.rs
similarity index 100%
rename from old.rs
rename to new.rs
diff --git a/gone.rs b/gone.rs
deleted file mode 100644
--- a/gone.rs
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/img.png b/img.png
new file mode 100644
Binary files /dev/null and b/img.png differ
"""


def test_diff(spark):
    a, b, c, d = diff.parse_diff(DIFF)
    assert (a.path, a.change, [h[:4] for h in a.hunks]) == ("src/a.rs", "modified", [(1, 3, 1, 3), (9, 1, 9, 2)])
    assert "--- two" in a.hunks[0][4]
    assert (b.path, b.change, b.renamed_from, b.hunks) == ("new.rs", "renamed", "old.rs", [])
    assert (c.path, c.change, d.path, d.change) == ("gone.rs", "deleted", "img.png", "added")
    plain = diff.parse_diff("--- a.c\t2024-01-01\n+++ a.c\t2024-01-02\n@@ -1 +1 @@\n-a\n+b\n--- a/b.c\n+++ b/b.c\n@@ -1 +1 @@\n-a\n+b\n")
    assert [(f.path, len(f.hunks)) for f in plain] == [("a.c", 1), ("b.c", 1)]
    got = diff.diff_hunks(spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "diff_id long, text string"))
    assert got.count() == 5 and rows(diff.candidate_paths(got.where("change = 'renamed'")), "path") == [("new.rs",), ("old.rs",)]
    shown, left = diff.render_diff([diff.FileChange("a", hunks=[(1, 1, 1, 1, "+" + "x" * 5000 + "\n"), (2, 1, 2, 1, "+y\n")])], 3000)
    assert left == 1 and "+y" in shown


def test_history(spark):
    t = spark.createDataFrame([(1, " s1 ", "2024", "q1", "a1", '[{"file_path": "a.rs", "start_line": 1, "end_line": 2, "score": 0.5}]'), (2, "s1", "2025", "q2", None, "[{"), (3, None, "x", "y", "z", "[]")], "id long, session_id string, asked_at string, question string, answer string, citations string")
    text = history.transcripts(t).first().transcript
    assert text.index("q1") < text.index("q2") and "`a.rs:1-2` (score 0.50)" in text and "_No answer was recorded" in text and "**Sources:** none" in text
    assert [r.id for r in history.recent_turns(t, 2).collect()] == [3, 2]
    assert history.count_turns(t.limit(0)).first() == (0, 0, 0)


def test_parsing():
    source = 'import os\nfrom a.b import c\n\nMAX = 3\n\n# adds\n@wrap\ndef f(x):\n    return g(x).h()\n\nclass K:\n    """Doc."""\n\n    def m(self):\n        pass\n'
    cs, rs = parsing.parse_source("x/y.py", source)
    assert [(c[1], c[2], c[3], c[5], c[6]) for c in cs] == [("y.py", "module", None, 1, 5), ("f", "function", None, 6, 9), ("K", "class", None, 11, 15), ("m", "function", "K", 14, 15)]
    assert "..." in cs[2][4] and "Defines: f (function), K (class), K::m (function)" in cs[0][4] and "MAX = 3" in cs[0][4]
    assert ("g", 9, "call") in rs and ("h", 9, "call") in rs and ("os", 1, "import") in rs and ("c", 2, "import") in rs
    rust = "use crate::tax::rate;\n\n/// Doc.\npub fn total(a: u32) -> u32 {\n    let s = \"{ (\";\n    rate(a)\n}\n\nimpl Cart {\n    fn add(&self) { total(1) }\n}\n"
    cs, rs = parsing.parse_source("a.rs", rust)
    assert [(c[1], c[2], c[3], c[5], c[6]) for c in cs[1:]] == [("total", "function", None, 3, 7), ("Cart", "impl", None, 9, 11), ("add", "function", "Cart", 10, 10)]
    assert [r for r in rs if r[2] == "call"] == [("rate", 6, "call"), ("total", 10, "call")]
    assert parsing.parse_source("a.py", "def (:\n")[0][0][2] == "general" and parsing.parse_source("a.py", "") == ([], [])
    assert len(parsing.parse_source("notes.md", "x\n" * 70)[0]) == 3


@pytest.mark.parametrize("path, text, found, calls, imports", [
    ("a.c", '#include "util/list.h"\n\n/* Adds. */\nstatic int add(int a, int b) {\n    if (a) { return sum(a, b); }\n    return 0;\n}\n\nstruct item {\n    int id;\n};\n', [("add", "function", None), ("item", "struct", None)], ["sum"], ["list", "h"]),
    ("a.cpp", "namespace shop {\nclass Cart {\npublic:\n    int total() const { return rate(1); }\n};\n}\nint Cart::size() { return 0; }\n", [("shop", "namespace", None), ("Cart", "class", "shop"), ("total", "method", "Cart"), ("size", "method", "Cart")], ["rate"], []),
    ("A.cs", "using System.Text;\n\npublic class Cart : Base\n{\n    public async Task<int> Total(int a)\n    {\n        return Rate(a);\n    }\n}\n", [("Cart", "class", None), ("Total", "method", "Cart")], ["Rate"], ["Text"]),
    ("a.kt", "import shop.tax.Rate\n\ndata class Item(val id: Int) {\n    fun total(a: Int): Int {\n        return rate(a)\n    }\n}\n", [("Item", "class", None), ("total", "function", "Item")], ["rate"], ["Rate"]),
    ("a.swift", "import Foundation\n\nstruct Cart {\n    func total(_ a: Int) -> Int {\n        return rate(a)\n    }\n}\n", [("Cart", "struct", None), ("total", "function", "Cart")], ["rate"], ["Foundation"]),
    ("a.php", "<?php\nuse Shop\\Tax\\Rate;\n\n# a } in a comment\nclass Cart {\n    public function total($a) {\n        return rate($a);\n    }\n}\n", [("Cart", "class", None), ("total", "function", "Cart")], ["rate"], ["Rate"]),
    ("a.sh", "source lib/util.sh\n\n# deploys { it\ndeploy() {\n  echo \"}\"\n}\nfunction clean {\n  rm x\n}\n", [("deploy", "function", None), ("clean", "function", None)], [], ["util", "sh"]),
    ("a.rb", "require 'shop/tax'\n\nmodule Shop\n  # Adds.\n  class Cart\n    def total(a)\n      rate(a)\n    end\n  end\nend\n", [("Shop", "module", None), ("Cart", "class", "Shop"), ("total", "method", "Cart")], ["rate"], ["tax"]),
])
def test_parsing_of_other_languages(path, text, found, calls, imports):
    chunks, refs = parsing.parse_source(path, text)
    assert [(c[1], c[2], c[3]) for c in chunks[1:]] == found and chunks[0][2] == "module"
    assert [r[0] for r in refs if r[2] == "call"] == calls and [r[0] for r in refs if r[2] == "import"] == imports


def test_bursts(spark):
    ev = spark.createDataFrame([(0.0, "create", "a.rs"), (0.5, "access", "b"), (1.2, "modify", "c.rs"), (5.0, "access", "d"), (9.0, "remove", "e.py")], "t double, kind string, path string").select(F.col("t").cast("timestamp").alias("ts"), "kind", "path")
    from quarry.streaming.watch import relevant

    got = bursts(ev, relevant(F.col("kind"), F.col("path")))
    assert rows(got, "events", "relevant") == [(1, 1), (3, 2)]
