import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.hashing import fnv1a64, project_key
from quarry.functions.porter import stem
from quarry.functions.vectors import clamped_score, dot, from_bytes, norm, normalise, to_bytes


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


@pytest.mark.parametrize("text", ["", "a", "foobar", "über/π", "x" * 200])
def test_fnv(spark, text):
    assert one(spark, text, fnv1a64) == fnv(text)


def test_published_vector_and_key(spark):
    assert one(spark, "a", fnv1a64) == "af63dc4c8601ec8c"
    assert one(spark, "/home/x/shop", project_key) == "shop-" + fnv("/home/x/shop")
    assert one(spark, None, fnv1a64) is None


@pytest.mark.parametrize("text, want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""])])
def test_lines(spark, text, want):
    assert one(spark, text, T.lines) == want


def test_paths(spark):
    assert one(spark, " .\\src\\a.rs ", T.stored_path) == "src/a.rs"
    assert [one(spark, p, T.is_test_file) for p in ("latest_x.rs", "src/cart_test.rs", "test.rs", "src/tests/a.py")] == [True, False, True, True]
    assert [one(spark, p, T.indexable) for p in ("a.RS", "a.min.js", "package-lock.json", "x/.env", "b.md", "c.yaml")] == [True, False, False, False, True, True]
    assert one(spark, "a.TSX", T.language_of) == "tsx" and one(spark, "a.xyz", T.language_of) is None


def test_questions(spark):
    assert one(spark, "How does the cart_total work, and the VAT?", T.keyword_query) == '"cart_total" OR "work" OR "VAT"'
    assert one(spark, "?? is it", T.keyword_query) is None
    assert one(spark, "cart cart", T.keyword_terms) == ["cart", "cart"]
    assert one(spark, None, T.keyword_query) is None


def test_citation_marks(spark):
    got = one(spark, "See (src/a.rs:12), `./src/a.rs:12`, lib/b.py:3-9. At 10:30 or x:y, src/c.rs: no", T.citation_marks)
    assert [(c.path, c.line) for c in got] == [("src/a.rs", 12), ("lib/b.py", 3)]
    assert one(spark, None, T.citation_marks) == []


def test_ranking_reply(spark):
    rank = lambda x: T.parse_ranking(x, F.lit(4))
    assert one(spark, "[3], 1 then 3; 9 and 0, 99999999999999", rank) == [3, 1]
    assert one(spark, "none", rank) == []


def test_small_texts(spark):
    assert one(spark, "// c\n\n  fn a() {\n", T.first_signature_line) == "fn a() {"
    assert one(spark, "abcdef", lambda x: T.shorten(x, 3)) == "abc…" and one(spark, "abc", lambda x: T.shorten(x, 3)) == "abc"
    assert [one(spark, s, T.age_text, "long") for s in (5, 60, 7300, 200000)] == ["just now", "1 minute ago", "2 hours ago", "2 days ago"]
    assert one(spark, "function_item", T.chunk_type_of) == "function"
    assert T.same_model("nomic-embed-text:latest", "nomic-embed-text") and not T.same_model("a", None)
    assert T.task_prefixes("nomic-embed-text:v1.5") == ("search_document: ", "search_query: ") and T.task_prefixes("other") == ("", "")
    df = spark.createDataFrame([("src/a.rs:12",), ("src/a.rs",)], "x string").select(*T.split_target(F.col("x")))
    assert [tuple(r) for r in df.collect()] == [("src/a.rs", 12), ("src/a.rs", None)]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("controll", "control"), ("generalizations", "gener"), ("adoption", "adopt")])
def test_porter(word, want):
    assert stem(word) == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(dot("a", "b").alias("d"), norm(F.col("a")).alias("n"), normalise(F.col("a")).alias("u"), normalise(F.col("z")).alias("z"), from_bytes(to_bytes("a")).alias("back")).first() if False else df.select(
        dot(F.col("a"), F.col("b")).alias("d"), norm(F.col("a")).alias("n"), normalise(F.col("a")).alias("u"), normalise(F.col("z")).alias("z"), from_bytes(to_bytes(F.col("a"))).alias("back"), clamped_score(F.lit(-0.5), F.lit(0.8)).alias("c")
    ).first()
    assert (r.d, r.n, r.z, r.back, r.c) == (3.0, 5.0, [0.0, 0.0], [3.0, 4.0], 0.0)
    assert [round(x, 6) for x in r.u] == [0.6, 0.8]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=12))
def test_stem_never_fails(word):
    assert isinstance(stem(word.lower()), str) and zlib.crc32(b"") == 0
