from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans import context

NODE = "id string, node_type string, repo string, api_paths array<string>, error_types array<string>, summary string"


def nodes(spark):
    return spark.createDataFrame(
        [("B", "UI", "r", ["/v1/cart"], ["CartError"], ""), ("A", "ui", "r", [], None, "s"), ("C", "Model", None, None, [None, "netexception"], None)], NODE
    )


def test_nodes(spark):
    n = nodes(spark)
    assert [r.id for r in search.list_nodes(n, "Ui").collect()] == ["A", "B"]
    assert [r.id for r in search.list_nodes(n, limit=2).collect()] == ["A", "B"]
    assert [r.id for r in search.by_api_path(n, "/v1/cart/items").collect()] == ["B"]
    assert [r.id for r in search.by_api_path(n, "cart").collect()] == ["B"]
    assert [r.id for r in search.by_error_type(n, "NetEx").collect()] == ["C"]
    assert search.by_api_path(n.limit(0), "x").count() == 0


FILES = [("r", "r/lib/Cart_bloc.dart", "one\nTwo\nthree\r\nfour TWO\n"), ("r", "r/build/cart_bloc.dart", "two"), ("s", "s/lib/x.js", "two\n\ntwo"), ("s", "s/lib/e.dart", ""), ("s", None, "two"), ("s", "s/lib/n.dart", None)]


def files(spark):
    return spark.createDataFrame(FILES, "repo string, path string, content string")


def test_filename(spark):
    m = spark.createDataFrame([("a", "q/other_Cart_bloc.dart"), ("b", None)], "id string, path string")
    assert [(r.path, r.in_graph) for r in search.by_filename(files(spark), m, "*CART?bloc*").collect()] == [("r/lib/Cart_bloc.dart", True)]
    assert [(r.path, r.in_graph) for r in search.by_filename(files(spark), m, "[en].dart", "s").collect()] == [("s/lib/e.dart", False), ("s/lib/n.dart", False)]


def test_grep(spark):
    got = {(r.path, r.line): r.snippet for r in search.grep(search.searched(files(spark)), "two", context=1).collect()}
    assert got == {
        ("r/lib/Cart_bloc.dart", 2): "   1:     one\n   2: >>> Two\n   3:     three",
        ("r/lib/Cart_bloc.dart", 4): "   3:     three\n   4: >>> four TWO",
        ("s/lib/x.js", 1): "   1: >>> two\n   2:     ",
        ("s/lib/x.js", 3): "   2:     \n   3: >>> two",
    }
    many = spark.createDataFrame([("p", "x\n" * 9)], "path string, content string")
    assert [r.line for r in search.grep(many, "X").orderBy("line").collect()] == [1, 2, 3]
    assert search.grep(files(spark), "two", max_files=1).select("path").distinct().count() == 1


def test_window(spark):
    text = spark.createDataFrame([("p", "".join(f"l{i}\n" for i in range(1, 13)))], "path string, content string")
    r = search.line_window(text, F.lit(10), F.lit(2)).first()
    assert (r.first, r.last, r.total, r.text) == (10, 11, 12, "  10: l10\n  11: l11")
    assert search.line_window(text, F.lit(99), F.lit(2)).first().text == "" and search.line_window(text, F.lit(-3), F.lit(1)).first().text == "   1: l1"
    code = spark.createDataFrame([("p", "a\nb\nc\nd\nclass Ab {\n}\n", "Ab"), ("q", "no", "Ab")], "path string, content string, name string")
    start = {r.path: (r.a, r.b) for r in code.select("path", search.class_start(F.col("content"), F.col("name"), F.lit(1)).alias("a"), search.class_start(F.col("content"), F.col("name"), F.lit(9)).alias("b")).collect()}
    assert start == {"p": (2, 7), "q": (1, 7)}
    snippet = {r.path: r.snippet for r in search.class_window(code, lines=2).collect()}
    assert snippet == {"p": "b\nc", "q": "no"}


def test_words(spark):
    lexicon = spark.createDataFrame([("Cart", "basket"), ("Pay", "money")], "token string, synonyms string")
    df = spark.createDataFrame([("PayCartCart",), ("paycart",), ("Xy",)], "id string")
    assert {r.id: r.synonyms for r in search.with_synonyms(df, "id", search.camel_words(F.col("id")), lexicon, ", ").collect()} == {"PayCartCart": "money, basket, basket"}
    q = spark.createDataFrame([("how does pay work with CART",)], "id string")
    assert search.with_synonyms(q, "id", search.query_words(F.col("id")), lexicon, " ").first().synonyms == "money"


def test_intent_preview_prompt(spark):
    df = spark.createDataFrame([("Luồng thanh toán",), ("fix the flow",), ("a CRASH",), ("hello",), (None,)], "q string")
    assert [r[0] for r in df.select(search.intent(F.col("q"))).collect()] == ["FLOW", "FLOW", "DEBUG", "GENERAL", "GENERAL"]
    p = spark.createDataFrame([("", "abcdef"), ("s", "abc"), (None, None)], "s string, c string")
    assert [r[0] for r in p.select(search.preview(F.col("s"), F.col("c"), 3)).collect()] == ["abc", None, None]
    assert p.select(search.preview(F.col("s"), F.col("c"), 0)).first()[0] is None
    text = df.select(context.prompt(F.col("q"), search.intent(F.col("q")), F.lit("flow"), F.lit("graph"), F.lit("rel"))).first()[0]
    assert "Luồng" in text and "real flow" in text
    assert context.expanded("Flash now") == "Flash now flash sale fsell product discount" and context.expanded("x") == "x"
