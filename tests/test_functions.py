import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deducta import values as V
from deducta.functions import computed as C
from deducta.functions import scalars as S
from deducta.operators import dispatch as D
from deducta.operators.pattern import ANY, Var
from deducta.sources.text_index import Provider, Sources
from deducta.values import RelationError

from .conftest import rows


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) if values else [F.lit(1).alias("x")])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "want"), [("", []), ("a  b", ["a", "b"]), ('say "two words" x', ["say", "two words", "x"]), ("a\\ b c", ["a b", "c"]), ('q"u"o', ["quo"]), ("end\\", ["end\\"]), ('""', []), ('"open x', ["open x"]), ("t\tn\n", ["t", "n"])])
def test_words(spark, text, want):
    assert S.split_words(text) == want and one(spark, S.words("s"), s=text) == want


@pytest.mark.parametrize(("text", "want"), [("first", 1), (" Twenty-First ", 21), ("3rd", 3), ("21.", 21), ("12", 12), ("0th", None), ("", None), ("x", None), ("ninety-ninth", 99), ("-3", None), ("twenty-", None)])
def test_ordinals(spark, text, want):
    assert one(spark, S.parse_ordinal("s"), s=text) == want


def test_strings(spark):
    assert one(spark, S.string_slice("s", 1, 3), s="héllo") == "él"
    for a, b in ((-1, 2), (3, 2), (0, 6)):
        with pytest.raises(Exception, match="E_INDEX"):
            one(spark, S.string_slice("s", a, b), s="hello")
    assert one(spark, S.string_chars("s"), s="a🙂") == ["a", "🙂"] and one(spark, S.string_len("s"), s="a🙂") == 2
    assert one(spark, S.url_encode_component("s"), s="a b*~é/-_.") == "a%20b%2A~%C3%A9%2F-_." and one(spark, S.url_decode_component("s"), s="a+b%20c") == "a b c"
    assert one(spark, S.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3 and one(spark, S.string_equal_fold(F.lit("ÄB"), F.lit("äb")))
    assert one(spark, S.from_literal(F.lit("42"), "bigint")) == 42 and one(spark, S.to_literal(F.lit("a"))) == '"a"'


def test_collections_and_json(spark):
    v = F.array(F.lit(3), F.lit(1))
    assert one(spark, S.index(v, 1)) == 1 and one(spark, S.index_or(v, 5, 9)) == 9 and one(spark, S.list_slice(v, 0, 1)) == [3, 1] and one(spark, S.list_set(v, 0, 7)) == [7, 1]
    for bad in (S.index(v, 2), S.list_slice(v, 1, 2), S.list_set(v, 2, 0), S.map_get(F.create_map(F.lit("a"), F.lit(1)), "b")):
        with pytest.raises(Exception, match="E_INDEX"):
            one(spark, bad)
    assert one(spark, S.map_set(F.create_map(F.lit("a"), F.lit(1)), "a", F.lit(2))) == {"a": 2}
    assert one(spark, S.json_decode(F.lit('{"a": 1}'), "a int")).a == 1 and one(spark, S.json_is_null(F.lit('{"a": null}'), "$.a"))
    for text, ok in (("[1, 2.5, null]", True), ("1 2", False), (str(1 << 60), False), ("1e99", False), ("NaN", False), ("", False)):
        assert one(spark, S.json_valid(F.lit(text))) is ok


def test_embedding(spark):
    got = one(spark, S.embed_text("s"), s="abc")
    want = [0.0] * 8
    for i, ch in enumerate("abc"):
        want[(ord(ch) + i) % 8] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert got == pytest.approx([x / norm for x in want]) and one(spark, S.embed_text("s"), s="") == [0.0] * 8


def test_exact_comparison(spark):
    cases = [(9007199254740993, 9007199254740992.0, ">"), (2, 2.5, "<"), (3, 2.5, ">"), (2, 2.0, "="), (-1, -1.5, ">"), (5, 1e300, "<"), (5, -1e300, ">"), (0, -0.0, "=")]
    df = spark.createDataFrame(cases, "i long, f double, want string")
    i, f = df.schema["i"].dataType, df.schema["f"].dataType
    for op, true_for in (("=", "="), ("<", "<"), (">", ">"), ("!=", "<>"), ("<=", "<="), (">=", ">=")):
        got = df.select(V.compare(op, F.col("i"), i, F.col("f"), f).alias("r"), V.compare(V.FLIP[op], F.col("f"), f, F.col("i"), i).alias("q"), "want").collect()
        assert all(r.r == r.q == (r.want in true_for) for r in got)


def test_arithmetic(spark):
    df = spark.createDataFrame([(7, 2, 0.5)], "a long, b long, f double")
    a, f = df.schema["a"].dataType, df.schema["f"].dataType
    do = lambda op, x, tx, y, ty: df.select(V.arithmetic(op, F.col(x), tx, F.col(y), ty).alias("r")).first().r
    assert do("+", "a", a, "b", a) == 9 and do("%", "a", a, "b", a) == 1 and do("*", "a", a, "f", f) == 3.5
    assert tuple(df.select(V.divide(F.col("a"), F.col("b")).alias("r")).first().r) == (None, 3.5) and df.select(V.negate(F.col("a"), a).alias("r")).first().r == -7
    big = spark.createDataFrame([(1 << 54, 0)], "a long, b long")
    for op, code in (("+", "E_ARITH"), ("*", "E_ARITH")):
        with pytest.raises(Exception, match=code):
            big.select(V.arithmetic(op, F.col("a"), a, F.col("a"), a)).collect()
    with pytest.raises(Exception, match="E_DIV"):
        big.select(V.divide(F.col("a"), F.col("b"))).collect()


def test_canonical_map(spark):
    df = spark.createDataFrame([(["b", "a", "b"], [1, 2, 3])], "k array<string>, v array<int>")
    assert [tuple(x) for x in df.select(V.canonical_map(F.col("k"), F.col("v")).alias("m")).first().m] == [("a", 2), ("b", 3)]


def test_nearest(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0]), (3, [2.0, 0.1])], "e long, v array<double>")
    of = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c")], "e long, s string")
    inside = spark.createDataFrame([("i", n) for n in range(4)], "i string, e long")
    rel = C.nearest_embedding(inside, of, vectors, version=3)
    assert [r.subject for r in rel.scan("i", 0, 2, Var("s"), ANY, ANY).collect()] == ["a", "c"]
    assert rel.scan("i", 0, 5, "b", ANY, ANY).first().score == pytest.approx(0.70710678)
    with pytest.raises(RelationError, match="needs k"):
        rel.scan("i", 0, ANY, ANY, ANY, ANY)
    with pytest.raises(Exception, match="E_VECTOR"):
        C.nearest(spark.createDataFrame([("z", [0.0, 0.0])], "s string, v array<double>"), [1.0, 0.0], 1, "s", "v").collect()
    registry = C.Registry()
    registry.register(rel)
    with pytest.raises(RelationError, match="E_READ_ONLY"):
        registry.assert_("NearestEmbedding")


def test_chunks():
    assert C.chunk_lines("a\nb\n\nc\n", 2, 99) == [(1, 2, "a\nb"), (3, 4, "\nc")]
    assert C.chunk_lines("aaaa\nbbbb\ncc", 9, 9) == [(1, 2, "aaaa\nbbbb"), (3, 3, "cc")]
    assert C.chunk_lines("ab\nééééé\nz", 9, 4) == [(1, 1, "ab"), (2, 2, "éé"), (2, 2, "éé"), (2, 2, "é"), (3, 3, "z")]
    assert C.chunk_lines("", 2, 9) == [] and C.chunk_lines("\n \n", 2, 9) == []


def test_text_index_and_search(spark):
    files = spark.createDataFrame([("r", "docs/guide.md", "The Guide\nhow to join relations\n"), ("r", "src/join.rs", "fn join() {}\n"), ("r", "tests/other.rs", "nothing here\n"), ("q", "x", "join")], "repository string, path string, text string")
    s = Sources(spark)
    s.register(Provider("p", "files", files))
    s.register(Provider("gone", "none", None))
    assert s.build("i", "r", "1", "p").status == "complete" and s.build("j", "r", "1", "gone").status == "failed"
    v = s.views()
    assert rows(v["IndexStatus"]) == {("i", "complete"), ("j", "failed")} and rows(v["ProviderAvailable"]) == {("p",)} and v["IndexBuildError"].count() == 1
    rel = {c.name: c for c in s.relations()}
    found = rel["IndexedTextSearch"].scan("i", "join", 10, ANY, *[ANY] * 7).collect()
    # query in path, title and text, term in file name, path, title and text; and query and term in text
    assert [(r.path, r.score) for r in found] == [("src/join.rs", 1030), ("docs/guide.md", 175)]
    assert [r.path for r in rel["IndexedTextSearch"].scan("i", "join", 10, "docs", *[ANY] * 7).collect()] == ["docs/guide.md"]
    assert rel["IndexedTextUnit"].scan("i", *[ANY] * 8).count() == 3 and rel["IndexedFile"].scan("i", *[ANY] * 5).count() == 3 and rel["IndexedFile"].scan("none", *[ANY] * 5).count() == 0
    assert rel["FileText"].scan("p", "q", ANY, Var("t")).first().text == "join" and rel["RepositoryEntry"].scan("p", "r", ANY, ANY).count() == 3


def test_search_symbols_snippets_and_terms(spark):
    assert C.search_terms("Foo, bar-baz_1 foo!") == ["bar-baz_1", "foo"]
    units = spark.createDataFrame([("r", "u", 1, "rs", "t", "a.rs", 5, 9, "m", "h\n" + "x " * 60 + "Needle" + " y" * 150)], "repository string, unit string, ordinal int, kind string, title string, path string, start_line int, end_line int, model string, text string")
    symbols = spark.createDataFrame([("r", "a.rs", "needle", 7, 7), ("r", "a.rs", "needles", 1, 5), ("r", "a.rs", "needle", 10, 12)], "repository string, path string, name string, start_line int, end_line int")
    (hit,) = C.text_search(units, "needle", 5, symbols=symbols).collect()
    assert hit.score == 120 + 55 + 320 + 190 and hit.match_line == 5
    assert hit.snippet.startswith("...x x") and hit.snippet.endswith("y...") and len(hit.snippet) == 3 + 70 + 190 + 3
    assert C.text_search(units, "!!", 5).count() == 0


def test_facts_about_a_subject(spark):
    rel = {"E": spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a long, b long"), "N": spark.createDataFrame([(1, "1")], "k int, n string")}
    assert rows(C.subject_facts(rel, 1).selectExpr("relation", "array_join(tuple, '|')")) == {("E", "1|2"), ("N", '1|"1"')}
    assert rows(C.mentioned_facts(rel, 1).selectExpr("relation", "position", "array_join(tuple, '|')")) == {("E", 0, "1|2"), ("E", 1, "2|1"), ("N", 0, '1|"1"')}


def test_dispatch_of_frobs_and_positions(spark):
    frame = spark.createDataFrame
    selectors = frame([("m", "go"), ("n", "go"), ("o", "go"), ("p", "go")], "method string, selector string")
    params = frame([("m", "x", "Int", 0), ("n", "x", "frob:base", 0), ("o", "x", "Frob", 0), ("p", "x", "*", 0), ("p", "y", "*", 1)], "method string, role string, restriction string, position int")
    up = D.reach(frame([("kind", "base", 0)], "child string, parent string, ord int"))
    calls = frame([(1, "go"), (2, "go")], "call int, selector string")
    args = frame([(1, "x", "f", "Frob", "kind"), (2, "x", "5", "Int", None), (2, "y", "6", "Int", None)], "call int, role string, value string, prototype string, delegate string")
    assert rows(D.applicable(selectors, params, calls, args, up)) == {(1, "n"), (1, "o"), (2, "m"), (2, "p")}
    by_place = args.withColumn("role", F.when(F.col("role") == "x", "0").otherwise("1"))
    placed = params.withColumn("position", F.col("position").cast("string"))
    found = D.applicable(selectors, placed, calls, by_place, up, by="position", exact=True)
    assert rows(found) == {(1, "n"), (1, "o"), (2, "p")}
    assert rows(D.ordered_arguments(frame([(2, "p")], "call int, method string"), params, args).selectExpr("call", "method", "array_join(args, ',')")) == {(2, "p", "5,6")}
    assert rows(D.programs(frame([(2, "p")], "call int, method string"), frame([("p", "code")], "method string, program string"))) == {(2, "p", "code")}


def test_ranges_updates_and_truth(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    v = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert get(S.list_slice(v, 1, 2)) == [2, 3] and get(S.list_slice(v, 0, 0)) == [1] and get(S.list_slice(v, 1)) == [2, 3] and get(S.list_slice(v, 3)) == []
    for first, last in ((-2, -1), (2, 0), (0, 3), (4, None)):
        with pytest.raises(Exception, match="E_INDEX"):
            get(S.list_slice(v, first, last))
    assert get(S.list_set(v, 1, 9)) == [1, 9, 3]
    for at in (-1, 3):
        with pytest.raises(Exception, match="E_INDEX"):
            get(S.list_set(v, at, 9))
    assert [get(S.truthy(c, t)) for c, t in ((F.lit(False), T.BooleanType()), (F.lit(0), T.LongType()), (F.lit(""), T.StringType()), (F.array(), T.ArrayType(T.LongType())), (v, T.ArrayType(T.LongType())))] == [False, True, True, False, True]


def test_literals_and_urls(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(S.from_literal(F.lit(" 12 "), "long")) == 12 and get(S.from_literal(F.lit('"a, b"'), "string")) == "a, b" and get(S.from_literal(F.lit("[1, 2]"), "array<long>")) == [1, 2]
    assert get(S.from_literal(F.lit('{"a": 1}'), "map<string,long>")) == {"a": 1} and get(S.from_literal(F.lit(":open"), "symbol")) == "open" and get(S.from_literal(F.lit("#12"), "identity")) == 12
    for text, kind in (('1, "x": 2', "long"), ("1 2", "long"), ("open", "symbol"), ("#x", "identity"), ('{"a": 1', "map<string,long>")):
        with pytest.raises(Exception, match="E_TYPE"):
            get(S.from_literal(F.lit(text), kind))
    assert get(S.url_decode_component(F.lit("a%C3%A4+b"))) == "aä b" and get(S.url_decode_component(F.lit("%E2%82%AC%21"))) == "€!"
    for bad in ("%FF", "%C3", "%zz", "a%2"):
        with pytest.raises(Exception, match="E_TYPE"):
            get(S.url_decode_component(F.lit(bad)))


def test_text_embedding_counts_characters_by_place(spark):
    texts = ["", "abc", "äöü€ x" * 50]
    for text, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.embed_text("t").alias("e")).collect():
        counts = [sum((ord(c) + i) % 8 == b for i, c in enumerate(text)) for b in range(8)]
        norm = sum(x * x for x in counts) ** 0.5 or 1
        assert got == pytest.approx([x / norm for x in counts])


def test_units_are_bounded_by_bytes_and_lines():
    text = "\n".join(["short"] * 100 + ["ä" * 1500, "", "end"])
    units = C.chunk_lines(text)
    assert all(b - a < 40 and len(t.encode()) <= 1200 for a, b, t in units) and [u[0] for u in units[:3]] == [1, 41, 81]
    assert "".join(t for _, _, t in units).replace("\n", "") == text.replace("\n", "")
