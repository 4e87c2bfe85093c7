import math

import pytest
from pyspark.sql import functions as F

from lakeweave.functions import books as B
from lakeweave.operators import cells as C
from lakeweave.operators import evidence as E
from lakeweave.operators import listings as L
from lakeweave.operators import linear
from lakeweave.operators import losses as S
from lakeweave.operators import metrics as M
from lakeweave.operators import relevance as V


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_keys(spark):
    assert [tuple(r) for r in col(spark, ["0-306-40615-2", "9780306406157", "978030640615", "x1", "none", None], B.book_key)] == [("isbn13:9780306406157", "isbn13"), ("isbn13:9780306406157", "isbn13"), ("isbn10:978030640615", "isbn10_fallback"), ("isbn10:X1", "isbn10_fallback"), (None, "unusable"), (None, "unusable")]
    df = spark.createDataFrame([("https://Shop.test/a/77/sf/?x=1", "A", "B"), ("https://shop.test/a", "Good  Books", None), ("https://shop.test/a/", "", "B"), (None, None, None)], "u string, n string, l string")
    got = [tuple(r[0]) for r in df.select(B.seller_key(F.col("u"), F.col("n"), F.col("l"))).collect()]
    assert got[0] == ("shop:77", "storefront_id") and got[1][1] == "name_location" and got[2][1] == "url_only" and got[3] == (None, "missing")
    assert col(spark, ["https://x/inv/1.jpg", "https://x/cover/1.jpg", "https://x/none.gif", " ", None], lambda c: B.picture_kind(c, "x/inv/", "x/cover/")) == ["seller_photo", "stock_cover", "placeholder", None, None]


def test_shop_texts(spark):
    assert col(spark, [" N/A ", "unknown", "A fine copy", "", None, "abcdefghi"], lambda c: B.free_text(c, 7)) == [None, None, "A fine", None, None, "abcdefg"]
    assert col(spark, ["About 1,204 results found", "12 result", "no", None], B.result_count) == [1204, 12, None, None]
    assert col(spark, ["Name of the Countries", "Rankings", "The Value", "Glass", "City_Names", None], B.header_key) == ["country", "ranking", "the value", "glass", "city name", ""]
    got = col(spark, ["1,204.5 km/h", "12%", "-3", "12 a b", "1,2", "x", None], B.number_with_unit)
    assert [None if r is None else (float(r.number), r.unit) for r in got] == [(1204.5, "km/h"), (12.0, "%"), (-3.0, ""), None, None, None, None]
    df = spark.createDataFrame([("Kelby Station", "Kelby"), ("Kelby", "Kelby"), ("Kelby stop", "Ulm station"), ("A station", "A"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(B.same_but_suffix(F.col("a"), F.col("b"), (" railway station", " station", " stop"))).collect()] == [True, False, False, False, False]
    assert col(spark, ['Fine text. 97801AB "About the title" may', '"About the title" x', "plain", None], lambda c: B.without_notice(c, '"About the title', r"\s*\d+[A-Z]*")) == ["Fine text.", None, "plain", None]
    assert col(spark, ["a <|end|> &amp; b", None], lambda c: B.escape_markers(c, ("<|end|>",))) == ["a &lt;|end|> & b", ""]


def test_losses(spark):
    rows = [("a", "t1", 1.0, True), ("a", "t2", 0.5, False), ("a", "t3", -1.0, False), ("b", "t1", 2.0, True), ("c", "t1", 3.0, False)]
    df = spark.createDataFrame(rows, "q string, t string, s double, p boolean")
    mass = {r.q: r.loss for r in S.rank_mass_loss(df, ["q"], "s", F.col("p")).collect()}
    want = math.log(math.exp(1) + math.exp(0.5) + math.exp(-1)) - 1
    assert mass["a"] == pytest.approx(want) and mass["b"] is None and mass["c"] is None
    pair = {r.q: r.loss for r in S.pair_loss(df, ["q"], "s", F.col("p")).collect()}
    assert pair["a"] == pytest.approx(math.log(1 + math.exp(-0.5) + math.exp(-2))) and pair["b"] is None and pair["c"] is None
    same = {r.q: r.loss for r in S.list_divergence(df, ["q"], "s", "s").collect()}
    assert all(abs(v) < 1e-12 for v in same.values())
    top = {r.q: r.loss for r in S.top_list_divergence(df, ["q"], "s", "s", [F.col("t")], 1).collect()}
    assert top["a"] == pytest.approx(want) and top["b"] == pytest.approx(0) and {r.q: r.loss for r in S.top_list_divergence(df, ["q"], "s", "s", [F.col("t")], 0).collect()}["a"] == pytest.approx(0)
    huge = spark.createDataFrame([("a", 900.0, True), ("a", -900.0, False)], "q string, s double, p boolean")
    assert S.rank_mass_loss(huge, ["q"], "s", F.col("p")).first().loss == pytest.approx(0) and S.pair_loss(huge, ["q"], "s", F.col("p")).first().loss == pytest.approx(0)
    assert S.rank_mass_loss(df.limit(0), ["q"], "s", F.col("p")).count() == 0


def test_gate(spark):
    cells = [("q", 0, "entity_url", "https://w.test/wiki/Kelby_Bridge"), ("q", 0, "Name", "Kelby"), ("q", 0, "Year", "1900"), ("q", 1, "entity_url", "https://w.test/wiki/Ulm%20Mill/"), ("q", 1, "Name", "Other"), ("q", 2, "Name", "Tarn")]
    a = E.entity_anchors(spark.createDataFrame(cells, "query_id string, row int, column_name string, text string"))
    got = {(r.query_id, r.row): r.anchors for r in a.collect()}
    assert got == {("q", 0): ["kelby", "kelby bridge"], ("q", 1): ["ulm mill"]}
    tasks = [("t1", "q", 0, ["text"], ["The Kelby ferry"]), ("t2", "q", 0, ["text"], ["The Ulm Mill burned", "at Ulm mill."]), ("t3", "q", 0, ["text"], ["The Ulm Mill", "nothing"]), ("t4", "q", 0, ["text", "image"], ["x"]), ("t5", "q", 2, ["text"], ["Ulm Mill"]), ("t6", "q", 1, ["text"], ["Kelbyton"])]
    df = spark.createDataFrame(tasks, "task_id string, query_id string, row int, kinds array<string>, texts array<string>")
    want = {"t1": "CURRENT_ENTITY_PRESENT", "t2": "OTHER_ROWS_ONLY", "t3": "UNCERTAIN_PASS", "t4": "VISUAL_PASS", "t5": "NO_RELIABLE_ANCHOR_PASS", "t6": "UNCERTAIN_PASS"}
    assert {r.task_id: r.verdict for r in E.evidence_gate(df, a).collect()} == want


def test_unanchored_texts(spark):
    titles = spark.createDataFrame([(i, f"Common tower story number{chr(97 + i % 26)}{chr(97 + i // 26)} rare{chr(97 + i % 26)}x{chr(97 + i // 26)}") for i in range(100)] + [(200, "Common"), (201, None)], "row int, title string")
    texts = spark.createDataFrame([("in", 3, "about numberda and rareDxa here"), ("one", 3, "only numberda"), ("common", 200, "common tower"), ("none", 201, "x"), ("null", 3, None)], "id string, row int, text string")
    assert {r.id for r in V.unanchored_texts(titles, texts).collect()} == {"one", "common", "none", "null"}


def test_records(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, target_id string, rank int")
    paths = spark.createDataFrame([("q", "a", "e1", 0.5), ("q", "a", "e1", 0.9), ("q", "a", "e2", 0.7), ("q", "a", "e3", 0.7), ("q", "c", "e1", 1.0)], "query_id string, target_id string, evidence_id string, score double")
    assert [(r.target_id, r.evidence) for r in V.top_records(ranked, paths, 2, 2).orderBy("rank").collect()] == [("a", ["e1", "e2"]), ("b", [])]
    kinds = paths.withColumn("kind", F.when(F.col("evidence_id") == "e3", "image").otherwise("text"))
    assert {(r.kind, r.evidence_id) for r in V.one_per_kind(kinds, "kind", "score").collect()} == {("text", "e1"), ("image", "e3")}
    gold = spark.createDataFrame([("q", "a"), ("q", "z"), ("r", "a")], "query_id string, target_id string")
    metrics = {(r.query_id, r.size, r.hits, r.coverage, r.hit) for r in V.pool_metrics(ranked.withColumn("collection", F.lit("all")), gold).collect()}
    assert metrics == {("q", 3, 1, 0.5, True), ("r", 0, 0, 0.0, False)}
    assert tuple(V.first_hits(ranked, gold).first()) == (2, 0.5, 0.5, 0.5)


def test_detail_listing(spark):
    book = spark.createDataFrame([("b1", "https://s.test/x/?r=1", "S", "T", "A"), ("b2", None, "good books", "T", "A"), ("b3", None, None, "The  Title", "An"), ("b4", None, None, "none", None)], "b string, seller_url string, seller_name string, title string, authors string")
    cards = spark.createDataFrame([("b1", 1, "https://S.test/x", "other", "T", "A"), ("b1", 2, "https://s.test/y", "S", "T", "A"), ("b2", 3, None, "Good Books", "T", "A"), ("b3", 4, None, "x", "the title", "an"), ("b4", 5, None, "x", "y", "z")], "b string, listing_id int, seller_url string, seller_name string, title string, authors string")
    got = {r.b: (r.method, r.listings) for r in L.detail_listing(book, cards, "b").collect()}
    assert got == {"b1": ("seller_url", [1]), "b2": ("seller_name", [3]), "b3": ("title_authors", [4]), "b4": ("none", [])}


def test_views_of_columns(spark):
    assert col(spark, [[4, 2, 4], [], None], C.source_columns, "array<int>") == [{4: 0, 2: 1}, {}, None]
    df = spark.createDataFrame([([1, 2], [2, 3], [5, 1, 6]), ([1], [1, 2], [2, 1]), ([], [4], [])], "q array<int>, t array<int>, f array<int>")
    assert [None if r[0] is None else (r[0].query, r[0].target) for r in df.select(C.context_choice(F.col("q"), F.col("t"), F.col("f"))).collect()] == [([1, 2], [3, 5]), None, ([], [4])]
    df = spark.createDataFrame([(["a", "b"], ["x", ""], "a"), (["a", "b"], ["x", ""], "b"), (["a"], [None], "a")], "n array<string>, t array<string>, w string")
    assert [r[0] for r in df.select(C.shows_attribute(F.col("n"), F.col("t"), F.col("w"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(C.evidence_is_shown(F.col("n"), F.col("w"))).collect()] == [True, True, True]
    got = col(spark, [["a", "b", "c"], [], None], lambda c: C.permuted(F.lit("k"), c), "array<string>")
    assert sorted(got[0]) == [0, 1, 2] and got[1] == [] and got[2] is None


def test_bin_means(spark):
    rows = [("a", i, [float(i), 1.0]) for i in range(7)] + [("b", 0, [3.0, 4.0])]
    got = {(r.k, r.bin): r.mean for r in linear.bin_means(spark.createDataFrame(rows, "k string, p int, v array<double>"), "k", "p", "v", 3).collect()}
    edges = [(j * 7) // 3 for j in range(4)]
    want = {("a", j): [sum(range(edges[j], edges[j + 1])) / (edges[j + 1] - edges[j]), 1.0] for j in range(3)} | {("b", 0): [3.0, 4.0]}
    assert got == want


def test_paired_contrast(spark):
    left = spark.createDataFrame([(f"q{i}", f"g{i % 5}", 0.5 + i % 2, 1.0) for i in range(20)], "query_id string, g string, a double, b double")
    right = left.select("query_id", "g", F.lit(0.5).alias("a"), "b")
    got = {r.metric: r for r in M.paired_contrast(left, right, "g", ["a", "b"], 200).collect()}
    assert got["a"].delta == pytest.approx(0.5) and got["a"].w == 10 and got["a"].t == 10 and got["b"].delta == 0 and got["b"].low == got["b"].high == 0
    with pytest.raises(ValueError, match="different"):
        M.paired_contrast(left, right.filter("query_id <> 'q3'"), "g", ["a"], 10)
    with pytest.raises(ValueError, match="twice"):
        M.paired_contrast(left.union(left), right, "g", ["a"], 10)
