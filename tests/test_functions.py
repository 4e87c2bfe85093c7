import pytest
from pyspark.sql import functions as F

from lakeweave.functions import books as B
from lakeweave.functions import text as T
from lakeweave.functions import vectors as X
from lakeweave.functions.values import decimal_text, parsed_answer, with_value


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_text(spark):
    assert col(spark, ["a &amp;\xa0 b", None, " x\n y "], T.clean_text) == ["a & b", "", "x y"]
    assert col(spark, ["A_b: C%", "Straße—É"], T.normalize) == ["a b c%", "strasse é"]
    assert col(spark, ["１２ – Ａ", "A  B"], T.norm) == ["12 - a", "a b"]
    assert col(spark, ["It’s O'Neil"], T.text_key) == ["its oneil"]
    assert col(spark, ["Caf%C3%A9_é"], T.gate_norm) == ["cafe e"]
    assert col(spark, ["1,000", "5%", "1_0", "nan", "x", "", "1e5", "."], T.is_number) == [True, True, True, True, False, False, True, False]
    assert col(spark, ["March 5, 1999 x", "Foo 1, 2000", None], T.iso_date) == ["1999-03-05", None, None]
    assert col(spark, ["in 1850 or", "20500", None], T.as_year) == [1850, None, None]
    assert col(spark, ["US$ -1,234.5 x", "x"], T.as_float) == [-1234.5, None]
    assert col(spark, ["a b/ü*~+"], T.percent_encode) == ["a%20b/%C3%BC%2A~%2B"]
    assert col(spark, ["HTTP://Ex.Org/A/?q#f", "nope"], T.bare_url) == ["http://ex.org/A", None]
    assert col(spark, ["http://localhost/x", "http://10.0.0.1/", "https://Ex.org:443/a#b", "http://u:p@ex.org/", "ftp://ex.org"], T.public_url) == [None, None, "https://ex.org/a", None, None]


@pytest.mark.parametrize(("a", "b", "want"), [("Foo", " foo ", True), ("1000", "1000.0", True), ("1,000", "1000", False), ("12", "13", False), ("tower of x", "tower", True), ("abc", "ab", False), ("", "x", False)])
def test_values_match(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.values_match("a", "b")).first()[0] is want


def test_typed_values(spark):
    raw = ["1,200.50", "-0.0", "007", "12%", "2020-02-30", "2020-02-28", "https://x.y", "\\a", "U+00E9", "!!", "Room 07.50", "n/a", None, "+3"]
    df = with_value(spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, x string"), "x")
    got = [(r.v_kind, r.v_key, list(r.v_digits)) for r in df.orderBy("i").collect()]
    assert got[0] == ("NUMBER", "NUMBER:1200.5", ["1200.5"])
    assert got[1][1] == "NUMBER:0" and got[2][0] == "ID" and got[3] == ("PERCENT", "PERCENT:12", ["12"])
    assert got[4][0] == "TEXT" and got[5][0] == "DATE" and got[6][0] == "URL" and got[7][0] == got[8][0] == got[9][0] == "SYMBOL"
    assert got[10] == ("TEXT", "TEXT:room 07.50", ["7.5"]) and got[11][1] is None and got[12][1] is None and got[13][1] == "NUMBER:3"
    assert col(spark, ["0.000", "100", "1.10", "-0"], decimal_text) == ["0", "100", "1.1", "0"]


def test_answers(spark):
    raw = ['"x"', "```json\n\"y z\"\n```", "null", "nope", '""', '"n/a"', "3"]
    got = [(r["status"], r["value"]) for r in col(spark, raw, parsed_answer)]
    assert got == [("VALUE", "x"), ("VALUE", "y z"), ("INSUFFICIENT_EVIDENCE", None), ("PARSE_ERROR", None), ("PARSE_ERROR", None), ("NORMALIZED_EMPTY", None), ("PARSE_ERROR", None)]


def test_books(spark):
    assert col(spark, ["0-306-40615-2", "978-0-306-40615-7", "9780306406158", "x", None], B.isbn13) == ["9780306406157", "9780306406157", None, None, None]
    same = [("Doe, Jane", "Jane Doe"), ("Joe Kaplan, Ryan Dunn", "Joe Kaplan; Ryan Dunn"), ("Michael D. Duffy", "Michael D Duffy"), ("Smith, John; Doe, Jane", "john smith jane doe")]
    for a, b in same:
        assert len(set(col(spark, [a, b], B.author_key))) == 1
    other = ["William Ford", "William Ford; William Topp", "Smith", "Roderick W. Smith", "Smith, Jr.", "O'Bee, Ann"]
    assert col(spark, other, B.author_key) == ["william ford", "william ford william topp", "smith", "roderick w smith", "smith jr", "ann obee"]
    assert col(spark, ["-", "0", " N/A ", "", None, "unknown"], B.author_key) == [""] * 6
    lists = ["Smith, John; Doe, Jane", "Doe, Jane, Smith, John", "Jane Doe and John Smith", "Jane Doe & John Smith:", "Jane Doe, John Smith", "Jane Doe, Smith", "Jane Doe, editor", "Jane Doe; Jane Doe", "Jane", "Jane 2 Doe", "Doe,, Jane", "", None, "Müller, Jörg et Doe, Jane"]
    assert col(spark, lists, B.author_names) == [["jane doe", "john smith"]] * 5 + [[]] * 8 + [["jane doe", "jörg müller"]]
    assert col(spark, ["Johnsonbaugh, Richard ; Schaefer, Marcus", "Ben-Ari, M."], B.natural_names) == ["Richard Johnsonbaugh; Marcus Schaefer", "M. Ben-Ari"]
    kept = ["Pohl, Ira, Kelley, Al", "Zelkovitz, Marvin W. Ed.", "Surname, Jr.", "0", "Walter Savitch", None]
    assert col(spark, kept, B.natural_names) == kept
    titles = ["Data Structures (2nd Edition)", "Data Structures, Third Edition", "DATA structures (Paperback)", "The Revised Tower (Green Series)", None]
    assert col(spark, titles, B.family_title) == ["data structures"] * 3 + ["the revised tower green series", ""]
    assert col(spark, ["The Tower (Green Series) Two"], B.without_series) == ["The Tower Two"]
    houses = ["Morgan Kaufmann Publishers, Inc.", "Morgan Kaufmann (edition 1)", "Pearson Education (US), New Jersey", "Elsevier Academic Press", "Butterworth-Heinemann", "Prentice Hall", "Routledge, Taylor & Francis Group", "-", "NA", "Nobody & Sons", None]
    assert col(spark, houses, B.publisher_key) == ["morgankaufmann", "morgankaufmann", "pearson", "academicpress", "butterworthheinemann", "prenticehall", "routledge", "", "", "nobodysons", ""]


def test_visible_names(spark):
    df = spark.createDataFrame([("NFS Illustrated", "NFS Illustrated (Technical Series)"), ("TCP/IP Illustrated", "NFS Illustrated"), ("", "NFS Illustrated"), (None, "x")], "a string, b string")
    assert [bool(r[0]) for r in df.select(B.same_title(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("Doe's Guide to Pearson Tools", "Jane Doe", "Pearson Education"), ("A Guide", "Jane Doe", "Pearson"), ("Guide", None, None)], "t string, a string, p string")
    got = df.select(B.visible_author(F.col("t"), B.author_names(F.col("a"))), B.visible_publisher(F.col("t"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]
    df = spark.createDataFrame([(" 1999 ", "publication_year"), ("99", "publication_year"), ("Elsevier BV", "publisher")], "v string, c string")
    assert [r[0] for r in df.select(B.context_key(F.col("v"), F.col("c"))).collect()] == ["1999", "", "elsevier"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(X.cosine("a", "b"), X.unit_cosine("a", "z"), X.scaled("a"), X.row_support("a", "b"), F.size(X.pair_features("a", "b"))).first()
    assert r[0] == pytest.approx(0.96) and r[1] == 0.0 and r[2] == [pytest.approx(0.6), pytest.approx(0.8)] and r[3] == 1.0 and r[4] == 8


def test_chunks(spark):
    text = "One two three. " * 100
    got = col(spark, [text, "", "x" * 2000, "First short.\n\nSecond. It is short.\n\n\nThird &amp; last.", None], T.chunks(200))
    assert all(len(c) <= 200 for c in got[0]) and " ".join(got[0]) == text.strip() and got[1] == [] and "".join(got[2]) == "x" * 2000
    assert got[3] == ["First short. Second. It is short. Third & last."] and got[4] is None
    assert all(len(c) <= 800 for c in col(spark, ["A sentence of some words is here. " * 200 + "word " * 900], T.chunks(800))[0])
    content = "Alpha was founded in 1990 and became known for bridge evidence. It later expanded into several regions with detailed public records.\n\nThe second paragraph contains target facts and additional context. It should be stored as a separate text asset chunk for retrieval."
    parts = col(spark, [content], T.chunks(120))[0]
    assert len(parts) == 4 and all(len(c) <= 120 for c in parts)


def test_headers_with_entities(spark):
    df = spark.createDataFrame([(["Caf&eacute;  no", None, "plain"],), (["a  b"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(T.clean_each("t")).collect()] == [["Café no", None, "plain"], ["a b"], None]
