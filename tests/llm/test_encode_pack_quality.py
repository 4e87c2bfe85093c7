import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import encode as E
from lakeweave.llm import packing as P
from lakeweave.llm import quality as Q


@pytest.fixture(scope="module")
def coder():
    return E.Coder(E.vocabulary_path(), 4096)


def direct(coder, text):
    return coder.model.encode(text, add_special_tokens=False).ids


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '’\n\t  ,.1é漢🙂vetllrs​")), max_size=120), st.integers(1, 17))
def test_tree_equals_direct_encoding(text, leaf):
    c = E.Coder(E.vocabulary_path(), leaf)
    ids = c.reduce(text).flat()
    assert ids == direct(c, text) and c.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "don't we'll 've '" * 300, "<|endoftext|> " * 50, "漢字" * 2000, "x\n\n \n y" * 700])
@pytest.mark.parametrize("leaf", [13, 256])
def test_long_runs(text, leaf):
    c = E.Coder(E.vocabulary_path(), leaf)
    assert c.reduce(text).flat() == direct(c, text)


def test_encode_documents(spark, coder, clash):
    long = "The tower of Ée's 12 bridges. " * 4000
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, long), (4, long), (None, "x")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, list(r.ids)) for r in E.encode_documents(df).collect()]
    assert sorted(got, key=str) == sorted([(i, direct(coder, t) if t else []) for i, t in rows], key=str)
    back = E.decode_documents(E.encode_documents(df.filter("doc_id = 1")))
    assert back.first().text == "Hello world"
    assert E.encode_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in E.count_tokens(df.filter("doc_id < 4")).collect()} == {1: 2, 2: 0, 3: 0}


def test_other_splitters_are_refused(tmp_path):
    import json

    known = json.load(open(E.vocabulary_path(), encoding="utf-8"))
    known["pre_tokenizer"] = {"type": "Whitespace"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(known))
    with pytest.raises(ValueError):
        E.Coder(str(path))


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def test_open_bins_match_best_fit():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 100):
        for _ in range(30):
            sizes = [rng.randint(0, capacity) for _ in range(rng.randint(0, 60))]
            t = P.OpenBins(capacity)
            used = {}
            for s in sorted(sizes, reverse=True):
                b = t.put(s)
                used[b] = used.get(b, 0) + s
            assert all(u <= capacity for u in used.values()) and t.opened == brute_best_fit(sizes, capacity)


def test_pack(spark, clash):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 300)) for i in range(2000)] + [(5000, 1000), (5001, None), (5002, 0), (5003, -4), (7, 20), (5004, 256)]
    df = clash(spark.createDataFrame(rows, "doc_id long, n_tokens long"))
    got = P.pack(df, capacity=128, part_containers=500).collect()
    per, pieces = {}, {}
    for r in got:
        per[r.container] = per.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
    assert max(per.values()) <= 128 and set(pieces) == {i for i, _ in rows}
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + max(0, n or 0)
    assert {i: sum(v) for i, v in pieces.items()} == want
    assert all(len(pieces[i]) == 1 for i, n in rows if n is not None and 0 < n <= 128 and i != 7)
    assert sorted(pieces[5000], reverse=True) == [128] * 7 + [104] and pieces[5004] == [128, 128] and pieces[5002] == [0]
    assert sum(want.values()) / (128 * len([c for c, u in per.items() if u])) > 0.97
    again = P.pack(df, capacity=128, part_containers=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert P.pack(df.limit(0)).count() == 0 and P.fill_report(P.pack(df, capacity=128), capacity=128).first().fullest <= 128


@pytest.mark.parametrize("kind", ["full", "null", "empty", "same", "huge"])
def test_parts_stay_small(spark, kind):
    n = 6000
    key = F.col("id").cast("long") if kind in ("full", "empty") else F.lit(None).cast("long") if kind == "null" else F.lit(7).cast("long")
    size = {"full": 64, "null": 3, "empty": 0, "same": 20, "huge": 64 * 3000}[kind]
    df = spark.range(2 if kind == "huge" else n).select(key.alias("doc_id"), F.lit(size).cast("long").alias("n_tokens"))
    got = P.pack(df, capacity=64, part_containers=100, part_pieces=500)
    part = F.shiftright("container", 24)
    loads = got.groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.countDistinct("container").alias("boxes")).collect()
    assert sum(r.c for r in loads) == n and max(r.c for r in loads) <= 1100 and len(loads) >= 6
    per = got.groupBy("container").agg(F.sum("n_tokens").alias("u")).agg(F.max("u"), F.count("*")).first()
    assert per[0] <= 64 and (kind == "empty" or size * df.count() / (64 * per[1]) > 0.9)


COMMON = frozenset("the of and a in to was with it is on that for he der die und ist das nicht".split())
PROSE = "The tower of the town was built in 1850, and it is said that the bridge was lost to the flood.\n"


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        (PROSE, False),
        (PROSE.replace(" ", "\n"), False),
        ("Contents\n\n" + PROSE * 3, False),
        (PROSE * 4 + "- one\n- two\n* three\n", False),
        (PROSE.upper(), False),
        ("这座灯塔在1954年被修复了。没有人知道为什么。", False),
        ("name | year | place\nA b | 1850 | x\nC d | 1851 | y\nE f | 1852 | z", True),
        ("name,year\n\"A b\",1850\n\"C d\",1851\n", True),
        ("<table><tr><td>A</td><td>1</td></tr><tr><td>B</td><td>2</td></tr></table>", True),
        ("• one thing\n• other thing\n• third thing\n• last thing", True),
        ("Year: 1850\nPlace: x\nColour: red\n" * 4, True),
        ("Name            Year      Place\nAb c            1850      xx\nCd e            1851      yy", True),
        ("x9f#~|!q ;;p0^ l:*' zz!! 8|~" * 10, True),
        (".,.,.,.,.,.", True),
        ("QWxhZGRpbjpvcGVuIHNlc2FtZQ==" * 4, True),
        ("12.5 88 91.2 7 1003", True),
        ("- The history of the sea\n- A tower in the town\n- The bridge and the ferry\n- It is on the map", True),
        ("Adams, A. The tower of the town. York, 1950. 12 pp.\nBell, B. A map of the sea. Bath, 1951. 90 pp.\nCole, C. The bridge in it. Kent, 1952. 77 pp.\n" * 2, True),
        (PROSE + "First tower\nOld bridge\nQuiet mill\nGreen ferry\nLate map\nWorn atlas\nCareful school\nNarrow chapel\nPlain harbour\nWooden quarry\nFaded letter\nBound ledger\n" * 3, True),
        (None, False),
        ("", False),
        (" \n\t ", False),
    ],
)
def test_prose_or_not(text, bad):
    assert Q.statistics(text, COMMON)["not_prose"] is bad


def test_layout_decides_what_words_leave_open(monkeypatch):
    text = "- The history of the sea\n- A tower in the town\n- The bridge and the ferry\n- It is on the map."
    assert Q.statistics(text, COMMON)["not_prose"]
    monkeypatch.setattr(Q, "layout", lambda lines: 0.0)
    assert not Q.statistics(text, COMMON)["not_prose"]


def test_too_many_common_words(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_WORDS", 2)
    words = spark.createDataFrame([("en", w) for w in "abc"], "lang string, word string")
    with pytest.raises(ValueError):
        Q.document_quality(spark.createDataFrame([(1, "x")], "doc_id long, text string"), words)


def test_layout_measures():
    assert Q.alignment(["a|b|c", "d|e|f"]) == 1.0 and Q.alignment(["a  b", "c  d"]) == 1.0 and Q.alignment(["x"]) == 0.0
    assert Q.alignment(["a, b, c, d, e"]) == 1.0 and Q.alignment(["The tower of the old town was, in the end, sold to it."] * 2) == 0.0
    assert Q.periodicity(["- a", "- b", "- c"]) == 1.0 and Q.periodicity(["a", "  b", "a", "  b"]) == pytest.approx(0.5)
    assert Q.length_autocorrelation(["aaaa", "b"] * 8) > 0.5 and Q.length_autocorrelation(["aa"] * 5) == 1.0


def test_document_quality(spark, clash):
    docs = clash(spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "- a\n- b\n- c\n"), (4, "- a\n- b\n- c\n"), (5, PROSE * 3000)], "doc_id long, text string"))
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    got = Q.document_quality(docs, words).collect()
    r = {x.doc_id: x for x in got}
    assert len(got) == 6 and r[1].n_words == 20 and not r[1].not_prose and r[4].not_prose and not r[2].not_prose and r[3].n_words == 0 and r[5].punct_line_share == 1.0
    assert Q.document_quality(docs.limit(0), words.limit(0)).count() == 0
