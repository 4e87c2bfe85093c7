import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from lakeweave.operators.unpack import latest_field, packed_authors, parse_packed, unpack


def texts(field):
    return [v.text for v in parse_packed(field)]


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ("A Bee; C Dee", ["A Bee", "C Dee"]),
        ("A Bee；C Dee、E Eff", ["A Bee", "C Dee", "E Eff"]),
        ("A Bee / C Dee", ["A Bee", "C Dee"]),
        ("A Bee\nC Dee\tE Eff", ["A Bee", "C Dee", "E Eff"]),
        ("A Bee, C Dee and E Eff", ["A Bee", "C Dee", "E Eff"]),
        ("A Bee, C Dee, & E Eff", ["A Bee", "C Dee", "E Eff"]),
        ("A Bee &amp; C Dee", ["A Bee", "C Dee"]),
        ("Bee, Ann, Dee, Carl", ["Bee, Ann", "Dee, Carl"]),
        ("Bee, A., Dee, C. D.", ["Bee, A.", "Dee, C. D."]),
        ("Ann Bee, Dee, Carl", ["Ann Bee", "Dee, Carl"]),
        ("Bee, Ann", ["Bee, Ann"]),
        ("Ann Bee, Jr.; Carl Dee", ["Ann Bee, Jr.", "Carl Dee"]),
        ('["Ann Bee", "Carl \\"Cal\\" Dee"]', ["Ann Bee", 'Carl "Cal" Dee']),
        ("['Ann Bee', 'Dee, Carl']", ["Ann Bee", "Dee, Carl"]),
        ('"Bee, Ann"; Carl Dee; "Eff, E."', ["Bee, Ann", "Carl Dee", "Eff, E."]),
        ('"Ann Bee","Timothy ""Tim"" Dee"', ["Ann Bee", 'Timothy "Tim" Dee']),
        ('Ann "Annie" Bee, Carl Dee', ['Ann "Annie" Bee', "Carl Dee"]),
        ("; Ann Bee; ; Carl Dee;", ["Ann Bee", "Carl Dee"]),
        ("Bee & Daughters Map Office and Carl Dee", ["Bee & Daughters Map Office", "Carl Dee"]),
        ("Carl Dee, Bee Committee on Bridges and Roads", ["Carl Dee", "Bee Committee on Bridges and Roads"]),
        ("Ann Bee (ed.) & Carl Dee", ["Ann Bee (ed.)", "Carl Dee"]),
        ("n/a", []),
        ("", []),
        ("  \n ", []),
        (None, []),
        ("Ann Bee; n/a; Carl Dee", ["Ann Bee", "Carl Dee"]),
    ],
)
def test_forms(field, want):
    assert texts(field) == want


def test_broken_quotes_are_read_again_and_flagged():
    got = parse_packed('"Ann Bee; Carl Dee')
    assert [v.text for v in got] == ['"Ann Bee', "Carl Dee"]
    assert got[0].flag == "unclosed quote"
    assert [v.text for v in parse_packed('["Ann Bee", "Carl Dee"')]


names = st.lists(st.sampled_from(["Ann Bee", "Carl Dee", "Eff, Gus", "Hal I. Jay", "Kay \"Kit\" Ell"]), min_size=2, max_size=6)


@settings(max_examples=60, deadline=None)
@given(names, st.sampled_from(["; ", ";", " | ", "\n", " · ", "；"]))
def test_strong_separators_round_trip(parts, mark):
    assert texts(mark.join(parts)) == parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ,;\"'[]\\&/|\n", max_size=40))
def test_anything_parses(field):
    for v in parse_packed(field):
        assert v.text == v.text.strip() and v.text


def test_operator(spark):
    rows = [(1, "A Bee; C Dee", 1, "x"), (1, "A Bee; C Dee; E Eff", 2, "x"), (2, None, 1, "x"), (3, "A Bee", 1, "x"), (4, "x y; " * 3000 + "z z", 1, "x"), (None, "A Bee; C Dee", 1, "x")]
    df = spark.createDataFrame(rows, "listing_id long, authors string, loaded_at int, pos string")
    got = packed_authors(df).orderBy("listing_id", "pos").collect()
    assert [tuple(r) for r in got[:3]] == [(1, 1, "A Bee"), (1, 2, "C Dee"), (1, 3, "E Eff")]
    assert {r.listing_id for r in got} == {1, 4} and len(got) == 3 + 3001
    assert packed_authors(df.limit(0)).count() == 0
    assert unpack(df.unionAll(df).filter("listing_id = 3"), "authors", ("listing_id",)).count() == 2
    assert latest_field(df, "listing_id", "authors", "loaded_at").filter("listing_id = 1").first()["authors"].count(";") == 2
