import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakeweave.llm import formatting as G
from lakeweave.llm import overlap as O
from lakeweave.llm import splits as S

VALUES = "value_id string, table_id string, column_index int, value string"
TABLES = "source_table_id string, data array<array<string>>"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Foo  bar", "bar, FOO.", True),
        ("１２ km", "12km", True),
        ("1.5", "1,5", False),
        ("soft­hyphen​", "softhyphen", True),
        ("é", "e", False),
        ("é", "é", True),
        ("a a b", "a b", False),
        ("A_b-c", "a b c", True),
        ("Straße", "STRASSE", True),
        ("x1", "x 1", True),
        ("!!", "", True),
    ],
)
def test_canonical_values(a, b, same):
    assert (G.canonical_value(a) == G.canonical_value(b)) is same


def test_trie_counts():
    rng, t, n = random.Random(3), G.Trie(3), collections.Counter()
    for _ in range(3000):
        k = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        n[k] += 1
        end = t.add(k, "%05d" % rng.randint(0, 99999))
        assert end[0] == k and end[1] == n[k]


def brute(values, tables):
    groups = collections.defaultdict(set)
    for i, t, c, v in values:
        if i is not None and v is not None and G.canonical_value(v):
            groups["distinct_values", t, c, G.canonical_value(v)].add(i)
    for i, d in tables:
        if i is not None and G.canonical_table(d):
            groups["source_tables", G.canonical_table(d)].add(i)
    return {(k[0], min(g), x) for k, g in groups.items() for x in g if x != min(g)}


@pytest.mark.parametrize("bucket", [5, 40, 100_000])
def test_copies_against_brute_force(spark, clash, bucket):
    rng = random.Random(bucket)
    words = ["tower", "Bridge", "x1", "12", "1.5", "ÉTÉ", "été", "１２"]
    values = [(f"v{k:04d}", rng.choice(["t1", "t2", None]), rng.choice([0, 1, None]), " ".join(rng.sample(words, rng.randint(1, 3)))) for k in range(250)]
    values += [(f"h{k:04d}", "t1", 0, rng.choice(["Hot value", "hot  VALUE", "value-hot"])) for k in range(150)]
    values += [("n1", "t1", 0, None), ("n2", "t1", 0, ""), ("n3", "t1", 0, "?!"), ("n4", "t1", 0, " "), (None, "t1", 0, "Hot value"), ("long", "t1", 0, "w " * 20000), ("long2", "t1", 0, "W, " * 20000)]
    values += values[:20]
    tables = [("a", [["x", "1"], ["y", ""]]), ("b", [["1", "X!"], ["Y"]]), ("c", [["y"], ["x", "1"]]), ("d", None), ("e", []), ("f", [[""], [None]]), ("a", [["x", "1"], ["y", ""]]), ("g", [None, ["q"]]), ("h", [[], ["Q."]])]
    got = G.formatting_copies(clash(spark.createDataFrame(values, VALUES)), clash(spark.createDataFrame(tables, TABLES)), bucket)
    rows = [tuple(r) for r in got.select("tab", "kept_key", "copy_key").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(values, tables)
    assert ("source_tables", "a", "b") in rows and not any("c" in r[1:] for r in rows)
    counts = {r.kept_key: r.n_copies for r in G.copy_counts(got).collect()}
    assert counts["h0000"] == 150


def test_no_copies_in_empty_tables(spark):
    assert G.formatting_copies(spark.createDataFrame([], VALUES), spark.createDataFrame([], TABLES)).count() == 0


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_hash_to_min(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(0, 300):03d}", f"n{rng.randint(0, 300):03d}") for _ in range(200)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("hub", f"s{k}") for k in range(200)]
    got = {r.node: r.component for r in S.hash_to_min(spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string")).collect()}
    assert got == union_find(edges)
    assert S.hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_splits(spark, clash):
    tables = [("s1", "Page A"), ("s1", "page_b"), ("s2", "PAGE B "), ("s3", None), ("s4", " "), ("s5", "Page_C"), (None, "Page A")]
    views = [("q1", "s1", "train"), ("q2", "s2", " TEST"), ("q3", "s3", "dev"), ("q4", "gone", "dev"), ("q5", "gone", "train"), ("q6", None, "train"), ("q7", "s5", "train"), ("q8", "s5", None), ("q9", "s5", ""), ("q1", "s1", "train"), ("q10", "s4", "test")]
    t, v = clash(spark.createDataFrame(tables, "source_table_id string, pgtitle string")), clash(spark.createDataFrame(views, "table_id string, source_table_id string, split string"))
    assert sorted(r[0] for r in S.torn_views(v, t).collect()) == ["q1", "q2", "q4", "q5"]
    new = {r.table_id: r.new_split for r in S.assign_splits(v, t).collect()}
    assert set(new) == {x[0] for x in views} and new["q1"] == new["q2"] and new["q4"] == new["q5"] and new["q7"] == new["q8"] == new["q9"]
    assert new == {r.table_id: r.new_split for r in S.assign_splits(v, t).collect()}
    assert S.torn_views(v.limit(0), t.limit(0)).count() == 0 and S.assign_splits(v.limit(0), t).count() == 0


def test_rendezvous_proportions(spark):
    d = spark.range(20000).select(S.rendezvous(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in d}
    assert share["train"] == pytest.approx(0.8, abs=0.015) and share["dev"] == pytest.approx(0.1, abs=0.01)


VIEW = "table_id string, source_table_id string, split string, rows array<struct<row_id:int,source_row_id:int,cells:array<struct<column_index:int,column_name:string,text:string>>>>"


def view(name, split, rows, source="s"):
    return (name, source, split, None if rows is None else [(k, k, [(i, f"c{i}", t) for i, t in enumerate(r)]) for k, r in enumerate(rows)])


def test_row_hashes_meet_after_a_slip():
    rng = random.Random(4)
    letters = "abcdefgh"
    for _ in range(600):
        row = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        k, other = rng.randrange(len(row)), list(row)
        c = row[k]
        if len(c) < O.SLIP_CHARS + 1:
            continue
        at = rng.randrange(len(c) - 1)
        other[k] = rng.choice([c[:at] + c[at + 1 :], c[:at] + "z" + c[at:], c[:at] + "z" + c[at + 1 :], c[:at] + c[at + 1] + c[at] + c[at + 2 :]])
        a, b = sorted(row), sorted(other)
        assert O.same_row(a, b) and O.row_hashes(a) & O.row_hashes(b), (a, b)


def test_overlaps_against_brute_force(spark, clash):
    rng = random.Random(9)
    base = [[["".join(rng.choice("abcdefg") for _ in range(8)), str(rng.randint(1000, 1010)), ""] for _ in range(5)] for _ in range(30)]
    blank = [["", "", ""], [None, "", " "]]
    views = []
    for k in range(160):
        rows = [list(r) for r in rng.choice(base)]
        for r in rows:
            if rng.random() < 0.2:
                r[0] = r[0][:3] + "z" + r[0][4:]
            if rng.random() < 0.15:
                r[1] = "other" + str(rng.random())
            if rng.random() < 0.5:
                r.reverse()
            r[:] = [c.upper() + " " if rng.random() < 0.3 else c for c in r]
        rng.shuffle(rows)
        views.append(view(f"v{k:03d}", rng.choice(["train", "TRAIN ", "dev", " test", None, ""]), rows, rng.choice(["s", "t", None])))
    views += [view("n1", "dev", None), view("n2", "dev", blank * 3), view("n3", "train", blank * 3), view("n4", "dev", []), view(None, "train", base[0]), views[0]]
    df = clash(spark.createDataFrame(views, VIEW))
    want = set()
    seen = {}
    for t, _, s, rows in views:
        label = (s or "").strip().lower()
        if t and rows is not None and label in ("train", "dev", "test"):
            seen[t] = (label == "train", O.canonical_rows([[c[2] for c in r[2]] for r in rows]))
    for a, (x, p) in seen.items():
        for b, (y, q) in seen.items():
            if a < b and x != y and len(p) >= 4 and len(q) >= 4 and O.rows_in_common(p, q) >= 4:
                want.add((a, b))
    for hot in (0, 1, 100_000):
        got = [tuple(r) for r in O.overlap_pairs(O.cross_split_overlaps(df, hot_pairs=hot)).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    counts = {(r.split, r.source_table_id): (r.n_pairs, r.n_views) for r in O.overlap_counts(df).collect()}
    pairs = {(r.split, r.source_table_id, r.train_id, r.eval_id) for r in O.cross_split_overlaps(df).collect()}
    assert counts == {g: (sum(p[:2] == g for p in pairs), len({p[3] for p in pairs if p[:2] == g})) for g in {p[:2] for p in pairs}} and len(counts) > 1
    one = {frozenset(r) for r in O.overlap_pairs(O.cross_split_overlaps(df, common=1, hot_pairs=1)).collect()}
    assert one == {frozenset((a, b)) for a, (x, p) in seen.items() for b, (y, q) in seen.items() if a < b and x != y and p and q and O.rows_in_common(p, q)}
    assert O.overlap_pairs(O.cross_split_overlaps(df.limit(0))).count() == 0


def test_matching_of_many_rows():
    rng = random.Random(1)
    x = [[f"value{k}", "same"] for k in range(3000)]
    assert O.rows_in_common(x, rng.sample(x, 3000)) == 3000
    chain = [["aaaa"], ["aaab"], ["aabb"], ["abbb"]]
    assert O.rows_in_common(chain, [["aaab"], ["aabb"], ["abbb"], ["bbbb"]]) == 4
    for _ in range(200):
        p, q = ([["".join(rng.choice("ab") for _ in range(5))] for _ in range(5)] for _ in range(2))
        best = max(sum(O.same_row(a, b) for a, b in zip(p, order, strict=True)) for order in itertools.permutations(q))
        assert O.rows_in_common(p, q) == best
