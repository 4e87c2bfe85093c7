import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.operators import dedupe as D
from lakeweave.operators import evidence as E
from lakeweave.operators import joinability as J
from lakeweave.operators import matching as M
from lakeweave.operators import metrics as Q
from lakeweave.operators import profiles as P
from lakeweave.operators import ranking as R
from lakeweave.operators import retrieval as N
from lakeweave.operators import sampling as S
from lakeweave.operators import survival as V

LAKE = "source_table_id string, source_file string, pgtitle string, title array<string>, num_cols int, num_rows int, data array<array<string>>, loaded_at int"


@pytest.fixture(scope="module")
def lake(spark):
    rows = [
        ("t1", "f", "P", ["A", "", "A"], 3, 3, [["[Foo_Bar|foo]", "1"], ["[Foo_Bar]", "2", "x"], ["[File:z|z]", "", "x"]], 1),
        ("t1", "f", "P", ["old"], 1, 1, [["gone"]], 0),
        ("t2", "f", None, None, None, 0, None, 1),
        ("t3", "f", None, None, None, 0, [], 1),
        ("t4", "f", None, ["B", "C"], 2, 2, [["k", "v"], ["k", "v"], ["k", "w"], None], 1),
    ]
    return spark.createDataFrame(rows, LAKE)


def test_cells(lake):
    got = {(r.source_table_id, r.row_id, r.column_index): r for r in C.cells(C.lake(lake)).collect()}
    assert len(got) == 9 + 6
    a = got["t1", 0, 0]
    assert (a.text, a.wiki_title, a.has_wiki_link) == ("foo", "Foo Bar", True)
    assert got["t1", 1, 0].text == "Foo Bar" and got["t1", 2, 0].wiki_title is None
    assert [got["t1", 0, k].column_name for k in range(3)] == ["A", "col_1", "A_1"] and got["t1", 0, 2].text == ""
    assert C.cells(C.lake(lake.limit(0))).count() == 0


def test_profiles(lake):
    c = C.cells(C.lake(lake))
    p = {(r.source_table_id, r.column_index): r for r in C.column_profiles(c).collect()}
    assert p["t1", 1].numeric_ratio == 1.0 and p["t1", 0].wiki_link_ratio == pytest.approx(0.666667)
    fd = {(r.source_table_id, r.x_col, r.y_col): (r.purity, r.support) for r in P.fd_purity(c).collect()}
    assert fd["t4", 0, 1] == (pytest.approx(2 / 3, abs=1e-6), 3) and fd["t4", 1, 0] == (1.0, 3)
    assert [tuple(r) for r in P.dominant_by_key(c).filter("source_table_id = 't4'").collect()] == [("t4", "k", "v", 2)]
    assert {(r.source_table_id, r.column_index): r.modal_share for r in P.modal_share(c).collect()}["t4", 0] == 1.0
    assert P.redundant_columns(c.filter("source_table_id = 't4'")).count() == 0
    assert C.skip_reason() is not None


def test_ranking(spark):
    df = spark.createDataFrame([("q", "a", 1, 3), ("q", "b", 2, 1), ("q", "c", 3, 2)], "q string, t string, first int, second int")
    assert [r.t for r in R.rrf(df, "q", "t", "first", "second").orderBy("fused_rank").collect()] == ["b", "a", "c"]
    tiers = spark.createDataFrame([("q", "a", 0.0, 0.0, 0.0, 1), ("q", "b", 0.0, 0.4, 0.2, 2), ("q", "c", 0.2, 0.0, 0.0, 3)], "q string, t string, bridge double, vis_idf double, vis_row double, first int")
    assert [r.t for r in R.tier_order(tiers, "q", "t", "bridge", "vis_idf", "vis_row", "first").orderBy("tier_rank").collect()] == ["c", "b", "a"]
    x = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("h", 0.0)], "g string, v double")
    lse = {r.g: r.l for r in R.log_sum_exp(x, ["g"], "v", "l").collect()}
    assert lse["g"] == pytest.approx(math.log(math.e + math.e**2)) and lse["h"] == pytest.approx(0.0)
    assert R.peak_span([0.1, 0.9, 0.5, 0.2], 2) == (1, 3) and R.peak_span([], 3) == (0, 0)
    assert R.descending(spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.9)], "q string, p int, s double"), "q", "p", "s").count() == 1


def test_matching(spark):
    view = spark.createDataFrame(
        [("q", [([(0, "A", "Foo"), (1, "B", "1")],), ([(0, "A", "bar"), (1, "B", "1")],)])], "table_id string, rows array<struct<cells:array<struct<column_index:int,column_name:string,text:string>>>>"
    )
    q = M.visible_query_values(M.query_cells(view))
    assert {(r.row, r.column_index) for r in q.collect()} == {(0, 0), (1, 0)}
    cells = spark.createDataFrame([("t", 0, "X", "foo"), ("t", 0, "X", "BAR"), ("u", 0, "X", "foo")], "source_table_id string, column_index int, column_name string, text string")
    scope = spark.createDataFrame([("q", "t", 1), ("q", "u", 2), ("q", "v", 3)], "table_id string, target string, stage1 int")
    got = {r.target: (r.vis_row, r.vis_idf) for r in M.visible_scores(scope, q, M.domains(cells)).collect()}
    w1, w2 = math.log(4 / 3) / math.log(4), math.log(4 / 2) / math.log(4)
    assert got["t"] == (pytest.approx(0.4), pytest.approx((w1 + w2) / 5)) and got["u"] == (pytest.approx(0.2), pytest.approx(w1 / 5)) and got["v"] == (0.0, 0.0)
    claims = spark.createDataFrame([("q", "X", 0, "foo"), ("q", "X", 0, "FOO"), ("q", "X", 1, "a"), ("q", "X", 1, "b"), ("q", "X", 2, "")], "table_id string, attribute string, row int, value string")
    status = {r.row: r.status for r in M.bridges(claims).collect()}
    assert status == {0: "VALUE", 1: "CONFLICT", 2: "MISSING", 3: "MISSING", 4: "MISSING"}
    assert {r.target: r.bridge for r in M.bridge_scores(scope, M.bridges(claims), M.domains(cells)).collect()} == {"t": 0.2, "u": 0.2, "v": 0.0}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    t, q = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    mk = lambda m, p: spark.createDataFrame([(f"{p}{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, z array<double>")
    got = {}
    for r in N.knn_join(mk(q, "q"), mk(t, "t"), 5, block_rows=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.target_id))
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(u(q) @ u(t).T), axis=1)[:, :5]
    assert all([x for _, x in sorted(got[f"q{i:03d}"])] == [f"t{j:03d}" for j in want[i]] for i in range(20))


def test_greedy_coverage():
    s = np.array([[1.0, 0, 0], [0.9, 0.1, 0], [0, 1, 1]])
    chosen, coverage = N.greedy_coverage([2.0, 2.0, 0.0], s, ["a", "b", "c"])
    assert chosen[0] == "c" and set(chosen) == {"a", "c", "b"} or chosen == ["c", "a"]
    assert 0 < coverage <= 1 and N.greedy_coverage([], np.zeros((0, 3)), [])[0] == []


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "x", 1)], "query_id string, target_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "y")], "query_id string, target_id string")
    m = {r.query_id: r for r in Q.rank_metrics(ranked, gold).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert m["q"].recall_5 == 0.5 and m["q"].ndcg_5 == pytest.approx((1 / math.log2(3)) / ideal, abs=1e-6) and m["r"].recall_10 == 0.0
    a = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, p boolean")
    assert Q.auc(a, "s", F.col("p")).first().auc == pytest.approx(0.875)
    d = spark.createDataFrame([("g", 0.5), ("g", 0.5), ("h", 0.0)], "g string, d double")
    r = Q.group_bootstrap(d, "g", "d", 200).first()
    assert r.delta == pytest.approx(1 / 3) and r.low <= r.delta <= r.high and (r.w, r.l, r.t) == (2, 0, 1)
    assert Q.unmatched(ranked, gold, "query_id").count() == 0


def test_sampling(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    small, large = ({r.k for r in S.exact_sample(ids, "k", p).collect()} for p in (0.1, 0.2))
    assert len(small) == 100 and small < large
    parts = {r.split: r["count"] for r in S.quota_splits(ids, "k", (0.8, 0.1, 0.1)).groupBy("split").count().collect()}
    assert parts == {"train": 800, "dev": 100, "test": 100}
    import hashlib

    got = ids.limit(20).select("k", S.holdout(F.col("k"), 10, "s").alias("h")).collect()
    assert all(r.h == int(hashlib.sha256(f"s|{r.k}".encode()).hexdigest(), 16) % 10 for r in got)
    for sizes, slots, root in [({"a": 1, "b": 10, "c": 5}, 8, False), ({"a": 1, "b": 100, "c": 3, "d": 3}, 20, True), ({"a": 0, "b": 2}, 9, False), ({"a": 5, "b": 5, "c": 5}, 7, False), ({"a": 7}, 0, False), ({k: 1 + ord(k) % 5 for k in "abcdefghijk"}, 17, True)]:
        got = {r.k: r.quota for r in S.quotas(spark.createDataFrame(list(sizes.items()), "k string, n long"), "k", slots, root).collect()}
        assert got == shared_out({k: c for k, c in sizes.items() if c}, slots, root)
    assert S.quotas(spark.createDataFrame([], "k string, n long"), "k", 5).count() == 0
    chosen = S.exact_two_way({"a": (1, 2), "b": (2, 0), "c": (3, 1)}, (5, 1))
    assert chosen == {"b", "c"} and S.exact_two_way({"a": (1, 1)}, (2, 2)) is None


def test_survival(spark):
    df = spark.createDataFrame([(5.0, True), (15.0, False), (15.0, True), (999.0, True), (-1.0, True)], "v double, e boolean")
    h = V.histogram(df, "v", 100.0, F.col("e"), bins=10)
    km = {r.bin: r.survival for r in V.kaplan_meier(h).collect()}
    assert km[0] == 1.0 and km[1] == pytest.approx(1 - 2 / 5) and km[2] == pytest.approx(0.6 * (1 - 1 / 3)) and km[9] == pytest.approx(0.4)


def test_components_and_aliases(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")
    assert {r.node: r.component for r in D.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    d = spark.createDataFrame([("1", "text", "é\r\n"), ("2", "text", "é\n"), ("3", "image", "é\n"), ("4", "text", None)], "k string, t string, c string")
    assert {r.k: r.canonical for r in D.aliases(d, "k", "t", "c").collect()} == {"1": "1", "2": "1", "3": "3"}


def test_evidence(spark):
    owners = spark.createDataFrame([(1, "e"), (2, None), (3, "f")], "o int, entity_id string")
    assets = spark.createDataFrame([("a", "e", "text"), ("b", "e", "image")], "asset_id string, entity_id string, asset_type string")
    assert {r.owner: (r.n_text, r.n_image, r.first_asset) for r in E.links(owners, "o", "entity_id", assets).collect()} == {1: (1, 1, "a"), 2: (0, 0, None), 3: (0, 0, None)}
    t = spark.createDataFrame([("see https://x.y/z ISBN 9780306406157",)], "t string").select(E.masked(F.col("t"))).first()[0]
    assert "[link]" in t and "[ISBN]" in t


def test_small_driver_algorithms():
    from lakeweave.operators.linear import balanced_clusters

    x = np.vstack([np.eye(3)[[0] * 6 + [1] * 2 + [2]] + 0.01 * np.arange(27).reshape(9, 3)])
    own = balanced_clusters(x, 3, 4)
    assert np.bincount(own, minlength=3).max() <= 4 and (own >= 0).all() and len(balanced_clusters(np.zeros((0, 3)), 1, 1)) == 0
    with pytest.raises(ValueError, match="hold"):
        balanced_clusters(x, 2, 4)
    filled, log = S.replacement_rounds(["a", "b", "c"], ["d", "e"], lambda cs: [c for c in cs if c in "ace"])
    assert filled == ["a", "e", "c"] and [r["judged"] for r in log] == [3, 1, 1] and S.replacement_rounds([], ["x"], lambda c: c) == ([], [])


def test_pca(spark):
    from lakeweave.operators.linear import fit_pca, project

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + 2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "i int, v array<double>")
    mean, axes, var = fit_pca(df, "v", 5, 2)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(var, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2])
    p = np.array([r.projected for r in project(df, "i", "v", mean, axes).orderBy("i").collect()])
    assert np.allclose(p, (x - mean) @ axes.T) and fit_pca(df.limit(0), "v", 5, 2)[1].shape == (0, 5)


def test_targets_reached_only_through_evidence_are_admitted(spark):
    from lakeweave.operators import retrieval

    z = spark.createDataFrame([("q", [1.0, 0.0]), ("near", [2.0, 0.0]), ("far", [3.0, 4.0])], "id string, z array<double>")
    direct = retrieval.knn_join(z.filter("id = 'q'"), z.filter("id <> 'q'"), 1)
    reached = spark.createDataFrame([("q", "far", 0.9)], "query_id string, target_id string, coverage double")
    pairs = retrieval.with_evidence_targets(direct, reached, z, z)
    assert {r.target_id: round(r.score, 9) for r in pairs.collect()} == {"near": 1.0, "far": 0.6}
    assert {r.target_id for r in retrieval.admit(pairs, reached, 150).collect()} == {"near", "far"}


def test_slices_keep_more_than_one_evidence(spark):
    from lakeweave.operators import retrieval

    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 2.0])], "id string, z array<double>")
    evidence = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 0.0, 0.0, 1.0])], "id string, z array<double>")
    paths = spark.createDataFrame([("q", "a", "t", 1.0), ("q", "b", "t", 1.0)], "query_id string, evidence_id string, target_id string, score double")
    kept = retrieval.retain_evidence(paths, retrieval.slice_rows(q, 2, 4), evidence).collect()
    assert {(r.evidence_id, r.step) for r in kept} == {("a", 1), ("b", 2)}


def test_vectors_are_not_shuffled_in_blocks(spark):
    """Blocks of targets go to the workers: no copies of queries and targets for pairs of blocks."""
    df = spark.createDataFrame([(f"v{i:02d}", [1.0, float(i)]) for i in range(40)], "id string, z array<double>")
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "CoGroup" not in plan(N.knn_join(df, df, 3, block_rows=10))
    reached = spark.createDataFrame([("v01", "v03"), ("v02", "v39")], "query_id string, target_id string")
    pairs = N.with_evidence_targets(reached.limit(0).withColumn("score", F.lit(0.0)), reached, df, df, block_rows=10)
    want = {"v01": (1 + 3) / math.sqrt(2 * 10), "v02": (1 + 2 * 39) / math.sqrt(5 * (1 + 39 * 39))}
    assert {r.query_id: round(r.score, 9) for r in pairs.collect()} == {q: round(v, 9) for q, v in want.items()} and "zip_with" not in plan(pairs)


def test_retention_of_many_pairs_equals_one_by_one(spark):
    rng = np.random.default_rng(8)
    ids = [f"e{i:02d}" for i in range(30)]
    z = {i: rng.normal(size=8) for i in ids}
    z["e07"] = z["e03"]
    z = {i: v / np.linalg.norm(v) for i, v in z.items()}
    q = {f"q{i}": rng.normal(size=8) for i in range(6)}
    paths = [(a, e, f"t{k}", float(round(rng.normal(), 1))) for a in q for k in range(9) for e in rng.permutation(ids)[: 1 + 3 * k]]
    df = spark.createDataFrame(paths, "query_id string, evidence_id string, target_id string, score double")
    vectors = lambda d: spark.createDataFrame([(i, v.tolist()) for i, v in d.items()], "id string, z array<double>")
    rows = N.slice_rows(vectors(q), 2, 8)
    got = {}
    for r in N.retain_evidence(df, rows, vectors(z)).collect():
        got.setdefault((r.query_id, r.target_id), []).append((r.step, r.evidence_id, round(r.coverage, 9)))
    m = {}
    for r in rows.orderBy("row").collect():
        m.setdefault(r.query_id, []).append(r.z)
    want = {}
    for a, t in {(p[0], p[2]) for p in paths}:
        best = sorted(((p[3], p[1]) for p in paths if (p[0], p[2]) == (a, t)), key=lambda x: (-x[0], x[1]))[:16]
        names = [e for _, e in best]
        support = np.clip((np.array([z[e] for e in names]) @ np.array(m[a]).T + 1) / 2, 0, 1)
        chosen, coverage = N.greedy_coverage([w for w, _ in best], support, names)
        want[a, t] = [(k + 1, e, round(coverage, 9)) for k, e in enumerate(chosen)]
    assert {k: sorted(v) for k, v in got.items()} == want and "FlatMapGroupsInPandas" not in N.retain_evidence(df, rows, vectors(z))._jdf.queryExecution().toString()


def shared_out(sizes, slots, root):
    """Largest remainder by filling the level up slot after slot of the saturated strata."""
    weight = {k: math.sqrt(c) if root else c for k, c in sizes.items()}
    slots, full = min(slots, sum(sizes.values())), set()
    for k in sorted(sizes, key=lambda k: (sizes[k] / weight[k], k)):
        rest = [j for j in sizes if j not in full]
        if (slots - sum(sizes[j] for j in full)) / sum(weight[j] for j in rest) >= sizes[k] / weight[k]:
            full.add(k)
        else:
            break
    rest = [k for k in sizes if k not in full]
    level = (slots - sum(sizes[k] for k in full)) / sum(weight[k] for k in rest) if rest else 0
    out = {k: sizes[k] if k in full else math.floor(level * weight[k]) for k in sizes}
    for k in sorted(rest, key=lambda k: (-(level * weight[k] - out[k]), sizes[k], k))[: slots - sum(out.values())]:
        out[k] += 1
    return out


def test_running_sums_over_ranges(spark):
    rows = [(i % 7, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r.v: r.s for r in R.running_sum(df, ["k", "v"], F.col("v"), "s").collect()}
    total, want = 0, {}
    for _, v in sorted(rows):
        total += v
        want[v] = total
    assert got == want
    ring = {r.v: r.nxt for r in R.following(df, "v", "nxt").collect()}
    assert ring == {i: (i + 1) % 300 for i in range(300)}
    assert R.following(df.limit(0), "v", "nxt").count() == 0 and {tuple(r) for r in R.following(df.filter("v = 5"), "v", "nxt").collect()} == {(5, 5)}


def test_bootstrap_is_the_same_however_rows_are_spread(spark):
    rows = [(f"g{i % 40}", float(i % 11) - 4.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, d double")
    a, b = (Q.group_bootstrap(x, "g", "d", 500).first() for x in (df.coalesce(1), df.repartition(7)))
    mean = sum(d for _, d in rows) / len(rows)
    assert abs(a.delta - mean) < 1e-12 and a.low < mean < a.high and abs(a.low - b.low) < 1e-9 and a.w + a.l + a.t == 400
    assert Q.group_bootstrap(df.limit(0), "g", "d", 50).count() == 0


def test_uniform_targets_with_many_exclusions(spark):
    targets = spark.createDataFrame([(f"t{i:03d}",) for i in range(120)], "target_id string")
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    out = spark.createDataFrame([("a", f"t{i:03d}") for i in range(115)] + [("b", "t000")], "query_id string, target_id string")
    got = {}
    for r in J.uniform_targets(queries, targets, out, 10).collect():
        got.setdefault(r.query_id, set()).add(r.target_id)
    assert got["a"] == {f"t{i:03d}" for i in range(115, 120)} and len(got["b"]) == len(got["c"]) == 10 and "t000" not in got["b"] and got["b"] != got["c"]


def test_vector_joins(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 400)] + 0.4 * rng.normal(size=(400, 16))
    x[7] = x[3] * 2
    x[9] = 0
    ids = [f"v{i:03d}" for i in rng.permutation(400)]
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in zip(ids, x, strict=True)], "id string, z array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = np.round(u @ u.T, 12)
    want = {ids[i]: [ids[j] for j in sorted(range(400), key=lambda j: (-c[i, j], ids[j]))[:5]] for i in range(400)}
    queries = df.filter("id < 'v150'")

    def lists(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
            out.setdefault(r.query_id, []).append(r.target_id)
        return out

    exact = {q: t for q, t in want.items() if q < "v150"}
    assert lists(N.knn_join(queries, df, 5)) == exact and lists(N.knn_join(queries, df, 5, block_rows=60)) == exact
    assert lists(N.list_join(queries, df, 5, probes=1000, list_rows=20, ask_rows=30)) == exact
    some = lists(N.list_join(queries, df, 5, probes=4, list_rows=20))
    assert sum(len(set(some[q]) & set(t)) for q, t in exact.items()) >= 0.9 * 5 * len(exact)
    none = df.limit(0)
    assert N.knn_join(none, df, 5).count() == N.knn_join(df, none, 5).count() == N.list_join(df, none, 5).count() == N.list_join(none, df, 5).count() == 0


def test_dataset_in_one_call(spark):
    cells = spark.createDataFrame([("t", r, c, f"h{c}", "" if (r, c) == (3, 1) else f"v{'same' if c == 1 and r in (0, 2) else r}{c}") for r in range(4) for c in range(4)], "source_table_id string, row_id int, column_index int, column_name string, text string")
    layout = spark.createDataFrame([("t", 0, "entity"), ("t", 1, "hidden"), ("t", 2, "query"), ("t", 3, "target")], "source_table_id string, column_index int, role string")
    made = J.build_dataset(cells, layout, spark.createDataFrame([("t", 1), ("t", 2)], "source_table_id string, row_id int"))
    q = {(r.row_id, r.source_row_id, r.column_index) for r in made["queries"].collect()}
    assert q == {(0, 1, 0), (0, 1, 2), (1, 2, 0), (1, 2, 2)}
    t = {(r.row_id, r.source_row_id, r.column_index) for r in made["targets"].collect()}
    assert t == {(0, 0, 1), (0, 0, 3), (1, 1, 1), (1, 1, 3)}
    (rel,) = made["qrels"].collect()
    assert rel.attribute == "h1" and rel.query_id.startswith("query_") and rel.target_id.startswith("target_")
