import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.sources import manifest as M
from lakeweave.sources import tables as S
from lakeweave.streaming import stages as T


def test_wiki_tables(spark, tmp_path):
    (tmp_path / "lake" / "sub").mkdir(parents=True)
    (tmp_path / "lake" / "sub" / "a.json").write_text(json.dumps({"x1": {"title": ["A", "B"], "pgTitle": "P", "numCols": 2, "data": [["1", "2"], ["3"]]}, "x2": {"title": ["C"]}}))
    got = {r.source_file: r for r in S.wiki_tables(spark, str(tmp_path / "lake")).filter("data is not null").collect()}
    assert got["sub/a.json"].num_rows == 2 and got["sub/a.json"].source_table_id.startswith("st_")
    assert S.wiki_tables(spark, str(tmp_path / "lake")).count() == 2


def test_web_tables(spark, tmp_path):
    folder = tmp_path / "web" / "Product"
    folder.mkdir(parents=True)
    with gzip.open(folder / "Product_shop1.test_October2023.json.gz", "wt") as f:
        for k in range(3):
            f.write(json.dumps({"row_id": k, "name": f"n{k}", "color": "red", "page_url": "u", **({"late": "x"} if k == 2 else {})}) + "\n\n[1]\n")
    rows = S.web_rows(spark, str(tmp_path / "web"))
    t = S.web_tables(rows).collect()
    assert len(t) == 1 and t[0].title == ["name", "color", "late"] and t[0].data[0] == ["n0", "red", ""] and t[0].num_rows == 3
    assert S.web_tables(S.web_rows(spark, str(tmp_path / "web"), 2)).first().num_rows == 2
    assert S.entity_column(S.web_tables(rows)).first().entity_column == 0
    assert S.catalogue(spark, str(tmp_path / "web")).first().subset == "unstratified"
    with zipfile.ZipFile(tmp_path / "web" / "Product_statistics.zip", "w") as z:
        z.writestr("table_statistics/Product_October2023_statistics_top100.csv", "host,number_of_rows,column_count\nshop.test,5,3\n,1,1\n")
    assert [tuple(r) for r in S.catalogue(spark, str(tmp_path / "web")).collect()] == [("Product", "top100", "shop.test", 5, 3)]


def test_csv_and_pages(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_bytes("﻿x,\n1,ä\n".encode())
    (tmp_path / "c" / "b.csv").write_bytes("x,y\n1,ä\n".encode("latin-1"))
    got = {r.source_table_id: r for r in S.csv_tables(spark, str(tmp_path / "c")).collect()}
    assert got["a"].title == ["x", ""] and got["a"].data == [["1", "ä"]] and got["b"].data == [["1", "ä"]]
    page = '<html><script type="application/ld+json">[{"a":1},2]</script><style>x</style><p>Foo <b>bar</b></p></html>'
    df = spark.createDataFrame([(page, '{"u":["/i.png","no space here"]}', "https://x.y/z")], "h string, j string, b string")
    r = df.select(S.page_text("h").alias("t"), S.json_ld("h").alias("l"), S.nested_image_urls("j", "b").alias("i")).first()
    assert r.t == "Foo bar" and r.l == ['{"a": 1}'] and r.i == ["https://x.y/i.png"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\nbroken\n{"a":2}\n')
    assert [r.a for r in S.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception):  # noqa: B017, PT011
        S.json_lines(spark, str(tmp_path / "a.jsonl"), "a int", strict=True).collect()


def test_versions(spark, tmp_path):
    root, made = str(tmp_path / "run"), []

    def make(name, n=10):
        made.append(name)
        return spark.range(n).select(F.col("id"), F.lit(name).alias("s"))

    stages = [("one", lambda: make("one")), ("two", lambda: make("two")), ("none", lambda: make("none", 0))]
    key = M.settings_key(p=1)
    assert M.run_stages(spark, stages, root, key) == ["one", "two", "none"] and M.run_stages(spark, stages, root, key) == [] and made == ["one", "two", "none"]
    assert M.read(spark, f"{root}/one", "id long, s string").count() == 10 and M.read(spark, f"{root}/none", "id long, s string").count() == 0
    with pytest.raises(ValueError, match="settings"):
        M.run_stages(spark, stages, root, M.settings_key(p=2))
    with pytest.raises(FileNotFoundError):
        M.read(spark, f"{root}/nothing", "id long")
    old = M.newest(spark, f"{root}/two")
    part = next((tmp_path / "run" / "two" / old["version"] / "rows").glob("part-*.gz"))
    part.write_bytes(gzip.compress(b"damaged\n"))
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="damaged"):
        M.read(spark, f"{root}/two", "id long, s string")
    assert M.run_stages(spark, stages, root, key) == ["two"] and M.read(spark, f"{root}/two", "id long, s string").count() == 10
    assert M.drop_old_versions(spark, f"{root}/two") == 1 and M.damaged(spark, f"{root}/two").isEmpty()
    with pytest.raises(FileExistsError):
        M.Folder(spark, f"{root}/two").put("x", M.LEDGER, f"{1:012d}")
    before = M.input_fingerprint(spark, f"{root}/one")
    assert before == M.input_fingerprint(spark, f"{root}/one")
    (tmp_path / "run" / "one" / "more.txt").write_text("x")
    assert before != M.input_fingerprint(spark, f"{root}/one")


def test_streaming(spark, tmp_path):
    lake = spark.createDataFrame([("t1", "f", None, ["A"], 1, 1, [["x"]], 1)], "source_table_id string, source_file string, pgtitle string, title array<string>, num_cols int, num_rows int, data array<array<string>>, loaded_at int")
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    lake.write.parquet(src)
    assert T.normalize_new(spark, src, lake.schema, out, state) == 1
    assert T.normalize_new(spark, src, lake.schema, out, state) == 0
    lake.withColumn("source_table_id", F.lit("t2")).write.mode("append").parquet(src)
    assert T.normalize_new(spark, src, lake.schema, out, state) == 1
    assert {r.source_table_id for r in spark.read.parquet(out).collect()} == {"t1", "t2"}
    kv = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int")
    T.upsert(spark, str(tmp_path / "kv"), kv(("a", 1, 1), ("b", 1, 1)), "k", "at")
    assert {(r.k, r.v) for r in T.upsert(spark, str(tmp_path / "kv"), kv(("a", 2, 2)), "k", "at").collect()} == {("a", 2), ("b", 1)}


def test_event_windows(spark, tmp_path):
    ev = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 1 as user_id, 'view' as event_type, 2.0 as value union all select timestamp'2024-01-01 00:02:00', 1, 'view', 3.0")
    ev.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))
    q = T.windowed_counts(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.sql("select n, total from w").collect()] == [(2, 5.0)]
    assert T.sessions(ev).first().n == 2 and C.latest(ev, "user_id", "ts").count() == 1


def test_fetched_once(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("")

    def fetch(keys):
        with open(log, "a") as f:
            f.writelines(k + "\n" for k in keys)
        return [None if k == "bad" else k.upper() for k in keys]

    tasks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "bad"), (5, None)], "id int, url string")
    store = str(tmp_path / "store")
    for _ in range(2):
        got = {r.id: r.page for r in T.fetched_once(spark, tasks, "url", store, fetch, "page").collect()}
        assert got == {1: "A", 2: "A", 3: "B", 4: None, 5: None}
    assert sorted(log.read_text().split()) == ["a", "b", "bad", "bad"]
    assert T.fetched_once(spark, tasks.limit(0), "url", store, fetch, "page").count() == 0
