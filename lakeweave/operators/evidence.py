"""Text evidence about entities: links, usefulness, containment, weak labels, term scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import clean_text, gate_norm, text_key


def usable(assets: DataFrame) -> DataFrame:
    """Images with a path, texts with visible content; one row per asset, the latest."""
    ok = F.when(F.col("asset_type") == "image", F.coalesce(F.trim("local_path"), F.lit("")) != "").otherwise(F.coalesce(F.trim("content"), F.lit("")) != "")
    order = Window.partitionBy("asset_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("content").desc_nulls_last())
    return assets.filter(F.col("asset_id").isNotNull() & ok).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def links(owners: DataFrame, owner: str, entity: str, assets: DataFrame) -> DataFrame:
    """(owner, n_text, n_image, first_asset): assets of the owner's entity; owners without any keep a row.

    Assets are reduced to one row per entity before the join, so an entity with a tenth of the assets
    and a tenth of the owners meets once per owner, not once per pair."""
    per = assets.filter("entity_id is not null").groupBy("entity_id").agg(F.count_if(F.col("asset_type") == "text").alias("n_text"), F.count_if(F.col("asset_type") == "image").alias("n_image"), F.min("asset_id").alias("first_asset"))
    return owners.select(F.col(owner).alias("owner"), F.col(entity).alias("entity_id")).join(per, "entity_id", "left").select("owner", F.coalesce("n_text", F.lit(0)).alias("n_text"), F.coalesce("n_image", F.lit(0)).alias("n_image"), "first_asset")


def support_mode(text: Column, image: Column) -> Column:
    return F.when(text & image, "text_and_image").when(text, "text_only").when(image, "image_only").otherwise("none")


def times(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("int")


def weak_label(text: Column, subject: Column, value: Column) -> Column:
    """0.9 where a text names subject and value, 0.8 the value alone, 0.5 the subject alone, else 0."""
    t = F.lower(text)
    s, v = (F.length(x) > 0 for x in (subject, value))
    has_s, has_v = s & t.contains(F.lower(subject)), v & t.contains(F.lower(value))
    return F.when(has_s & has_v, 0.9).when(has_v, 0.8).when(has_s, 0.5).otherwise(0.0)


def tf_idf(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): length-normalised tf x (ln((N + 1) / (df + 1)) + 1)."""
    words = texts.select(F.col(key), F.explode(F.filter(F.split(text_key(text), " "), lambda w: w != "")).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    n = texts.select(key).distinct().agg(F.count("*").alias("n"))
    weighed = words.join(df, "token").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("weight"))


def masked(text: Column) -> Column:
    """URLs and ISBNs blotted out."""
    t = F.regexp_replace(clean_text(text), r"https?://\S+", "[link]")
    return F.regexp_replace(t, r"\b97[89][- ]?\d{1,5}(?:[- ]?\d+){2,3}[- ]?\d\b|\b97[89]\d{10}\b", "[ISBN]")


def entity_anchors(cells: DataFrame) -> DataFrame:
    """(query_id, row, anchors): per row of (query_id, row, column_name, text) the title in its entity
    address and the visible texts that are a beginning of it, four letters or more."""
    named = F.lower(F.trim("column_name")) == "entity_url"
    keyed = cells.withColumn("url", named).withColumn("k", gate_norm(F.when(named, F.regexp_extract("text", r"^https?://[^/?#]+(?:/[^?#]*)?/([^/?#]+)/*(?:[?#].*)?$", 1)).otherwise(F.col("text"))))
    known = keyed.filter((F.length("k") >= 4) & F.col("k").rlike(r"\p{L}"))
    titles = known.filter("url").groupBy("query_id", "row").agg(F.collect_set("k").alias("titles"))
    seen = known.filter("not url").groupBy("query_id", "row").agg(F.collect_set("k").alias("seen"))
    starts = F.filter("seen", lambda v: F.exists("titles", lambda t: (t == v) | t.startswith(F.concat(v, F.lit(" ")))))
    return titles.join(seen, ["query_id", "row"], "left").select("query_id", "row", F.array_sort(F.array_union("titles", F.coalesce(starts, F.array().cast("array<string>")))).alias("anchors"))


def evidence_gate(tasks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(task_id, verdict) of reading tasks (task_id, query_id, row, kinds, texts): whether the texts name
    the row's entity, only other rows' entities, or cannot be told; images always pass."""
    own = anchors.select("query_id", "row", "anchors")
    every = anchors.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("every"))
    texts = tasks.select("task_id", F.explode("texts").alias("t")).select("task_id", gate_norm("t").alias("t")).groupBy("task_id").agg(F.collect_list(F.concat(F.lit(" "), "t", F.lit(" "))).alias("chunks"))
    j = tasks.join(own, ["query_id", "row"], "left").join(every, "query_id", "left").join(texts, "task_id", "left")
    none = F.array().cast("array<string>")
    j = j.withColumn("anchors", F.coalesce("anchors", none)).withColumn("other", F.array_except(F.coalesce("every", none), F.col("anchors"))).withColumn("chunks", F.coalesce("chunks", none))
    says = lambda chunk, words: F.exists(words, lambda a: chunk.contains(F.concat(F.lit(" "), a, F.lit(" "))))
    current = F.exists("chunks", lambda c: says(c, F.col("anchors")))
    others = (F.size("other") > 0) & F.forall("chunks", lambda c: says(c, F.col("other")))
    verdict = F.when(F.exists("kinds", lambda k: k != "text"), "VISUAL_PASS").when(F.size("anchors") == 0, "NO_RELIABLE_ANCHOR_PASS").when(current, "CURRENT_ENTITY_PRESENT").when(others, "OTHER_ROWS_ONLY").otherwise("UNCERTAIN_PASS")
    return j.select("task_id", verdict.alias("verdict"))
