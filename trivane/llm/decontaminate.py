"""Benchmark decontamination by size-partitioned MinHash containment search (native).

An item contaminates a document if the document holds at least ``threshold`` of the item's distinct
five-word shingles. Symmetric MinHash signatures fail here: for a 30-shingle item inside a
20,000-word text the Jaccard similarity is near 0. So, as in ensemble containment search, items are
partitioned by size, and each partition's threshold is turned into a number of hash values: an item
of a partition with at most ``u`` shingles is represented by its ``k(u) = u - ceil(t * u) + 1`` minimum
hash values (all, if it has fewer). A document that lacks more than ``n - ceil(t * n)`` of an item's ``n``
shingles is no match, so every match meets at least ``k - (n - ceil(t * n)) >= 1`` of the minima:
no true pair is lost. Document shingles are hashed inside the row and meet the minima in an equi-join; only the hits
leave the scan. Candidates are then verified by exact containment of the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, written

SHINGLE = 5
THRESHOLD = 0.8


def normal_words(text: Column) -> Column:
    """Lower-case words of letters, digits and all beyond ASCII."""
    joined = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _hashed(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the word n-grams; the whole sequence as one if there are fewer words."""

    def grams(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.array_distinct(F.when(F.size(h) >= n, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))

    return let(F.transform(words, lambda x: F.xxhash64(x)), grams)


def _grams(words: Column, n: int) -> Column:
    def grams(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return let(words, grams)


def contamination(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment) of items inside documents.

    n_shingles counts the item's distinct shingles. Texts of fewer than ``shingle`` words have their whole
    sequence as their one shingle; null and empty ones have none and match nothing. Repeated items
    match alike; rows that share a doc_id (null is a value too) are judged each by itself and reported
    once, with the largest containment. Other columns are ignored; empty tables give no pair.
    """
    shared, it = _matches(docs, items, shingle, threshold)
    pairs = shared.join(it.select("item_id", "_item"), "_item")
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_shingles"), F.max("n_shared").cast("long").alias("n_shared"), F.max(F.col("n_shared") / F.col("n")).alias("containment"))


def _matches(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, _t: hash of the text) by items (_item, n, n_shared) that they hold, and the items."""
    it = items.select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    it = it.withColumn("_item", F.xxhash64(F.array_join("w", " ")))
    it = written(it.withColumn("h", _hashed(F.col("w"), shingle)).withColumn("n", F.size("h")), "decon-items")
    # Partition by size: (2^(c-1), 2^c] shingles.
    top = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    k = F.least(F.col("n"), top - F.ceil(top * threshold - 1e-9).cast("int") + 1)
    mins = it.select("_item", "n", need.alias("need"), k.alias("k"), F.slice(F.array_sort("h"), F.lit(1), k).alias("mins"))
    mins = mins.dropDuplicates(["_item"]).select("_item", "n", "need", "k", F.explode("mins").alias("h"))
    # Generated code makes and looks up a document's shingles one at a time: no array of them, no row but the hits.
    d = docs.select("doc_id", "text").select("doc_id", F.xxhash64("text").alias("_t"), F.transform(normal_words(F.col("text")), lambda x: F.xxhash64(x)).alias("ws"))
    d = d.where(F.size("ws") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - shingle, F.lit(0)))))
    run = F.xxhash64(*[F.get("ws", F.col("i") + j) for j in range(shingle)])
    size = F.greatest(F.size("ws") - shingle + 1, F.lit(1))
    probes = d.select("doc_id", "_t", size.alias("size"), F.when(F.size("ws") >= shingle, run).otherwise(F.xxhash64("ws")).alias("h"))
    hits = probes.join(mins, "h").where("size >= need").dropDuplicates(["doc_id", "_t", "_item", "h"])
    cand = hits.groupBy("doc_id", "_t", "_item").agg(F.count(F.lit(1)).alias("hits"), F.first("k").alias("k"), F.first("n").alias("n"), F.first("need").alias("need"))
    cand = written(cand.where("hits >= k - (n - need)").select("doc_id", "_t", "_item", "n", "need"), "decon-pairs")
    # Exact: words of shared shingles, for candidate documents alone.
    ids = cand.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u")).distinct()
    d = docs.select("doc_id", F.xxhash64("text").alias("_t"), "text")
    d = d.join(ids, d.doc_id.eqNullSafe(F.col("_id")) & (d._t == F.col("_u")), "left_semi").distinct()
    d = d.select("doc_id", "_t", F.explode(_grams(normal_words(F.col("text")), shingle)).alias("s"))
    grams = it.dropDuplicates(["_item"]).select("_item", "n", F.explode(_grams(F.col("w"), shingle)).alias("s"))
    shared = d.join(grams, "s").groupBy("doc_id", "_t", "_item", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    c = cand.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u"), F.col("_item").alias("_i"), "need")
    on = shared.doc_id.eqNullSafe(F.col("_id")) & (shared._t == F.col("_u")) & (shared._item == F.col("_i"))
    return shared.join(c, on).where("n_shared >= need").select("doc_id", "_t", "_item", "n", "n_shared"), it


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows whose text contains an item; all columns stay, whatever their names.

    Rows are judged one by one by their text: of rows that share a doc_id (or have none) only those with an
    item go; of repeated rows all or none. Null, empty and wordless texts stay. Empty tables change nothing.
    """
    bad = _matches(docs, items, shingle, threshold)[0].select(F.col("doc_id").alias("_bad"), F.col("_t").alias("_text")).distinct()
    bad = written(bad, "decon-bad")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    rows = rows.join(bad, rows._id.eqNullSafe(F.col("_bad")) & (rows._t == F.col("_text")), "left_anti")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


WORDS_SQL = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
GRAMS_SQL = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
OP5_SQL = f"""
    WITH d AS (SELECT doc_id, unnest({GRAMS_SQL}) AS s FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents)),
    b AS (SELECT item_id, unnest(g) AS s, len(g) AS n FROM (SELECT item_id, {GRAMS_SQL} AS g FROM (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark)))
    SELECT doc_id, item_id, n::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*) / n AS containment
    FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""
