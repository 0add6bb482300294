"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of 13 words. A window lies in a document only if all its word
shingles do, so for exact containment the necessary prefix is one shingle: the window's rarest in the
documents. Documents are joined on those prefix shingles alone; the shingle's place in the window bounds
where the window must begin and end, and then all its words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Shielded, cut

#: What stands between words (fixed value): ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Words of a shingle; shorter windows have one shingle of all their words.
SHINGLE = 3
#: Tables from a benchmark of at most so many bytes are broadcast; those of a larger one are joined by shuffling positions.
BROADCAST_BYTES = 32_000_000


def words(text: Column) -> Column:
    """The text's words with A-Z in lower case; empty for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # what stands between words cuts far faster than words are extracted; only a first and a last piece can be empty
    return F.array_remove(F.split(plain, BETWEEN), "")


def _shingle(words_: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(F.col(words_), at + j) for j in range(k)))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """w (words), n (their number), items: the distinct windows and which items they come from."""
    rows = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("words")).where("size(words) > 0")
    cut_ = rows.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - WINDOW))).alias("at"))
    return cut_.groupBy(F.slice("words", F.col("at") + 1, WINDOW).alias("w")).agg(F.collect_set("item").alias("items")).withColumn("n", F.size("w"))


def _window_shingles(table: DataFrame) -> DataFrame:
    """w, n, items, o (place of the shingle in the window), k, h of all shingles of all windows."""
    at = table.withColumn("k", F.least("n", F.lit(SHINGLE))).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("o"))
    h = F.when(F.col("k") == 1, _shingle("w", F.col("o"), 1))
    for k in range(2, SHINGLE + 1):
        h = h.when(F.col("k") == k, _shingle("w", F.col("o"), k))
    return at.withColumn("h", h)


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """id, mark, n_words, p, h: a shingle of each of the sizes at each word, and one row with p = -1 for each document."""
    rows = docs.select("id", "mark", F.size("words").alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("p"))
    hashes = [F.when(F.col("p") >= 0, _shingle("words", F.col("p"), k)) for k in sizes]
    h = hashes[0] if len(sizes) == 1 else F.explode(F.when(F.col("p") >= 0, F.array(*hashes)).otherwise(F.array(F.lit(None).cast("long"))))
    return rows.select("id", "mark", "n_words", "p", h.alias("h"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """id, mark, n_words, copies, spans, items of every distinct (key, text) row.

    spans is the set of (start, end) word ranges that equal a window, items the set of their items.
    `mark` is a 64-bit hash of the row's text, so that rows of one key with other texts stay apart.

    Documents are cut into words once for the places where a benchmark's shingle stands, which are written;
    all that follows works on those. Only documents with a place that the prefix and its bounds leave are cut
    again, to compare words. What comes from the benchmark is broadcast if its bytes are few, whatever the
    number of documents; a benchmark of any size is joined by shuffling instead.
    """
    spark = docs.sparkSession
    shingles = cut(_window_shingles(windows(benchmark, item, item_text)), "window-shingles")
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.lit(1), text).alias("mark"), words(F.col(text)).alias("words"))
    if not sizes:
        none = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast(spark.createDataFrame([], benchmark.select(F.array(item).alias("i")).schema).schema["i"].dataType)
        return rows.groupBy("id", "mark").agg(F.max(F.size("words")).alias("n_words"), F.count("*").alias("copies")).withColumns({"spans": none[0], "items": none[1]})
    weight = shingles.agg(F.sum(F.octet_length(F.array_join("w", " ")) + 100).alias("bytes")).first().bytes
    sent = F.broadcast if weight <= BROADCAST_BYTES else lambda table: table.hint("merge")

    keys = shingles.select("h", F.lit(True).alias("known")).distinct()
    seen = cut(_positions(rows, sizes).join(sent(keys), "h", "left").where("known or p = -1").drop("known"), "seen")
    places = seen.where("p >= 0")
    # the rarest shingle of each window; a window with one that no document has can't occur
    counts = places.groupBy("h").agg(F.count("*").alias("count"))
    ranked = shingles.join(counts, "h", "left").groupBy("w", "n", "items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "h", "o")).alias("x"))
    prefix = cut(ranked.where("x.c > 0").select("w", "n", "items", "x.h", "x.o", F.xxhash64("w").alias("wid")), "prefix")

    bounded = places.join(sent(prefix.select("h", "o", "n", "wid")), "h").where("p >= o and p - o + n <= n_words")
    starts = F.collect_set(F.struct((F.col("p") - F.col("o")).alias("s"), "n", "wid")).alias("starts")
    wanted = bounded.groupBy(F.col("id").alias("id_"), F.col("mark").alias("mark_")).agg(starts)
    lean = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    texts = lean.join(wanted.hint("merge"), F.col("key_").eqNullSafe(F.col("id_")) & (F.xxhash64(F.lit(1), "text_") == F.col("mark_")))
    got = texts.select("id_", "mark_", words(F.col("text_")).alias("words"), "starts").select("id_", "mark_", "words", F.inline("starts"))
    got = got.select("id_", "mark_", "s", "n", "wid", F.slice("words", F.col("s") + 1, F.col("n")).alias("got"))
    sure = got.join(sent(prefix.select("wid", "w", "items")), "wid").where("got = w")
    span = F.struct("s", (F.col("s") + F.col("n")).alias("e")).alias("span")
    sure = sure.select(F.col("id_").alias("id"), F.col("mark_").alias("mark"), span, "items", F.lit(None).cast("int").alias("n_words"))
    base = seen.where("p = -1").select("id", "mark", F.lit(None).cast("struct<s:int,e:int>").alias("span"), F.lit(None).cast(prefix.schema["items"].dataType).alias("items"), "n_words")
    return base.unionByName(sure).groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: str) -> Column:
    """The number of words in the union of a row's spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    fold = F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.to))).alias("n"), F.greatest(a.to, x.e).alias("to")))
    return F.when(F.size(spans) == 0, F.lit(0)).otherwise(fold.n).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, mark, n_words, n_hit, items, contaminated, copies of every distinct (key, text) row.

    contaminated: at least one word in `share` lies in an occurrence of a window. Null and empty texts
    have no words and are clean; null and empty items have no windows; items that share a window all
    count; a null item id joins as nothing. Repeated rows come as one with their number in copies.
    Empty tables give empty or clean results. Texts of any length are read whole, as one row of words. Other
    columns are not read.
    """
    rows = matches(docs, benchmark, key, text, item, item_text).withColumn("n_hit", covered("spans"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, under any names, that are not contaminated (see `contamination`). Rows
    that repeat each other all stay or all go; a null key is a key like others."""
    own = Shielded(docs)
    docs, key, text = own.docs, own[key], own[text]
    found = contamination(docs, benchmark, key=key, text=text).where("contaminated")
    bad = cut(found.select(F.col("id").alias("__bad"), F.col("mark").alias("__mark")), "contaminated")
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__bad")) & (F.xxhash64(F.lit(1), text) == F.col("__mark")), "left_anti").select(*own.columns())


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    out = rows.select("id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT row_number() OVER () AS r, * FROM w),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
pos AS (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT r, i, pos.n, item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
cov AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
