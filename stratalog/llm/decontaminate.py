"""Benchmark decontamination: scan documents for windows of benchmark words.

The hashes of the normalised benchmark windows form a broadcast hash set; every window of
every document is hashed inside generated code and probed. What passes, which is little, is
verified word by word against the windows themselves, so a hash collision never counts. A
benchmark of more windows than one broadcast may hold is scanned for in parts, one pass over
the documents each; documents' windows are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import MAX_BROADCAST_ROWS, durable, join_hot, lower_az, without

WINDOW = 10
#: Hashes in one broadcast, some 40 bytes each.
MAX_BROADCAST_KEYS = 2_000_000
#: Windows that may be broadcast whole to verify hits; some 300 bytes each at most for usual words.
MAX_BROADCAST_WINDOWS = 300_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of digits, a-z and non-ASCII characters, A-Z lower-cased; null has none."""
    return F.coalesce(F.array_remove(F.split(lower_az(text), BREAK, -1), ""), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """What tells the text of a row: a hash, and whether there is none."""
    return F.struct(text.isNull().alias("none"), F.xxhash64(text).alias("hash"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, size, win, items): each distinct window with the ids of the items that hold it.

    An item of fewer words is one window; one without words has none. Null ids are no items,
    but their windows count.
    """
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(window), F.size("w"))
    return (
        words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
        .select("item", "size", F.expr("slice(w, at, size)").alias("win"))
        .groupBy("size", "win")
        .agg(F.collect_set("item").alias("items"))
        .select(F.xxhash64("size", "win").alias("key"), "size", "win", "items")
    )


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, text_key, n_words, hits, items.

    hits: sorted structs (at, size) of windows found, at counted from 0; items: ids of the
    benchmark items found, null ids left out. Null and empty texts have no words; repeated
    rows come back as often as they came; other columns are not read. An empty benchmark hits
    nothing, empty docs give no rows.
    """
    windows = durable(benchmark_windows(benchmark, window=window))
    facts = windows.agg(F.collect_set("size").alias("sizes"), F.count(F.lit(1)).alias("n")).first()
    sizes = sorted(facts["sizes"])  # at most `window` integers

    read = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    # One number for each window of each size, and -1 for the document's header row. A single
    # generator of plain numbers stays in generated code, so no row holds a copy of the words.
    n, place = F.size("w"), F.col("place")
    begins = [F.lit(0)]
    for x in sizes:
        begins.append(begins[-1] + F.greatest(n - x + 1, F.lit(0)))
    size, at = F.lit(0), F.lit(-1)
    for x, begin in zip(sizes, begins):
        size, at = F.when(place >= begin, x).otherwise(size), F.when(place >= begin, place - begin).otherwise(at)
    starts = read.select("id", "text_key", "w", F.explode(F.sequence(F.lit(-1), begins[-1] - 1)).alias("place"))
    starts = starts.select("id", "text_key", n.alias("n"), "w", F.when(place < 0, 0).otherwise(size).alias("size"), F.when(place < 0, -1).otherwise(at).alias("at"))
    seen = F.expr("slice(w, greatest(at + 1, 1), size)")
    starts = starts.withColumn("key", F.xxhash64("size", seen))

    # The header's key, that of no words, is in the first part of the set.
    parts = -(-facts["n"] // MAX_BROADCAST_KEYS) or 1
    header = docs.sparkSession.range(1).select(F.xxhash64(F.lit(0), F.array().cast("array<string>")).alias("key"))
    keys = [windows.select("key").distinct().where(F.pmod("key", F.lit(parts)) == k) for k in range(parts)]
    keys[0] = keys[0].unionByName(header)
    passed = reduce(DataFrame.unionByName, [starts.join(F.broadcast(x), "key", "left_semi") for x in keys])
    passed = passed.select("id", "text_key", "n", "at", "size", F.when(F.col("at") >= 0, F.col("key")).alias("key"), seen.alias("seen"))
    known = windows.withColumnRenamed("size", "item_size")
    if facts["n"] <= MAX_BROADCAST_WINDOWS:
        probed = passed.join(F.broadcast(known), "key", "left")
    else:
        passed = durable(passed)
        probed = join_hot(passed.where("at >= 0"), known, "key").unionByName(passed.where("at < 0"), allowMissingColumns=True)
    hits = probed.where((F.col("at") < 0) | (F.col("size") == F.col("item_size")) & (F.col("seen") == F.col("win")))
    return (
        hits.select("id", "text_key", "n", "at", "size", "items")
        .groupBy("id", "text_key")
        .agg(
            F.max("n").cast("long").alias("n_words"),
            F.count_if(F.col("at") < 0).alias("times"),
            F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "size")))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select("*", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"))
        .drop("_", "times")
    )


def n_hit(hits: Column) -> Column:
    """Words inside any hit window."""

    def add(state: Column, hit: Column) -> Column:
        end = hit["at"] + hit["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(state["end"], hit["at"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + fresh).cast("long").alias("n"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), add, lambda s: s["n"])


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    found = scan(docs, benchmark, id_col, text_col)
    hit = n_hit(F.col("hits"))
    return found.select(
        F.col("id").alias(id_col),
        "text_key",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text holds a benchmark window.

    Rows with a null id or text are judged like others; rows repeat as they come; columns may
    have any names. Only ids and hashes of the rows to go are compared with docs.
    """
    bad = judge(docs, benchmark, id_col, text_col).where("contaminated").select(F.col(id_col).alias("id"), "text_key.none", "text_key.hash").distinct()
    return without(docs, bad, [docs[id_col], docs[text_col].isNull(), F.xxhash64(docs[text_col])], ["id", "none", "hash"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every row's text with hit words left out, other words joined by a space.

    A row without a hit keeps its text untouched.
    """
    found = durable(scan(docs, benchmark, id_col, text_col).where("size(hits) > 0").dropDuplicates(["id", "text_key"]).select("id", "text_key", "hits"))
    small = found.limit(MAX_BROADCAST_ROWS + 1).agg(F.sum(F.size("hits"))).first()[0] or 0
    read = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col), text_key(F.col(text_col)).alias("_key"))
    joined = read.join(F.broadcast(found) if small <= MAX_BROADCAST_ROWS else found, read[id_col].eqNullSafe(found["id"]) & (read["_key"] == found["text_key"]), "left")
    kept = F.expr(f"""array_join(transform(filter(transform(w, (x, i) -> struct(x, i)),
        p -> not exists(hits, h -> p.i >= h.at and p.i < h.at + h.size)), p -> p.x), ' ')""")
    return joined.withColumn("w", words_of(F.col(text_col))).select(read[id_col], F.when(F.size("hits") > 0, kept).otherwise(F.col(text_col)).alias(text_col))
