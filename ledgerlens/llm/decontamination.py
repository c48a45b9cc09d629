"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every window of w consecutive k-gram hashes of a text the smallest (the first, on ties) is kept as a fingerprint.
A span of k + w - 1 = window_words words that two texts share then shares a fingerprint: the guarantee. Fingerprints
of documents meet those of the benchmark, each hit is extended to the shared windows around it, compared word by word,
and a document's hit words are the union of its windows. Items shorter than a window are one window of their own
length; for the few lengths that occur, documents add all their grams of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import screened, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: every ASCII character but digits and lower-case letters (fixed by the contract).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), lambda w: w != "")


def _grams(words: str, size: int) -> Column:
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (size - 1))
    return F.when(n >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _winnowed(df: DataFrame, words: str, window_words: int, gram: int) -> DataFrame:
    """Add places of the word array: (size, at, hash) of each winnowed gram; at counts words from 1."""
    width = window_words - gram + 1
    df = df.withColumn("_h", _grams(words, gram))
    # hash and place in one number, so that the least one names its place: 31 bits order, the low 32 place
    df = df.withColumn("_v", F.transform("_h", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 32) + i + 1))
    starts = F.sequence(F.lit(1), F.size("_v") - (width - 1))
    least = F.when(F.size("_v") >= width, F.transform(starts, lambda i: F.array_min(F.slice("_v", i, width)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_m", F.array_distinct(least))
    at = lambda v: v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    entry = lambda v: F.struct(F.lit(window_words).alias("size"), at(v).alias("at"), F.get("_h", at(v) - 1).alias("hash"))
    return df.withColumn("places", F.transform("_m", entry)).drop("_h", "_v", "_m")


def _short_places(words: str, size: int) -> Column:
    return F.transform(_grams(words, size), lambda h, i: F.struct(F.lit(size).alias("size"), (i + 1).alias("at"), h.alias("hash")))


def _surroundings(words: str, p: Column, window_words: int, gram: int) -> Column:
    """A place with near, the words that any window over its gram can have, and before, how many of them come ahead."""
    long = p["size"] == window_words
    first = F.when(long, F.greatest(F.lit(1), p["at"] - (window_words - gram))).otherwise(p["at"])
    near = F.slice(words, first, p["at"] + p["size"] - first)
    return F.struct(p["size"].alias("size"), p["at"].alias("at"), p["hash"].alias("hash"), (p["at"] - first).alias("before"), near.alias("near"))


def benchmark_prints(benchmark: DataFrame, window_words: int, gram: int, item_col: str, text_col: str) -> DataFrame:
    """size, hash, item_id, before (words from the surroundings' start to the gram), near (the words around it)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), item_words(F.col(text_col)).alias("iw")).where(F.size("iw") > 0)
    items = items.withColumn("n", F.size("iw"))
    long = _winnowed(items.where(F.col("n") >= window_words), "iw", window_words, gram)
    long = long.select("item_id", F.inline(F.transform("places", lambda p: _surroundings("iw", p, window_words, gram)))).select("size", "hash", "item_id", "before", "near")
    short = items.where(F.col("n") < window_words).select(F.col("n").alias("size"), F.xxhash64("iw").alias("hash"), "item_id", F.lit(0).alias("before"), F.col("iw").alias("near"))
    return long.unionByName(short).distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window_words: int = 10,
    gram: int = 5,
    max_broadcast_prints: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans holds (start, size) of every window found, words counted from 1. Null texts have no words. Rows that repeat
    id and text are told apart by nothing and give equal rows, as many as there are; rows of one id and other texts
    stay apart by text_key. Items without words match nothing; null item ids hit, but are not listed. An empty
    benchmark hits nothing. Very long texts stay one row; only fingerprints and hits are exploded. The benchmark's
    prints are broadcast if they number at most max_broadcast_prints, else the join shuffles. Other columns are not read.
    """
    prints = written(benchmark_prints(benchmark, window_words, gram, item_col, item_text_col), "benchmark-prints")
    sizes = [r["size"] for r in prints.select("size").distinct().collect()]  # at most window_words values
    small = prints.limit(max_broadcast_prints + 1).count() <= max_broadcast_prints
    shared = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    # Where prints meet: size, at and hash only; the row of size 0 stands for the document itself.
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("_text"))
    rows = _winnowed(keyed.select("doc_id", "text_key", item_words(F.col("_text")).alias("dw")), "dw", window_words, gram)
    extra = [_short_places("dw", m) for m in sorted(sizes) if m < window_words]
    whole = F.struct(F.lit(0).alias("size"), F.size("dw").alias("at"), F.lit(None).cast("bigint").alias("hash"))
    rows = rows.withColumn("places", F.concat(F.array(whole), "places", *extra))
    # a generator of its own, below which no later filter moves: it would evaluate the places again
    rows = rows.select(F.inline(F.array(F.struct("doc_id", "text_key", "places"))))
    rows = rows.select("doc_id", "text_key", F.explode("places").alias("p")).select("doc_id", "text_key", "p.*")
    wanted = prints.select(F.col("size").alias("b_size"), F.col("hash").alias("b_hash"), F.lit(True).alias("met")).distinct()
    met = rows.join(shared(wanted), (F.col("size") == F.col("b_size")) & (F.col("hash") == F.col("b_hash")), "left").where("met or size = 0")
    met = written(met.select("doc_id", "text_key", "size", "at", "hash"), "prints-met")

    # Extension, on the texts that met any: the windows over the gram that lie in both texts and are equal word by word.
    hits = met.where("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("size", "at", "hash")).alias("hits"))
    hits = written(hits, "print-hits")
    near = screened(keyed, ["doc_id", "text_key"], hits.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key")))
    near = near.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(["doc_id", "text_key"])
    near = near.select("doc_id", "text_key", item_words(F.col("_text")).alias("dw"), "hits")
    near = near.select("doc_id", "text_key", F.inline(F.transform("hits", lambda h: _surroundings("dw", h, window_words, gram))))
    other = prints.select(F.col("size").alias("b_size"), F.col("hash").alias("b_hash"), "item_id", F.col("before").alias("i_before"), F.col("near").alias("i_near"))
    both = near.join(shared(other), (F.col("size") == F.col("b_size")) & (F.col("hash") == F.col("b_hash")))
    size, at = F.col("size"), F.col("at")
    ahead, behind = (F.col("before"), F.col("near")), (F.col("i_before"), F.col("i_near"))
    backs = F.sequence(F.lit(0), F.least(ahead[0], behind[0]))

    def same(o: Column) -> Column:
        a, b = (F.slice(near, before - o + 1, size) for before, near in (ahead, behind))
        return (F.size(a) == size) & (a == b)

    spans = F.transform(F.filter(backs, same), lambda o: F.struct((at - o).alias("start"), size.alias("size")))
    found = both.select("doc_id", "text_key", "item_id", spans.alias("spans")).where("size(spans) > 0")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))

    per = met.where("size = 0").groupBy("doc_id", "text_key").agg(F.max("at").cast("long").alias("n_words"), F.count("*").cast("int").alias("copies"))
    per = per.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    per = per.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["size"] - 1).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - 1 - F.greatest(a["end"], s["start"] - 1))).alias("n"))
    per = per.withColumn("n_hit", F.aggregate("spans", start, step, lambda a: a["n"]))
    per = per.withColumn("_", F.explode(F.sequence(F.lit(1), "copies")))
    return per.select("doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without any benchmark window; only rows that may be contaminated are shuffled."""
    found = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    found = written(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "contaminated")
    rows = docs.withColumn("_key", F.xxhash64(F.col(text_col))).withColumn("_id", F.col(id_col))
    clear = screened(rows, ["_id", "_key"], found, "left_anti")
    gone = found.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"))
    near = screened(rows, ["_id", "_key"], found).join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_anti")
    return clear.unionByName(near).drop("_key", "_id")
