"""Phrase mining: counts of all word n-grams per language, pointwise scores of their cuts, phrases inside longer ones dropped.

Texts are cut into pieces, equal pieces are counted, and the 1..max_n-grams of each are exploded into rows and summed by
hash aggregation per language. From three words on, only n-grams are exploded whose two parts of one word less may
themselves be frequent, as a frequent phrase has frequent parts only; the test is a bounded pre-filter that lets some
more through, never less. A candidate's first and last parts are candidates or words, so that their counts are joined
from the same tables; scores are exact in Decimal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.llm.common import screened, written

#: What ends a piece, and what parts the words of a piece (fixed by the contract).
PIECE_GAP, WORD_GAP = r"[.,;:!?\x0A-\x0D]+", r"[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "und"
SCALE = 1_000_000


def _lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; translate, which is slow, only where a text has other letters and changes."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only | (F.lower(text) == text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece (lower-cased, one space between words) and n, its number, of all pieces that have a word.

    Null languages are UNKNOWN, null texts have no piece. Pieces that repeat, as in copies and in short phrases, are counted
    here once, so that what follows works on each of them once.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(f"`{text_col}`", PIECE_GAP, -1)).alias("piece"))
    rows = rows.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''").select("lang", _lower(F.col("piece")).alias("piece"))
    # one space between words, so that they part at a plain character, not at an expression to be compiled for each piece
    wide = F.contains("piece", F.lit("  ")) | F.contains("piece", F.lit("\t"))
    plain = F.when(wide, F.regexp_replace("piece", WORD_GAP, " ")).otherwise(F.col("piece"))
    return rows.select("lang", plain.alias("piece")).groupBy("lang", "piece").agg(F.count("*").alias("n"))


def _grams(size: int) -> Column:
    """All n-grams of so many words, joined by one space: each is one of a word less with the word after it."""
    found = F.col("words")
    for n in range(2, size + 1):
        joined = F.zip_with(found, F.slice("words", n, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
        found = F.slice(joined, 1, F.greatest(F.size("words") - (n - 1), F.lit(0)))
    return found


def _longer() -> Column:
    """head, tail and last of every n-gram: what lacks its last word, what lacks its first, and its last word."""
    return F.transform("last", lambda word, i: F.struct(F.get("heads", i).alias("head"), F.get("heads", i + 1).alias("tail"), word.alias("last")))


def counted(docs: DataFrame, max_n: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, f: all single words, and every longer phrase of up to max_n words that occurs least times."""
    rows = written(pieces(docs, text_col, lang_col), "pieces").select("lang", "n", F.split("piece", " ", -1).alias("words"))
    n_words = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).alias("words")

    def summed(grams: DataFrame, name: str) -> DataFrame:
        found = grams.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        kept = found.where((F.col("f") >= least) | ~F.contains("phrase", F.lit(" ")))
        return written(kept.select("lang", "phrase", n_words, "f"), name)

    levels = [summed(rows.select("lang", "n", F.explode(F.flatten(F.array(*map(_grams, range(1, min(max_n, 2) + 1))))).alias("phrase")), "phrases-2")]
    for size in range(3, max_n + 1):
        known = levels[-1].where(F.col("words") == size - 1)
        # no filter by size: it would move below and split every piece once more
        grams = rows.select("lang", "n", "words", _grams(size - 1).alias("heads"))
        grams = grams.withColumn("last", F.slice("words", size, F.size("words"))).select("lang", "n", F.inline(_longer()))
        for part in ("head", "tail"):
            grams = screened(grams, ["lang", part], known.withColumnRenamed("phrase", part))
        levels.append(summed(grams.select("lang", "n", F.concat("head", F.lit(" "), "last").alias("phrase")), f"phrases-{size}"))
    return reduce(DataFrame.unionByName, levels)


def scored(counts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more: those of its lowest cut, the earliest on ties."""
    known = counts.where((F.col("words") == 1) | (F.col("f") >= least))
    words = F.split("phrase", " ", -1)
    part = lambda at, n: F.array_join(F.slice("_w", at, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("first"), part(k + 1, F.size("_w") - k).alias("rest")))
    rows = known.where("words > 1").withColumn("_w", words).select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    for name, of in (("l", "first"), ("r", "rest")):
        other = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        rows = rows.join(other, (F.col("lang") == F.col("_lang")) & (F.col(of) == F.col("_part"))).drop("_lang", "_part")
    big = lambda c: F.col(c).cast(T.DecimalType(19, 0))
    # at most 19 + 19 digits and the scale: exact up to counts of 10^16; a is at most l and r, so the quotient is a long
    rows = rows.withColumns({"_top": big("a") * big("a") * F.lit(SCALE).cast(T.DecimalType(7, 0)), "_low": big("l") * big("r")})
    rows = rows.select("lang", "phrase", "a", F.struct(F.expr("_top div _low").cast("long").alias("score"), "k", "l", "r").alias("cut"))
    return rows.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inside(counts: DataFrame, least: int, percent: int) -> DataFrame:
    """lang, phrase of those that an extension by one word covers: 100 * f(extension) >= percent * f(phrase).

    A longer phrase that covers one contains an extension by one word which occurs at least as often, and covers it too.
    """
    longer = counts.where((F.col("words") > 2) & (F.col("f") >= least)).withColumn("_w", F.split("phrase", " ", -1))
    ends = [F.array_join(F.slice("_w", at, F.size("_w") - 1), " ") for at in (1, 2)]
    most = longer.select("lang", F.explode(F.array(*ends)).alias("_part"), "f").groupBy("lang", "_part").agg(F.max("f").alias("_most"))
    short = counts.where((F.col("words") > 1) & (F.col("f") >= least))
    most = most.withColumnRenamed("lang", "_lang")
    near = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part"))
    return short.join(most, near).where(100 * F.col("_most") >= percent * F.col("f")).select("lang", "phrase")


def mine(docs: DataFrame, max_n: int = 3, least: int = 10, percent: int = 50, top: int | None = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the best phrases of 2 to max_n words: lang, rank, phrase, a, l, r, n, score.

    n counts all words of the language, a the phrase, l and r the parts of its lowest-scoring cut; score is
    floor(SCALE * a * a / (l * r)). Phrases under least occurrences are no candidates; candidates inside longer ones that
    occur percent as often are dropped. The first top rows a language stay (all for None), by score and a downwards, then
    phrase. Null languages are UNKNOWN, null and empty texts hold nothing, repeated rows all count, and an empty table
    gives no rows. Very long texts are exploded piece by piece. Other columns are not read, whatever their names.
    """
    counts = counted(docs, max_n, least, text_col, lang_col)
    totals = counts.where("words = 1").groupBy(F.col("lang").alias("_lang")).agg(F.sum("f").alias("n"))
    gone = inside(counts, least, percent).select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"))
    rows = scored(counts, least).join(gone, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # first within shares of a language, so that only the best of each share meet in one task
        rows = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top).drop("_share")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
