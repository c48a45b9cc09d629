"""Spelling variants: words one code point apart, found by wildcard groups and deletions, without any pair of a group.

Words that differ by one replaced code point share a wildcard group: (position, prefix, suffix). A group keeps its size
and its two most frequent words; a word's best neighbour there is the first of them that is not itself. A word with a
code point too many meets its neighbour where one of its deletions is a word. Both give a count and a best neighbour for
each word; they are summed without naming the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import written

#: What parts the runs, and the case folding of the contract.
RUN_GAP = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: str, at: Column) -> Column:
    """The word without its code point at a place counted from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def vocabulary(docs: DataFrame, least: int = 3, min_chars: int = 5, one_in: int | None = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all runs of letters of at least min_chars code points and least occurrences.

    With one_in, runs whose crc32 of "<id>:<run>" it divides lose a code point first; a null id is written as ''.
    """
    runs = F.filter(F.split(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), RUN_GAP, -1), lambda w: F.length(w) >= min_chars)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if one_in:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        rows = rows.select(F.when(F.col("h") % one_in == 0, _without("run", (F.col("h") % F.length("run")).cast("int") + 1)).otherwise(F.col("run")).alias("word"))
    else:
        rows = rows.select(F.col("run").alias("word"))
    return rows.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def replaced(words: DataFrame) -> DataFrame:
    """word, near, best (struct of -n and word): per wildcard group of two words or more, what each word finds there.

    A group has at most as many words as there are letters, since its words differ in one place only.
    """
    at = F.sequence(F.lit(1), F.length("word"))
    rows = words.select("word", "n", F.explode(at).alias("at"))
    rows = rows.select("word", "n", "at", F.substring("word", F.lit(1), F.col("at") - 1).alias("prefix"), F.substring("word", F.col("at") + 1, F.length("word")).alias("suffix"))
    group = Window.partitionBy("at", "prefix", "suffix")
    whole = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    rows = rows.select("word", F.count("*").over(whole).alias("size"), F.nth_value(one, 1).over(whole).alias("first"), F.nth_value(one, 2).over(whole).alias("second"))
    best = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    return rows.where("size > 1").select("word", (F.col("size") - 1).alias("near"), best.alias("best"))


def shifted(words: DataFrame) -> DataFrame:
    """word, near, best as replaced(), for neighbours with a code point more or less: one row a link and side.

    Links grow with the words, not with pairs: a word has as many deletions as code points.
    """
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))))
    long = words.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(cut).alias("cut"))
    links = long.join(words, F.col("cut") == F.col("word")).select("long", "long_n", F.col("word").alias("short"), F.col("n").alias("short_n"))
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col(f"{b}_n")).alias("minus"), F.col(b).alias("word")).alias("best"))
    return links.select(F.inline(F.array(side("long", "short"), side("short", "long"))))


def rooted(forms: DataFrame) -> DataFrame:
    """Add root to word, form: the last word reached from form to form, or the word itself.

    Forms must get strictly more frequent, so that chains end. Each round doubles the steps behind each pointer; a chain
    over counts that double has at most log2(greatest n) steps, so there are few rounds.
    """
    at = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        step = written(at.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        at = step.drop("moved")
        if not moved:
            break
    at = at.select(F.col("word").alias("_w"), "root")
    return forms.join(at, F.col("word") == F.col("_w"), "left").drop("_w").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, least: int = 3, min_chars: int = 5, one_in: int | None = 97, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    form is the most frequent near word (the least in code-point order on ties) if it occurs times as often, else null;
    root follows forms to the last. Null texts hold nothing, null ids count as '' in the hash, repeated rows all count, an
    empty table gives no rows. Very long texts are one row until their runs are exploded. Other columns are not read,
    whatever their names.
    """
    words = written(vocabulary(docs, least, min_chars, one_in, id_col, text_col), "vocabulary")
    near = replaced(words).unionByName(shifted(words)).groupBy(F.col("word").alias("_w")).agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    rows = words.join(near, F.col("word") == F.col("_w"), "left")
    strong = -F.col("best.minus") >= times * F.col("n")
    rows = rows.select("word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    return rooted(written(rows, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
