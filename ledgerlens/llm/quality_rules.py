"""Quality rules: a learned decision list over text statistics, with Spark functions only.

Sequential covering: each round grows one conjunction of threshold conditions on two thirds of the labelled rows (by
information gain), prunes it back on the other third, keeps it if it is precise enough there, and goes on with the
rows it leaves. Every step is one aggregation of the labelled statistics into counts per feature, bin and label; the
driver sees these counts only. The list becomes one ordered conditional expression, applied without any shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import words_of, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "marks", "distinct")


def _spread(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an internal column; each in a step of its own, so that later ones do not evaluate it again."""
    return df.withColumn(f"_{name}", value)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, the five base counts and the features of every text; one row per input row, without a shuffle.

    Null and empty texts have zeros. Words are runs of anything but ASCII white space. n_repeat_words counts words in
    windows of five words that the text holds twice or more; windows are compared by a 64-bit hash within one text.
    Other input columns are not read, but for row_col: the name of a struct that carries the whole input row.
    The result stands above a generator, so that later filters on it do not evaluate the statistics again.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if row_col else []
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *carried)
    d = _spread(d, "bare", F.translate("_text", SPACES, ""))
    d = _spread(d, "w", words_of(F.col("_text")))
    d = _spread(d, "n", F.size("_w"))
    d = _spread(d, "lines", F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    starts = F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1))
    d = _spread(d, "h", F.when(F.col("_n") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    d = _spread(d, "again", F.size("_h") > F.size(F.array_distinct("_h")))
    d = _spread(d, "s", F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda e, k: F.coalesce(e["h"] == F.get("_s", k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("_s", k + 1)["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_s", near), lambda e: e["i"]))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(twice, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")), lambda a: a["n"])
    d = _spread(d, "repeat", F.coalesce(covered, F.lit(0)).cast("long"))
    d = _spread(d, "distinct", F.size(F.array_distinct("_w")))

    lost = lambda chars: (F.length("_bare") - F.length(F.translate("_bare", chars, ""))).cast("long")
    d = d.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.length("_bare").cast("long").alias("word_chars"),
        lost(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        lost("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        lost("!?").alias("_marks"),
        "_distinct",
        *(["_row"] if row_col else []),
    )
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    out = F.struct(
        "doc_id",
        *STATS,
        F.col("n_words").cast("double").alias("words"),
        per("word_chars", "n_words").alias("mean_word"),
        per("n_symbols", "n_words").alias("symbols"),
        per("n_dup_lines", "_n_lines").alias("dup_lines"),
        per("n_repeat_words", "n_words").alias("repeats"),
        per("_upper", "word_chars").alias("upper"),
        per("_marks", "n_words").alias("marks"),
        per("_distinct", "n_words").alias("distinct"),
        *([F.col("_row").alias(row_col)] if row_col else []),
    )
    return d.select(F.inline(F.array(out)))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def fires(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: false where a rule rejects, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(fires(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cut points of each feature: midway between neighbouring quantiles of either class, so that a gap is cut in its middle."""
    at = [i / bins for i in range(1, bins)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).collect()  # two rows
    values = {f: sorted({v for r in found for v in r[f] or []}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Per feature, for each bin (index: cut points below the value), [good, bad] rows."""

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])).cast("array<double>"), lambda t: t < F.col(f)))

    parts = [F.struct(F.lit(f).alias("f"), bin_of(f).alias("bin")) for f in FEATURES if cuts[f]]
    if not parts:
        return {}
    out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    grouped = rows.select("bad", F.explode(F.array(*parts)).alias("x")).groupBy("x.f", "x.bin", "bad").count()
    for r in grouped.collect():  # at most features x bins x 2 rows
        out[r["f"]][r["bin"]][r["bad"]] = r["count"]
    return out


def _best(counts: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, int, int]:
    """The condition of the largest information gain: gain, condition, good and bad rows that it keeps."""
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for f in counts:
        good, bad = (list(accumulate(c[k] for c in counts[f])) for k in (0, 1))
        all_good, all_bad = good[-1], bad[-1]
        if not all_bad:
            continue
        base = log2(all_bad / (all_good + all_bad))
        for i, cut in enumerate(cuts[f]):
            for above, n, p in ((False, good[i], bad[i]), (True, all_good - good[i], all_bad - bad[i])):
                if p and (gain := p * (log2(p / (p + n)) - base)) > best[0] + 1e-9:
                    best = (gain, Condition(f, above, cut), n, p)
    return best


def learn(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 24, least_precision: float = 0.95, least_support: int = 5, seed: int = 11) -> list[Rule]:
    """Rules that reject, from rows of doc_id, bad (0 or 1) and FEATURES; empty where no rule is precise enough."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)))
    cuts = _thresholds(rows, bins)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = rows.where("part > 0"), rows.where("part = 0")
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            _, condition, good, _ = _best(_counts(grow.where(fires(tuple(rule))), cuts), cuts)
            if condition is None:
                break
            rule.append(condition)
            if not good:
                break
        if not rule:
            break
        prefixes = [tuple(rule[:k]) for k in range(1, len(rule) + 1)]
        held = prune.agg(*[F.count_if(fires(p) & (F.col("bad") == b)).alias(f"n{i}_{b}") for i, p in enumerate(prefixes) for b in (0, 1)]).first()
        worth = [(held[f"n{i}_1"], held[f"n{i}_0"]) for i in range(len(prefixes))]
        score = [(p - n) / (p + n) if p + n else -1.0 for p, n in worth]
        i = score.index(max(score))
        p, n = worth[i]
        if p < least_support or p < least_precision * (p + n):
            break
        rules.append(prefixes[i])
        rows = rows.where(~fires(prefixes[i]))
    return rules


def base_failed() -> Column:
    """Under ten words, or over 20 % of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of at most max_labelled labelled documents, those of the smallest id hashes, as a written table.

    Ids whose labels disagree or are null are left out; of documents that share an id one is used. Rows that the base
    rules fail are left out too: the list is learned for what they let through.
    """
    picked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high and low in (0, 1) and _id is not null")
    picked = picked.select("_id", (1 - F.col("low")).alias("bad")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id"))  # bounded by max_labelled
    texts = texts.select(F.col(id_col).alias("doc_id"), F.struct("bad", F.col(text_col).alias("text")).alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = statistics(texts.select("doc_id", "x.text")).where(~base_failed())
    return written(rows.join(texts.select(F.col("doc_id").alias("_id"), "x.bad"), F.col("doc_id") == F.col("_id")).select("doc_id", "bad", *FEATURES), "quality-rows")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text", **options) -> list[Rule]:
    return learn(labelled(docs, labels, max_labelled, id_col, text_col), **options)


def apply(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, rule_rejects, kept and, if named, the input row; one row per input row."""
    rows = statistics(docs, id_col, text_col, row_col).withColumn("base_failed", base_failed()).withColumn("rule_rejects", ~verdict(rules))
    return rows.select("doc_id", *STATS, "base_failed", "rule_rejects", (~F.col("base_failed") & ~F.col("rule_rejects")).alias("kept"), *([row_col] if row_col else []))
