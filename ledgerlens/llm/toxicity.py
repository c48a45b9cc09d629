"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, applied in Arrow batches.

A word's embedding is the sum of rows of one hashed table: one for the word and one for each of its byte n-grams, so that
words of one stem share rows. Filters of several widths slide over the words of a text; the greatest value of each filter
goes through a rectifier into a logistic unit. Training uses a bounded sample of labelled texts on the driver; scoring
reads every whole text once, in chunks that overlap by the widest filter, and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Byte n-grams of a word in brackets that have embeddings beside the word's own.
GRAMS = (4, 5)
#: Words that are scored at a time; memory of a task is bounded by this and one batch of texts.
CHUNK = 1 << 17


@dataclass
class Model:
    """Embeddings, filters per width (width x dimension x filters), output unit, calibration and thresholds by language."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    level: float = 0.0
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    @property
    def widest(self) -> int:
        return len(self.filters)


def _hashed(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words one after the other, and how many each has (one at least)."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    whole = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))
    rows, owner = [(whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)], [np.arange(len(raw))]
    left = np.repeat(ends, sizes) - np.arange(len(flat))  # bytes from here to the word's end
    at = np.repeat(np.arange(len(raw)), sizes)
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(1099511628211)) ^ flat[k : len(flat) - n + 1 + k]
        fits = left[: len(h)] >= n
        rows.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40))[fits])
        owner.append(at[: len(h)][fits])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (rows[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(raw))


def _embedded(table: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of table rows per word over the root of their number, and a last row of zeros for what is no word."""
    out = np.zeros((len(counts) + 1, table.shape[1]), np.float32)
    if len(counts):
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        out[:-1] = np.add.reduceat(table[rows], starts, axis=0) / np.sqrt(counts)[:, None]
    return out


def _slid(filters: list[np.ndarray], words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Value of every filter at every place of ids; ids ends with widest - 1 places that only fill up."""
    n = len(ids) - (len(filters) - 1)
    out = []
    for f in filters:
        value = (words @ f[0])[ids[:n]]
        for k in range(1, len(f)):
            value += (words @ f[k])[ids[k : n + k]]
        out.append(value)
    return np.concatenate(out, axis=1)


def _spans(text: str, size: int) -> Iterator[tuple[list[str], bool]]:
    """Lower-cased words of a text, at most size at a time, and whether they are its last; one list at least."""
    if len(text) <= 8 * size:
        yield [w.lower() for w in WORD.findall(text)], True
        return
    found: list[str] = []
    for m in WORD.finditer(text):
        found.append(m[0].lower())
        if len(found) == size:
            yield found, False
            found = []
    yield found, True


def raw_scores(model: Model, texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
    """The uncalibrated score of every whole text; null as empty."""
    gap = model.widest - 1
    best = np.full((len(texts), len(model.bias)), -np.inf, np.float32)
    held: list[tuple[int, list[str], bool]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        coded = pa.array([w for _, ws, _ in held for w in ws], pa.string()).dictionary_encode()
        rows, counts = _hashed(coded.dictionary.to_pylist(), len(model.table))
        words = _embedded(model.table, rows, counts)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # every span is followed by gap places of no word, one that is empty by one more
        lens = np.array([len(ws) for _, ws, _ in held])
        room = np.maximum(lens, 1) + gap
        starts = np.concatenate(([0], np.cumsum(room)[:-1]))
        ids = np.full(int(room.sum()) + gap, len(counts), np.int64)
        ids[np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(len(codes))] = codes
        values = _slid(model.filters, words, ids)
        # places count where a window may begin: at words, or at the gap of an empty text, but where the next span goes on
        full = np.maximum(lens, 1) - np.array([0 if last else gap for _, _, last in held])
        values[np.arange(len(values)) - np.repeat(starts, room) >= np.repeat(full, room)] = -np.inf
        np.maximum.at(best, np.array([i for i, _, _ in held]), np.maximum.reduceat(values, starts, axis=0))
        held, size = [], 0

    for i, text in enumerate(texts):
        tail: list[str] = []
        for words, last in _spans(text or "", chunk):
            words = tail + words
            held.append((i, words, last))
            size += len(words)
            tail = words[-gap:] if gap else []
            if size >= chunk:
                flush()
    if held:
        flush()
    return np.maximum(best + model.bias, 0) @ model.out + model.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def probability(model: Model, texts: list[str | None]) -> np.ndarray:
    return _sigmoid(model.slope * raw_scores(model, texts).astype(np.float64) + model.level)


class _Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def move(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def _trained(texts: list[str], labels: np.ndarray, weights: np.ndarray, buckets: int, dim: int, widths: int, per_width: int, epochs: int, batch: int, rate: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    docs = [[w.lower() for w in WORD.findall(t)] for t in texts]
    coded = pa.array([w for d in docs for w in d], pa.string()).dictionary_encode()
    rows, counts = _hashed(coded.dictionary.to_pylist(), buckets)
    begin = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)

    # The first dimension starts at the log odds of a toxic text for each table row, so that the greatest values of the
    # filters lie on telling words from the start; everything is trained from there.
    seen = np.zeros((2, buckets))
    for i in range(len(docs)):
        if cut[i + 1] > cut[i]:
            has = np.unique(np.concatenate([rows[begin[w] : begin[w + 1]] for w in np.unique(codes[cut[i] : cut[i + 1]])]))
            seen[int(labels[i]), has] += 1
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    table = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    table[:, 0] = np.where(seen.sum(axis=0) > 1, odds, 0) / 4
    filters = [rng.normal(0, 0.2, (k, dim, per_width)).astype(np.float32) for k in range(1, widths + 1)]
    for f in filters:
        f[:, 0, : per_width // 2] = 1.0 / len(f)
    n_out = widths * per_width
    bias, out = np.zeros(n_out, np.float32), np.full(n_out, 1.0 / n_out, np.float32)
    model = Model(table, filters, bias, out, 0.0)
    shift = np.array([-1.0], np.float32)
    adam = _Adam([table, *filters, bias, out, shift], rate)
    gap = widths - 1
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            picked = order[lo : lo + batch]
            used, local = np.unique(np.concatenate([codes[cut[i] : cut[i + 1]] for i in picked]), return_inverse=True)
            n_rows = counts[used]
            if len(used):
                of = np.repeat(begin[used] - np.concatenate(([0], np.cumsum(n_rows)[:-1])), n_rows) + np.arange(n_rows.sum())
            else:
                of = np.zeros(0, np.int64)
            words = _embedded(table, rows[of], n_rows)
            lens = cut[picked + 1] - cut[picked]
            room = np.maximum(lens, 1) + gap
            starts = np.concatenate(([0], np.cumsum(room)[:-1]))
            ids = np.full(int(room.sum()) + gap, len(used), np.int64)
            ids[np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(len(local))] = local
            values = _slid(filters, words, ids)
            ends = starts + np.maximum(lens, 1)
            at = np.stack([s + values[s:e].argmax(axis=0) for s, e in zip(starts, ends)])  # texts x filters
            top = values[at, np.arange(n_out)] + bias
            hidden = np.maximum(top, 0)
            z = hidden @ out + shift[0]
            err = ((_sigmoid(z) - labels[picked]) * weights[picked] / len(picked)).astype(np.float32)
            d_hidden = np.where(top > 0, err[:, None] * out, 0).astype(np.float32)
            d_words = np.zeros_like(words)
            d_filters = []
            for k, f in enumerate(filters):
                mine = slice(k * per_width, (k + 1) * per_width)
                g = np.zeros_like(f)
                for j in range(k + 1):
                    w = ids[at[:, mine] + j]  # texts x filters of this width
                    g[j] = np.einsum("tfd,tf->df", words[w], d_hidden[:, mine])
                    np.add.at(d_words, w.ravel(), (d_hidden[:, mine][:, :, None] * f[j].T[None]).reshape(-1, dim))
                d_filters.append(g)
            d_words[-1] = 0
            d_table = np.zeros_like(table)
            hit = np.flatnonzero(np.abs(d_words[:-1]).sum(axis=1))
            for w in hit:
                np.add.at(d_table, rows[begin[used[w]] : begin[used[w] + 1]], d_words[w] / np.sqrt(counts[used[w]]))
            adam.move([d_table, *d_filters, d_hidden.sum(axis=0), (err[:, None] * hidden).sum(axis=0), np.array([err.sum()], np.float32)])
    model.shift = float(shift[0])
    return model


def _calibrated(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve through the scores, with smoothed targets, by damped Newton steps."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (weights * (p - target)) + 1e-3 * (w - [1.0, 0.0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max())
    return max(float(w[0]), 1e-3), float(w[1])


def _threshold(p: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Midway between the two neighbouring scores between which the weighted errors are fewest, nearest to 0.5 on ties."""
    values = np.unique(np.concatenate([p, [0.0, 1.0]]))
    cuts = (values[1:] + values[:-1]) / 2
    wrong = [(weights * ((p >= c) != (labels == 1))).sum() for c in cuts]
    return float(min(zip(wrong, np.abs(cuts - 0.5), cuts))[2])


def held_out(id_: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0; false for null ids."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list, list[int]]:
    """Rows (doc_id, toxic, text, lang) to learn from, and how many labelled ids have 0 and 1.

    At most half of max_labelled ids of each label, those of the smallest hashes, none of them held out; then the texts of
    at most max_chars among them. Ids whose labels disagree or are null are left out, and of documents of one id one is used.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    known = known.where("low = high and low in (0, 1)").select("_id", F.col("low").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    some = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled // 2)
    picked = some(0).unionByName(some(1))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(picked), F.col("id") == F.col("_id")).groupBy("id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))
    found = rows.select("id", "toxic", "x.text", "x.lang").collect()  # at most max_labelled rows of max_chars
    return sorted(found, key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"]))), [totals.get(0, 0), totals.get(1, 0)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 5_000,
    max_chars: int = 12_000,
    buckets: int = 1 << 16,
    dim: int = 8,
    widths: int = 3,
    per_width: int = 6,
    epochs: int = 6,
    batch: int = 64,
    rate: float = 0.01,
    max_langs: int = 64,
    least_per_lang: int = 20,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """A model of the sample; a fifth of it calibrates scores and sets a threshold for each language.

    Scores read the text only. A language of fewer than least_per_lang calibration rows of either label, or beyond
    max_langs, takes the threshold of all. Without rows of both labels every score is the share of label 1.
    """
    rows, totals = sample(docs, labels, max_labelled, max_chars, id_col, text_col, lang_col)
    y = np.array([r["toxic"] for r in rows])
    if len(set(y.tolist())) < 2:
        share = min(max((totals[1] + 1e-6) / (sum(totals) + 2e-6), 1e-6), 1 - 1e-6) if sum(totals) else 1e-6
        return Model(np.zeros((1, dim), np.float32), [np.zeros((1, dim, 1), np.float32)], np.zeros(1, np.float32), np.zeros(1, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    texts = [r["text"] for r in rows]
    n = np.bincount(y, minlength=2)
    weights = np.array([totals[v] / n[v] for v in y])
    weights = weights / weights.mean()
    fold = np.array([zlib.crc32(f"calibrate:{r['id']}".encode()) % 5 for r in rows])
    apart = fold == 0
    if min(np.bincount(y[apart], minlength=2)) < 5 or min(np.bincount(y[~apart], minlength=2)) < 5:
        apart = np.ones(len(y), bool)  # too few labels to hold any back
        learn = apart
    else:
        learn = ~apart
    index = np.flatnonzero(learn)
    model = _trained([texts[i] for i in index], y[index].astype(np.float32), np.ones(len(index)), buckets, dim, widths, per_width, epochs, batch, rate, seed)
    held = np.flatnonzero(apart)
    z = raw_scores(model, [texts[i] for i in held]).astype(np.float64)
    model.slope, model.level = _calibrated(z, y[held], weights[held])
    p = _sigmoid(model.slope * z + model.level)
    model.threshold = _threshold(p, y[held], weights[held])
    langs = np.array([r["lang"] or "" for r in rows])[held]
    names, found = np.unique(langs, return_counts=True)
    for lang in names[np.argsort(-found, kind="stable")][:max_langs]:
        of = langs == lang
        if lang and min(np.bincount(y[held][of], minlength=2)) >= least_per_lang:
            model.by_lang[str(lang)] = _threshold(p[of], y[held][of], weights[held][of])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, flagged of every row of docs, without a shuffle.

    predicted is 1 from a score of 0.5, flagged compares with the threshold of the row's language (that of all for null or
    unknown ones). Null texts are empty; texts without words have a score of their own. Rows that repeat give equal rows,
    null ids stay and are not held out, an empty table gives no rows. Whole texts are read in overlapping chunks of words.
    Other columns are not read, whatever their names; the id keeps its type.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                p = probability(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p, pa.float64())], ["doc_id", "lang", "score"])

    found = rows.mapInArrow(scores, schema)
    limit = F.lit(model.threshold)
    if model.by_lang:
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(model.by_lang.items()) for x in kv]), F.col("lang")), limit)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
