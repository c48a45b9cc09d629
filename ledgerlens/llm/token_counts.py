"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The table of a text holds, at byte offset k, the number of tokens the tokenizer gives for the first k bytes.
Texts are cut into units that no later character can re-split (a pre-token, with the white space run before it).
Within a unit the last token of each prefix is the only vocabulary entry that ends there and may follow, under the
merge rules, the last token of the prefix before it; its count is one more than that prefix's count. Units add up,
so the table answers truncation and budget questions without encoding anything again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The byte-level pre-tokenizer's pattern (fixed values of the public tokenizer).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_UNIT = regex.compile(rf"(?:\s+(?=\s))?(?:{PIECE})")
_SPACE = regex.compile(r"\s")


def _basic_unit() -> re.Pattern[str]:
    """_UNIT for texts of code points below 0x10000, its classes spelled out for the standard library, which looks a
    character up in a table; letters go first, as no contraction begins with one."""
    basic = "".join(map(chr, range(0x10000)))
    letter, number, space, other = (
        "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{kind}+", basic)) for kind in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]")
    )
    piece = rf" ?[{letter}]+|{'|'.join(CONTRACTIONS)}| ?[{number}]+| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(rf"(?:[{space}]+(?=[{space}]))?(?:{piece})")


_BASIC_UNIT = _basic_unit()
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Prefix tables of texts for one tokenizer file.

    cache_units bounds the unit cache: when that many are new, the older generation goes, and what is met again moves up.
    """

    def __init__(self, path: str, cache_units: int = 300_000, cache_bytes: int = 96):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._model = tokenizer.model
        self._stand_in = str.maketrans(dict(enumerate(_byte_chars())))
        back = {ord(c): b for b, c in enumerate(_byte_chars())}
        #: Tokens as strings of one character per byte.
        self._vocab = {t.translate(back) for t in tokenizer.get_vocab(with_added_tokens=False)}
        #: What tokens begin with, nothing and themselves included, each with its _ends once a text comes to it.
        self._begin: dict[str, tuple[tuple[int, ...], tuple[tuple[int, str], ...]]] = {t[:k]: () for t in self._vocab for k in range(len(t) + 1)}
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._pairs: dict[tuple[str, str], bool] = {}
        self._units: dict[str, tuple[bytes, int, int]] = {}
        self._older: dict[str, tuple[bytes, int, int]] = {}
        self._most, self._short = cache_units, cache_bytes
        #: By 256 times a state's number plus a byte: 65536 times the next one's number plus the last token's length.
        self._steps: dict[int, int] = {}
        self._restart()

    def _follows(self, last: str, token: str) -> bool:
        """Whether the merge rules leave these two tokens as they are, side by side."""
        if len(self._pairs) >= 2 * self._most:
            self._pairs.clear()
        found = [t.value for t in self._model.tokenize((last + token).translate(self._stand_in))]
        known = found == [t.translate(self._stand_in) for t in (last, token) if t]
        self._pairs[last, token] = known
        return known

    def _restart(self) -> None:
        """Only the state before a piece, and no steps.

        A state is the longest beginning of a token that the bytes so far end in, and the last tokens of the prefixes
        that end where one of its suffixes begins a token; nothing else decides which tokens end at later bytes.
        """
        self._states: list[tuple[str, tuple[str, ...]]] = [("", ("",))]
        self._numbers = {self._states[0]: 0}
        self._steps.clear()

    def _number(self, state: tuple[str, tuple[str, ...]]) -> int:
        number = self._numbers.setdefault(state, len(self._states))
        if number == len(self._states):
            self._states.append(state)
        return number

    def _ends(self, tail: str) -> tuple[tuple[int, ...], tuple[tuple[int, str], ...]]:
        """Lengths of its suffixes that begin a token, shortest first, and of those that are one, longest first."""
        suffixes = [(n, tail[len(tail) - n :]) for n in range(len(tail) + 1)]
        found = tuple(n for n, s in suffixes if s in self._begin), tuple((n, s) for n, s in reversed(suffixes) if s in self._vocab)
        self._begin[tail] = found
        return found

    def _step(self, key: int) -> int:
        """One byte of the dynamic programming: its last token, and the state it leads to."""
        begin = self._begin
        state = tail, lasts = self._states[key >> 8]
        if len(self._steps) >= 2 * self._most:  # a piece goes on from where it is, however long
            self._restart()
            key = self._number(state) << 8 | key & 255
        before = dict(zip((begin[tail] or self._ends(tail))[0], lasts))
        tail += chr(key & 255)
        while tail not in begin:
            tail = tail[1:]
        lengths, tokens = begin[tail] or self._ends(tail)
        for size, token in tokens:
            known = self._pairs.get((before[size - 1], token))
            if known or known is None and self._follows(before[size - 1], token):
                break
        state = tail, (token, *[before[n - 1] for n in lengths[1:]])
        self._steps[key] = found = self._number(state) << 16 | size
        return found

    def _piece(self, piece: str) -> list[int]:
        """Counts after each byte of one pre-token."""
        steps, at, counts = self._steps, 0, [0]
        for byte in piece.encode():
            found = steps.get(at + byte) or self._step(at + byte)
            counts.append(counts[-(found & 0xFFFF)] + 1)
            at = found >> 16 << 8
        if len(piece) == 3 and piece in CONTRACTIONS:
            counts[2] = 2  # cut after two characters, the mark and the letter are two pre-tokens
        return counts[1:]

    def _unit(self, unit: str) -> tuple[bytes, int, int]:
        """Counts after each byte of a unit followed by more text, their number, and what the unit adds."""
        run = 0
        if unit[1:2].isspace():
            while run < len(unit) and _SPACE.match(unit[run]):
                run += 1
        if run < 2:
            counts = self._piece(unit)
            total = counts[-1]
        else:  # as a prefix the run is one pre-token; with text behind it, its last character stands apart
            head, rest = self._piece(unit[:run]), self._piece(unit[run - 1 :])
            base = self._piece(unit[: run - 1])[-1]
            counts = head + [base + c for c in rest[len(unit[run - 1].encode()) :]]
            total = base + rest[-1]
        return array("i", counts).tobytes(), len(counts), total

    def _known(self, unit: str) -> tuple[bytes, int, int]:
        """A unit that is not in the younger generation."""
        found = self._older.get(unit) or self._unit(unit)
        if found[1] <= self._short:
            if len(self._units) >= self._most:
                self._older, self._units = self._units, {}
            self._units[unit] = found
        return found

    def _plain(self, text: str) -> tuple[np.ndarray, int]:
        end = len(text)
        while end and _SPACE.match(text[end - 1]):
            end -= 1
        units = (_UNIT if _BEYOND.search(text) else _BASIC_UNIT).findall(text[:end])
        parts = [found or self._known(u) for u, found in zip(units, map(self._units.get, units))]
        if end < len(text):
            tail = self._piece(text[end:])
            parts.append((array("i", tail).tobytes(), len(tail), tail[-1]))
        adds = np.array([p[2] for p in parts], np.int64)
        before = np.cumsum(adds) - adds
        inner = np.frombuffer(b"".join([p[0] for p in parts]), np.int32)
        return inner + np.repeat(before, [p[1] for p in parts]), int(adds.sum())

    def table(self, text: str | None) -> np.ndarray:
        """Counts after each UTF-8 byte. A special string counts as one token, from its last byte on; inside it
        the table repeats the count before it plus the plain encoding of its part."""
        text = text or ""
        found = list(self._special.finditer(text)) if self._special else []
        pieces, total, at = [], 0, 0
        for m in [*found, None]:
            plain = text[at : m.start() if m else len(text)]
            if plain:
                counts, add = self._plain(plain)
                pieces.append(counts + total)
                total += add
            if m:
                inside, _ = self._plain(m.group())
                inside = inside + total
                total += 1
                inside[-1] = total
                pieces.append(inside)
                at = m.end()
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int64)


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One counter for all tasks of a worker."""
    return PrefixCounter(path)


def longest_within(table: np.ndarray, limit: int) -> int:
    """Bytes of the longest prefix from which on no shorter prefix exceeds the limit."""
    over = np.flatnonzero(table > limit)
    return int(over[0]) if len(over) else len(table)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", with_table: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, bytes_within_limit and, if asked for, the table as little-endian int32.

    One output row per input row, repeated rows included; null and empty texts have 0 bytes and 0 tokens; other
    input columns are not read. The text is never cut: a very long one only makes a long table.
    """
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {key}, n_bytes bigint, n_tokens bigint, over_limit boolean, bytes_within_limit bigint" + (", prefix_counts binary" if with_table else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                counts = counter.table(text.as_py())
                n = int(counts[-1]) if len(counts) else 0
                for col, v in zip(cols, (len(counts), n, n > limit, longest_within(counts, limit), counts.astype("<i4").tobytes() if with_table else None)):
                    col.append(v)
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "bytes_within_limit"]
            if with_table:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
