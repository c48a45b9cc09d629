import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import token_counts
from ledgerlens.llm.token_counts import PrefixCounter, count_tokens, longest_within

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = PrefixCounter(PATH)


def brute(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


TEXTS = [
    "Hello world, it's we're they've I'll x'd",
    "a  b\n\n\nc \t d   ",
    "über  größe 1234567    x",
    "  leading",
    "!!'re ''ll 're",
    "日本語のテキスト 🙂🙂 x" * 3,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 5,
    "\x1c\x1d \x85 ​﻿ x",
    "QmFzZTY0" * 40,
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(text):
    table = COUNTER.table(text)
    at = 0
    for k, c in enumerate(text):
        at += len(c.encode())
        assert table[at - 1] == brute(text[: k + 1]), repr(text[: k + 1])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abtheingr' \n\t's1 2.,!éß日 ")), max_size=40))
def test_prefixes_of_random_texts(text):
    table = COUNTER.table(text)
    at = 0
    for k, c in enumerate(text):
        at += len(c.encode())
        assert table[at - 1] == brute(text[: k + 1])


def test_units_of_basic_texts():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for text in (every, "x".join(every), " ".join(every), "'".join(every), " 're  'll'x \n\t 1's", *TEXTS):
        basic = "".join(c for c in text if c < "\U00010000")
        assert token_counts._BASIC_UNIT.findall(basic) == token_counts._UNIT.findall(basic)


def test_new_words_take_few_new_steps():
    """Words not met before mostly go through known states: the merge rules are not looked up for each of their bytes."""

    class Asked(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    counter = PrefixCounter(PATH)
    counter._pairs = Asked()
    words = [f" {a}{b}{c}{d}" for a in ("tion", "sch", "ver") for b in ("ing", "heit", "ous") for c in ("ant", "ell", "ich") for d in ("ment", "ner", "ü")]
    counter.table("".join(words[::2]))
    before, new = counter._pairs.n, "".join(words[1::2])
    assert counter.table(new)[-1] == brute(new)
    assert 10 * (counter._pairs.n - before) < len(new.encode())


def test_states_start_anew():
    counter = PrefixCounter(PATH, cache_units=20)
    for text in (*TEXTS, *TEXTS):
        assert counter.table(text)[-1] == brute(text)
        assert len(counter._steps) <= 40 and len(counter._states) <= 42


def test_special_string():
    text = "a <|endoftext|> b<|endoftext|>"
    assert COUNTER.table(text)[-1] == brute(text)


def test_limit():
    assert longest_within(np.array([1, 1, 2, 3]), 2) == 3
    assert longest_within(np.array([], int), 2) == 0


def test_operator(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (None, "z " * 3000, "n_tokens")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH, 1024).collect())
    n = brute("z " * 3000)
    assert got == [(0, 6000, n, True), (1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False)]
    assert count_tokens(df.limit(0), PATH, 1024).count() == 0
    table = count_tokens(df.where("doc_id = 1"), PATH, 1024, with_table=True).first().prefix_counts
    assert np.frombuffer(table, "<i4")[-1] == 2
