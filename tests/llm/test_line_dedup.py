import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import line_dedup as q


def distance(a, b):
    if a.startswith(b) or b.startswith(a):
        return abs(len(a) - len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for k, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[k] + 1, before[k - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_within(a, b, edits):
    assert q.within(a, b, edits) == (distance(a, b) <= edits)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=6, max_size=20), st.integers(1, 3), st.integers(2, 7), st.randoms())
def test_near_lines_meet(a, edits, per_edit, r):
    b = list(a)
    for _ in range(r.randrange(edits + 1)):
        k = r.randrange(len(b)) if b else 0
        b[k : k + 1] = r.choice([[], [r.choice("ab")], [r.choice("ab"), "b"]])
    b = "".join(b)
    low, high = sorted((a, b), key=len)
    if low != high and distance(a, b) <= min(edits, len(low) // per_edit):
        assert set(q.filed(low, edits, per_edit)) & set(q.filed(high, edits, per_edit) + q.probes(high, edits, per_edit))


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=10, max_size=30), st.integers(1, 3), st.integers(3, 7), st.randoms())
def test_near_rests_meet(a, edits, per_edit, r):
    b = list(a)
    for _ in range(r.randrange(edits + 1)):
        k = r.randrange(len(b)) if b else 0
        b[k : k + 1] = r.choice([[], [r.choice("ab")], [r.choice("ab"), "b"]])
    low, high = sorted((a, "".join(b)), key=len)
    if low == high or distance(low, high) > min(edits, len(low) // per_edit):
        return
    rows = {x: {(q._key(f"{n},{i},{s}"), *y) for n, i, s in q.filed(x, edits, per_edit) + q.probes(x, edits, per_edit) for y in q.rests(q._key(f"{n},{i},{s}"), x, edits, per_edit)} for x in (low, high)}
    for _ in range(3):
        owned = {k for x in rows.values() for k, own, *_ in x if own}
        assert owned & {x[0] for x in rows[low]} & {x[0] for x in rows[high]}
        rows = {x: {z for y in rows[x] for z in q.divided(*y)} for x in rows}


def brute(rows, edits, per_edit):
    place = []
    for k, (doc_id, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(q.BLANKS):
                place.append((k, at, line.strip(q.BLANKS)))
    lines = sorted({p[2] for p in place})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            t = min(edits, min(len(a), len(b)) // per_edit)
            if abs(len(a) - len(b)) <= t and ((ca := Counter(a)) - (cb := Counter(b))).total() + (cb - ca).total() <= 2 * t and distance(a, b) <= t:
                root[find(a)] = find(b)
    order = sorted(place, key=lambda p: (-1 if rows[p[0]][0] is None else rows[p[0]][0], p[0], p[1]))
    first, gone = {}, {}
    for k, at, line in order:
        c = find(line)
        if c in first:
            gone.setdefault(k, []).append((at, line == first[c]))
        else:
            first[c] = line
    out = []
    for k, (doc_id, text) in enumerate(rows):
        drop = {at for at, _ in gone.get(k, ())}
        kept = "\n".join(x for at, x in enumerate((text or "").split("\n")) if at not in drop)
        same = sum(e for _, e in gone.get(k, ()))
        out.append((doc_id, sum(p[0] == k for p in place), same, len(drop) - same, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("edits", [1, 2])
def test_against_brute_force(spark, edits, monkeypatch):
    r = random.Random(edits)
    say = lambda n: "".join(r.choice("abcdé ") for _ in range(n)).strip() + "x"
    bases = [say(n) for n in (6, 9, 10, 12, 18, 19, 25, 25, 40, 41, 60)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(r.randrange(5)):
            w = list(r.choice(bases))
            for _ in range(r.randrange(4)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["z"], ["q", w[k]]])
            lines.append(r.choice(["", " ", "\t"]) + "".join(w) + r.choice(["", "\r"]))
        lines += [r.choice(["", "short", say(30)])]
        rows.append((i, "\n".join(lines)))
    rows += [(80, None), (81, ""), (82, "\n \n"), (83, "y" * 30_000), (84, "y" * 30_001 + "\nshort")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, row string").coalesce(1)
    monkeypatch.setattr(q, "BLOCK", 4)
    got = sorted((tuple(x)[:5] for x in q.dedup(df, edits).collect()), key=str)
    assert got == brute(rows, edits, 10)


@pytest.mark.parametrize("divisions", [1, 2])
def test_large_groups_are_divided(spark, divisions, monkeypatch):
    r = random.Random(divisions)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)) + "x"
    head, tail, rows = "in the beginning there was ", " and so it ended", []
    for i in range(60):
        w = list(head + say(r.choice([20, 20, 21])) + r.choice(["", tail]))
        rows.append((i, "".join(w)))
        for k in r.sample(range(len(w)), r.randrange(3)):
            w[k] = r.choice(["z", "", "q" + w[k]])
        rows.append((i + 100, "".join(w)))
    rows += [(300, "ab" * 20), (301, "ba" * 20), (302, "ab" * 19 + "a"), (303, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(q, "BLOCK", 4)
    monkeypatch.setattr(q, "LARGE", 6)
    monkeypatch.setattr(q, "DIVISIONS", divisions)
    got = sorted((tuple(x)[:5] for x in q.dedup(df).collect()), key=str)
    assert got == brute(rows, 2, 10)
    assert sum(x[3] for x in got) > 20


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a line\nother"), (1, "a line\nother"), (None, "a line")], "doc_id long, text string").coalesce(1)
    got = sorted((str(x.doc_id), x.n_equal, x.kept_text) for x in q.dedup(df).collect())
    assert got == [("1", 1, "other"), ("1", 2, ""), ("None", 0, None)]
    assert q.dedup(df.limit(0)).count() == 0


def test_texts_of_equal_short_hash(spark):
    # "0000348d..." and "55 99 11..." have one 32-bit hash, whatever follows
    same = "a line of over twenty characters"
    rows = [(None, f"0000348d\n{same}\nx"), (None, f"55 99 11\n{same}\nx")]
    got = q.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), whole_text=True).collect()
    assert sorted(r.kept_text for r in got) == [rows[0][1], "55 99 11"]
