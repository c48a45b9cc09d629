import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat_format as c


def model(seed=1):
    r = np.random.default_rng(seed)
    log = lambda *shape: np.log(r.dirichlet(np.ones(shape[-1]), shape[:-1]))
    return c.Model(log(3), log(2, 3, 3), [log(3, n) for n in c.SIZES])


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_against_all_paths(seed):
    m, r = model(seed), random.Random(seed)
    values = [tuple(r.randrange(n) for n in c.SIZES) for _ in range(6)]
    score = m.scores(values)

    def worth(path):
        s = m.start[path[0]] + score[0, path[0]]
        for k in range(1, len(path)):
            s += m.move[int(values[k][1] > 0), path[k - 1], path[k]] + score[k, path[k]]
        return s

    best = max(itertools.product(range(3), repeat=6), key=worth)
    steps = c._start(m, values)
    assert c.decode(steps, np.zeros(3)) == list(best)
    assert c.product(steps).max() == pytest.approx(worth(best))


def test_markers():
    assert c.features("User: hi?", False) == ((2, 2, 1, 1), "hi?")
    assert c.features("[Assistant] well", True)[0][:2] == (3, 3)
    assert c.features("AI - x", False)[1] == "x"
    assert c.features("Note: x", False) == ((4, 0, 1, 0), "Note: x")
    assert c.features("plain text", False)[0][0] == 0


def turns(n):
    r = random.Random(4)
    rows = []
    for k in range(n):
        for t in range(r.randrange(2, 8)):
            role = ("user", "assistant")[t % 2]
            rows.append((k, t, role, ("What is it? " if role == "user" else "It is a long answer. " * 9) + "\nmore" * (t % 2)))
    return rows


def test_chunks_agree_with_whole(spark, monkeypatch):
    rows = turns(12) + [(None, 0, "user", "null id"), (99, None, "user", "no order"), (98, 0, "user", None), (97, 0, "user", " \n"), (3, 0, "user", "second"), (3, 0, "user", "second")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, id string")
    raw, m = c.as_transcript(df), model(3)

    def run():
        out = {}
        for x in sorted(c.parse(raw, m).collect(), key=lambda x: x.chunk):
            had = out.get(x.id, ("", 0, 0))
            out[x.id] = (had[0] + x.rendered, had[1] + x.n_lines, had[2] + x.n_turns)
        return out

    whole = run()
    monkeypatch.setattr(c, "PIECES", 2)
    assert run() == whole
    assert 98 in whole and None in whole  # a marker without text is a line
    assert all(t.count("<|end|>") == n == t.count("<|user|>") + t.count("<|assistant|>") + t.count("<|system|>") for t, _, n in whole.values())


def test_held_out_accuracy(spark):
    all_turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    train, test = all_turns.where("conv_id % 5 > 0"), all_turns.where("conv_id % 5 = 0")
    styled = lambda d: c.as_transcript(d).join(d.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    m = c.fit(styled(train))
    want = {}
    for x in sorted(test.collect(), key=lambda x: x.turn):
        want.setdefault(x.conv_id, []).append(x.role)
    got = {x.id: x.roles.split(",") for x in c.parse(c.as_transcript(test), m).collect()}
    right = sum(got[k] == v for k, v in want.items()) / len(want)
    assert right > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.format_chats(df).count() == 0


def test_rows_of_equal_keys_train_once(spark, monkeypatch):
    rows = [(None, None, role, f"{role} {k}") for k in range(20) for role in ("user", "assistant")]
    seen = []
    monkeypatch.setattr(c, "fit", lambda pieces: seen.extend(pieces.select("role", "text").collect()) or model(3))
    c.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(seen) == len(rows) and all(r.role in r.text for r in seen)


def plain_viterbi(m, values):
    """Roles of lines by the textbook recursion, one line and one pair of roles at a time."""
    show = lambda v, r: sum(m.shows[f][r][x] for f, x in enumerate(v))
    best, back = [m.start[r] + show(values[0], r) for r in range(3)], []
    for v in values[1:]:
        came = [max(range(3), key=lambda q: best[q] + m.move[int(v[1] > 0)][q][r]) for r in range(3)]
        best = [best[came[r]] + m.move[int(v[1] > 0)][came[r]][r] + show(v, r) for r in range(3)]
        back.append(came)
    path = [max(range(3), key=lambda r: best[r])]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def plain_format(rows, m, pieces):
    """conv_id: n_lines, n_turns, roles, digest of rows (conv_id, turn, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv and r[2].strip()]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2][: c.HEAD], hashlib.sha256(r[2].encode()).hexdigest()))
        lines = [(k // pieces, *x) for k, r in enumerate(mine) for x in c.lines_of(r[2])]
        if not lines:
            continue
        texts, roles, last = {}, [], None
        for (chunk, v, t), r in zip(lines, plain_viterbi(m, [x[1] for x in lines])):
            if r != last or v[0] in (1, 2, 3):
                texts[chunk] = texts.get(chunk, "") + ("" if last is None else "<|end|>\n") + f"<|{c.ROLES[r]}|>\n"
                roles.append(c.ROLES[r])
            last = r
            texts[chunk] = texts.get(chunk, "") + t + "\n"
        texts[max(texts)] += "<|end|>\n"
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(lines), len(roles), [x for x in roles], sha(",".join(sha(texts[k]) for k in sorted(texts))))
    return out


def test_format_against_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(c, "PIECES", 3)
    monkeypatch.setattr(c, "COPIES", 4)
    rows = turns(40) + [(None, 0, "user", "null id"), (99, None, "user", "no order"), (99, -5, "user", "below"), (99, None, "assistant", "no order either"), (98, 0, "user", None), (97, 0, "user", " \n")]
    rows += [(3, 0, "user", "second")] * 11 + [(50, None, "user", f"tie {k % 7}") for k in range(30)] + [(51, 1, "assistant", "x" * 70 + str(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    raw = c.as_transcript(df, ("role",)).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "conv_id"), F.lit(c.FOLDS)))
    want = {}
    for k in range(c.FOLDS):
        mine = [(r.conv_id, r.turn, r.text) for r in raw.where(F.col("fold") == k).collect()]
        want |= plain_format(mine, c.fit(raw.where(F.col("fold") != k)), 3)
    got = {r.conv_id: (r.n_lines, r.n_turns, r.roles.split(","), r.rendered_sha256) for r in c.format_chats(df).collect()}
    assert got == want and got[50][0] == 30


def test_many_equal_rows_all_count(spark):
    rows = [(1, 2, "user", "again")] * 3000 + [(None, None, "user", "no id")] * 700
    got = {r.conv_id: r.n_lines for r in c.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: 3000, None: 700}


def test_markers_tell_roles_without_labels(spark):
    rows = [(1, 0, None, "User: hi"), (1, 1, None, "\nAssistant: yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r.roles for r in c.parse(df, c.fit(df)).collect()] == ["user,assistant"]
