import hashlib
import random
import re

import pytest

from ledgerlens.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[i : i + m]))):
                    hit |= set(range(i, i + m))
                    found |= {str(v) for v in x if v is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    r = random.Random(3)
    vocabulary = ["Ab", "cd", "e", "für", "x1", "the", "of", "日本"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.randrange(8, 40))) for i in range(30)] + [(30, "one two three"), (31, "solo"), (32, None), (33, " .,"), (None, say(20)), (5, say(12)), (100, "a b c d e f g h i j")]
    docs = [(i, say(r.randrange(0, 80))) for i in range(60)]
    for i in range(60, 120):
        text = r.choice(items)[1] or ""
        a = r.randrange(0, 20)
        docs.append((i, say(r.randrange(10)) + " -- " + " ".join(text.split()[a : a + r.randrange(5, 30)]).upper() + "! " + say(r.randrange(10))))
    docs += [(200, None), (201, ""), (202, "One, two;three"), (203, "solo"), (None, "a b c d e f g h i j"), (204, "a b c d e f g h i"), (7, docs[7][1]), (7, items[0][1]), (205, "q " * 20_000 + items[1][1])]
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 0])
def test_against_brute_force(spark, limit):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, hash string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(d, b, max_broadcast_prints=limit)
    got = sorted((tuple(r[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows.collect()), key=str)
    assert got == brute(docs, items)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).where("contaminated").count() == 0
