import random
from collections import Counter

import pytest

from rejoinder.llm import decontaminate

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain(docs, items, size=10):
    rows = []
    for doc_id, text in docs:
        words, hit, named = plain_words(text), set(), set()
        for item_id, item in items:
            own = plain_words(item)
            for i in range(max(1, len(own) - size + 1) if own and item_id is not None else 0):
                window = own[i : i + size]
                for at in range(len(words) - len(window) + 1):
                    if words[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        named.add(str(item_id))
        rows.append((doc_id, len(words), len(hit), sorted(named)))
    return sorted(rows, key=repr)


def made(seed):
    pick = random.Random(seed)
    word = lambda: pick.choice(["the", "of", "And", "é1", "zeta", "rare%d" % pick.randrange(40)])
    items = [(i, " ".join(word() for _ in range(pick.choice([1, 3, 9, 10, 11, 25])))) for i in range(8)]
    items += [(3, "repeated id, other words"), (20, None), (21, "--"), (None, "no name"), (22, items[0][1])]
    docs = []
    for i in range(40):
        parts = [word() for _ in range(pick.randrange(60))]
        if i % 3 == 0:
            parts[5:5] = [pick.choice(items)[1] or "", pick.choice(["", "x"])]
        docs.append((i, pick.choice([" ", "-", "\n"]).join(parts)))
    return docs + [(50, None), (51, ""), (None, items[1][1]), (7, "second seven"), (7, "second seven")], items


@pytest.mark.parametrize("block_windows", [20_000, 7])
def test_equals_brute_force(spark, block_windows):
    docs, items = made(block_windows)
    frame = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", items int").repartition(3)
    found = decontaminate.contamination(frame, spark.createDataFrame(items, ITEMS), block_windows=block_windows)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=repr)
    assert got == plain(docs, items)
    kept = decontaminate.clean(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(d) for d, _, n, _ in plain(docs, items) if not n)


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "x beta y alpha gamma z"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha"), (4, None), (5, "alpha beta")], DOCS
    )
    items = spark.createDataFrame([(9, "alpha beta gamma")], ITEMS)
    got = sorted(tuple(r) for r in decontaminate.proximity(docs, items, slack=2).collect())
    # gamma is as rare as beta; the earlier one in the item is the anchor among equals: gamma (4), beta (5), alpha (5)
    assert [(d, i) for d, i, _ in got] == [(1, "9"), (3, "9")]
    assert decontaminate.proximity(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("block_windows", [1, 50])
def test_proximity_equals_brute_force(spark, block_windows):
    pick = random.Random(11)
    names = ["a", "b", "c", "d", "e", "f"]
    docs = [(i, " ".join(pick.choice(names) for _ in range(pick.randrange(25)))) for i in range(30)] + [(None, "d c b a"), (31, None)]
    items = [(1, "a b c d"), (2, "f e"), (3, "a a f"), (4, None)]
    counts = Counter(w for _, t in docs for w in plain_words(t))
    for slack in (0, 1, 3):
        want = set()
        for item, text in items:
            own = plain_words(text)
            rarest = min(own, key=lambda w: (counts[w], own.index(w)), default=None)
            for doc, words in ((d, plain_words(t)) for d, t in docs):
                reach = len(own) + slack - 1
                near = lambda at, t: any(w == t and abs(j - at) <= reach for j, w in enumerate(words))  # noqa: B023, E731
                want |= {(doc, str(item), at) for at, w in enumerate(words) if w == rarest and all(near(at, t) for t in own)}
        got = decontaminate.proximity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), slack=slack, block_windows=block_windows)
        assert set(map(tuple, got.collect())) == want


def test_empty_tables(spark):
    docs, items = made(1)
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    frame = spark.createDataFrame(docs, DOCS)
    assert decontaminate.contamination(none_docs, spark.createDataFrame(items, ITEMS)).count() == 0
    got = decontaminate.contamination(frame, none_items)
    assert got.count() == len(docs)
    assert got.filter("n_hit > 0 or size(items) > 0").count() == 0
