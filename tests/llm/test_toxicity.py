import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rejoinder.llm import toxicity
from rejoinder.llm.common import table

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"


def plain_kernel(s, t):
    def features(word):
        found = {}
        for at in itertools.combinations(range(len(word)), toxicity.ORDER):
            key = "".join(word[i] for i in at)
            found[key] = found.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return found

    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def words(count, most=16, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice("abcde") for _ in range(pick.randrange(most + 1))) for _ in range(count)]


def test_kernel_equals_sum_over_subsequences():
    some, other = words(300), "abcadbe"
    codes = toxicity.letters(some)
    assert np.allclose(toxicity.kernel(codes, toxicity.letters([other])[0]), [plain_kernel(w, other) for w in some], rtol=1e-4)
    assert np.allclose(toxicity.own_kernel(codes), [plain_kernel(w, w) for w in some], rtol=1e-4)


def normalised(w, m):
    own = plain_kernel(w, w) * plain_kernel(m, m)
    return plain_kernel(w, m) / own**0.5 if own else 0


def test_sums_of_landmarks_skip_no_pair():
    marks, some = [w for w in words(40, 9, 3) if len(w) >= 4], words(400)
    landmarks = toxicity.Landmarks(marks)
    got = landmarks.sums(some)
    want = np.array([[normalised(w, m) for m in marks] for w in some])
    assert np.allclose(got, want, atol=1e-3)
    landmarks.rows = None  # as for a large alphabet
    assert np.allclose(landmarks.sums(some), want, atol=1e-3)


def test_machine_of_landmarks_is_a_sum_over_subsequences():
    marks, some = ["idiot", "stupid", "disgusting"], ["idxiot", "stupd", "dust", "st", ""]
    weights, bias = np.array([[1.0, 0.5], [2.0, 0.0], [-1.0, 3.0]]), np.array([-0.25, 0.5])
    segments = toxicity.Segments(toxicity.Landmarks(marks).machines(weights, bias, [5, 6, 7]))
    want = np.array([[normalised(w, m) for m in marks] for w in some]) @ weights + bias
    assert np.allclose(segments.decide(some), want, atol=1e-3)


def machine_for(mark):
    return toxicity.Landmarks([mark]).machines(np.ones((1, 1)), np.zeros(1), list(range(4, 15)))


@pytest.mark.parametrize(
    ("text", "mark"),
    [("You idiot! Fine.", "idiot"), ("so.STU-PID,", "stupid"), ("i d i o t here", "idiot"), ("x" * 40 + "stupid" + "y" * 3, "stupid"), ("well,idiot", "idiot"),
     ("idiot/moron", "moron"), ("stupid-loser", "loser"), ("y o u i d i o t", "idiot"), ("ab" * 400 + "stupid" + "cd" * 30, "stupid"),
     ("ab" * 30_000 + "stupid" + "cd" * 30_000, "stupid"), ("mn" * 20 + "disgusting" + "opq" * 9, "disgusting")],
)
def test_glued_long_and_spelled_segments(text, mark):
    segments = toxicity.Segments(machine_for(mark))
    ((largest, dense, _, _),) = segments.facts([text])
    assert largest[0] == pytest.approx(1, abs=1e-3) and dense[0] > 0


def test_texts_without_segments():
    segments = toxicity.Segments(machine_for("idiot"))
    assert [(most[0], dense[0]) for most, dense, *_ in segments.facts(["", "   ", "123 !!", "of a"])] == [(0.0, 0.0)] * 4


@pytest.fixture(scope="module")
def made():
    pick = random.Random(7)
    neutral = ["river", "stone", "window", "green", "paper", "cloud", "table", "music"]
    docs, labels = [], []
    for i in range(400):
        own = [pick.choice(neutral) for _ in range(pick.randrange(3, 40))]
        toxic = i % 5 == 0
        if toxic:
            own[pick.randrange(len(own))] = pick.choice(["blockhead", "nitwit"])
        docs.append((i, " ".join(own) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_tolerates_gaps_and_insertions(spark, made):
    docs, labels = spark.createDataFrame(made[0], DOCS), spark.createDataFrame(made[1], LABELS)
    model = toxicity.train(docs, labels)
    rows = [
        (1, "the river blockhead stone"), (2, "block-head"), (3, "bloxckhead paper"), (4, "b l o c k h e a d"), (5, "a nittwit"),
        (6, "green paper"), (7, None), (8, ""), (9, "music " * 60_000), (9, "music " * 60_000 + "blockhead"),
    ]
    new = spark.createDataFrame([(*r, 0.1) for r in rows], DOCS + ", toxicity_ double")
    got = sorted((r["doc_id"], r["toxicity"]) for r in toxicity.score(new, model).collect())
    assert all(s >= 0.5 for d, s in got if d <= 5) and all(s < 0.5 for d, s in got if 6 <= d <= 8)
    assert [s >= 0.5 for d, s in got if d == 9] == [False, True]
    assert "toxicity_" in toxicity.score(new, model).columns
    own = toxicity.score(new.withColumnRenamed("toxicity_", "Toxicity"), model)  # a column of that name is replaced
    assert own.columns == ["doc_id", "text", "toxicity"] and sorted((r["doc_id"], r["toxicity"]) for r in own.collect()) == got
    kept = toxicity.reject(new, model)
    assert kept.columns == new.columns and sorted(r["doc_id"] for r in kept.collect()) == [6, 7, 8, 9]


def test_without_both_classes(spark, made):
    docs = spark.createDataFrame(made[0][:5], DOCS)
    for labels, want in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, None)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
        assert {round(r["toxicity"]) for r in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), spark.createDataFrame([], LABELS))).count() == 0


def test_held_out_fold(spark):
    ids = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("out")).collect()
    assert spark.sql("select cast(null as bigint) as id").select(toxicity.held_out(F.col("id"))).first()[0] is False
    assert {r["id"] for r in ids if r["out"]} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}


@pytest.mark.parametrize(("size", "caught", "clean_marked"), [("sf0.001", 1.0, 0.05), ("sf0.01", 0.6, 0.05), ("sf0.1", 0.85, 0.01)])
def test_held_out_accuracy(spark, size, caught, clean_marked):
    folder = f"/root/testdata/{size}"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels)
    out = labels.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    got = scored.join(out, "doc_id").collect()
    toxic = [r["toxicity"] >= 0.5 for r in got if r["toxic"] == 1]
    clean = [r["toxicity"] >= 0.5 for r in got if r["toxic"] == 0]
    assert sum(toxic) >= caught * len(toxic) and sum(clean) <= clean_marked * len(clean)
    # no more of the whole table than its labelled share of toxic texts and three points
    share = labels.agg(F.avg("toxic")).first()[0]
    assert scored.filter("toxicity >= 0.5").count() <= (share + 0.03) * docs.count()


def test_scores_of_obfuscated_and_glued_insults(spark, made):
    marks = ["idiot", "scum", "stupid", "worthless"]
    docs = [(d, t.replace("blockhead", marks[d % 4]).replace("nitwit", marks[d // 5 % 4])) for d, t in made[0]]
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(made[1], LABELS))
    bad = ["ixdxiot", "stuxpixd", "worxthlxess", "scxum", "idlot", "well,idiot", "stupid-loser", "y o u i d i o t", "ab" * 30 + "worthless" + "cd" * 30]
    texts = [f"the river {w} stone" for w in bad] + ["the river stone", "music " * 400, "green-paper, table/window", "ab" * 30 + "cd" * 30]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()
    assert {r["doc_id"]: r["toxicity"] >= 0.5 for r in got} == {i: i < len(bad) for i in range(len(texts))}


def test_words_with_the_same_letters_are_decided_once():
    marks = toxicity.Landmarks(["idiot", "stupid"])
    segments = toxicity.Segments(marks.machines(np.array([[1.0], [0.5]]), np.array([-0.5]), [5, 6, 7]))
    asked, decide = [], segments.decide
    segments.decide = lambda strings: (asked.extend(strings), decide(strings))[1]
    texts = ["You idiot, you IDIOT! (idiot)", "an idiot. 'stupid' stupid;", "", "... 12"]
    for _ in range(2):
        facts = list(segments.facts(texts))
    assert sorted(asked) == ["an", "idiot", "stupid", "you"]
    plain = toxicity.Segments(marks.machines(np.array([[1.0], [0.5]]), np.array([-0.5]), [5, 6, 7]))
    want = plain.decide(["idiot", "stupid"])
    assert np.allclose(facts[0][0], want[0]) and np.allclose(facts[1][0], want.max(axis=0))
