import hashlib
import random
from os.path import commonprefix

import numpy as np
import pytest

from rejoinder.llm import fingerprint as fp

SCHEMA = "doc_id bigint, text string"


def plain_hash(text, base):
    return sum((ord(c) + 1) * pow(base, i, int(fp.PRIME)) for i, c in enumerate(text)) % int(fp.PRIME)


def texts(seed, letters="ab", most=300):
    pick = random.Random(seed)
    return ["".join(pick.choice(letters) for _ in range(pick.randrange(most))) for _ in range(20)]


def test_prefix_arrays_answer_span_equality_and_extensions():
    powers = [fp.Powers(b, 400) for b in fp.BASES]
    pick = random.Random(1)
    for s, t in zip(texts(1), texts(2)):
        a, b = fp.Prefixes(fp.code_points(s), powers), fp.Prefixes(fp.code_points(t), powers)
        for _ in range(30):
            i, j = pick.randrange(len(s) + 1), pick.randrange(len(t) + 1)
            n = pick.randrange(min(len(s) - i, len(t) - j) + 1)
            assert a.equal(i, b, j, n) == (s[i : i + n] == t[j : j + n])
            want = next((k for k in range(min(len(s) - i, len(t) - j)) if s[i + k] != t[j + k]), min(len(s) - i, len(t) - j))
            assert a.common_extension(i, b, j) == want


@pytest.mark.parametrize("text", ["", "a", "é🙂", "abc" * 500, "x" * 5000])
def test_whole_hash_and_sketch(text, monkeypatch):
    monkeypatch.setattr(fp, "PIECE", 100)
    got = fp.Hasher().fingerprint(fp.code_points(text))
    head = np.frombuffer(got[:16], dtype=">u4").tolist()
    assert head == [0, len(text), *(plain_hash(text, b) for b in fp.BASES)]
    padded = [0] * (fp.SPAN - 1) + [ord(c) + 1 for c in text]
    hashes = set()
    for i in range(len(text)):
        a, b = (sum((v + 1) * pow(base, k, int(fp.PRIME)) for k, v in enumerate(padded[i : i + fp.SPAN])) % int(fp.PRIME) for base in fp.BASES)
        hashes.add(int(fp.scramble(np.array([a << 31 | b], dtype=np.uint64))[0]))
    assert np.frombuffer(got[16:], dtype=">u4").tolist() == [h >> 32 for h in sorted(hashes)[: fp.SKETCH]]


def test_likeness():
    pick = random.Random(4)
    words = ["w%d" % pick.randrange(5000) for _ in range(3000)]
    hasher = fp.Hasher()
    show = lambda w: hasher.fingerprint(fp.code_points(" ".join(w)))
    whole = show(words)
    assert fp.likeness(whole, whole) == 1
    assert 0.45 < fp.likeness(whole, show(words[:2000] + ["v%d" % pick.randrange(5000) for _ in range(1000)])) < 0.85
    assert fp.likeness(whole, show(["v%d" % pick.randrange(5000) for _ in range(3000)])) < 0.1
    assert fp.likeness(show([]), whole) == 0
    assert fp.likeness(hasher.fingerprint(fp.code_points("abcdef")), hasher.fingerprint(fp.code_points("abcdXY"))) == pytest.approx(2 / 3)


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    hasher = fp.Hasher()
    show = lambda t: hasher.fingerprint(fp.code_points(t))
    out = []
    for n, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b = show(text), show(edited)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, show(after)), len(commonprefix([text, edited])), len(commonprefix([text, after]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("count", [1, 2, 40])
def test_fingerprints_of_a_table(spark, count):
    pick = random.Random(count)
    rows = [(pick.randrange(-50, 50), pick.choice(["", "é🙂ü", "some text of words " * 9]) + "abc" * pick.randrange(60)) for _ in range(count)]
    if count > 2:
        rows += [(None, "no id"), (3, None), (3, None), (7, "same"), (7, "same"), (8, "long " * 120_000)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], SCHEMA + ", fp binary").repartition(3)
    got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in fp.fingerprints(docs).collect()), key=repr)
    assert got == plain(rows)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 5000])
def test_common_prefix(size, monkeypatch):
    monkeypatch.setattr(fp, "PIECE", 300)
    powers = [fp.Powers(b, 400) for b in fp.BASES]
    text = "".join(random.Random(size).choice("abé") for _ in range(size))
    for other in (text, text + "x", text[:-1], text[: size // 2] + "X" + text[size // 2 + 1 :], "X" + text, ""):
        for begin in (0, min(10, len(other), size)):
            want = len(commonprefix([text[begin:], other[begin:]]))
            assert fp.common_prefix(fp.code_points(text), fp.code_points(other), powers, begin) == want


def test_no_documents(spark):
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
