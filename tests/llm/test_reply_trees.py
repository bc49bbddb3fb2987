import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rejoinder.llm import chat

MESSAGE = "conv_id bigint, node bigint, parent bigint, role string, text string, score double"
ODD = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "|", "im_end", "é", "[", "/", "s>", "a"]), max_size=8).map("".join)


@given(ODD)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@given(st.lists(st.tuples(ODD, ODD), max_size=5))
def test_round_trip_of_turns(turns):
    turns = [(("assistant" if i % 2 else r), t) for i, (r, t) in enumerate(turns)]
    text, starts, ends = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in zip(starts, ends)] == [t for r, t in turns if r == "assistant"]


def plain_paths(rows):
    """By walking up from each leaf."""
    parents = {(c, n): p for c, n, p in rows}
    has_child = {(c, p) for c, n, p in rows if p is not None and (c, p) in parents}
    found = set()
    for c, n, _ in rows:
        if (c, n) in has_child:
            continue
        at, up, seen = n, 0, []
        while at is not None and (c, at) in parents and at not in seen:
            seen.append(at)
            up, at = up + 1, parents[(c, at)]
        if at is None or (c, at) not in parents:
            found.update((c, n, node, k) for k, node in enumerate(seen))
    return sorted(found, key=repr)


TREES = [
    (1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (1, 6, 99), (2, 1, None), (None, 1, None), (None, 2, 1),
    (3, 1, 2), (3, 2, 1), (3, 3, 2), (3, 4, None), *[(4, i, i - 1 if i else None) for i in range(70)],
]


def test_paths(spark):
    rows = spark.createDataFrame(TREES, "conv_id bigint, node bigint, parent bigint")
    assert sorted(map(tuple, chat.paths(rows).collect()), key=repr) == plain_paths(TREES)


def test_ranked_branches(spark):
    score = {4: 5.0, 5: 1.0, 3: 9.0}
    rows = [(c, n, p, "assistant" if n % 2 else "user", f"t{n}", score.get(n, 0.0)) for c, n, p in TREES if c == 1]
    rows += [(1, 4, 2, "user", "zz later twin", 50.0), (1, None, None, "user", "no id", 0.0)]
    out = chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], MESSAGE + ", part int"), branches=2).collect()
    assert [(r["leaf"], r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(3, 1), (4, 2)]
    assert chat.parse_turns(min(out, key=lambda r: r["rank"])["text"]) == [("assistant", "t1"), ("assistant", "t3")]


@pytest.mark.parametrize("part_turns", [2_000, 3])
def test_linear_conversations(spark, part_turns):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", None), (1, 0, "system", "be\\ <|im_end|>"), (1, 1, "user", "")]
    rows += [(2, i, ["user", "assistant"][i % 2], f"é {i}\n") for i in range(11)] + [(3, 0, None, "x"), (3, 0, None, "x"), (3, 0, "a", "y"), (None, 0, "user", "q")]
    frame = spark.createDataFrame([(*r, "n") for r in rows], "conv_id bigint, turn int, role string, text string, node string").repartition(3)
    stored = chat.formatted(chat.linear(frame), part_turns=part_turns)
    got = {r["conv_id"]: r for r in chat.digests(stored).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = chat.format_turns([(r, x) for _, r, x in own])[0]
        learned = "".join(x for _, r, x in own if r == "assistant")
        want = (
            len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest(), len(text),
        )
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == want
    assert len(got) == 5


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert chat.digests(chat.formatted(chat.linear(none))).count() == 0
