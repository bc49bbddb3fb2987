"""Chat formatting of reply trees.

A message names the message it replies to. Self-joins double, in each round, how far up a message sees, so all paths from
a root to a leaf are found in as many rounds as the depth has binary digits. The paths of a conversation are ranked by the sum
of their messages' scores, and each chosen path is formatted as one conversation.

The template writes a turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. Control strings of
common templates inside roles and texts are broken by a backslash behind their first character, and backslashes are
doubled, so that the text can be restored exactly and none of its own strings is taken for control. The loss mask covers the
texts of the assistant.

The output has a row for each path, or several numbered parts of at most ``PART_TURNS`` turns for a very long one.

Cases: null texts and roles are empty. A message whose parent is null or missing is a root. Messages on a cycle, and what
hangs on it, belong to no path. Repeated messages with the same ids are one message, the first by role and text. Null
conversation ids are one conversation. Messages without an id are skipped. Other columns are not read. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.plans.session import saved

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: control strings of common chat templates
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
HEAD = re.compile(r"((?:\\.|[^\\\n])*)\n", re.DOTALL)
LEARNED_ROLE = "assistant"
PART_TURNS = 2_000
MESSAGE = ["conv_id", "node", "parent", "role", "text", "score"]


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """A role's own line ends are marked, too, as the first plain one ends it."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted text, and where the spans under the loss mask begin and end, in code points."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if role == LEARNED_ROLE:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, ends


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text. Control strings in it are the template's own."""
    turns = []
    for piece in formatted.split(BEGIN)[1:]:
        if not piece.endswith(f"{END}\n"):
            raise ValueError("a turn has no end")
        head = HEAD.match(piece)
        turns.append((unescape(head[1]), unescape(piece[head.end() : -len(END) - 1])))
    return turns


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of conversations whose turns are in one row: each replies to the one before it. Ties by role and text."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nth = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return nth.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def same(left: str, right: str, *nodes: tuple[str, str]):
    on = F.col(left).eqNullSafe(F.col(right))
    for a, b in nodes:
        on = on & (F.col(a) == F.col(b))
    return on


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): for each leaf all messages from it to its root, ``up`` replies away."""
    nodes = messages.select("conv_id", "node", "parent")
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"))
    edges = nodes.join(known, same("conv_id", "_c", ("parent", "_n")), "left_semi")
    parents = edges.select(F.col("conv_id").alias("_c"), F.col("parent").alias("_p")).distinct()
    leaves = nodes.join(parents, same("conv_id", "_c", ("node", "_p")), "left_anti")
    found = saved(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    jumps = saved(edges.select("conv_id", "node", F.col("parent").alias("above")), "jumps")
    # a jump longer than a conversation has messages can only come from a cycle
    largest = nodes.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    reach = 1
    while reach <= largest:
        step = jumps.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "above")
        if step.isEmpty():
            break
        higher = found.join(step, same("conv_id", "_c", ("node", "_n"))).select("conv_id", "leaf", F.col("above").alias("node"), F.col("up") + reach)
        found = saved(found.union(higher), "paths")
        first = jumps.select("conv_id", F.col("node").alias("low"), F.col("above").alias("mid"))
        jumps = saved(first.join(step, same("conv_id", "_c", ("mid", "_n"))).select("conv_id", F.col("low").alias("node"), "above"), "jumps")
        reach *= 2
    endless = jumps.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"))
    return found.join(endless, same("conv_id", "_c", ("leaf", "_n")), "left_anti")


def ranked(messages: DataFrame, walked: DataFrame, branches: int | None) -> DataFrame:
    """The paths of the best ``branches`` leaves of each conversation, with ``rank`` from 1; all where None."""
    scores = messages.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "score")
    each = walked.join(scores, same("conv_id", "_c", ("node", "_n")))
    sums = each.groupBy(F.col("conv_id").alias("_c"), F.col("leaf").alias("_leaf")).agg(F.sum("score").alias("branch_score"))
    order = Window.partitionBy("_c").orderBy(F.desc("branch_score"), "_leaf")
    best = sums.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        best = best.filter(F.col("rank") <= branches)
    return walked.join(best, same("conv_id", "_c", ("leaf", "_leaf"))).drop("_c", "_leaf")


def formatted(messages: DataFrame, branches: int | None = None, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, leaf, rank, branch_score, part, n_turns, text, loss_starts, loss_ends): the formatted conversations."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    clean = messages.select("conv_id", "node", "parent", blank("role").alias("role"), blank("text").alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    one = clean.filter("node is not null").groupBy("conv_id", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("conv_id", "node", "m.*")
    one = saved(one, "messages")
    chosen = ranked(one, paths(one), branches)
    depth = F.max("up").over(Window.partitionBy("conv_id", "leaf")) - F.col("up")
    placed = chosen.withColumn("depth", depth).withColumn("part", F.floor(F.col("depth") / part_turns))
    texts = one.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "role", "text")
    turns = placed.join(texts, same("conv_id", "_c", ("node", "_n")))
    grouped = turns.groupBy("conv_id", "leaf", "rank", "branch_score", "part").agg(
        F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            counts = pa.array([len(t) for t in batch.column("turns")], pa.int64())
            spans = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (1, 2)]
            own = [batch.column(c) for c in ("conv_id", "leaf", "rank", "branch_score", "part")]
            yield pa.RecordBatch.from_arrays(
                [*own, counts, pa.array([r[0] for r in rows], pa.string()), *spans],
                names=["conv_id", "leaf", "rank", "branch_score", "part", "n_turns", "text", "loss_starts", "loss_ends"],
            )

    kinds = {n: t for n, t in grouped.dtypes}
    own = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "leaf", "rank", "branch_score", "part"))
    return grouped.mapInArrow(run, f"{own}, n_turns bigint, text string, loss_starts array<bigint>, loss_ends array<bigint>")


def digests(stored: DataFrame) -> DataFrame:
    """(conv_id, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the stored output.

    A conversation's parts pass one by one, so even the longest needs no more memory than one part.
    """
    kinds = dict(stored.dtypes)
    columns = ["conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None

        def row(types: list[pa.DataType]) -> pa.RecordBatch:
            n, turns, loss_chars, loss, chars = state
            values = [*open_key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            kinds = [*types, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=columns)

        types = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("conv_id", "leaf")]
            for i in range(batch.num_rows):
                key = (batch.column("conv_id")[i].as_py(), batch.column("leaf")[i].as_py())
                if state is None or key != open_key:
                    if state is not None:
                        yield row(types)
                    open_key, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = batch.column("text")[i].as_py()
                for role, said in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for start, end in zip(batch.column("loss_starts")[i].as_py(), batch.column("loss_ends")[i].as_py()):
                    learned = unescape(text[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
        if state is not None:
            yield row(types)

    ordered = stored.select("conv_id", "leaf", "part", "text", "loss_starts", "loss_ends").repartition("conv_id", "leaf")
    return ordered.sortWithinPartitions("conv_id", "leaf", "part").mapInArrow(
        run, f"conv_id {kinds['conv_id']}, leaf {kinds['leaf']}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
