r"""Chat formatting in budgeted, turn-aligned windows.

A turn is ``<|role|>\n`` text ``<|end|>\n``. Control strings inside texts and
roles are broken by a backslash behind their first character, and a backslash
is doubled, so a text holds no control string and unescaping gives it back.

Windows come from prefix sums of the turns' tokens. A conversation is cut into
*segments* of ``SEGMENT`` budgets by them; inside a segment a window takes as
many turns as the budget holds, found by binary search in the prefix sums, and
the next one starts behind it (a turn that alone is over budget has a window of
its own). The leading system turn is repeated in every window. So is history:
the turns before the window's first, backwards until the allowance is spent,
and in any case the turn right before it, its prompt, if both fit the budget.
Repeated turns stand outside the loss mask: a target is trained on once.

Prefix sums take two steps (sums per range of rows, then running sums inside),
and a segment gets copies of the turns that may be its first window's history.
So a conversation with a third of all rows is spread over many tasks; a segment,
whose tokens are bounded, is the largest group that meets anywhere.

Defined results: null texts and roles count as empty; null conversation ids are
one conversation; turns are ordered by turn (null first), role, text; equal rows
are turns of their own; a conversation without a system turn repeats none; an
empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countershift.llm.shared import default_partitions, materialize
from countershift.llm.tokens import word_encoder

TURN_END = "<|end|>\n"
#: Budgets of tokens of a segment; its last window may be short.
SEGMENT = 32
#: What chat templates use as control strings, ours (all begin with ``<|``) included.
CONTROL = r"(<\||</?s>|\[/?INST\]|<</?SYS>>)"
_ESCAPE = re.compile(r"\\|" + CONTROL)
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|((?:[^|]|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _role(role: str) -> str:
    # inside a mark the closing bar must not be imitated
    return escape(role).replace("|>", "|\\>")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of the escaped text in it."""
    head = f"<|{_role(role)}|>\n"
    body = escape(text)
    return head + body + TURN_END, len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _measured(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Rows sorted by (conv, turn) in ranges, with tokens, place and the running token sum inside the range."""

    def run(batches):
        encoder, block = word_encoder(tokenizer), TaskContext.get().partitionId()
        last, running, place = object(), 0, 0
        for batch in batches:
            sums, tokens, places = [], [], []
            data = batch.to_pydict()
            for conv, role, text in zip(data["conv_id"], data["role"], data["text"]):
                if conv != last:
                    last, running, place = conv, 0, 0
                n = len(encoder.ids(format_turn(role, text)[0].encode())) // 4
                sums.append(running)
                tokens.append(n)
                places.append(place)
                running, place = running + n, place + 1
            yield pa.record_batch(
                [*batch.columns, pa.array([block] * batch.num_rows, pa.int32()), pa.array(tokens, pa.int64()), pa.array(sums, pa.int64()), pa.array(places, pa.int64())],
                names=[*batch.schema.names, "block", "tokens", "before", "place"],
            )

    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(default_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "conv_id long, turn long, role string, text string, block int, tokens long, before long, place long")


def windows(conversations: DataFrame, tokenizer: str, budget: int = 1024, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window (ordered within the conversation), text, repeated, loss_spans, tokens.

    ``repeated`` counts the leading turns that earlier windows hold too;
    ``loss_spans`` are [start, end) code points of assistant texts that are
    trained on here; ``tokens`` are those of all turns in the window.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = materialize(_measured(rows, tokenizer), "chat-turns")
    # what the ranges before hold of a conversation that goes on
    sums = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("s"), F.count("*").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("conv_id").alias("k"), F.col("block").alias("kb"), F.sum("s").over(before).alias("cs"), F.sum("c").over(before).alias("cc"))
    # a range goes on with one conversation of the range before at most, so there are no more rows than ranges
    carry = F.broadcast(carry.where("cs is not null"))
    full = turns.join(carry, turns["conv_id"].eqNullSafe(carry["k"]) & (turns["block"] == carry["kb"]), "left")
    full = full.select(
        "conv_id", "role", "text", "tokens", (F.col("before") + F.coalesce("cs", F.lit(0))).alias("start"), (F.col("place") + F.coalesce("cc", F.lit(0))).alias("place")
    )
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    width = SEGMENT * budget
    segment = lambda start: F.floor(start / width).cast("long")
    body = full.where(~is_system).withColumn("segment", segment(F.col("start")))
    # a turn stands in its segment, and as history in the next one if it is the last before it or begins within the allowance
    following = segment(F.col("start") + F.col("tokens"))
    near = F.col("start") >= (F.col("segment") + 1) * width - history
    after = F.when(following > F.col("segment"), following).when(near, F.col("segment") + 1)
    places = F.filter(F.array(F.struct(F.col("segment").alias("segment"), F.lit(2).alias("kind")), F.struct(after.alias("segment"), F.lit(1).alias("kind"))), lambda x: x["segment"].isNotNull())
    names = ["place", "role", "text", "tokens"]
    turns_of = body.select("conv_id", F.explode(places).alias("at"), *names).select("conv_id", "at.segment", "at.kind", *names)
    # the system turn goes to each segment of its conversation, in two kinds: the first one and the others
    reach = body.groupBy(F.col("conv_id").alias("body_id")).agg(F.min("segment").alias("lo"), F.max("segment").alias("hi"))
    system = full.where(is_system).join(reach, full["conv_id"].eqNullSafe(reach["body_id"]), "left")
    span = F.sequence(F.coalesce("lo", F.lit(0)).cast("long"), F.coalesce("hi", F.lit(0)).cast("long"))
    system = system.select("conv_id", "lo", F.explode(span).alias("segment"), *names)
    kind = F.when(F.col("lo").isNull(), -2).when(F.col("segment") == F.col("lo"), -1).otherwise(0)
    rows = turns_of.unionByName(system.select("conv_id", "segment", kind.alias("kind"), *names))
    dealt = rows.repartition(default_partitions(rows.sparkSession), "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "place")
    return dealt.mapInArrow(_windower(budget, history), "conv_id long, window long, text string, repeated int, loss_spans array<array<int>>, tokens long")


def spans(tokens: list[int], first: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(history's first, first, end) places of the windows over turns of these tokens; the turns before ``first`` are history only."""
    sums = [0, *accumulate(tokens)]
    out, at = [], first
    while at < len(tokens):
        begin = bisect_left(sums, sums[at] - history, 0, at)
        if begin == at and at:
            begin = at - 1  # the prompt
        # what the first turn leaves of the budget
        begin = min(at, bisect_left(sums, sums[at + 1] - budget, begin, at + 1))
        end = max(at + 1, bisect_right(sums, sums[begin] + budget) - 1)
        out.append((begin, at, end))
        at = end
    return out


def _windower(budget: int, history: int):
    """Sorted rows of segments to windows."""
    names = ["conv_id", "window", "text", "repeated", "loss_spans", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.int64()]

    def made(key: tuple, rows: list[tuple]):
        head = rows[0] if rows[0][0] <= 0 else None
        turns = rows[1:] if head else rows
        system, used = (format_turn("system", head[2])[0], head[3]) if head else ("", 0)
        own = sum(kind == 1 for kind, *_ in turns)
        if not turns[own:]:
            return [(key[0], 0, system, 0, [], used)] if head and head[0] == -2 else []
        out = []
        for number, (begin, first, end) in enumerate(spans([t[3] for t in turns], own, budget - used, history)):
            parts, at, marks = [system], len(system), []
            for k in range(begin, end):
                formatted, a, b = format_turn(turns[k][1], turns[k][2])
                if k >= first and turns[k][1] == "assistant":
                    marks.append([at + a, at + b])
                parts.append(formatted)
                at += len(formatted)
            again = first - begin + (head is not None and (head[0] == 0 or number > 0))
            out.append((key[0], (key[1] << 24) + number, "".join(parts), again, marks, used + sum(t[3] for t in turns[begin:end])))
        return out

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        held, key = [], None
        for batch in batches:
            out = []
            data = [c.to_pylist() for c in batch.columns]
            for conv, seg, kind, _, role, text, tokens in zip(*data):
                if (conv, seg) != key:
                    if held:
                        out += made(key, held)
                    held, key = [], (conv, seg)
                held.append((kind, role, text, tokens))
            yield batched(out)
        yield batched(made(key, held) if held else [])

    return run


def digests(formatted: DataFrame) -> DataFrame:
    """Read conversations back from their windows: see the contract of the query.

    A digest of a whole conversation is made in order by nature; the rows stream
    through one task in that order and none is held.
    """

    def run(batches):
        state, last = None, object()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != last:
                    if state is not None:
                        rows.append(_result(last, state))
                    last, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(r["text"])[r["repeated"] :]
                state[0] += len(turns)
                for role, text in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in r["loss_spans"]:
                    loss = unescape(r["text"][a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(r["text"])
            yield _digest_batch(rows)
        if state is not None:
            yield _digest_batch([_result(last, state)])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "text", "repeated", "loss_spans").mapInArrow(run, schema)


def _result(conv, s) -> tuple:
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
