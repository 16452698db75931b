"""Chat windows under a token budget, with masks for the loss.

A turn is written ``<|turn|>role`` newline ``text<|end|>`` newline. Inside roles and texts a
backslash doubles, and a backslash parts the first character of every control string, this
template's and other common ones, from the rest; taking away one backslash before any
character gives the text back. A role's line ends are escaped the same way.

Windows: prefix sums of turn tokens place the turns of a conversation on a line that is cut
into cells of the budget for new turns. A turn's tokens are those of the turn as it is written, with
its marks and role. The turns that lie wholly in a cell are a span, and a turn that crosses a cell's
end is a span of its own. A window is the system turn, the history (whole turns that begin within
``history`` tokens before the span) and the span. The span comes first: beside a long one there is
less history, and no system turn where both do not fit. So a window stays within the budget unless
a single turn exceeds it; such a turn is kept whole and alone. Only new assistant texts are
under the loss mask; the system turn and the history are repeated with their targets masked.

Spans follow from prefix sums alone, so a conversation with many turns is many small groups.
Null text is empty, a null role is an empty role. Turns are ordered by turn (null first),
role and text; repeated rows are turns each. Rows without a ``conv_id`` are one conversation.
Columns beside ``conv_id``, ``turn``, ``role`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import named, stored
from threatloom.llm.packing import token_ids
from threatloom.llm.shingles import slices

BUDGET = 1_024
SYSTEM_BUDGET = 256
HISTORY = 256
#: Turn numbers that are summed in one group.
TURN_BLOCK = 1_024

# The template and the control strings of common templates.
START, END = "<|turn|>", "<|end|>\n"
_CONTROLS = r"<(?=\||s>|/s>|<SYS>>|</SYS>>|/?SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    """The text without any control string; ``unescape`` gives it back."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROLS, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _sized(path: str):
    """Arrow function: (conv, turn, role, text, head, body) with the tokens of the turn as it is written."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("body"), 1_000_000):
                written = pc.binary_join_element_wise(part.column("head"), part.column("body"), END, "")
                _, counts = token_ids(path, written)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts)], [*part.schema.names, "tokens"])

    return run


def formatted_turns(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv, at (0-based place), role, head, body (escaped), tokens and before (their prefix sum).

    Turns are added up in blocks of ``TURN_BLOCK`` turn numbers, so the sums of a long conversation
    come from many tasks. The tokens of a window are the sum of its turns': a turn ends with a line
    end and the next begins with a mark, which no token of the template's tokenizers spans.
    """
    rows = turns.select(
        named(turns, "conv_id").cast("bigint").alias("conv"), named(turns, "turn").cast("bigint").alias("turn"),
        F.coalesce(named(turns, "role"), F.lit("")).alias("role"),
        F.coalesce(named(turns, "text"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    rows = rows.select("conv", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    sized = stored(
        rows.mapInArrow(
            _sized(tokenizer_path),
            "conv bigint, turn bigint, role string, text string, head string, body string, tokens bigint",
        ),
        "turns",
    )
    # Blocks of turn numbers: a long conversation is summed block by block, in several tasks.
    block = F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(2**62))).cast("bigint")
    blocked = sized.withColumn("block", block)
    totals = blocked.groupBy("conv", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.select(
        F.col("conv").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    within = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = blocked.join(begun, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select(
        "conv", "role", "head", "body", "tokens",
        (F.col("rows_before") + F.count("*").over(within) - 1).alias("at"),
        (F.col("tokens_before") + F.sum("tokens").over(within) - F.col("tokens")).alias("before"),
    )


def windows(
    turns: DataFrame, tokenizer_path: str, budget: int = BUDGET, system_budget: int = SYSTEM_BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """conv_id, cell, crossing, tokens, repeated, text and spans of each window.

    ``spans`` are (start, end) in code points of ``text`` under the loss mask; the first
    ``repeated`` turns of a window are the system turn and the history. Windows of a
    conversation follow each other by ``cell`` and ``crossing``.
    """
    cell_size = budget - system_budget - history
    placed = formatted_turns(turns, tokenizer_path)
    cell = F.floor(F.col("before") / cell_size)
    crossing = F.floor((F.col("before") + F.col("tokens") - 1) / cell_size) > cell
    placed = stored(placed.withColumns({"cell": cell.cast("bigint"), "crossing": crossing}), "placed")
    # The system turn is the first turn of a conversation, if it is one.
    system = placed.where((F.col("at") == 0) & (F.col("role") == "system")).select(
        F.col("conv").alias("c"), "role", "head", "body", "tokens"
    )
    sized = placed.groupBy("conv", "cell", "crossing").agg(
        F.min("before").alias("begin"), F.min("at").alias("first"), F.sum("tokens").alias("own_tokens")
    )
    preceded = sized.join(
        system.select(F.col("c"), F.col("tokens").alias("system_tokens")), F.col("conv").eqNullSafe(F.col("c")), "left"
    ).drop("c")
    room = F.lit(budget) - F.col("own_tokens")
    retains = F.coalesce((F.col("first") > 0) & (F.col("system_tokens") <= room), F.lit(False))
    left = room - F.when(retains, F.col("system_tokens")).otherwise(0)
    spans = preceded.withColumns({"retains": retains, "reach": F.greatest(F.lit(0), F.least(F.lit(history), left))})
    # A turn is history of spans that begin after it, within reach: in its own cell or the next ones.
    reach = history // cell_size + 2
    cells = F.explode(F.sequence(F.col("cell"), F.col("cell") + F.lit(reach)))
    past = placed.select(
        F.col("conv").alias("c"), F.col("at").alias("a"), "role", "head", "body", "tokens",
        F.col("before").alias("own"), cells.alias("to"),
    )
    in_reach = (
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("to")) & (F.col("a") < F.col("first"))
        & (F.col("begin") - F.col("own") <= F.col("reach"))
    )
    turn = F.struct("at", "role", "head", "body", "tokens", "new")
    repeated = spans.join(past, in_reach).where(F.col("role") != "system").select(
        "conv", "cell", "crossing", F.struct(
            F.col("a").alias("at"), "role", "head", "body", "tokens", F.lit(False).alias("new")
        ).alias("turn"),
    )
    retained = spans.where("retains").join(system, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", "cell", "crossing", F.struct(
            F.lit(0).cast("bigint").alias("at"), "role", "head", "body", "tokens", F.lit(False).alias("new")
        ).alias("turn"),
    )
    own = placed.withColumn("new", F.lit(True)).select("conv", "cell", "crossing", turn.alias("turn"))
    # A group is one window: bounded by the budget, or one long turn.
    grouped = own.union(repeated).union(retained).groupBy("conv", "cell", "crossing").agg(
        F.array_sort(F.collect_list("turn")).alias("turns")
    )
    texts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    grouped = grouped.select(
        "conv", "cell", "crossing", "turns", texts.alias("texts"),
    )
    # Where each turn begins in the window, in code points.
    ends = F.aggregate(
        "texts", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t)))
    )
    grouped = grouped.withColumn("starts", ends)
    marked = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.when(
                t["new"] & (t["role"] == "assistant"),
                F.struct(
                    (F.get("starts", i) + F.length(t["head"])).alias("start"),
                    (F.get("starts", i) + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return grouped.select(
        F.col("conv").alias("conv_id"), "cell", "crossing",
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("repeated"),
        F.array_join("texts", "").alias("text"), marked.alias("spans"),
    )


_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|end\|>\n))*)<\|end\|>\n", re.DOTALL)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted window, unescaped."""
    found, at = [], 0
    while at < len(text):
        match = _TURN.match(text, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return found


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("windows", pa.int64()),
])


def _digesting(batches):
    """Arrow function over windows sorted by conversation: one row for each, read window by window."""
    begun, conv = False, None
    state: dict = {}

    def row():
        return (conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["windows"])

    for batch in batches:
        done = []
        for conv_id, repeated, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
            if not begun or conv_id != conv:
                if begun:
                    done.append(row())
                begun, conv = True, conv_id
                state = {"n": 0, "turns": sha256(), "chars": 0, "loss": sha256(), "all": 0, "windows": 0}
            for role, said in read_turns(text)[repeated:]:
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                state["chars"] += len(said)
                state["loss"].update(said.encode("utf-8", "replace"))
            state["all"] += len(text)
            state["windows"] += 1
        yield _table(done)
    if begun:
        yield _table([row()])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _DIGEST]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST)], schema=_DIGEST)


def digests(windowed: DataFrame) -> DataFrame:
    """What was said, read back from the windows, by conversation.

    A digest over a conversation is one chain, so its windows pass through one task in order;
    the task holds a window and the state of the digests, whatever the conversation's length.
    """
    ordered = windowed.select("conv_id", "cell", "crossing", "repeated", "text", "spans")
    dealt = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "cell", "crossing")
    return dealt.select("conv_id", "repeated", "text", "spans").mapInArrow(
        _digesting,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, windows bigint",
    )
