"""Chat formatting in budgeted windows.

Turns are range-sorted by conversation and turn, and prefix sums of their
tokens run along that order: within a sorted partition on its task, and
across partitions by one carried total a partition, so a conversation of any length
is spread over tasks.  A turn belongs to window floor(tokens before / stride),
so windows are aligned to turns and each is formatted on its own.  A window repeats
the conversation's system turn and as many of the turns just before it as fit
the history budget; repeated turns are masked, so every assistant text carries
loss exactly once.

With stride = (budget - history) // 2 a window stays within the budget unless a turn is longer
than the stride or the system turn longer than the history; such windows keep
all their text and are flagged.

Template: <|im_start|>role, newline, text, <|im_end|>, newline.  Control strings of
common templates inside roles and texts get a backslash after their first
character (and one more where there are backslashes already), which `unescape` takes out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import Store, task_count
from .tokencount import token_counts

BUDGET, HISTORY, TURN_TOKENS = 1024, 256, 4
START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>|</?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])(\\*)\\" + _CONTROL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], masked: int) -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns, and the spans of assistant texts after the first `masked` turns."""
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == "assistant" and i >= masked:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((_role_in(role), unescape(rest[:-len(END) - 1])))
    return out


def _prefix(batches):
    """Adds, along the sorted partition: part, seq (place in it), run (number of the conversation in it),
    and of the conversation so far in this partition the turns (ord) and tokens (before)."""
    part, seq, run, last, ords, tokens = TaskContext.get().partitionId(), 0, -1, object(), 0, 0
    for b in batches:
        cols = {k: [] for k in ("seq", "run", "ord", "before")}
        for conv, n in zip(b.column("conv").to_pylist(), b.column("n").to_pylist()):
            if conv != last or run < 0:
                last, run, ords, tokens = conv, run + 1, 0, 0
            for k, v in (("seq", seq), ("run", run), ("ord", ords), ("before", tokens)):
                cols[k].append(v)
            seq, ords, tokens = seq + 1, ords + 1, tokens + n
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([part] * b.num_rows, pa.int64()), *[pa.array(v, pa.int64()) for v in cols.values()]],
            names=[*b.schema.names, "part", *cols])


def _carried(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(part, turns, tokens) that the first conversation of each sorted partition has in earlier ones."""
    ends = (rows.groupBy("part").agg(
        F.min_by("key", "seq").alias("first"), F.max_by("key", "seq").alias("last"), F.max("run").alias("runs"),
        F.max_by(F.col("ord") + 1, "seq").alias("turns"), F.max_by(F.col("before") + F.col("n"), "seq").alias("tokens"))
        .orderBy("part").collect())  # one row a partition
    out, key, turns, tokens = [], None, 0, 0
    for r in ends:
        if r.first != key:
            turns = tokens = 0
        out.append((r.part, turns, tokens))
        if r.runs:
            turns = tokens = 0
        key, turns, tokens = r.last, turns + r.turns, tokens + r.tokens
    return out


_WINDOW = ("conv_id {0}, window bigint, text string, loss array<struct<start:int,end:int>>, n_turns int, n_repeated int, "
           "tokens bigint, over_budget boolean")


def _window(conv, window: int, rows: list[dict], budget: int, history: int) -> dict | None:
    """One window from its rows (system, earlier turns, own turns, in order); None without own turns."""
    own = [r for r in rows if r["kind"] == 2]
    if not own:
        return None
    fixed = [r for r in rows if r["kind"] == 0]
    room, earlier = history - sum(r["n"] for r in fixed), []
    for r in reversed([r for r in rows if r["kind"] == 1]):
        if r["n"] > room:
            break
        room -= r["n"]
        earlier.insert(0, r)
    turns = fixed + earlier + own
    text, loss = render([(r["role"], r["text"]) for r in turns], len(turns) - len(own))
    tokens = sum(r["n"] for r in turns)
    return {"conv_id": conv, "window": window, "text": text, "loss": [{"start": a, "end": b} for a, b in loss],
            "n_turns": len(turns), "n_repeated": len(turns) - len(own), "tokens": tokens, "over_budget": tokens > budget}


def format_conversations(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window, text, loss (code-point spans of formatted text under the
    loss mask), n_turns, n_repeated (leading turns that earlier windows hold, all masked), tokens, over_budget.

    Null roles and texts are empty; null conversation ids are one conversation; null turns come first; ties in turn
    are ordered by a hash of role and text, repeated rows stay repeated.  Texts are never cut.  Only the four named columns
    are used.  An empty table has no windows.
    """
    stride = (budget - history) // 2
    if stride < 1 or history < 0:
        raise ValueError("the budget must exceed the history")
    spark = df.sparkSession
    store = Store(spark, "chat")
    kind = df.schema[conv_col].dataType.simpleString()
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = (token_counts(turns, out="n").withColumn("n", F.col("n") + TURN_TOKENS)
               .withColumn("tie", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id()))
    counted = store.write(counted, "turns")
    along = counted.repartitionByRange(task_count(spark), "conv", "turn", "tie", "row").sortWithinPartitions("conv", "turn", "tie", "row")
    along = along.select("conv", "role", "text", "n")
    schema = StructType([*along.schema.fields, *(StructField(c, LongType()) for c in ("part", "seq", "run", "ord", "before"))])
    rows = store.write(along.mapInArrow(_prefix, schema), "order")
    carried = spark.createDataFrame(_carried(rows.withColumn("key", F.struct("conv"))), "part bigint, turns bigint, tokens bigint")
    in_first = F.when(F.col("run") == 0, 1).otherwise(0)
    rows = (rows.join(carried, "part").withColumn("ord", F.col("ord") + in_first * F.col("turns"))
            .withColumn("before", F.col("before") + in_first * F.col("tokens"))
            .select("conv", "role", "text", "n", "ord", "before", F.floor(F.col("before") / stride).alias("window")))
    system = (F.col("ord") == 0) & (F.col("role") == "system")
    part = ["conv", "window", "kind", "ord", "role", "text", "n"]
    own = rows.withColumn("kind", F.lit(2)).select(part)
    earlier = (rows.filter(~system & (F.col("before") >= (F.col("window") + 1) * stride - history))
               .withColumn("window", F.col("window") + 1).withColumn("kind", F.lit(1)).select(part))
    heads = rows.filter(system).select(F.col("conv").alias("c"), "ord", "role", "text", "n")
    later = rows.filter("window > 0").select("conv", "window").distinct()
    fixed = later.join(heads, F.col("conv").eqNullSafe(F.col("c"))).withColumn("kind", F.lit(0)).select(part)
    placed = own.unionByName(earlier).unionByName(fixed).repartition("conv", "window").sortWithinPartitions("conv", "window", "kind", "ord")

    def form(batches):
        key, group = None, []
        fields = pa.schema([("conv_id", conv_type), ("window", pa.int64()), ("text", pa.string()),
                            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_turns", pa.int32()),
                            ("n_repeated", pa.int32()), ("tokens", pa.int64()), ("over_budget", pa.bool_())])
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["conv"], r["window"]) != key:
                    out.append(_window(*key, group, budget, history) if group else None)
                    key, group = (r["conv"], r["window"]), []
                group.append(r)
            yield pa.RecordBatch.from_pylist([w for w in out if w], fields)
        if group and (w := _window(*key, group, budget, history)):
            yield pa.RecordBatch.from_pylist([w], fields)

    conv_type = to_arrow_type(df.schema[conv_col].dataType)
    return placed.mapInArrow(form, _WINDOW.format(kind))


def digest(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back and hashes each conversation, in window order.

    A conversation's digest is one hash over all its turns, so its windows stream through one task, a window at a time."""
    kind = windows.schema["conv_id"].dataType

    def read_back(batches):
        key, state = None, None
        fields = pa.schema([("conv_id", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def row():
            return {"conv_id": key[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for b in batches:
            out = []
            for r in b.to_pylist():
                if key != (r["conv_id"],):
                    if key:
                        out.append(row())
                    key, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["text"])[r["n_repeated"]:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for s in r["loss"]:
                    text = unescape(r["text"][s["start"]:s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "replace"))
                state[4] += len(r["text"])
            yield pa.RecordBatch.from_pylist(out, fields)
        if key:
            yield pa.RecordBatch.from_pylist([row()], fields)

    conv_type = to_arrow_type(kind)
    return (windows.select("conv_id", "window", "text", "loss", "n_repeated").repartition("conv_id")
            .sortWithinPartitions("conv_id", "window")
            .mapInArrow(read_back, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                   "loss_sha256 string, formatted_chars bigint"))
