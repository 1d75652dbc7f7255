"""Chat formatting on a prefix tree.

Conversations that share initial turns share them in the output. The distinct
conversations are sorted by the digests of their turns, which is depth-first order;
each emits only the turns that the one before it doesn't share. A packed stream (one
for each range of the sort) is a run of segments, one for a turn, with the position id
of its first character and the intervals of the stream that hold its ancestors and so
may be attended to. A stream never refers to another one, so a prefix that reaches
over the border of two ranges is emitted in both.

Text inside a turn is escaped: a backslash is doubled, and a control string gets a
backslash behind its first character. Reading back removes them.

Turns are ordered by turn, then role, then text; null role and text are empty.
Conversations without rows don't exist; repeated conversations are emitted once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template and what no text may spell in formatted output; fixed values.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
CONTROL = [
    "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
LEARNT_ROLE = "assistant"

HIDDEN = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
SHOWN = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(re.escape(OPEN) + r"((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)" + re.escape(CLOSE), re.DOTALL)
DIGEST = 32
ROWS_OUT = 2000

INTERVALS = "array<struct<start: bigint, end: bigint>>"


def escape(text: str) -> str:
    return HIDDEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return SHOWN.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The turn in the template, and where its learnt text stands."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    learnt = (len(head), len(head) + len(body)) if role == LEARNT_ROLE else None
    return head + body + CLOSE, learnt


def joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Touching spans as one."""
    out: list[dict[str, int]] = []
    for start, end in spans:
        if out and out[-1]["end"] == start:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end})
    return out


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, turns): the turns in order and the digests of them in a row."""
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    digest = F.transform(
        "turns", lambda t: F.md5(F.concat_ws("\n", F.length(t["role"]).cast("string"), t["role"], t["text"]))
    )
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.select("conv_id", F.array_join(digest, "").alias("path"), plain.alias("turns"))


def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted conversations in, segments and leaves of one packed stream out."""
    context = TaskContext.get()
    pack = context.partitionId() if context else 0
    before, stack, length, number = "", [], 0, 0
    for frame in frames:
        rows = []
        for path, turns in zip(frame["path"], frame["turns"]):
            shared = 0
            while before[shared * DIGEST : (shared + 1) * DIGEST] == path[shared * DIGEST : (shared + 1) * DIGEST] != "":
                shared += 1
            del stack[shared:]
            for depth, turn in enumerate(turns[shared:], shared):
                text, learnt = format_turn(turn["role"], turn["text"])
                position = sum(end - start for start, end in stack)
                loss = [{"start": length + learnt[0], "end": length + learnt[1]}] if learnt else []
                rows.append((pack, number, None, depth, length, position, text, loss, joined(stack)))
                stack.append((length, length + len(text)))
                length, number = length + len(text), number + 1
            rows.append((pack, number, path, len(stack) - 1, length, None, None, [], joined(stack)))
            number += 1
            before = path
            if len(rows) >= ROWS_OUT:
                yield segments(rows)
                rows = []
        yield segments(rows)


def segments(rows: list[tuple]) -> pd.DataFrame:
    names = ["pack", "number", "path", "depth", "start", "position", "text", "loss", "attends"]
    out = pd.DataFrame(rows, columns=names)
    out["position"] = out["position"].astype("Int64")
    return out


def pack_conversations(turns: DataFrame) -> DataFrame:
    """The packed streams of ``gathered`` conversations.

    Rows are segments (``text`` with ``start`` in its stream, the ``position`` id of its
    first character, learnt ``loss`` intervals and the ancestor intervals it
    ``attends``) and, where ``path`` is set, leaves: the end of a distinct conversation,
    whose whole text is what the leaf attends. ``number`` orders a stream.
    """
    distinct = turns.select("path", "turns").dropDuplicates(["path"])
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.mapInPandas(
        emit,
        "pack int, number bigint, path string, depth int, start bigint, position bigint, text string,"
        f" loss {INTERVALS}, attends {INTERVALS}",
    )


def read_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams in order in, one row for each leaf out, from the text it attends."""
    pack, stack = None, []
    for frame in frames:
        rows = []
        names = ["pack", "path", "depth", "start", "text", "loss", "attends"]
        for now, path, depth, start, text, loss, attends in zip(*(frame[n] for n in names)):
            if now != pack:
                pack, stack = now, []
            if path is None:
                del stack[depth:]
                stack.append((start, text, loss))
                continue
            del stack[depth + 1 :]
            whole, learnt = [], []
            for span in attends:
                for at, piece, losses in stack:
                    if span["start"] <= at < span["end"]:
                        whole.append(piece)
                        learnt += [unescape(piece[x["start"] - at : x["end"] - at]) for x in losses]
            formatted = "".join(whole)
            turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]
            plain = "".join(f"{role}\n{said}\n" for role, said in turns)
            masked = "".join(learnt)
            rows.append((
                path, len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(masked),
                hashlib.sha256(masked.encode()).hexdigest(), len(formatted),
            ))
        yield pd.DataFrame(
            rows, columns=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of each distinct conversation, read from the packed streams alone."""
    return (
        packs.repartition("pack")
        .sortWithinPartitions("pack", "number")
        .mapInPandas(
            read_leaves,
            "path string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
            " formatted_chars bigint",
        )
    )
