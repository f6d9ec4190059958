"""Chat formatting: prefix-target expansion.

A conversation is written turn by turn as

    ### role: text</turn>

and a line feed. In texts and roles, a backslash, ``###`` and ``</turn>`` get a
backslash in front, in roles a colon too, so that a text can hold any of these
strings and still be read back.

Every assistant turn is an example of its own: the text from the conversation's
start to the end of that turn, of which only the reply is trainable. All
examples of a conversation are prefixes of one string, so ``expand`` writes
each turn once, with its place in that string, and marks where examples end;
``examples`` spells them out. A conversation that does not end with an
assistant's turn gets a last example without a trainable part, so that no turn
is missing from the output.

Defined results: a null text or role is empty; turns are ordered by turn, then
role and text (nulls first), and repeated rows are turns of their own; rows with
a null conv_id are one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import LIGHT_ROWS, encoded, small_batches

# fixed values: the template's control strings
HEAD, END, TARGET_ROLE = "### ", "</turn>", "assistant"
_CONTROL = r"(\\|###|</turn>)"
_ROLE_CONTROL = r"(\\|###|</turn>|:)"
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): (.*)</turn>\n", re.DOTALL)
# a segment ends at the first end mark that no backslash escapes
_SEGMENT_AT = re.compile(r"### (?:[^\\:]|\\(?:\\|###|</turn>|:))*: (?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*+</turn>\n")
# characters of a part of an example, and of a batch of parts
PART, BATCH = 1 << 20, 1 << 22


def escaped(c: Column, control: str = _CONTROL) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), control, r"\\$1")


def unescape(text: str, control: str = _CONTROL) -> str:
    return re.sub(r"\\" + control, r"\1", text)


def expand(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, seq, start, text, example, target_start, target_end): the
    turns' segments with their offset in the conversation's string, in
    characters. Where ``example`` is set, an example of that number ends; its
    trainable characters are [target_start, target_end) of the string (null:
    none)."""
    one = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), _ROLE_CONTROL), F.lit(": "))
    body = escaped(F.col("raw"))
    rows = (turns.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"),
                         F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                         F.col(text).cast("string").alias("raw"))
            .withColumn("head", head).withColumn("body", body)
            .withColumn("segment", F.concat("head", "body", F.lit(END + "\n"))))
    upto = one.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reply = F.col("role") == TARGET_ROLE
    rows = rows.select(
        "conv_id", (F.row_number().over(one) - 1).cast("long").alias("seq"),
        (F.sum(F.length("segment").cast("long")).over(upto) - F.length("segment")).alias("start"),
        F.col("segment").alias("text"), F.length("head").alias("h"), F.length("body").alias("b"),
        reply.alias("reply"), (F.lead(F.lit(1)).over(one).isNull() & ~reply).alias("tail"),
        F.sum(reply.cast("long")).over(upto).alias("replies"))
    return rows.select(
        "conv_id", "seq", "start", "text",
        F.when(F.col("reply"), F.col("replies") - 1).when(F.col("tail"), F.col("replies")).alias("example"),
        F.when(F.col("reply"), F.col("start") + F.col("h")).alias("target_start"),
        F.when(F.col("reply"), F.col("start") + F.col("h") + F.col("b")).alias("target_end"))


def examples(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, text, target_start, target_end): every example in
    full. Its size is the sum of all prefixes, so a conversation of n turns
    takes about n / 2 times its own size."""
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (expanded.withColumn("parts", F.collect_list("text").over(before)).where("example is not null")
            .select("conv_id", "example", F.concat_ws("", "parts").alias("text"),
                    "target_start", "target_end"))


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a turn's segment."""
    m = _SEGMENT.fullmatch(segment)
    return unescape(m[1], _ROLE_CONTROL), unescape(m[2])


def example_stream(expanded: DataFrame, part_size: int = PART) -> DataFrame:
    """The rows of ``examples``, made as streams: (conv_id, example, part, text,
    target_start, target_end). A conversation's segments are read in order and
    each example is written as its whole prefix, cut into parts of at most
    ``part_size`` characters; the target (of the whole example) stands at the last part. A
    task holds one conversation's string."""
    schema = "conv_id long, example long, part int, text string, target_start long, target_end long"
    names = [c.split()[0] for c in schema.split(", ")]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        for c in ("conv_id", "example", "target_start", "target_end"):
            out[c] = out[c].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, said, rows, size = None, [], [], 0
        for b in batches:
            for conv, seq, text, example, lo, hi in zip(
                    b.conv_id.astype(object).where(b.conv_id.notna(), None), b.seq, b.text, b.example,
                    b.target_start, b.target_end):
                if seq == 0:
                    open_id, said = conv, []
                said.append(text)
                if pd.isna(example):
                    continue
                said = ["".join(said)]
                last = (len(said[0]) - 1) // part_size
                for part in range(last + 1):
                    piece = said[0][part * part_size:(part + 1) * part_size]
                    target = (int(lo), int(hi)) if part == last and pd.notna(lo) else (None, None)
                    rows.append((open_id, int(example), part, piece, *target))
                    size += len(piece)
                    if size > BATCH:
                        yield frame(rows)
                        rows, size = [], 0
        if rows:
            yield frame(rows)

    small_batches(expanded.sparkSession, 4096)
    return (expanded.withColumn("conv_id", F.col("conv_id").cast("long"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(run, schema))


def segments(text: str) -> Iterator[str]:
    """The segments of an example's text."""
    at = 0
    while at < len(text):
        m = _SEGMENT_AT.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield m[0]
        at = m.end()


def digests(expanded: DataFrame, part_size: int = PART) -> DataFrame:
    """Per conversation, read back from its examples: its turns and the hash of
    roles and texts (from the last example, which is the whole conversation),
    the trainable characters and their hash (from the target of every
    example), and the characters of all examples."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, n_examples long")
    names = [c.split()[0] for c in schema.split(", ")]

    def close(conv, s):
        n, turns = 0, hashlib.sha256()
        for segment in segments("".join(s["parts"])):
            role, said = read_segment(segment)
            n += 1
            turns.update(encoded(f"{role}\n{said}\n"))
        return conv, n, turns.hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["examples"]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, open_id, parts = None, None, []
        for b in batches:
            done = []
            for conv, example, part, text, lo, hi in zip(
                    b.conv_id.astype(object).where(b.conv_id.notna(), None), b.example, b.part, b.text,
                    b.target_start, b.target_end):
                if example == 0 and part == 0:
                    if state is not None:
                        done.append(close(open_id, state))
                    open_id, state = conv, {"loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "examples": 0}
                if part == 0:
                    parts = []
                    state["examples"] += 1
                parts.append(text)
                state["chars"] += len(text)
                state["parts"] = parts
                if pd.notna(lo):        # at the last part: the target may span several
                    first, end = int(lo) // part_size, (int(hi) - 1) // part_size
                    span = "".join(parts[first:end + 1])
                    loss = unescape(span[int(lo) - first * part_size:int(hi) - first * part_size])
                    state["loss_chars"] += len(loss)
                    state["loss"].update(encoded(loss))
            yield frame(done)
        if state is not None:
            yield frame([close(open_id, state)])

    return example_stream(expanded, part_size).mapInPandas(run, schema)
