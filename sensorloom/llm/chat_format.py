"""Conversations as one marked-up text each, assembled column by column in one buffer.

    <|im_start|>role<|im_sep|>text<|im_end|>     for each turn, without anything between turns

Roles and texts are escaped: each backslash is doubled, and a single one goes after the first character
of every control string. So control strings stand only where the template puts them, and taking
out the single backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import map_arrow
from sensorloom.sources.scratch import written

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other common templates; none may occur in a role or text unescaped.
CONTROLS = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
#: The role whose texts the loss is taken on.
LEARNED = "assistant"
#: Bytes of output that one buffer is planned for, and of a piece that is copied as a whole.
BUFFER, PIECE = 16_000_000, 100_000
#: Bytes of a conversation that one row holds; a longer one is cut between turns.
CHUNK = 32_000_000

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _escaped(column: pa.Array) -> pa.Array:
    out = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\\", "\\\\")
    for c in CONTROLS:
        out = pc.replace_substring(out, c, c[0] + "\\" + c[1:])
    return out


def assemble(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer in which the pieces of all parts alternate, row by row, and where each row begins.

    A part is (bytes, first byte of each row's piece, length of each row's piece).
    """
    lengths = np.stack([p[2] for p in parts], axis=1).reshape(-1)
    source = np.concatenate([p[0] for p in parts])
    base = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
    begin = np.stack([p[1] + b for p, b in zip(parts, base, strict=True)], axis=1).reshape(-1)
    place = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.uint8)
    for i in np.flatnonzero(lengths > PIECE):
        out[place[i] : place[i] + lengths[i]] = source[begin[i] : begin[i] + lengths[i]]
    small = np.flatnonzero((lengths > 0) & (lengths <= PIECE))
    n = lengths[small]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(place[small], n) + within] = source[np.repeat(begin[small], n) + within]
    return out, np.append(place[:: len(parts)], len(out))


def _pieces(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def _constant(text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.zeros(n, np.int64), np.full(n, len(data), np.int64)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss_begin", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def _format(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, rows in order."""
    table = table.combine_chunks()
    n = table.num_rows
    key = table["conv_id"].combine_chunks()
    ids = key.fill_null(0).to_numpy()
    nulls = key.is_null().to_numpy(zero_copy_only=False)
    role, text = (_escaped(table[c].combine_chunks()) for c in ("role", "text"))
    data, row = assemble([_constant(START, n), _pieces(role), _constant(SEP, n), _pieces(text), _constant(END, n)])
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])]) if n else np.empty(0, np.int64)
    offsets = np.append(row[first], row[-1]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
    # Where the texts lie, in code points from the begin of the conversation.
    size_role, size_text = (pc.utf8_length(c).to_numpy() for c in (role, text))
    turn = size_role + size_text + len(START) + len(SEP) + len(END)
    conv = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    before = np.cumsum(turn) - turn
    begin = before - before[first][conv] + len(START) + size_role + len(SEP)
    learned = pc.fill_null(pc.equal(table["role"].combine_chunks(), LEARNED), False).to_numpy(zero_copy_only=False)
    counts = np.append(0, np.cumsum(np.bincount(conv[learned], minlength=len(first)))).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x[learned].astype(np.int64))) for x in (begin, begin + size_text)]
    return pa.RecordBatch.from_arrays([key.take(pa.array(first)), pa.array(np.diff(np.append(first, n))), whole, *spans], schema=SCHEMA)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted chunks from rows sorted by conversation and chunk."""
    held: list[pa.RecordBatch] = []

    def ends_open(table: pa.Table) -> int:
        """The row with which the last chunk of the table, which may go on, begins."""
        same = np.ones(table.num_rows, bool)
        for c in ("conv_id", "chunk"):
            column = table[c].combine_chunks()
            null, value = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
            same &= (null == null[-1]) & (value == value[-1])
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    def chunks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = table["chunk"].combine_chunks().to_numpy()
        at = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
        for a, b in zip(at[:-1], at[1:], strict=True):
            found = _format(table.slice(a, b - a).drop_columns(["chunk"]))
            column = pa.array(np.full(found.num_rows, number[a]), pa.int64())
            yield pa.RecordBatch.from_arrays([found.column(0), column, *found.columns[1:]], names=["conv_id", "chunk", *found.schema.names[1:]])

    size, wait = 0, BUFFER
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= wait:
            table = pa.Table.from_batches(held)
            begin = ends_open(table)
            if begin:
                yield from chunks(table.slice(0, begin))
            held = table.slice(begin).to_batches()
            size = sum(b.nbytes for b in held)
            wait = max(BUFFER, 2 * size)  # a chunk is looked over as often as it doubles
    if held:
        yield from chunks(pa.Table.from_batches(held))


def _with_chunks(rows: DataFrame) -> DataFrame:
    """rows with the chunk of each: 0, but for conversations of more than CHUNK bytes.

    Those are sorted in ranges, and a row's chunk is the bytes before it over CHUNK: the bytes of the
    ranges before, one number each, and a running sum in the range.
    """
    weight = F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)) + len(START + SEP + END)
    long = rows.groupBy("conv_id").agg(F.sum(weight.cast("long")).alias("bytes")).where(F.col("bytes") > CHUNK)
    long = written(long.select(F.col("conv_id").alias("_long"), F.lit(True).alias("_is_long")))
    single = F.lit(0).cast("long").alias("chunk", metadata={"single": True})
    if long.isEmpty():
        return rows.select("*", single)
    # At most one for each CHUNK bytes; the rows of a long conversation are left where they are if it is broadcast.
    marked = rows.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left").drop("_long")
    short = marked.where("_is_long is null").drop("_is_long").withColumn("chunk", F.lit(0).cast("long"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("conv_id", "turn", "role")
    cut = marked.where("_is_long").drop("_is_long").withColumns({"_head": F.left("text", F.lit(64)), "_weight": weight.cast("long")})
    cut = cut.repartitionByRange(parts, *keys, "_head").sortWithinPartitions(*keys, "text").drop("_head")
    cut = written(cut.withColumn("_place", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_place", 33))
    totals = cut.groupBy("conv_id", "_range").agg(F.sum("_weight").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    totals = totals.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"), before.alias("_before"))
    cut = cut.join(totals, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_at")))
    running = F.sum("_weight").over(Window.partitionBy("conv_id", "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_weight")
    cut = cut.withColumn("chunk", F.floor((F.col("_before") + running) / CHUNK))
    return short.unionByName(cut.select(*short.columns))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, n_turns, formatted, loss_begin, loss_end) for each conversation of turns.

    turns has conv_id, turn, role and text (and any other columns); a conversation's rows are ordered by
    turn, a null turn first and ties by role and text. A conversation of more than CHUNK bytes has
    several rows, numbered by chunk, each with whole turns. loss_begin and loss_end are the code points
    of formatted between which the loss is taken: the escaped text of each assistant row. A null
    role or text is taken as empty; rows with a null conv_id are one conversation; repeated rows are
    repeated turns. An empty table gives an empty result.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.col(c).cast("string").alias(c) for c in ("role", "text")])
    rows = _with_chunks(rows)
    marks = rows.schema["chunk"].metadata
    ordered = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")
    found = map_arrow(ordered, _run, "conv_id long, chunk long, n_turns long, formatted string, loss_begin array<long>, loss_end array<long>")
    return found.withColumn("chunk", F.col("chunk").alias("chunk", metadata=marks))


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from the result of format_chats.

    Chunks of one conversation are read in order as a stream; a digest can only be computed so.
    """
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    if not formatted.schema["chunk"].metadata.get("single"):
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return map_arrow(formatted.select("conv_id", "chunk", "formatted", "loss_begin", "loss_end"), _digests, kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    conv, sums, state = None, [0, 0, 0], None

    def row() -> tuple:
        return conv, sums[0], state[0].hexdigest(), sums[1], state[1].hexdigest(), sums[2]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            conv_id, chunk, text, begin, end = (batch.column(c)[i].as_py() for c in ("conv_id", "chunk", "formatted", "loss_begin", "loss_end"))
            if state is None or chunk == 0 or conv_id != conv:
                if state is not None:
                    rows.append(row())
                conv, sums, state = conv_id, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
            for role, said in read_chat(text):
                sums[0] += 1
                state[0].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(begin, end, strict=True):
                learned = unescape(text[a:b])
                sums[1] += len(learned)
                state[1].update(learned.encode("utf-8", "surrogatepass"))
            sums[2] += len(text)
        if rows:
            yield table(rows)
    if state is not None:
        yield table([row()])
