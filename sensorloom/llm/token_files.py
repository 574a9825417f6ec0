"""Token ids in packed binary segments: written in order of the documents, read back by offset.

A segment is one binary value:

    bytes   0-3   b"TPK1"
    bytes   4-7   bits for an id; 8-11 ids in a block (both unsigned 32-bit, little-endian as all)
    bytes  12-19  number of documents; 20-27 number of ids (unsigned 64-bit)
    then          doc_id of each document (64-bit), one byte each that is 1 where it is null,
                  first id of each document and the end of the last (64-bit),
                  first byte of each block within the packed data and the end (64-bit),
                  the packed data, and 8 zero bytes

Ids of a block follow each other without gaps, lowest bit first, and a block begins at a whole byte.
So any id is found from its number alone, and a block is unpacked by one gather, shift and mask.
Segments are the rows of a Parquet table, which Spark writes and commits task by task on any file
system. Their columns (shard, segment, first_token, n_docs, n_tokens) say which segment holds a document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import give_back, map_arrow
from sensorloom.sources.scratch import scratch_folder

BLOCK_IDS = 8192
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 2_000_000
#: Characters of text for which one shard is planned, and the least and most shards.
SHARD_CHARS = 1_000_000
LEAST_SHARDS, MOST_SHARDS = 64, 16_384
#: Words whose ids a worker remembers, and the characters (or ids) of them all.
CACHE_WORDS, CACHE_CHARS = 300_000, 25_000_000
#: Text that is encoded together.
PIECE_BYTES = 1 << 20

MAGIC = b"TPK1"
#: Bits of an id that are whole numbers as they stand.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in bits each, lowest first. Eight of them fill bits whole bytes."""
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    rows = -(-len(ids) // 8)
    values = np.zeros((rows, 8), np.uint64)
    values.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, bits + 8), np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        shifted = values[:, j] << np.uint64(shift)
        for b in range((bits + shift + 7) // 8):
            out[:, at + b] |= (shifted >> np.uint64(8 * b)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: np.ndarray, first: int, count: int, bits: int) -> np.ndarray:
    """count ids from number first on, of data that goes on for 8 bytes after the last."""
    if bits in WHOLE:
        return np.ndarray((count,), WHOLE[bits], buffer=data, offset=first * bits // 8).astype(np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    windows = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    return ((windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class SegmentWriter:
    """Gathers documents in order and gives their segment."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids.append(ids)
        self.n_ids += len(ids)

    def payload(self) -> bytes:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint32)
        blocks = [pack(ids[x : x + BLOCK_IDS], self.bits) for x in range(0, len(ids), BLOCK_IDS)]
        head = MAGIC + np.array([self.bits, BLOCK_IDS], "<u4").tobytes() + np.array([len(self.docs), len(ids)], "<u8").tobytes()
        docs = np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs)
        starts = np.cumsum([0, *map(len, self.ids)]).astype("<u8").tobytes()
        offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes()
        return b"".join([head, docs, starts, offsets, *blocks, bytes(8)])


class Segment:
    """Random access to the documents of a segment."""

    def __init__(self, payload: bytes | memoryview) -> None:
        raw = np.frombuffer(payload, np.uint8)
        if raw[:4].tobytes() != MAGIC:
            raise ValueError("not a token segment")
        self.bits, self.block = (int(x) for x in raw[4:12].view("<u4"))
        n_docs, self.n_ids = (int(x) for x in raw[12:28].copy().view("<u8"))
        at = 28

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            part = raw[at : at + n * np.dtype(kind).itemsize].copy().view(kind)
            at += n * np.dtype(kind).itemsize
            return part

        self.doc_ids, self.nulls = take(n_docs, "<i8"), take(n_docs, "u1")
        self.starts = take(n_docs + 1, "<u8").astype(np.int64)
        self.offsets = take(-(-self.n_ids // self.block) + 1, "<u8").astype(np.int64)
        self.data = raw[at:]

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids first to end - 1, from the blocks that hold them only."""
        out = []
        while first < end:
            b = first // self.block
            stop = min(end, (b + 1) * self.block)
            out.append(unpack(self.data[self.offsets[b] : self.offsets[b + 1] + 8], first - b * self.block, stop - first, self.bits))
            first = stop
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


#: Words of letters that have one code point in either case, and what may follow: their ids are those of
#: the lower-case word and of the marks, if the tokenizer passes the probes.
_SIMPLE = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-þ]+)(?P<marks>[.,!|#$%&*]*)$"
_PROBES = (("Abc", ("abc",)), ("ÀÞø", ("àþø",)), ("one.", ("one", ".")), ("One,!|", ("one", ",!|")), ("Two three.", ("two", "three", ".")), ("one.$$$", ("one", ".$$$")), ("abc#$%&*.|", ("abc", "#$%&*.|")), (" a\n\nb ", ("a", "b")))


class Words:
    """Ids of the words met so far, in one array, and the place of each word in it.

    A text is encoded blank by blank, and words of letters by their lower-case letters and marks. Both
    is right for tokenizers that lower-case, split the marks from letters and end words by `</w>`; any
    other is found out by the probes and encodes whole texts.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_words = all(ids(text) == [i for part in parts for i in ids(part)] for text, parts in _PROBES)
        self.by_words &= all(ids(part) and self.ends[ids(part)[-1]] and self.ends[ids(part)].sum() == 1 for part in ("abc", "àþø", "three"))

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(2, np.int64)
        self.met = np.zeros(1, bool)  # again since the word was learned, or since room was last made
        self.chars = 0

    def _full(self, share: float = 1) -> bool:
        return len(self.place) > share * CACHE_WORDS or max(self.chars, len(self.ids)) > share * CACHE_CHARS

    def _make_room(self) -> None:
        """Forget the words not met again, or all where those met again leave too little room."""
        words, sizes = list(compress(self.place, self.met)), np.diff(self.starts)[self.met]
        begin = self.starts[:-1][self.met]
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)]
        self.forget()
        self._add(words, ids, sizes)
        if self._full(2 / 3):
            self.forget()

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.met = np.append(self.met, np.zeros(len(words), bool))
        self.chars += sum(map(len, words))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        # The fast form leaves out the places of tokens in their text.
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], letters: bool) -> None:
        """Add new words; words of letters are encoded as one text that is cut at the ends of words."""
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            if letters:
                own = np.array(self._ids([" ".join(part)])[0], np.uint32)
                cuts = np.flatnonzero(self.ends[own]) + 1
                if len(cuts) == len(part) and cuts[-1] == len(own):
                    ids.append(own)
                    sizes.append(np.diff(cuts, prepend=0))
                    continue
            each = self._ids(part)
            ids.append(np.array([i for x in each for i in x], np.uint32))
            sizes.append(np.array([len(x) for x in each], np.int64))
        if words:
            self._add(words, np.concatenate(ids), np.concatenate(sizes))

    def _places(self, words: pa.Array, letters: bool) -> np.ndarray:
        """The place of each word, new ones learned first; an empty or null word has none of its own."""
        coded = words.fill_null("").dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        place = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        self.met[place[place > 0]] = True
        n = len(self.place)
        self._learn([distinct[i] for i in new], letters)
        place[new] = np.arange(n, n + len(new))
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id behind it, and how many each has."""
        if not self.by_words:
            found = [[*ids, end_id] for ids in self._ids(texts.to_pylist())]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, _SIMPLE)
        simple = parts.is_valid()
        others = pc.if_else(simple, "", coded.dictionary)
        letters = self._places(pc.utf8_lower(parts.field("letters")).filter(simple), True)
        marks = self._places(parts.field("marks").filter(simple), False)
        pairs = np.zeros((len(coded.dictionary) + 1, 2), np.int64)
        pairs[:-1, 0] = self._places(others, False)
        at = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        pairs[at, 0], pairs[at, 1] = letters, marks
        # One more word, the end id, behind the words of each text.
        starts, ids = self.starts, np.append(self.ids, np.uint32(end_id))
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:] - offsets[0], len(pairs) - 1)
        pieces = pairs[codes]
        begin, size = starts[pieces], starts[pieces + 1] - starts[pieces]
        last = offsets[1:] - offsets[0] + np.arange(len(texts))  # where the end ids stand
        begin[last, 0], size[last, 0], size[last, 1] = len(self.ids), 1, 0
        begin, size = begin.reshape(-1), size.reshape(-1)
        done = np.cumsum(size)
        out = ids[np.arange(done[-1] if len(done) else 0) + np.repeat(begin - done + size, size)]
        total = done[2 * last + 1] if len(last) else np.empty(0, np.int64)
        if self._full():
            self._make_room()
        return out, np.diff(total, prepend=0)


@lru_cache(maxsize=2)
def _words(definition: str) -> Words:
    return Words(definition)


def encode_texts(definition: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with the end id behind each, and how many each text has; see Words."""
    return _words(definition).encode(texts.fill_null(""), end_id)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in parts of PIECE_BYTES of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done, at = np.append(0, np.cumsum(sizes)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(done, done[at] + PIECE_BYTES, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


class Shards:
    """Numbers of shards by ascending doc_id, null first.

    A doc_id that several shards' worth of rows share (a repeated bound, or null) has as many shards of
    its own; its rows are dealt over them by a checksum of their ids.
    """

    def __init__(self, bounds: list[int], nulls: int) -> None:
        self.bounds, self.times = np.unique(np.array(bounds, np.int64), return_counts=True)
        self.times[self.times == 1] = 0
        self.nulls = nulls if nulls > 1 else 0
        # The shards of null, those below the first bound, then of each bound its own and the rest.
        self.own = self.nulls + 1 + np.cumsum(self.times + 1) - (self.times + 1)

    def number(self, doc: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        null = doc.is_null().to_numpy(zero_copy_only=False)
        value = doc.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.bounds, value, side="right") - 1
        out = np.where(at >= 0, (self.own + self.times)[at], self.nulls) if len(self.bounds) else np.full(len(value), self.nulls)
        hot = (at >= 0) & (self.bounds[at] == value) & (self.times[at] > 0) & ~null if len(self.bounds) else np.zeros(len(value), bool)
        first, shares = np.where(null, 0, self.own[at] if len(self.own) else 0), np.where(null, self.nulls, self.times[at] if len(self.own) else 0)
        out[null] = 0
        for i in np.flatnonzero(hot | (null & (self.nulls > 0))):
            out[i] = first[i] + (zlib.crc32(ids[ends[i] : ends[i + 1]]) * int(shares[i]) >> 32)
        return out.astype(np.int64)


def _encode(definition: Broadcast, end_id: int, shards: Shards, wide: bool):
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary())])
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                ids, sizes = encode_texts(definition.value, batch.column(1), end_id)
                doc = batch.column(0)
                ends = np.append(0, np.cumsum(sizes))
                shard = shards.number(doc, ids, ends)
                ends = ends * kind.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([pa.array(shard), doc, pa.array(sizes), data.cast(pa.binary())], names=schema.names)

    return run, "shard long, doc_id long, n_tokens long, ids binary"


def _segments(bits: int, wide: bool):
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("first_token", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker may have encoded texts before: what it remembers of words is of no use here.
        _words.cache_clear()
        give_back()
        shard, segment, first, writer = None, 0, 0, SegmentWriter(bits)

        def row() -> pa.RecordBatch:
            values = [shard, segment, first, len(writer.docs), writer.n_ids, writer.payload()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        for batch in batches:
            shards, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, doc, ids in zip(shards, docs, batch.column(3), strict=True):
                if writer.docs and (s != shard or writer.n_ids >= SEGMENT_IDS):
                    yield row()
                    segment, first, writer = segment + 1, first + writer.n_ids, SegmentWriter(bits)
                if s != shard:
                    shard, segment, first = s, 0, 0
                writer.add(doc, np.frombuffer(ids.as_buffer(), kind).astype(np.uint32))
        if writer.docs:
            yield row()

    return run, "shard long, segment long, first_token long, n_docs long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1) -> None:
    """Write the ids of every text of docs (doc_id, text) as segments at path, in ascending doc_id order.

    The tokenizer is read from tokenizer_file by the driver. One that lower-cases, splits marks from
    letters and ends words by `</w>` encodes distinct words, any other whole texts. A null text is taken as empty and gives the end id alone. Rows without doc_id come
    first; rows that share a doc_id follow each other, ordered by their ids, or first by a checksum of
    them where so many share it that they take several shards. An empty table gives a table without rows. Columns other than doc_id and text are left out.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    definition = open(tokenizer_file, encoding="utf-8").read()
    vocabulary = max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1)
    bits, wide = bits_for(vocabulary), vocabulary > 2**16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars, low, n, some = rows.agg(F.sum(F.length("text")), F.min("doc_id"), F.count(F.lit(1)), F.count("doc_id")).first()
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, int((chars or 0) / SHARD_CHARS)))
    bounds: list[int] = []
    if low is not None:
        shares = [i / shards for i in range(1, shards)]
        bounds = rows.agg(F.percentile_approx("doc_id", shares, 20 * shards)).first()[0]
    dealt = Shards(bounds, (n - some) * shards // n if n else 0)
    encoded = map_arrow(rows, *_encode(spark.sparkContext.broadcast(definition), end_id, dealt, wide))
    ordered = encoded.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "ids")
    map_arrow(ordered, *_segments(bits, wide)).write.mode("errorifexists").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for start, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            segment = Segment(value.as_buffer())
            for at in range(0, len(segment.doc_ids), 500):
                part = range(at, min(at + 500, len(segment.doc_ids)))
                ids = [segment.document(i) for i in part]
                doc = pa.array(segment.doc_ids[at : at + 500], mask=segment.nulls[at : at + 500].astype(bool))
                first = pa.array(segment.starts[at : at + len(part)] + start)
                data = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([doc, first, pa.array([len(x) for x in ids], pa.int64()), data], schema=schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of the segments at path.

    start counts the ids of all documents before it, ids are unsigned 32-bit little-endian numbers.
    """
    segments = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard, MOST_SHARDS at most
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(starts), "shard").select((F.col("base") + F.col("first_token")).alias("start"), "payload")
    return map_arrow(placed, _documents, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write docs to segments in the shared folder and read them back; see write_tokens and read_tokens."""
    path = scratch_folder(docs.sparkSession)
    write_tokens(docs, tokenizer_file, path, end_id)
    return read_tokens(docs.sparkSession, path)
