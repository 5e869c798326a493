"""Token ids in binary files of patched frame-of-reference blocks.

A file is a Parquet table whose rows are *segments*: whole documents, in ascending
order of doc_id, until a segment has ``SEGMENT`` ids. (Parquet is the container
because Spark commits it atomically on any store; the ids themselves are one
binary value per segment.) The value of a segment, all little-endian:

    uint32 ids, uint32 blocks, then per block 16 bytes of index:
        uint32 start of the block's body, uint32 minimum, uint16 ids, uint8 width,
        uint8 unused, uint32 exceptions
    then the bodies: ids - minimum packed at width bits, padded to a byte; then the
    exceptions' places (uint16) and the bits above the width (uint32).

The width is that of the block's ``QUANTILE`` of (id - minimum), so outliers do not
widen a block; they are the exceptions. Columns beside it hold shard, segment, start
(ids of all documents before the segment), and the documents' ids and lengths.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockloom.llm.nbest import gathered
from stockloom.llm.words import encoder

BLOCK, SEGMENT, QUANTILE = 4096, 1 << 18, 0.9
#: Words whose ids a worker keeps; more are tokenized anew.
KEPT = 1_000_000
INDEX = np.dtype([("start", "<u4"), ("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("unused", "u1"), ("exceptions", "<u4")])


def _cell(width: int) -> int:
    """Bytes of the integers that bits are cut from."""
    return 2 if width <= 16 else 4


def pack_block(values: np.ndarray) -> tuple[tuple[int, int, int, int], bytes]:
    """(minimum, ids, width, exceptions) and body of one block of up to ``BLOCK`` ids."""
    low = int(values.min())
    rest = (values - np.uint32(low)).astype("<u4")
    k = int(np.ceil(QUANTILE * len(rest))) - 1
    width = int(np.partition(rest, k)[k]).bit_length()
    cell = _cell(width)
    bits = np.unpackbits(rest.astype(f"<u{cell}").view(np.uint8).reshape(-1, cell), axis=1, bitorder="little")[:, :width]
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    at = np.flatnonzero(high)
    body = np.packbits(bits.ravel(), bitorder="little").tobytes() + at.astype("<u2").tobytes() + high[at].astype("<u4").tobytes()
    return (low, len(rest), width, len(at)), body


def pack(ids: np.ndarray) -> bytes:
    """The binary value of a segment."""
    blocks = [pack_block(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    index = np.zeros(len(blocks), INDEX)
    start = 8 + index.nbytes
    for row, ((low, n, width, exceptions), body) in zip(index, blocks):
        row["start"], row["low"], row["n"], row["width"], row["exceptions"] = start, low, n, width, exceptions
        start += len(body)
    return np.array([len(ids), len(blocks)], "<u4").tobytes() + index.tobytes() + b"".join(body for _, body in blocks)


def unpack_block(value: bytes, row: np.void) -> np.ndarray:
    """Ids of one block; nothing else of the value is read."""
    n, width, start = int(row["n"]), int(row["width"]), int(row["start"])
    size = (n * width + 7) // 8
    out = np.zeros(-(-n // 8) * 8, "<u4")
    if width:  # eight ids take ``width`` bytes; the k-th of each eight starts at the same bit
        packed = value[start:start + size] + bytes(width + 8)
        for k in range(8):
            byte, bit = divmod(k * width, 8)
            near = np.ndarray(len(out) // 8, "<u8", packed, byte, (width,))
            out[k::8] = near >> np.uint64(bit) & np.uint64((1 << width) - 1)
    out = out[:n]
    if k := int(row["exceptions"]):
        at = np.frombuffer(value, "<u2", k, start + size)
        out[at] |= np.frombuffer(value, "<u4", k, start + size + 2 * k) << np.uint32(width)
    return out + row["low"]


def block_index(value: bytes) -> np.ndarray:
    return np.frombuffer(value, INDEX, int(np.frombuffer(value, "<u4", 1, 4)[0]), 8)


def unpack(value: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of a segment, from the blocks that hold them."""
    last = int(np.frombuffer(value, "<u4", 1)[0]) if last is None else last
    if last <= first:
        return np.empty(0, np.uint32)
    index = block_index(value)
    near = range(first // BLOCK, (last - 1) // BLOCK + 1)
    return np.concatenate([unpack_block(value, index[b]) for b in near])[first - near[0] * BLOCK:last - near[0] * BLOCK]


#: The byte-level pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
TOUCHING = ("  ", " \n", "\n ", "\n\n")
START = "\x00"


class Words(dict):
    """Numbers of words (with the space or line feed before them), and by number their ids from the tokenizer's model."""

    def __init__(self, tokenizer: Tokenizer, letters: dict[int, str]):
        super().__init__()
        self.tokenizer, self.letters = tokenizer, letters
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.ids, self.first = array("I"), array("q", [0])
        self.parts: dict[str, int] = {}  # the same for what the pre-tokenizer cuts words into
        self.part_ids, self.part_first = array("I"), array("q", [0])

    def _part(self, part: str) -> int:
        shown = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        self.part_ids.extend([t.id for t in self.tokenizer.model.tokenize(shown)])
        self.part_first.append(len(self.part_ids))
        self.parts[part] = n = len(self.part_first) - 2
        return n

    def __missing__(self, word: str) -> int:
        own = word[1:] if word[:1] == START else word if word[:1] == "\n" else " " + word
        for part in [own] if own[1:].isalpha() and own[0] == " " else PATTERN.findall(own):
            k = self.parts.get(part)
            if k is None:
                k = self._part(part)
            self.ids.extend(self.part_ids[self.part_first[k]:self.part_first[k + 1]])
        self.first.append(len(self.ids))
        self[word] = len(self.first) - 2
        return self[word]

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``, without special tokens.

        Where spaces and line feeds do not touch, no token crosses the place
        before one, so the text is looked up word by word. A text with other white space
        (it counts as not printable, as some rare signs do), or with some that touches
        or ends it, is encoded as a whole; so is one with the string of an added token.
        """
        if any(t in text for t in self.added) or any(t in text for t in TOUCHING) or text[-1:] in ("", " ") or not text.replace("\n", "").isprintable():
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > KEPT:
            self._empty()
        words = text.replace("\n", " \n").split(" ")
        words[0] = START + words[0]
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        first = np.frombuffer(self.first, np.int64)
        ids = gathered(np.frombuffer(self.ids, np.uint32), first[n], first[n + 1] - first[n])
        del first
        return ids


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _words(model: str) -> Words:
    return Words(Tokenizer.from_str(model), _byte_letters())


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id``, and write segments to ``path``.

    Documents are range-partitioned by doc_id, nulls first; equal doc_ids are in the
    order of their texts' hashes, and repeated rows all stay, so one hot id is cut
    as well. A null or empty text has the end id only. ``tokenizer_path`` is a
    byte-level BPE file, read by the driver only.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, segment, first = encoder(model.value), TaskContext.get().partitionId(), 0, 0
        docs_now, ids_now, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(ids_now)
            columns = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                       pa.array([docs_now], pa.list_(pa.int64())), pa.array([list(map(len, ids_now))], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "first", "n_ids", "doc_ids", "lengths", "value"])

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for low, found, ends in coder.encode(b.column("text")):
                for doc_id, own in zip(doc_ids[low:low + len(ends)], np.split(found, ends[:-1])):
                    docs_now.append(doc_id)
                    ids_now.append(np.append(own, np.uint32(end_id)))
                    size += len(own) + 1
                    if size >= SEGMENT:
                        yield flush()
                        segment, first, docs_now, ids_now, size = segment + 1, first + size, [], [], 0
        if docs_now:
            yield flush()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(run, "shard int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, value binary").write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of ``path`` with start: ids of all documents before. Shards without a row have no documents."""
    found = spark.read.parquet(path)
    shards = found.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    # One row for each task that wrote a file.
    return found.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of ``path``: doc_id, start, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, ids in _documents(batches):
            columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids"])

    return segments(spark, path).select("start", "doc_ids", "lengths", "value").mapInArrow(run, "doc_id long, start long, ids array<int>")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    for b in batches:
        for i in range(b.num_rows):
            lengths = np.array(b.column("lengths")[i].as_py(), np.int64)
            ends = np.cumsum(lengths)
            ids = unpack(b.column("value")[i].as_py())
            yield b.column("doc_ids")[i].as_py(), b.column("start")[i].as_py() + ends - lengths, np.split(ids, ends[:-1])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of ``path``: doc_id, start, n_tokens, ids_crc32 (its ids as little-endian 32-bit integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, ids in _documents(batches):
            columns = [doc_ids, starts, list(map(len, ids)), [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments(spark, path).select("start", "doc_ids", "lengths", "value").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
