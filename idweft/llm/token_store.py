"""Token ids on disk: shards of separately compressed documents with a shared dictionary.

A zstandard dictionary is trained once on serialized id arrays of a bounded sample. Every
document's ids are compressed on their own with it, so that short ones shrink too and any
one can be read alone. A shard is one binary value:

    magic "IDTS" | version | width of an id in bytes | 0 0
    dictionary hash (8 bytes) | number of documents n | length of the keys
    n + 1 payload offsets | n token counts | keys (JSON list) | payload

All numbers are little-endian (offsets and counts 64-bit). Shards are rows of a Parquet
table, which Spark writes to and reads from any store; the dictionary is its own small table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from idweft.llm.storage import new_path

MAGIC, HEAD = b"IDTS", struct.Struct("<4sBBxx8sQQ")
#: Documents and bytes of their ids that the dictionary is trained on at most, and its size.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES, DICTIONARY_BYTES = 512, 4_096, 32_768
#: Pieces that an array of more bytes is sampled by, from its start to its end.
SAMPLE_PIECES = 8
#: The least size that the library's trainer takes.
LEAST_TRAINED = 256
#: A shard is closed once it holds this many bytes of ids before compression.
SHARD_BYTES = 1 << 20
#: Distinct words of a generation that a Python worker remembers, some 200 bytes each.
REMEMBERED = 500_000

#: One thread for each Python worker: Spark's tasks are the parallel ones.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_encoders: dict[str, WordEncoder] = {}


#: A word of Latin letters, as lower case leaves it, and ASCII marks after it.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes every byte as a printable character: the others count up from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder:
    """Encodes texts word by word, and asks the library for each distinct word once.

    This tokenizer drops white space and its pre-tokens never reach across it, so a text's
    ids are its words' ids in order. A word of Latin letters is one pre-token, already in
    the form that normalizing gives once it is lower case, and goes to the library's model
    directly; marks after it are one more pre-token. Any other word takes the whole way.
    Two generations of words are remembered, so frequent ones stay. With ``special_as_text``
    a literal <|endoftext|> is ordinary pieces; without, as the library has it, its special id.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text.lower())
        if not plain:
            return self._whole(text)
        core, marks = plain.groups()
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(core)]).tobytes()
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[marks] = self._whole(marks)
        return ids + self.marks[marks]

    def encode(self, data: bytes) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        words = data.split()
        missing = set(words).difference(self.known)
        if missing:
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
                missing = set(words)
            older = self.older
            for word in missing:
                self.known[word] = older[word] if word in older else self._word(word)
        return b"".join(map(self.known.__getitem__, words))


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file with the library's defaults, kept in each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, special_as_text=False)
    return _encoders[path]


def train_dictionary(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, end_id: int = 1, width: int = 2) -> bytes:
    """A dictionary for serialized ids; empty only where there is no document with an id.

    The sample is the ``sample_docs`` documents of smallest id hash, each up to
    ``SAMPLE_TEXT_BYTES`` of ids from all over it, so what reaches the driver is bounded.
    Where the library can train nothing from it, the sampled ids themselves are the
    dictionary, as zstandard allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = word_encoder(vocabulary)
            ids = [spread(_packed(encoder.encode(x or b""), end_id, width), width) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.binary()))], ["ids"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("data"))
    few = rows.filter("doc_key is not null").select("doc_key").orderBy(F.xxhash64("doc_key"), "doc_key").limit(sample_docs).distinct()  # ids only, so that no task gathers texts
    sample = rows.join(F.broadcast(few), "doc_key", "left_semi").select("data").mapInArrow(run, "ids array<binary>").limit(sample_docs)
    parts = sorted(bytes(x) for r in sample.collect() for x in r[0])
    size = min(DICTIONARY_BYTES, sum(map(len, parts)) // 4)
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if size >= LEAST_TRAINED else raw_dictionary(parts)
    except zstandard.ZstdError:  # too few ids, or nothing that they have in common
        return raw_dictionary(parts)


def raw_dictionary(parts: list[bytes]) -> bytes:
    """The ids of a sample as a dictionary without entropy tables."""
    return b"".join(parts)[:DICTIONARY_BYTES]


def spread(ids: bytes, width: int) -> list[bytes]:
    """``ids`` whole, or where they are too long, pieces at even distances with the first and last id."""
    if len(ids) <= SAMPLE_TEXT_BYTES:
        return [ids]
    size = SAMPLE_TEXT_BYTES // SAMPLE_PIECES
    starts = [(len(ids) - size) // width * i // (SAMPLE_PIECES - 1) * width for i in range(SAMPLE_PIECES)]
    return [ids[s : s + size] for s in starts]


def _packed(ids: bytes, end_id: int, width: int) -> bytes:
    if width == 4:
        return ids + struct.pack("<I", end_id)
    return np.append(np.frombuffer(ids, "<u4"), end_id).astype("<u2").tobytes()


def pack_shard(docs: list[tuple[object, bytes]], dictionary: bytes, compressor, width: int) -> bytes:
    """One shard from (key, serialized ids) in order."""
    payload = [compressor.compress(ids) for _, ids in docs]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payload])]).astype("<u8")
    counts = np.asarray([len(ids) // width for _, ids in docs], "<u8")
    keys = json.dumps([k for k, _ in docs]).encode()
    return b"".join([HEAD.pack(MAGIC, 1, width, dictionary_hash(dictionary), len(docs), len(keys)), offsets.tobytes(), counts.tobytes(), keys, *payload])


def dictionary_hash(dictionary: bytes) -> bytes:
    return xxhash.xxh3_64_digest(dictionary)


class Shard:
    """Reads a shard: all documents, or one by its place without touching the others."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, used, n, keys = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        if used != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        at = HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n + 1, at)
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * (n + 1))
        at += 8 * (2 * n + 1)
        self.keys = json.loads(data[at : at + keys])
        self.payload = memoryview(data)[at + keys :]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, place: int) -> np.ndarray:
        part = self.payload[int(self.offsets[place]) : int(self.offsets[place + 1])]
        return np.frombuffer(self.decompressor.decompress(part), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, level: int = 3, shard_bytes: int = SHARD_BYTES, partitions: int | None = None) -> str:
    """Encodes every text, appends ``end_id``, and writes shards in ascending id order.

    Literal special tokens get their ids, as in the library's ``encode``.
    A null text counts as empty and gives the end id alone. Null ids come first; rows with
    equal ids are ordered by their text, so equal rows are interchangeable. Texts are dealt
    by ranges of the id before they are encoded, each partition sorted on its own.
    Returns the folder, under ``path`` or the session's shared folder.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    width = 2 if word_encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary, id_col, text_col, end_id=end_id, width=width)
    spark.createDataFrame([(dictionary, dictionary_hash(dictionary))], "dictionary binary, hash binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        held, size, no = [], 0, 0

        def shard():
            tokens = sum(len(x) for _, x in held) // width
            return pa.RecordBatch.from_pydict({"part": [part], "no": [no], "n_docs": [len(held)], "n_tokens": [tokens], "content": [pack_shard(held, dictionary, compressor, width)]}, schema=pa.schema([("part", pa.int32()), ("no", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())]))

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((key, _packed(encoder.encode(data or b""), end_id, width)))
                size += len(held[-1][1])
                if size >= shard_bytes:
                    yield shard()
                    held, size, no = [], 0, no + 1
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("data"))
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(count, F.col("doc_key").asc_nulls_first()).sortWithinPartitions(F.col("doc_key").asc_nulls_first(), "data")
    dealt.mapInArrow(run, "part int, no int, n_docs long, n_tokens long, content binary").write.parquet(f"{path}/shards")
    return path


def read(spark: SparkSession, path: str, id_type: str = "long", digests: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (binary), or ``ids_crc32`` with ``digests``.

    ``start`` is the number of ids of all documents before this one. Totals of partitions
    and shards are summed first; both are tables of sizes only.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shards = spark.read.parquet(f"{path}/shards")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), zero).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("no"))), zero)
    bases = shards.select("part", "no", inside.alias("inside")).join(parts, "part").select("part", "no", (F.col("before") + F.col("inside")).alias("base"))
    last = ("ids_crc32", T.LongType(), pa.int64()) if digests else ("ids", T.BinaryType(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py(), dictionary)
                counts = shard.counts.astype(np.int64)
                starts = base + np.concatenate([[0], np.cumsum(counts)[:-1]])
                raw = (shard.ids(i).tobytes() for i in range(len(counts)))
                values = [zlib.crc32(x) for x in raw] if digests else list(raw)
                keys = pa.array([None if k is None else str(k) for k in shard.keys], pa.string())
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(counts), pa.array(values, last[2])], ["doc_id", "start", "n_tokens", last[0]])

    schema = T.StructType().add("doc_id", "string").add("start", "long").add("n_tokens", "long").add(last[0], last[1])
    based = shards.join(bases, ["part", "no"]).select("base", "content")
    return based.mapInArrow(run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))
