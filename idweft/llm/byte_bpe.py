"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file whose path is a parameter. Long texts are cut before
encoding, only where no match of the pattern can reach across the cut: before white space
that follows anything else, and before a mark that follows a letter or digit. A long run of
white space is one match of the pattern (but for its last character, where more text
follows), and is merged without asking the pattern, whose lookahead would exhaust its stack.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.llm.words import slices

#: Texts of more characters than this are cut into pieces of about this many.
PIECE_CHARS = 65_536
#: What the pattern's \s matches.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits, and marks, that every version of Unicode classes alike.
_LETTER = r"0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = r"!-/:-@\[-`{-~\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
#: Places at which every match of the pattern ends.
SAFE_CUT = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{_LETTER}])(?=[{_MARK}])")
#: Runs of white space from this length on are merged on their own.
LONG_RUN = 8_192
_LONG = re.compile(rf"[{SPACE}]{{{LONG_RUN},}}")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """The encoding of a rank file, and one that takes what it is given as a single match."""

    def __init__(self, rank_path: str, pattern: str):
        self.rank_path = rank_path
        self.split = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_ranks(rank_path), special_tokens={})

    @cached_property
    def whole(self) -> tiktoken.Encoding:
        """Made when a text first needs it, as it has tables of its own."""
        return tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(self.rank_path), special_tokens={})

    def ids(self, text: str) -> list[int]:
        """The ids of a text of any content."""
        if len(text) < LONG_RUN or not (run := _LONG.search(text)):
            return self.split.encode_ordinary(text)
        out, at = [], 0
        while run:
            end = run.end() - (run.end() < len(text))  # the last one may join what follows
            out += self.split.encode_ordinary(text[at : run.start()]) + self.whole.encode_ordinary(text[run.start() : end])
            at, run = end, _LONG.search(text, run.end())
        return out + self.split.encode_ordinary(text[at:])

    def text_bytes(self, ids) -> bytes:
        return self.split.decode_bytes(ids)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoding(rank_path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, read once in each Python worker."""
    if (rank_path, pattern) not in _encoders:
        _encoders[rank_path, pattern] = Encoder(rank_path, pattern)
    return _encoders[rank_path, pattern]


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """The text in order, cut at safe places only; a stretch without one stays whole."""
    start = 0
    while len(text) - start > piece_chars:
        cut = SAFE_CUT.search(text, start + piece_chars)
        if not cut or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: Encoder, text: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    """All ids of a text as little-endian unsigned 32-bit integers."""
    if len(text) <= piece_chars:
        return np.asarray(enc.ids(text), "<u4")
    return np.concatenate([np.asarray(enc.ids(p), "<u4") for p in safe_pieces(text, piece_chars)])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document: ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit).

    A null text counts as empty and gives no ids. Null, tied and repeated ids are passed
    through row by row; other columns are left out. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in slices(batches):
            ids = pa.array([encode_text(enc, t or "", piece_chars).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_key", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_key", rows.schema[0].dataType), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_key", id_col)


def decoder(rank_path: str, pattern: str):
    """A Column function from ``ids`` to the raw bytes that they stand for (binary)."""

    @F.pandas_udf(T.BinaryType())
    def decode(ids):
        enc = encoding(rank_path, pattern)
        return ids.map(lambda x: enc.text_bytes(np.frombuffer(x, "<u4").tolist()))

    return decode


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Encodes, decodes the ids, and keeps digests only, so that no array crosses to the JVM.

    ``id_col``, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` string.
    Nulls and ties as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in slices(batches):
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(enc, text or "", piece_chars)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.text_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_key", rows.schema[0].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_key", id_col)
