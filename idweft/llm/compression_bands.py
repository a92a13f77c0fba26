"""Quality rules by compression: zstandard ratios of whole documents and fixed chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.llm.words import Rolling, covered, word_hashes

#: (bytes from, lowest ratio, highest ratio): plain size over compressed size at level 3.
#: Short texts hardly compress, so what is usual rises with length. Up to 1,000 bytes the
#: limits leave a margin around labelled good text. From there the upper ones are set on
#: licenses, manuals and release notes, whose ratio rises up to 4.2 at 512 KB; they only
#: stop gross repetition, and the chunks, whose ratio does not rise, judge a long text.
WHOLE_BANDS = ((0, 0.60, 1.60), (100, 0.95, 2.20), (300, 1.25, 2.20), (1_000, 1.55, 2.60), (3_000, 1.80, 3.10), (10_000, 1.95, 3.50), (40_000, 2.0, 4.0), (160_000, 2.0, 4.6), (640_000, 2.0, 6.0))
#: The same for chunks, which are one length but for the last: wider, as a chunk varies more.
CHUNK_BANDS = ((0, 0.50, 2.5), (100, 0.80, 3.2), (300, 1.10, 3.2), (1_000, 1.40, 3.2), (3_000, 1.60, 3.2))
CHUNK_BYTES = 4_096
#: (bytes from, share of marks, bytes that one mark adds): ASCII punctuation that is more than this
#: share of a text and adds less than so many compressed bytes each is repeated for nothing. Marks
#: of prose are 2 to 5 % and add some 0.8; manuals in markup of some length hold up to 12 % cheap ones.
MARK_BANDS = ((0, 1.0, 0.0), (300, 0.08, 0.5), (4_096, 0.15, 0.5))
#: A document goes when more than this share of its chunks is out of band.
BAD_CHUNKS = 0.25
SYMBOLS = b"#*$%&|<>"


def in_band(size: int, ratio: float, bands=WHOLE_BANDS) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(bands) if size >= least)
    return low <= ratio <= high


def ratios(data: bytes, compressor: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole text, and (size, ratio) of each fixed chunk."""

    def ratio(part: bytes) -> float:
        return len(part) / len(compressor.compress(part)) if part else 1.0

    if len(data) <= chunk_bytes:
        whole = ratio(data)
        return whole, [(len(data), whole)]
    chunks = [data[i : i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
    return ratio(data), [(len(c), ratio(c)) for c in chunks]


_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def marks(data: bytes, whole: float, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Share of marks in a text, and the compressed bytes that each adds (0 without any).

    ``whole`` is the ratio of the text: its compressed size less that of the text without marks.
    """
    plain = data.translate(None, _MARKS)
    n = len(data) - len(plain)
    if not n:
        return 0.0, 0.0
    return n / len(data), (len(data) / whole - len(compressor.compress(plain))) / n


def marks_in_band(size: int, share: float, cost: float, bands=MARK_BANDS) -> bool:
    most, least = next((a, b) for low, a, b in reversed(bands) if size >= low)
    return share < most or cost >= least


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that the text holds twice or more."""
    if len(words) <= size:
        return 0
    grams = Rolling(word_hashes(words)).windows(size)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(covered(np.flatnonzero(twice), size, len(words)).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = Counter(x for x in data.split(b"\n") if x and not x.isspace())
    return sum(lines.values()) - len(lines)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_bands=WHOLE_BANDS, chunk_bands=CHUNK_BANDS, chunk_bytes: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS, level: int = 3, mark_bands=MARK_BANDS) -> DataFrame:
    """Counts, ratios and the verdict for every document, in one pass without a shuffle.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` long, ``base_failed``
    boolean, ``ratio`` double of the whole text, ``chunk_low, chunk_high`` double over the
    chunks, ``mark_share, mark_cost`` double (see :func:`marks`), ``in_bands`` boolean, ``kept``
    boolean (false if ``base_failed``).
    A null or empty text has no words: it fails the base rule, its ratio is 1. Null, tied
    and repeated ids are passed through row by row; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                data = data or b""
                words = data.split()
                repeat = repeated_words(words)
                whole, chunks = ratios(data, compressor, chunk_bytes)
                failed = len(words) < 10 or 100 * repeat > 20 * len(words)
                bad = sum(not in_band(n, r, chunk_bands) for n, r in chunks)
                share, cost = marks(data, whole, compressor)
                good = in_band(len(data), whole, whole_bands) and bad <= bad_chunks * len(chunks) and marks_in_band(len(data), share, cost, mark_bands)
                # a code point has one byte that is not 10xxxxxx
                chars = int((np.frombuffer(b"".join(words), np.int8) >= -64).sum())
                out.append((len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), duplicate_lines(data), repeat, failed, whole, min(r for _, r in chunks), max(r for _, r in chunks), share, cost, good, good and not failed))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            arrays = [pa.array(list(c), to_arrow[k]) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    fields = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("ratio", "double"), ("chunk_low", "double"), ("chunk_high", "double"), ("mark_share", "double"), ("mark_cost", "double"), ("in_bands", "boolean"), ("kept", "boolean")]
    kinds = [k for _, k in fields]
    names = ["doc_key", *(n for n, _ in fields)]
    to_arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("data"))
    schema = T.StructType([T.StructField("doc_key", rows.schema[0].dataType)])
    for name, kind in fields:
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_key", id_col)
