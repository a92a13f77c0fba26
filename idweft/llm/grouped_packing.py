"""Packing of token pieces into sequences of fixed capacity by linear grouping.

Lengths are whole numbers up to the capacity, so their histogram is small whatever the table,
and a packing is planned on the histogram alone (Fernandez de la Vega and Lueker's scheme):

* lengths above a limit (the best of a few) are sorted and cut into groups of equal cardinality, and count as the
  longest of their group;
* for these few sizes the best mix of configurations (which sizes share a sequence) is a
  linear program; column generation finds the configurations, a knapsack at a time, and the
  whole part of each count is used;
* the actual lengths take the places of the rounded ones, which leaves room behind them;
* all other lengths, the longest first, go by best fit: into the fullest sequences that have
  room, or into new ones.

Sequences that hold the same lengths are one range of the plan, and so are the pieces of one
length that go there, by rank. Spark ranks the pieces of each length (a count for each task
that encoded them, summed up, and the place among its own) and looks the rank up in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from idweft.llm.byte_bpe import LONG_RUN, Encoder, encode_text
from idweft.llm.storage import written
from idweft.llm.words import slices

CAPACITY = 1_024
#: Groups of equal cardinality, and the parts of the capacity above which a length may count as large.
GROUPS, LARGE = 96, (1 / 2, 1 / 3, 1 / 16)


# ---- the plan


def groups_of(counts: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """Lengths in groups of equal cardinality, longest first: (size that all count as, lengths and counts)."""
    total, out, seen = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            number = seen * groups // total
            take = min(left, -(-(number + 1) * total // groups) - seen)
            if not out or out[-1][0] != number:
                out.append((number, length, {}))
            out[-1][2][length] = out[-1][2].get(length, 0) + take
            seen, left = seen + take, left - take
    return [(size, members) for _, size, members in out]


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the worth within the capacity is greatest."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")  # sizes ascending
    for c in range(int(sizes[0]), capacity + 1):
        n = fits[c]
        values = best[c - sizes[:n]] + worth[:n]
        i = int(values.argmax())
        best[c], taken[c] = (values[i], i) if values[i] > best[c - 1] else (best[c - 1], -2)
    out, c = np.zeros(len(sizes)), capacity
    while c > 0 and taken[c] != -1:
        if taken[c] == -2:
            c -= 1
        else:
            out[taken[c]] += 1
            c -= int(sizes[taken[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2_000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, for ascending sizes with a demand each.

    The linear program: fewest sequences that together hold the demand. Every round brings in
    the configuration of greatest worth at present prices, until none is worth more than a sequence.
    """
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    used = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        column = knapsack(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-9:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        used -= ratio[out] * change
        used[out] = ratio[out]
        used = np.maximum(used, 0)
        columns[:, out] = column
    return [(columns[:, i].astype(int), float(used[i])) for i in range(len(sizes))]


class Plan:
    """Ranges of sequences that hold the same lengths, filled by moves.

    A move ``(length, rank, n, sequence, per, offset)`` puts the n pieces of a length from a
    rank on into sequences from ``sequence`` on, ``per`` into each, from ``offset`` on.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE[-1]):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c}
        self.rank = dict.fromkeys(self.left, 0)
        self.moves: list[tuple[int, int, int, int, int, int]] = []
        self.n_sequences = 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: ranges (first, count)
        big = {n: c for n, c in self.left.items() if n > large * capacity}
        if big:
            self._configure(groups_of(big, groups))
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _move(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.moves.append((length, self.rank[length], n, sequence, per, offset))
        self.rank[length] += n
        self.left[length] -= n

    def _configure(self, grouped) -> None:
        sizes = sorted({size for size, _ in grouped})
        members: dict[int, list[list[int]]] = {s: [] for s in sizes}
        for size, lengths in grouped:
            members[size] += [[n, c] for n, c in lengths.items()]
        demand = np.array([float(sum(c for _, c in members[s])) for s in sizes])
        for column, times in sorted(configurations(np.array(sizes), demand, self.capacity), key=lambda x: -x[1]):
            count = int(times + 1e-6)
            if not count:
                continue
            ranges = [(self.n_sequences, count, 0)]  # first, count, used
            self.n_sequences += count
            for size, copies in zip(reversed(sizes), reversed(column.tolist()), strict=True):
                for _ in range(copies):
                    ranges = self._substitute(ranges, members[size])
            for first, n, used in ranges:
                self.room[self.capacity - used].append((first, n))

    def _substitute(self, ranges, stock: list[list[int]]):
        """One piece of a group for each sequence of the ranges, its longest first, while there are any."""
        out = []
        for first, count, used in ranges:
            while count and stock:
                length, have = stock[0]
                n = min(count, have)
                self._move(length, n, first, 1, used)
                out.append((first, n, used + length))
                first, count = first + n, count - n
                stock[0][1] -= n
                if not stock[0][1]:
                    stock.pop(0)
            if count:
                out.append((first, count, used))
        return out

    def _best_fit(self, length: int) -> None:
        for free in range(length, self.capacity + 1):
            ranges, self.room[free] = self.room[free], []
            per = free // length
            for first, count in ranges:
                full = min(count, self.left[length] // per)
                if full:
                    self._move(length, full * per, first, per, self.capacity - free)
                    self.room[free - per * length].append((first, full))
                    first, count = first + full, count - full
                some = self.left[length] if count and self.left[length] < per else 0
                if some:
                    self._move(length, some, first, some, self.capacity - free)
                    self.room[free - some * length].append((first, 1))
                    first, count = first + 1, count - 1
                if count:
                    self.room[free].append((first, count))
            if not self.left[length]:
                return
        per = self.capacity // length
        for n in (self.left[length] // per * per, self.left[length] % per):
            if n:
                each = min(n, per)
                self.room[self.capacity - each * length].append((self.n_sequences, n // each))
                self._move(length, n, self.n_sequences, each, 0)
                self.n_sequences += n // each


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> Plan:
    """The plan with fewest sequences among those for each limit of what is large, the first of equal ones.

    A low limit is for mixes that have to be combined with care; where there are few small
    pieces to fill the room that rounding leaves, a high one loses less.
    """
    return min((Plan(counts, capacity, groups, x) for x in large), key=lambda plan: plan.n_sequences)


# ---- pieces


#: All but Latin letters, marks and spaces, and letters and marks of other scripts whose class has never changed.
_UNSETTLED = re.compile(r"[^\u0000-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0905-\u0939\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20]")
_SPACES = re.compile(rf"\s{{{LONG_RUN},}}")


class VocabularyEncoder(Encoder):
    """Ids of a byte-level BPE vocabulary in the tokenizers library's format.

    Its merges are those of ranks, which tiktoken applies several times faster; the library
    itself encodes the texts about which the two could differ: those that hold a special
    token's string, a character whose class may depend on the version of Unicode, or a long
    run of white space.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        from public_tokenizers import PATTERN  # the pattern that is the library's own for these files

        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special)
        self.ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.split = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.path, self.size = path, max(spec["model"]["vocab"].values()) + 1

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def whole_ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _UNSETTLED.search(text) or _SPACES.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return encode_text(self, text)


_encoders: dict[str, VocabularyEncoder] = {}


def vocabulary_encoder(path: str) -> VocabularyEncoder:
    """The encoder of a vocabulary file, read once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = VocabularyEncoder(path)
    return _encoders[path]


def cut_sizes(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: whole ones of the capacity after a shorter first, if any."""
    if n <= capacity:
        return [n]
    return [*([n % capacity] if n % capacity else []), *[capacity] * (n // capacity)]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_key, piece, start, length, ids_crc32, ids`` of every document, with ``part, no``.

    ``ids`` are little-endian unsigned integers of 16 bits (32 for larger vocabularies);
    ``ids_crc32`` is of the 32-bit form. ``part`` is the task that encoded the piece, ``no``
    its place among that task's pieces of one length. A null text is empty: its end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = vocabulary_encoder(vocabulary), TaskContext.get().partitionId()
        narrow = "<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4"
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, 128):
            rows, piece, start, length, crc, ids, no = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                whole = np.append(encoder.whole_ids(text or ""), end_id).astype("<u4")
                at = 0
                for i, n in enumerate(cut_sizes(len(whole), capacity)):
                    part_ids = whole[at : at + n]
                    rows.append(row)
                    piece.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part_ids.tobytes()))
                    ids.append(part_ids.astype(narrow).tobytes())
                    no.append(int(seen[n]))
                    seen[n] += 1
                    at += n
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *longs, pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(no, pa.int64())], ["doc_key", "piece", "start", "length", "ids_crc32", "ids", "part", "no"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_key"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("ids", "binary").add("part", "integer").add("no", "long")
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> DataFrame:
    """Every piece and its place: ``id_col, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut, the
    first piece being the shorter one. Sequences are numbered from 0 and filled from offset 0
    on without gaps. A null or empty text is its end id; null, tied and repeated ids are
    documents of their own; other columns are left out; an empty table gives no rows.
    What reaches the driver is one count for each length up to the capacity; the plan that
    is broadcast has at most some tens of rows for each length, at any number of pieces.
    """
    table = written(pieces(docs, vocabulary, id_col, text_col, end_id, capacity), "pieces")
    spark = table.sparkSession
    counts = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves = best_plan(totals, capacity, groups, large).moves
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))
    plan = spark.createDataFrame(moves, "of_length long, first long, n long, sequence long, per long, place long")
    ranked = table.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("no"))
    inside = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    placed = ranked.join(F.broadcast(plan), inside).withColumn("step", F.col("rank") - F.col("first"))
    return placed.select(F.col("doc_key").alias(id_col), "piece", "start", "length", "ids_crc32", "ids", F.expr("sequence + step div per").alias("sequence_id"), F.expr("place + step % per * length").alias("offset"))


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, n_tokens, ids, segments`` of what :func:`pack` returns.

    ``segments`` are (id, piece, offset, length) in order of offset; a sequence has at most
    as many as the capacity, so each is one small group.
    """
    one = F.struct("offset", F.col(id_col).alias("doc_key"), "piece", "length", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("held"), F.sum("length").alias("n_tokens"))
    ids = F.expr("unhex(array_join(transform(held, x -> hex(x.ids)), ''))")
    segments = F.transform("held", lambda x: F.struct(x["doc_key"].alias("doc_key"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return held.select("sequence_id", "n_tokens", ids.alias("ids"), segments.alias("segments"))
