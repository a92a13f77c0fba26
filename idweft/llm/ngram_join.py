"""N-gram Jaccard self-join of documents with rare-first prefix filtering.

Documents with one shingle set are one class and are joined once. Shingles are ordered by
how often they occur, rarest first; the counts are of all documents, in a table that grows
with the input up to 2^26 bytes. Two sets of Jaccard similarity J share a shingle among
their first ``n - ceil(J n) + 1``, so only those prefixes are joined, and of these only
shingles that can occur twice. Length and position bound what a pair can still share; counts
of shingles in 128 hash classes bound it again, which is the suffix filter's bound taken
once over the whole set. Every pair that is left is verified once, on the exact sets.

A prefix shingle shared by many is never expanded into all its pairs. First every document
meets one other: the first document under its shingles, the one under most of them. Verified
links are merged into components, and shingles whose documents are all in one component are
done. Under the others every document meets one of another component, in a few rounds. What
then is left are pairs of different components under one shingle; they are formed in blocks
of bounded size, within the largest component never. Rows that meet no other there go, the
rest come again with their sets: pairs are verified inside the block, and of its links only
those leave it that join what it has not joined yet, fewer than it has rows. So pairs that
turn out not to link are never rows of a table. No link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idweft.llm.components import components
from idweft.llm.storage import discard, written
from idweft.llm.words import Rolling, slices, word_hashes

WORDS, PERCENT = 5, 80
#: Fixed sizes: the classes of the suffix bound, a block's rows, and the group size from which
#: pairs wait for the blocks.
CLASSES, BLOCK, EARLY_BOUND = 128, 256, 64
#: The table of shingle counts has a byte for some LOAD shingles, between these powers of two.
#: It is summed in ranges of 2^18 buckets, at most so many partitions' in a task, and kept as
#: STEPS levels to each doubling. A level of SINGLE is a bucket with one shingle of one set.
LOAD, LEAST_BITS, MOST_BITS, RANGE_BITS, MOST_SUMMED, STEPS = 16, 18, 26, 18, 256, 8
SINGLE = STEPS
#: Shingles of a set, the first in order, by which a pair is known to have been formed already.
FIRST = 16
#: Rounds in which a document meets one of another component before all such pairs are formed.
ROUNDS = 2
#: Shingles of the longest set that is compared inside a block, and sets that meet one at once;
#: pairs with a longer set are verified two by two.
MOST_IN_BLOCK, AT_ONCE = 1 << 15, 64
#: Texts that a worker gets at once.
BATCH_ROWS = 1_024
#: Shingles held before a partition's counts are written out.
MOST_HELD = 1 << 24
#: A shingle whose bucket counts this many times the mean bucket, and so many at least, may be
#: shared by many documents: a task gets about HOT_LEAST of them. Results don't depend on it.
HOT_TIMES, HOT_LEAST = 8, 1_024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(data: bytes | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; a shorter text is one shingle."""
    words = (data or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    rolling = Rolling(word_hashes(words))
    if len(words) < size:
        return rolling.ranges(np.array([0]), np.array([len(words)]))
    return np.unique(rolling.windows(size))


def _buckets(s: np.ndarray, bits: int) -> np.ndarray:
    return ((s >> np.uint64(20)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _signature(s: np.ndarray) -> bytes | None:
    """Shingles in each hash class, a byte each; none where a class has more than a byte holds."""
    counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=CLASSES)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _least_shared(total, percent: int):
    """Shared shingles that sets of ``total`` elements together need: ceil(p / (1 + p) * total)."""
    return -(-percent * total // (100 + percent))


def _describe(size: int, bits: int):
    """A row for each document, and one for each range of the partition's shingle counts."""
    names = ["doc_key", "n", "set_high", "set_low", "classes", "range", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def batch_of(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds, strict=True)], names)

    def tables(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, pack = np.sort(np.concatenate(parts)), zstandard.ZstdCompressor(level=1)
        ends = np.searchsorted(held, np.arange(1, (1 << bits - RANGE_BITS) + 1, dtype=np.uint64) << RANGE_BITS)
        begin = 0
        for k, end in enumerate(ends):
            if end > begin:
                counts = np.bincount(held[begin:end] - np.uint32(k << RANGE_BITS), minlength=1 << RANGE_BITS)
                yield batch_of(range=[k], counts=[pack.compress(counts.astype("<u4").tobytes())])
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, count = set(), [], 0
        for batch in slices(batches):
            n, high, low, marks = [], [], [], []
            for data in batch.column(1).to_pylist():
                s = shingles(data, size)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                high.append((whole >> 64) - (1 << 63))
                low.append((whole & (1 << 64) - 1) - (1 << 63))
                marks.append(_signature(s) if len(s) else None)
                if len(s) and whole not in seen:
                    seen.add(whole)
                    parts.append(_buckets(s, bits))
                    count += len(s)
            yield batch_of(doc_key=batch.column(0), n=n, set_high=high, set_low=low, classes=marks)
            if count > MOST_HELD:
                yield from tables(parts)
                parts, count = [], 0
        if parts:
            yield from tables(parts)

    return run


def _summed(levels: bool):
    """Counts of each range from rows sorted by it; with ``levels`` as a byte a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            for k, counts in zip(batch.column("range").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if k != at:
                    if at is not None:
                        yield out(at, sums)
                    at, sums = k, np.zeros(1 << RANGE_BITS, np.int64)
                sums += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "<u4")
        if at is not None:
            yield out(at, sums)

    def out(k: int, sums: np.ndarray) -> pa.RecordBatch:
        data = np.minimum(np.round(STEPS * np.log2(1.0 + sums)), 255).astype(np.uint8) if levels else np.minimum(sums, (1 << 32) - 1).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(data.tobytes())])], ["range", "counts"])

    return run


def _prefixes(size: int, percent: int, bits: int, levels):
    """The prefix of every set, once for each partition: ``token, doc_key, n, place, parts``.

    Shingles that occur once keep their place and are left out. ``parts`` is over how many
    tasks a shingle's documents are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, parts), seen = levels.value, set()
        for batch in slices(batches):
            tokens, rows, sizes, places, dealt = [], [], [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                s = shingles(data, size)
                if not len(s) or (whole := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(whole)
                k = prefix_length(len(s), percent)
                level = often[_buckets(s, bits)]
                order = np.lexsort((s, level))[:k]
                place = np.flatnonzero(level[order] != SINGLE)
                order = order[place]
                tokens.append(s[order])
                dealt.append(parts[level[order]])
                rows.append(np.full(len(order), i))
                sizes.append(np.full(len(order), len(s), np.int32))
                places.append(place.astype(np.int32))
            if tokens:
                keys = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), keys, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(np.concatenate(dealt))], ["token", "doc_key", "n", "place", "parts"])

    return run


def _shared(percent: int):
    """Rows that may link with another under their shingle, from rows sorted by it.

    Up to ``EARLY_BOUND`` rows under a shingle are compared by length and position here, and
    those that fit none go. More rows, or hot ones, all stay and are marked ``many``.
    ``lead`` is the first document under the shingle, where the two may link. Of a run that
    goes on in the next batch, at most ``EARLY_BOUND`` rows are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_run = None, None  # rows of a short run; token and first row of a long one
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            begin = int(np.searchsorted(columns[0], columns[0][-1]))
            goes_on = long_run is not None and columns[0][-1] == long_run[0]
            short = n - begin <= EARLY_BOUND and not goes_on
            cut = begin if short else n
            held = [c[begin:] for c in columns] if short else None
            if cut:
                done = [c[:cut] for c in columns]
                yield from out(done, long_run)
                if short:
                    long_run = None
                elif not goes_on:
                    long_run = columns[0][-1], *(int(c[begin]) for c in columns[1:4])
        if held is not None:
            yield from out(held, None)

    def out(columns, long_run):
        token, doc, n, place, parts = columns
        n, place = n.astype(np.int64), place.astype(np.int64)
        rows = np.arange(len(token))
        begins = np.concatenate([[True], token[1:] != token[:-1]])
        head = np.maximum.accumulate(np.where(begins, rows, 0))
        length = np.diff(np.concatenate([np.flatnonzero(begins), [len(token)]]))
        many = (parts > 1) | np.repeat(length > EARLY_BOUND, length)
        lead = [c[head].astype(np.int64) for c in (doc, n, place)]
        if long_run is not None:
            later = token == long_run[0]
            many |= later
            for c, first in zip(lead, long_run[1:], strict=True):
                c[later] = first
        keep, index, d = many.copy(), rows[~many], 0
        while len(index):  # rows d apart in one run, for all runs at once
            d += 1
            index = index[index + d < len(token)]
            index = index[token[index] == token[index + d]]
            fits = index[_may_link(n[index], n[index + d], place[index], place[index + d], percent)]
            keep[fits] = keep[fits + d] = True
        fits = (lead[0] != doc) & _may_link(lead[1], n, lead[2], place, percent, first=False)
        if keep.any():
            arrays = [pa.array(c[keep]) for c in (token, doc, columns[2], columns[3], many)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lead[0][keep], mask=~fits[keep])], ["token", "doc_key", "n", "place", "many", "lead"])

    return run


def _may_link(n1, n2, p1, p2, percent: int, first: bool = True):
    """Length and position filter, on numpy arrays, for a shingle of two sets at places p1 and p2.

    With ``first`` it is for the first shingle that both share; every linked pair passes at its own.
    """
    need = _least_shared(n1 + n2, percent)
    length = (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)
    before = 0 if first else np.minimum(p1, p2)
    # what both can share: of the places so far, this shingle, the lesser of the rests
    same = before + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= need
    return length & same


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles that sets can share, by the lesser count in each class."""
    return np.minimum(a, b).sum(axis=1, dtype=np.int64)


def _share_one(lists: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the lists of rows i and j have an element in common."""
    out = np.zeros(len(i), bool)
    at = np.arange(lists.shape[1])
    for begin in range(0, len(i), 4_096):
        a, b = i[begin : begin + 4_096], j[begin : begin + 4_096]
        same = lists[a][:, :, None] == lists[b][:, None, :]
        same &= (at < sizes[a][:, None])[:, :, None] & (at < sizes[b][:, None])[:, None, :]
        out[begin : begin + 4_096] = same.any(axis=(1, 2))
    return out


_ROWS = ["block", "rep", "label", "n", "place", "own", "cross", "classes", "earlier"]


def _candidates(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of one block and different components that all bounds let pass.

    A pair is formed under the first shingle that both share: ``earlier`` holds shingles that
    come before a row's own, and a pair with one of these in common is left to that one.
    """
    key, _, label, n, place, own, cross = (table.column(c).to_numpy() for c in _ROWS[:7])
    classes, earlier = (table.column(c).to_pylist() for c in _ROWS[7:])
    n, place, cross = n.astype(np.int64), place.astype(np.int64), cross.astype(bool)
    sizes = np.array([len(e) for e in earlier], np.int64)
    lists = np.zeros((len(key), FIRST), np.int64)
    for row in np.flatnonzero(sizes):
        lists[row, : sizes[row]] = earlier[row]
    found, index, d = [np.zeros((2, 0), np.int64)], np.arange(len(key)), 0
    has = np.array([c is not None for c in classes], bool)
    counts = np.zeros((len(classes), CLASSES), np.uint8)
    if has.any():
        counts[has] = np.frombuffer(b"".join(c for c in classes if c is not None), np.uint8).reshape(-1, CLASSES)
    while len(index):  # rows d apart in one block, for all blocks at once
        d += 1
        index = index[index + d < len(key)]
        index = index[key[index] == key[index + d]]
        i, j = index, index + d
        good = (label[i] != label[j]) & (~cross[i] | (own[i] != own[j]))
        i, j = i[good], j[good]
        good = _may_link(n[i], n[j], place[i], place[j], percent)
        i, j = i[good], j[good]
        both = has[i] & has[j]
        if both.any():
            fits = np.ones(len(i), bool)
            fits[both] = _bound(counts[i[both]], counts[j[both]]) >= _least_shared(n[i[both]] + n[j[both]], percent)
            i, j = i[fits], j[fits]
        if len(i):
            new = ~_share_one(lists, sizes, i, j)
            found.append(np.stack([i[new], j[new]]))
    return tuple(np.concatenate(found, axis=1))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block, no block in two tables."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = table.column("block").to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and (keys != keys[-1]).any() else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _met(percent: int):
    """The rows that meet another in their block; pairs ``a, b`` instead where a set is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            i, j = _candidates(table, percent)
            rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
            long = np.maximum(n[i], n[j]) > MOST_IN_BLOCK
            rows = table.take(pa.array(np.unique(np.concatenate([i[~long], j[~long]]))))
            none = pa.nulls(rows.num_rows, pa.int64())
            yield from rows.append_column("a", none).append_column("b", none).to_batches()
            if long.any():
                a, b = rep[i[long]], rep[j[long]]
                ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                nulls = [pa.nulls(ends.shape[1], f.type) for f in table.schema]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(ends[0]), pa.array(ends[1])], [*table.schema.names, "a", "b"])

    return run


def _linked(percent: int):
    """Links that join components, verified on the sets of rows sorted by block; fewer than rows."""

    def links(table: pa.Table) -> Iterator[tuple[int, int]]:
        i, j = _candidates(table, percent)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        rep = table.column("rep").to_numpy()
        component = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("elements").combine_chunks()]
        size = np.array([len(x) for x in sets], np.int64)
        rows, begins = np.unique(i, return_index=True)
        for row, others in zip(rows.tolist(), np.split(j, begins[1:]), strict=False):
            for k in range(0, len(others), AT_ONCE):
                few = others[k : k + AT_ONCE]
                few = few[(component[few] != component[row]) & (np.maximum(size[few], size[row]) <= MOST_IN_BLOCK)]
                if not len(few):
                    continue
                values = np.concatenate([sets[x] for x in few])
                at = np.minimum(np.searchsorted(sets[row], values), size[row] - 1)
                shared = np.add.reduceat((sets[row][at] == values).astype(np.int64), np.cumsum(size[few]) - size[few])
                for other in few[100 * shared >= percent * (size[few] + size[row] - shared)].tolist():
                    if component[other] != component[row]:
                        component[component == component[other]] = component[row]
                        yield int(min(rep[row], rep[other])), int(max(rep[row], rep[other]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            found = np.array(list(links(table)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


class _Join:
    """The tables of one join; nothing in it holds rows."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_key"), F.col(text_col).cast("binary").alias("data"))
        words = (self.rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0) / 6
        self.bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, words / LOAD)))))
        schema = "doc_key long, n long, set_high long, set_low long, classes binary, range int, counts binary"
        described = written(self.rows.mapInArrow(_describe(size, self.bits), schema), "described", BATCH_ROWS)
        self.levels = self.spark.sparkContext.broadcast(self._levels(described.filter("range is not null").select("range", "counts")))
        self.sets = written(described.filter("range is null").drop("range", "counts"), "sets")
        discard(described)
        known = self.sets.filter("n > 0 and doc_key is not null")
        self.classes = written(known.groupBy("set_high", "set_low").agg(F.min("doc_key").alias("rep"), F.max("n").cast("int").alias("n")), "classes")
        # documents with more than one row, and those of them with several texts
        often = written(known.groupBy("doc_key").agg(F.count("*").alias("rows"), (F.min("set_low") < F.max("set_low")).alias("twins")).filter("rows > 1"), "often")
        self.repeats = not often.isEmpty()
        # where a document is not its class's smallest; one with several texts has a row for each
        members = known.select("doc_key", "set_high", "set_low").distinct().join(self.classes, ["set_high", "set_low"]).select("doc_key", "rep")
        moved = members.filter("doc_key <> rep").select("doc_key").distinct()
        self.moved = written(members.join(moved, "doc_key", "left_semi"), "moved")
        # the texts of one document are linked; no bound is taken on a class that stands for several
        several = members.join(often.filter("twins").select("doc_key"), "doc_key", "left_semi") if self.repeats else members.limit(0)
        least = several.groupBy("doc_key").agg(F.min("rep").alias("b"))
        self.twins = written(several.join(least, "doc_key").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct(), "twins")
        bounds = known.select(F.col("doc_key").alias("rep"), F.col("n").cast("int").alias("n"), "classes")
        if self.repeats:
            mixed = often.filter("twins").select(F.col("doc_key").alias("rep"), F.lit(True).alias("mixed"))
            bounds = bounds.dropDuplicates(["rep"]).join(mixed, "rep", "left").select("rep", "n", F.when(F.col("mixed").isNull(), F.col("classes")).alias("classes"))
        self.bounds = bounds

    def _levels(self, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each bucket, at most 2 ** MOST_BITS whatever the input, and a level's tasks."""
        most = counts.groupBy("range").count().agg(F.max("count")).first()[0] or 0
        schema = "range int, counts binary"
        if most > MOST_SUMMED:
            part = F.pmod(F.xxhash64("counts"), F.lit(math.ceil(most / MOST_SUMMED)))
            counts = written(counts.repartition("range", part).sortWithinPartitions("range").mapInArrow(_summed(False), schema), "counts")
        found = counts.repartition("range").sortWithinPartitions("range").mapInArrow(_summed(True), schema).collect()
        levels = np.zeros(1 << self.bits, np.uint8)
        for k, data in found:
            levels[k << RANGE_BITS : (k + 1) << RANGE_BITS] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8)
        times = np.exp2(np.arange(256) / STEPS) - 1
        most = max(HOT_LEAST, HOT_TIMES * sum(float(times @ np.bincount(part, minlength=256)) for part in np.split(levels, 64)) / len(levels))
        return levels, np.where(times > most, np.minimum(times // HOT_LEAST + 1, 1 << 20), 1).astype(np.int32)

    def groups(self) -> DataFrame:
        """``token, doc_key, n, place, many, lead`` under every prefix shingle that is shared."""
        prefixes = self.rows.filter("doc_key is not null").mapInArrow(_prefixes(self.size, self.percent, self.bits, self.levels), "token long, doc_key long, n int, place int, parts int")
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_key"), F.col("parts")))
        dealt = prefixes.repartition("token", part).sortWithinPartitions("token", "doc_key")
        return written(dealt.mapInArrow(_shared(self.percent), "token long, doc_key long, n int, place int, many boolean, lead long"), "groups", BATCH_ROWS)

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the class counts let pass."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = batch.column("classes_a").to_pylist(), batch.column("classes_b").to_pylist()
                need = _least_shared(batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy(), percent)
                keep = np.array([x is None or y is None for x, y in zip(left, right, strict=True)], bool)
                at = np.flatnonzero(~keep)
                if len(at):
                    table = lambda part: np.frombuffer(b"".join(part[i] for i in at), np.uint8).reshape(-1, CLASSES)
                    keep[at] = _bound(table(left), table(right)) >= need[at]
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        end = lambda x: self.bounds.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("classes").alias(f"classes_{x}"))
        return pairs.join(end("b"), "b").join(end("a"), "a").mapInArrow(run, "a long, b long")

    def elements(self, reps: DataFrame) -> DataFrame:
        """``rep, tag, elements``: the sets of documents, written; one with several texts has a row for each."""
        size = self.size
        asked = written(reps.distinct().join(self.classes.select("rep", F.col("set_low").alias("tag")), "rep"), "asked")  # the tag tells a class's text from another with its id

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep, sets = [], []
                for i, (data, tag) in enumerate(zip(batch.column("data").to_pylist(), batch.column("tag").to_pylist(), strict=True)):
                    s = shingles(data, size)
                    if (xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1) - (1 << 63) == tag:
                        keep.append(i)
                        sets.append(s.view(np.int64))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), batch.column("tag").take(at), pa.array(sets, pa.list_(pa.int64()))], ["rep", "tag", "elements"])

        texts = self.rows.join(asked, self.rows.doc_key == asked.rep).select("rep", "data", "tag")
        sets = texts.mapInArrow(run, "rep long, tag long, elements array<long>")
        if self.repeats:
            sets = sets.dropDuplicates(["rep", "tag"])
        sets = written(sets, "elements", BATCH_ROWS)
        discard(asked)
        return sets

    def verified(self, pairs: DataFrame) -> DataFrame:
        """``a, b`` of the pairs that link, on the whole sets."""
        sets = self.elements(pairs.select(F.explode(F.array("a", "b")).alias("rep")))
        end = lambda x: sets.select(F.col("rep").alias(x), F.col("elements").alias(f"set_{x}"))
        both = pairs.join(end("b"), "b").join(end("a"), "a")
        both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
        links = written(both.filter(f"100 * shared >= {self.percent} * (total - shared)").select("a", "b"), "links")
        discard(sets)
        return links

    def first_pairs(self, groups: DataFrame) -> DataFrame:
        """Each class with the document that is first under most of its shingles."""
        led = groups.filter("lead is not null").groupBy("doc_key", "lead").agg(F.count("*").alias("times"))
        one = led.groupBy("doc_key").agg(F.max_by("lead", F.struct("times", -F.col("lead"))).alias("lead"))
        end = lambda x: self.moved.select(F.col("doc_key").alias(x), F.col("rep").alias(f"rep_{x}"))
        pairs = one.select(F.col("lead").alias("a"), F.col("doc_key").alias("b"))
        pairs = pairs.join(end("b"), "b", "left").join(end("a"), "a", "left").select(F.coalesce("rep_a", "a").alias("a"), F.coalesce("rep_b", "b").alias("b"))
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def named(self, groups: DataFrame) -> DataFrame:
        """``token, rep, n, place, many``: the groups by class."""
        known = groups.join(self.moved, "doc_key", "left").select("token", F.coalesce("rep", "doc_key").alias("rep"), "n", "place", "many")
        return written(known, "named")

    def open_rows(self, named: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        """Rows of ``named`` under shingles with several components, with labels and one row picked for each shingle."""
        of = labels.filter("node <> label").select(F.col("node").alias("rep"), "label")
        rows = named.join(of, "rep", "left").select("token", "rep", F.coalesce("label", "rep").alias("label"), "n", "place", "many")
        pick = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("to"), F.col("label").alias("to_label"), F.col("n").alias("to_n"), F.col("place").alias("to_place")))
        tokens = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), pick.alias("pick")).filter("low < high").select("token", "pick.to", "pick.to_label", "pick.to_n", "pick.to_place")
        return written(rows.join(tokens, "token"), "open")

    def next_pairs(self, rows: DataFrame, tried: DataFrame) -> DataFrame:
        """Each class with one of another component that is picked under most of its shingles."""
        n, to_n, place, to_place = (F.col(c).cast("long") for c in ("n", "to_n", "place", "to_place"))
        p = self.percent
        need = F.ceil(F.lit(p) * (n + to_n) / F.lit(100.0 + p) - 1e-6)
        fits = (100 * n >= p * to_n) & (100 * to_n >= p * n) & (F.least(place, to_place) + 1 + F.least(n - place - 1, to_n - to_place - 1) >= need)
        asks = rows.filter((F.col("label") != F.col("to_label")) & fits).groupBy("rep", "to").agg(F.count("*").alias("times"))
        asks = asks.select("rep", "to", "times", F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).join(tried, ["a", "b"], "left_anti")
        one = asks.groupBy("rep").agg(F.max_by("to", F.struct("times", -F.col("to"))).alias("to"))
        return one.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()

    def other_links(self, mixed: DataFrame) -> DataFrame:
        """Links that join all components whose pairs under one shingle link; formed and verified in blocks."""
        mixed = mixed.select("token", "rep", "label", "n", "place", "many")
        firsts = mixed.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("place", "token"))), 1, FIRST).alias("firsts"))
        # a class that stands for several texts has no bound, and its shingles no common order
        firsts = self.bounds.select("rep", "classes").join(firsts, "rep").select("rep", "classes", F.when(F.col("classes").isNotNull(), F.col("firsts")).otherwise(F.array().cast("array<struct<place:int,token:long>>")).alias("firsts"))
        earlier = F.transform(F.filter("firsts", lambda x: x["place"] < F.col("place")), lambda x: x["token"]).alias("earlier")
        cols = [*_ROWS[:-1], earlier]
        # shingles that few share: a block each
        few = mixed.filter("not many").select(F.col("token").alias("block"), "rep", "label", "n", "place", F.lit(0).alias("own"), F.lit(False).alias("cross"))
        # those that many share: blocks of bounded size
        many = mixed.filter("many").drop("many").distinct()
        sizes = many.groupBy("token", "label").agg(F.count("*").alias("rows"))
        tokens = sizes.groupBy("token").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", (-F.col("label")).alias("minus"))).alias("largest"))
        tokens = tokens.select("token", "all", F.col("largest.rows").alias("most"), (-F.col("largest.minus")).alias("major"))
        rows = many.join(tokens, "token").withColumn("main", F.col("label") == F.col("major"))
        rows = rows.withColumn("mains", F.ceil(F.col("most") / BLOCK).cast("int")).withColumn("others", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
        rows = rows.withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
        # a block is (kind, i, j): all rows of a small group; block i of the largest component
        # with block j of the others; blocks i and j of the others
        blocks = F.expr(f"""
            case when `all` <= {BLOCK} then array(struct(0 as kind, 0 as i, 0 as j, 0 as own, false as cross))
            when main then transform(sequence(0, others - 1), k -> struct(1 as kind, at as i, k as j, 0 as own, true as cross))
            else concat(transform(sequence(0, mains - 1), k -> struct(1 as kind, k as i, at as j, 1 as own, true as cross)),
                        transform(sequence(0, others - 1), k -> struct(2 as kind, least(at, k) as i, greatest(at, k) as j, at as own, at <> k as cross))) end""")
        dealt = rows.select("token", "rep", "label", "n", "place", F.explode(blocks).alias("x")).select("token", "rep", "label", "n", "place", "x.*")
        dealt = dealt.withColumn("block", F.xxhash64("token", "kind", "i", "j")).drop("token", "kind", "i", "j")
        dealt = few.unionByName(dealt).join(firsts, "rep").select(*cols).repartition("block").sortWithinPartitions("block")
        met = written(dealt.mapInArrow(_met(self.percent), "block long, rep long, label long, n int, place int, own int, cross boolean, classes binary, earlier array<long>, a long, b long"), "met")
        rows = met.filter("a is null").drop("a", "b")
        sets = self.elements(rows.select("rep"))
        whole = rows.join(sets.drop("tag"), "rep").select(*_ROWS, "elements").repartition("block").sortWithinPartitions("block")
        links = written(whole.mapInArrow(_linked(self.percent), "a long, b long").distinct(), "links", BLOCK)
        discard(sets)
        long = written(met.filter("a is not null").select("a", "b").distinct(), "pairs")
        discard(met)
        if long.isEmpty():
            return links
        both = written(links.unionByName(self.verified(long)), "links")
        discard(links, long)
        return both


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every document.

    Texts are lower-cased in A-Z; a set holds the distinct shingles of ``words`` words, or the
    whole text where it is shorter. Documents link when 100 * shared >= percent * union.
    ``component_id`` is the smallest id that links reach. A null text, or one without words,
    has no shingles and reaches itself. A row with a null id takes no part: its component is
    null. Repeated rows are one class. Rows with one id and several texts are one document,
    linked by any of them. Ids are integers; other columns are left out.
    """
    join = _Join(docs, id_col, text_col, words, percent)
    groups = join.groups()
    tried = written(join.bounded(join.first_pairs(groups)), "tried")
    links = join.verified(tried)
    labels = written(components(links.unionByName(join.twins)), "labels")
    rows = join.named(groups)
    discard(groups, links)
    for turn in range(ROUNDS + 1):
        before, rows = rows, join.open_rows(rows.select("token", "rep", "n", "place", "many"), labels, turn)
        discard(before)
        if rows.isEmpty():
            break
        if turn < ROUNDS:
            pairs = written(join.bounded(join.next_pairs(rows, tried)), "pairs")
            if pairs.isEmpty():
                continue
            links = join.verified(pairs)
            before, tried = tried, written(tried.unionByName(pairs), "tried")
            discard(before, pairs)
        else:
            links = join.other_links(rows)
        earlier, labels = labels, written(components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")
        discard(links, earlier)
    discard(rows, tried, join.twins, join.moved)
    classes = join.classes.select("set_high", "set_low", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("set_high", "set_low", F.coalesce("label", "rep").alias("component"))
    out = join.sets.drop("classes").join(classes, ["set_high", "set_low"], "left")
    component = F.when(F.col("doc_key").isNotNull(), F.coalesce("component", "doc_key"))
    return out.select(F.col("doc_key").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
