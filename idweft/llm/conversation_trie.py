"""A prefix trie of conversations: z-fast tries over ranges of sequences, joined where ranges meet.

A conversation is the sequence of its turns; a turn is the 128-bit digest of its role and text,
so texts never cross the network. Equal sequences are counted where they are read, with the
list of their ids as text. Distinct sequences are dealt by ranges in lexical order, so that a
first turn which a third of all conversations share is spread over many tasks, and every task
builds a z-fast trie of its range:

* A compacted node stands for an edge: the depths from its parent's to its own. It is kept in
  a hash table under its handle, the prefix whose depth is the two-fattest number in there.
* The exit node of a sequence, the one where its path leaves the trie, is found by fat binary
  search: at each step the two-fattest depth left is looked up in the table.
* Sequences are inserted batch by batch; after each batch the nodes off the path to the last
  sequence can't change any more: their edges are expanded to one row for each depth, and
  they are dropped, so a task holds a batch and one path.

Two neighbouring ranges share the nodes above the depth up to which the last sequence of one
equals the first of the next. Those come as parts that add up: a node is owned by the first
range that has it, and only owned nodes count as children or as one text that must be kept.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idweft.llm.storage import discard, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Ids that a task gathers, and bytes of paths, before the sequences counted so far are written.
GATHERED, GATHERED_BYTES = 200_000, 32 << 20
#: Sequences from which the limits between ranges are chosen, for each range, and bytes of each.
SAMPLE, LIMIT_BYTES = 16, 4_096
#: Rows of shared nodes up to which they are broadcast (some 60 bytes each).
BROADCAST_ROWS = 200_000

_ROOT = xxhash.xxh3_128_digest(b"")
_NONE = hashlib.sha256(b"").hexdigest()


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def prefix_digest(path: bytes, depth: int) -> bytes:
    return xxhash.xxh3_128_digest(path[: depth * WIDTH])


def common_depth(a: bytes, b: bytes) -> int:
    """How many turns from the start on two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """A compacted node: the edge from depth ``above`` (exclusive) to ``depth``."""

    __slots__ = ("above", "depth", "path", "sizes", "parent", "kids", "handle", "own", "any_kid", "n", "low", "leaves", "saved", "owned_kids", "tops")

    def __init__(self, above, depth, path, sizes, parent):
        self.above, self.depth, self.path, self.sizes, self.parent = above, depth, path, sizes, parent
        self.kids: dict[bytes, Node] = {}
        self.handle, self.own, self.any_kid = None, None, False
        self.n, self.low, self.leaves, self.saved, self.owned_kids = 0, None, 0, 0, 0  # of what is below and done
        self.tops: list[list] = []  # rows of done children, which want this node's smallest member

    def join(self, n: int, low) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)


class ZFastTrie:
    """Sequences by handles. ``insert`` takes any order; ``settle`` needs ascending paths.

    ``left`` and ``right`` are the depths up to which the first and the last sequence are
    shared with the ranges before and after.
    """

    def __init__(self, left: int = 0, right: int = 0):
        self.root = Node(0, 0, b"", (), None)
        self.table: dict[bytes, Node] = {_ROOT: self.root}
        self.left, self.right, self.first, self.last = left, right, None, b""
        self.rows: list[list] = []

    def exit_node(self, path: bytes) -> Node:
        """The node on whose edge, or at whose end, the path of a sequence leaves the trie."""
        low, high, at = 0, len(path) // WIDTH, self.root
        while low < high:
            depth = two_fattest(low, high)
            found = self.table.get(prefix_digest(path, depth))
            if found is None:
                high = depth - 1
            else:
                at, low = found, found.depth
        end = at.depth * WIDTH
        if len(path) >= end and path[:end] == at.path[:end]:  # whole edge: it is the parent, or the exit node itself
            return at.kids.get(path[end : end + WIDTH], at)
        return at

    def _enter(self, node: Node) -> None:
        node.handle = prefix_digest(node.path, two_fattest(node.above, node.depth))
        self.table[node.handle] = node

    def insert(self, path: bytes, sizes, n: int, low, ends: str) -> None:
        """A sequence of ``n`` members, the smallest of which is ``low``; distinct from those before."""
        if self.first is None:
            self.first = path
        self.last = path
        node, depth = self.exit_node(path), len(path) // WIDTH
        meets = common_depth(path, node.path[: node.depth * WIDTH])
        if meets < node.depth:  # split the edge where the paths part
            upper = Node(node.above, meets, node.path, node.sizes, node.parent)
            node.parent.kids[node.path[node.above * WIDTH : (node.above + 1) * WIDTH]] = upper
            del self.table[node.handle]
            upper.kids[node.path[meets * WIDTH : (meets + 1) * WIDTH]] = node
            node.above, node.parent = meets, upper
            self._enter(upper)
            self._enter(node)
            node = upper
        if depth > meets:
            leaf = Node(meets, depth, path, sizes, node)
            node.kids[path[meets * WIDTH : (meets + 1) * WIDTH]] = leaf
            self._enter(leaf)
            node = leaf
        node.own = ends
        node.join(n, low)

    def settle(self, finish: bool = False) -> list[list]:
        """Rows of all nodes that later sequences can't change, which are dropped here."""
        if finish:
            self._close(self.root)
        else:
            node = self.root
            while node.kids:
                *done, last = node.kids.values()
                for child in done:
                    self._close(child)
                node = last
        out, self.rows = self.rows, []
        return out

    def _close(self, top: Node) -> None:
        order, stack = [], [top]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.kids.values()
        for node in reversed(order):
            self._expand(node)

    def _expand(self, node: Node) -> None:
        """One row for each depth of the edge, and what the parent needs of it."""
        left = min(common_depth(node.path, self.first), self.left) if self.first is not None and node.above < self.left else 0
        right = min(common_depth(node.path, self.last), self.right) if node.above < self.right else 0
        shared = max(left, right)
        any_kid, n, low, saved = node.any_kid, node.n, node.low, node.saved
        leaves = node.leaves if any_kid else int(node.depth > right)  # what ends where the next range goes on is no leaf
        for row in node.tops:
            self._give(row, node, node.depth <= shared)
        row = None
        for depth in range(node.depth, node.above, -1):
            size, owned = int(node.sizes[depth - 1]), depth > left
            saved += n * size - (size if owned else 0)
            end = depth == node.depth
            if row:
                self._give(row, node, depth <= shared)
            row = [low, depth, None, None, n, node.owned_kids if end else int(depth + 1 > left), leaves, saved, node.own if end else None, prefix_digest(node.path, depth) if depth <= shared else None]
        parent = node.parent
        if parent is None:  # the root, which all ranges share
            self.rows.append([low, 0, None, None, n, node.owned_kids, leaves, saved, node.own, _ROOT])
            return
        parent.any_kid = True
        parent.join(n, low)
        parent.leaves += leaves
        parent.saved += saved
        parent.owned_kids += int(node.above + 1 > left)
        if parent.parent is None:
            self._give(row, parent, True)
        else:
            parent.tops.append(row)
        del self.table[node.handle]
        del parent.kids[node.path[node.above * WIDTH : (node.above + 1) * WIDTH]]

    def _give(self, row: list, parent: Node, shared: bool) -> None:
        """Puts out a row with its parent's smallest member, or its key where other ranges have that node too."""
        if shared:
            row[3] = prefix_digest(parent.path, row[1] - 1)
        else:
            row[2] = parent.low
        self.rows.append(row)


def _borrowed(conv: int, most: int) -> int:
    return zlib.crc32(str(conv).encode()) % most


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 1, most: int = 1) -> DataFrame:
    """Sequences of turns and who has them: ``path, sizes, n, low, ids``.

    ``path`` holds a digest of 16 bytes for each turn, ``sizes`` the UTF-8 bytes of its text,
    ``ids`` the decimal ids of the ``n`` conversations in ascending order, ``low`` the smallest.
    A sequence has a row for each stretch of ids in which it was met. Turns are in the order
    of ``turn_col``, null first, equal ones in that of their digests; rows that are all equal
    are so many turns. A null role or text is empty, rows with a null id belong to no
    conversation, and other columns are left out.

    With ``family`` above 1, conversation c starts with the first h turns of conversation
    c - c mod family (all if fewer, none if that one is absent), and goes on with its own
    after its first h, where h is crc32 of the decimal c, mod ``most``.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col)).cast("binary")))
    conv = F.col(id_col).cast("long")
    rows = turns.filter(F.col(id_col).isNotNull()).select((conv - F.pmod(conv, F.lit(family).cast("long"))).alias("kin"), conv.alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text(text_col)).cast("long").alias("size"))
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, "kin").sortWithinPartitions("kin", "conv", F.col("turn").asc_nulls_first(), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("low", pa.int64()), ("ids", pa.string())]
        met: dict[bytes, list] = {}
        count = held = 0
        conv, base, base_path, base_sizes = None, None, b"", np.zeros(0, np.int64)
        path_parts: list[bytes] = []
        size_parts: list[np.ndarray] = []

        def done():
            nonlocal base, base_path, base_sizes, count, held
            path, sizes = b"".join(path_parts), np.concatenate(size_parts)
            if conv % family == 0:
                base, base_path, base_sizes = conv, path[: most * WIDTH], sizes[:most]
            h = _borrowed(conv, most)
            if h:
                start = (base_path[: h * WIDTH], base_sizes[:h]) if base == conv - conv % family else (b"", base_sizes[:0])
                path, sizes = start[0] + path[h * WIDTH :], np.concatenate([start[1], sizes[h:]])
            if path in met:
                met[path][1].append(conv)
            else:
                met[path] = [sizes, [conv]]
                held += 2 * len(path)
            count += 1

        def out():
            nonlocal count, held
            values = [list(met), [x[0] for x in met.values()], [len(x[1]) for x in met.values()], [x[1][0] for x in met.values()], [",".join(map(str, x[1])) for x in met.values()]]
            met.clear()
            count = held = 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)], [name for name, _ in kinds])

        for batch in batches:
            convs, sizes = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            digests = b"".join(batch.column(3).to_pylist())
            cuts = [0, *(np.flatnonzero(np.diff(convs)) + 1).tolist(), len(convs)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if conv != (this := int(convs[begin])):
                    if conv is not None:
                        done()
                        if count >= GATHERED or held >= GATHERED_BYTES:
                            yield out()
                    conv, path_parts, size_parts = this, [], []
                path_parts.append(digests[begin * WIDTH : end * WIDTH])
                size_parts.append(sizes[begin:end])
        if conv is not None:
            done()
            yield out()

    return dealt.mapInArrow(run, "path binary, sizes array<long>, n long, low long, ids string")


def _limits(seqs: DataFrame, parts: int) -> list[bytes]:
    """Paths at which ranges begin, from a sample that depends on the paths alone.

    The sequences of smallest hash among the rows, at most ``SAMPLE`` for each range, each by
    its first ``LIMIT_BYTES``: bounded whatever the table.
    """
    few = seqs.select(F.substring("path", 1, LIMIT_BYTES).alias("path"), F.xxhash64("path").alias("h")).orderBy("h", "path").limit(SAMPLE * parts).select("path").distinct()
    paths = sorted(bytes(r[0]) for r in few.collect())
    return sorted({paths[len(paths) * i // parts] for i in range(1, parts)} - {b""}) if paths else []


def prefix_trie(seqs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the sequences that :func:`sequences` gives.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id`` (the root's is null); ``n_convs``
    members; ``n_children``; ``n_leaves`` childless nodes of the subtree, itself included;
    ``saved_tokens`` over the subtree the sum of (n_convs - 1) times the bytes of a node's last
    text; ``ends_sha256`` digest of the comma-joined ids that end there. The root has depth 0
    and no text; a table without conversations has no root. Ids of one sequence are digested
    as a stream, in order, from stretches that hold many ids each.
    """
    spark = seqs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    seqs = written(seqs, "sequences")
    limits = _limits(seqs, parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [bisect_right(limits, x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    placed = seqs.mapInArrow(place, "part int, path binary, sizes array<long>, n long, low long, ids string")
    # one row for each range: how deep it meets its neighbours
    ends = seqs.select("path").mapInArrow(place, "part int, path binary").groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = written(ends, "ends")
    order = Window.orderBy("part")
    meets = F.udf(lambda a, b: 0 if a is None or b is None else common_depth(bytes(a), bytes(b)), "int")
    pairs = ends.select("part", "first", F.lag("last").over(order).alias("before"))
    left = {r["part"]: r["depth"] for r in pairs.select("part", meets("before", "first").alias("depth")).collect()}
    numbers = sorted(left)
    right = {a: left[b] for a, b in zip(numbers[:-1], numbers[1:], strict=True)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["conv_id", "depth", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key"]

        def table(rows):
            for begin in range(0, len(rows), 50_000):
                columns = zip(*rows[begin : begin + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        trie = part = path = None
        for batch in batches:
            for this, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is not None and (this, row[0]) != (part, path):
                    trie.insert(path, sizes, n, low, digest.hexdigest())  # noqa: F821
                    path = None
                if this != part:
                    if trie is not None:
                        yield from table(trie.settle(finish=True))
                    part, trie = this, ZFastTrie(left[this], right.get(this, 0))
                if path is None:
                    path, sizes, n, low = row[0], row[1], 0, row[3]
                    digest = hashlib.sha256()
                else:
                    digest.update(b",")
                n += row[2]
                low = min(low, row[3])
                digest.update(row[4].encode())
            if trie is not None:
                yield from table(trie.settle())
        if trie is not None:
            trie.insert(path, sizes, n, low, digest.hexdigest())
            yield from table(trie.settle(finish=True))

    dealt = placed.repartitionById(max(len(limits) + 1, 1), F.col("part")).sortWithinPartitions("part", "path", "low")
    schema = "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary"
    nodes = written(dealt.mapInArrow(build, schema), "nodes")
    discard(seqs, ends)
    total = lambda name: F.sum(name).alias(name)
    shared = nodes.filter("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    shared = written(shared, "shared")
    above = shared.select(F.col("key").alias("above_key"), F.col("conv_id").alias("above"))
    above = F.broadcast(above) if shared.count() <= BROADCAST_ROWS else above
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")]
    inner = nodes.filter("key is null and parent_key is null").select(columns)
    edge = nodes.filter("key is null and parent_key is not null").unionByName(shared.filter("parent_key is not null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    edge = edge.join(above, F.col("parent_key") == F.col("above_key")).withColumn("parent_conv_id", F.col("above")).select(columns)
    root = shared.filter("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns)
    return inner.unionByName(edge).unionByName(root)
