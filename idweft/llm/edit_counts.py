"""Token counts that follow edits without counting the whole text again.

A text is cut into leaves, runs of whole pre-tokens of about ``LEAF`` characters, only where
no match of the tokenizer's pattern can reach across, so that the leaves' counts add up to
the text's. Characters and counts of the leaves stand in two binary trees of sums. An edit
finds its leaves from the root; these and the neighbours whose border is no longer a safe
one are encoded again, and the sums above them are updated. All other leaves keep their
counts, and their text is not copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.llm.byte_bpe import SAFE_CUT, Encoder, encoding, safe_pieces
from idweft.llm.words import slices

LEAF = 512


def border_is_safe(left: str, right: str) -> bool:
    """Whether no match of the pattern reaches from the end of ``left`` into ``right``."""
    return bool(left) and bool(right) and SAFE_CUT.match(left[-1] + right[0], 1) is not None


def _sums(values: list[int]) -> list[list[int]]:
    """The values, then on each next level the sums of pairs below."""
    levels = [list(values)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sum(below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def _put(levels: list[list[int]], i: int, value: int) -> None:
    """Sets a leaf's value and every sum above it."""
    change = value - levels[0][i]
    if change:
        for level in levels:
            level[i] += change
            i //= 2


class CountTree:
    """Leaves of one text, and the sums of their characters and tokens.

    ``chars[0]`` and ``counts[0]`` hold the leaves' values, each next level the sums of pairs
    below. An edit that needs no more leaves than it touches keeps the trees' shape, with
    empty leaves (no characters, count 0) for those it does not need; one that needs more
    builds the trees anew from the counts it has.
    """

    def __init__(self, text: str, enc: Encoder, leaf: int = LEAF, lengths=None, counts=None):
        self.enc, self.leaf, self.encoded = enc, leaf, 0
        if lengths is None:
            self.leaves = list(safe_pieces(text, leaf))
            counts = [self._count(p) for p in self.leaves]
        else:
            self.leaves, at = [], 0
            for n in lengths:
                self.leaves.append(text[at : at + n])
                at += n
        self.chars, self.counts = _sums([len(x) for x in self.leaves]), _sums(counts)

    def _count(self, part: str) -> int:
        self.encoded += len(part)
        return len(self.enc.ids(part)) if part else 0

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def total(self) -> int:
        return self.counts[-1][0]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at ``place`` (the last one beyond the end), and its start."""
        i = begin = 0
        for level in reversed(self.chars[:-1]):
            i *= 2
            if i + 1 < len(level) and begin + level[i] <= place:
                begin += level[i]
                i += 1
        return i, begin

    def replace(self, start: int, end: int, new: str) -> int:
        """Replaces characters ``start`` to ``end`` by ``new``; the new total.

        Positions beyond the text mean its end.
        """
        size = self.chars[-1][0]
        start, end = sorted((min(max(0, start), size), min(max(0, end), size)))
        first, begin = self._leaf_at(start)
        last, last_begin = self._leaf_at(max(start, end - 1))
        part = self.leaves[first][: start - begin] + new + self.leaves[last][max(0, end - last_begin) :]
        # borders that the edit has made unsafe: take in the next leaf that has characters
        while first > 0 and not border_is_safe(self.leaves[first - 1], part):
            first -= 1
            part = self.leaves[first] + part
        while last + 1 < len(self.leaves) and not border_is_safe(part, self.leaves[last + 1]):
            last += 1
            part += self.leaves[last]
        parts = list(safe_pieces(part, self.leaf))
        counts = [self._count(p) for p in parts]
        room = last - first + 1
        if len(parts) > room:
            self.leaves[first : last + 1] = parts
            self.chars = _sums([len(x) for x in self.leaves])
            self.counts = _sums(self.counts[0][:first] + counts + self.counts[0][last + 1 :])
            return self.total
        for k in range(room):
            self.leaves[first + k] = parts[k] if k < len(parts) else ""
            _put(self.chars, first + k, len(self.leaves[first + k]))
            _put(self.counts, first + k, counts[k] if k < len(parts) else 0)
        return self.total


def build(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``id_col, text_col, leaf_lengths, leaf_counts, n_tokens``: the state kept for edits.

    A null text counts as empty: one leaf without tokens. Null, tied and repeated ids are
    passed through row by row; other columns are left out. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in slices(batches):
            trees = [CountTree(t or "", enc, leaf) for t in batch.column(1).to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.chars[0] for t in trees], ints), pa.array([t.counts[0] for t in trees], ints), pa.array([t.total for t in trees], pa.int64())], ["doc_key", "doc_text", "leaf_lengths", "leaf_counts", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("doc_text"))
    schema = T.StructType([rows.schema["doc_key"], rows.schema["doc_text"]]).add("leaf_lengths", T.ArrayType(T.IntegerType())).add("leaf_counts", T.ArrayType(T.IntegerType())).add("n_tokens", "long")
    return rows.mapInArrow(run, schema).withColumnsRenamed({"doc_key": id_col, "doc_text": text_col})


#: An edit replaces the characters from ``start`` to ``end`` of the text as it then is.
EDITS = "array<struct<start:int,end:int,new:string>>"


def apply_edits(state: DataFrame, rank_path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Applies each row's ``edits_col`` (see :data:`EDITS`) in order to the state of :func:`build`.

    The state's columns for the edited text, with ``n_before`` and ``n_recoded``: the
    characters that were encoded again. Null edits change nothing; a null ``new`` is empty,
    null positions are 0. Edits of one document that come as rows are first joined to its
    state by the caller, on the id, so that a document's text moves once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in slices(batches):
            trees, before = [], []
            for text, lengths, counts, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_text", "leaf_lengths", "leaf_counts", "edits")), strict=True):
                tree = CountTree(text or "", enc, leaf, lengths, counts)
                before.append(tree.total)
                for e in edits or ():
                    if e is not None:
                        tree.replace(e["start"] or 0, e["end"] or 0, e["new"] or "")
                trees.append(tree)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array([t.text for t in trees], pa.string()), pa.array([t.chars[0] for t in trees], ints), pa.array([t.counts[0] for t in trees], ints), pa.array([t.total for t in trees], pa.int64()), pa.array(before, pa.int64()), pa.array([t.encoded for t in trees], pa.int64())], ["doc_key", "doc_text", "leaf_lengths", "leaf_counts", "n_tokens", "n_before", "n_recoded"])

    rows = state.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("doc_text"), "leaf_lengths", "leaf_counts", F.col(edits_col).cast(EDITS).alias("edits"))
    schema = T.StructType([rows.schema["doc_key"], rows.schema["doc_text"], rows.schema["leaf_lengths"], rows.schema["leaf_counts"]]).add("n_tokens", "long").add("n_before", "long").add("n_recoded", "long")
    return rows.mapInArrow(run, schema).withColumnsRenamed({"doc_key": id_col, "doc_text": text_col})


def derived_edits(text: Column, doc_id: Column) -> Column:
    """Three edits of a text that follow from it: a word put in, a stretch taken out, one replaced."""
    n = F.length(F.coalesce(text, F.lit("")))
    at = lambda seed: F.when(n > 0, F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), n.cast("long"))).otherwise(F.lit(0)).cast("int")
    edit = lambda start, size, new: F.struct(start.alias("start"), (start + F.lit(size)).alias("end"), new.alias("new"))
    some = F.substring(F.coalesce(text, F.lit("")), 1, 24)
    return F.array(edit(at(1), 0, F.lit(" inserted words")), edit(at(2), 17, F.lit("")), edit(at(3), 9, some)).cast(EDITS)
