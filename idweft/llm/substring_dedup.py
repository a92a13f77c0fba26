"""Removal of passages that an earlier document holds, by runs of repeated window hashes.

This replaces greedy relative Lempel-Ziv parsing: the index holds no positions, no longest
match is extended against one reference, and a factor below is a run of repeated windows
without (document, position, length). What is removed is every window that an earlier
document holds, which needs no reference text beside the document.

Every document is cut into content-defined blocks: each window of 50 words belongs to the
smallest hash among its 8-word grams (its anchor), and a block is a run of windows with one
anchor. Windows with the same words have the same anchor wherever they stand, so a window
can only repeat inside blocks that share an anchor. The reference index holds every block
under its anchor with the first document that has it. A document is then factored against
that index, left to right: a factor runs on while its windows start in an earlier document.
Whole equal blocks extend a factor at once; where a factor begins or ends inside a block,
the block's windows are compared one by one. Factors of at least 50 words are duplicates.

Keys are two independent 64-bit hashes (anchor and content). What crosses the network is
one row for each block (about one for 22 words), the windows of blocks at factor boundaries,
and each text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.llm.storage import discard, written
from idweft.llm.words import Rolling, mixed, word_hashes

WINDOW, GRAM = 50, 8


class Blocks:
    """Windows and blocks of one text's words."""

    def __init__(self, words: list[bytes], window: int = WINDOW, gram: int = GRAM):
        hashes = word_hashes(words)
        self.window, self.rolling = window, Rolling(hashes)
        grams = Rolling(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))).windows(gram)
        span, width = window - gram + 1, 1
        while 2 * width <= span:  # smallest of 1, 2, 4 ... grams, then of all in a window
            grams = np.minimum(grams[:-width], grams[width:])
            width *= 2
        if width < span:
            grams = np.minimum(grams[: len(grams) - (span - width)], grams[span - width :])
        self.anchors = grams  # of each window
        cuts = np.flatnonzero(grams[1:] != grams[:-1]) + 1
        self.first = np.concatenate([[0], cuts])
        self.last = np.concatenate([cuts, [len(grams)]])  # exclusive
        self.content = self.rolling.ranges(self.first, self.last + (window - 1))

    def members(self, which: np.ndarray) -> np.ndarray:
        """For each window, whether its block is among ``which`` (booleans by block)."""
        return np.repeat(which, self.last - self.first)

    def window_hashes(self) -> np.ndarray:
        return self.rolling.windows(self.window)


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, contents, ids, counts = [], [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                words = (data or b"").split()
                if len(words) < window:
                    continue
                b = Blocks(words, window, gram)
                pairs = np.unique(np.stack([b.anchors[b.first], b.content]), axis=1) if len(b.first) > 1 else np.stack([b.anchors[b.first], b.content])
                anchors.append(pairs[0])
                contents.append(pairs[1])
                ids.append(i)
                counts.append(pairs.shape[1])
            if ids:
                keys = batch.column(0).take(pa.array(np.repeat(ids, counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(contents).view(np.int64)), keys], ["anchor", "block", "doc_key"])

    return run


def _edge_windows(window: int, gram: int):
    """Windows of the blocks listed in ``edges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, windows, ids, counts = [], [], [], []
            for i, (data, edges) in enumerate(zip(batch.column("data").to_pylist(), batch.column("edges"), strict=True)):
                if not edges.is_valid or len(edges) == 0:
                    continue
                words = (data or b"").split()
                if len(words) < window:
                    continue
                b = Blocks(words, window, gram)
                at = b.members(np.isin(b.content.view(np.int64), edges.values.to_numpy()))
                pairs = np.unique(np.stack([b.anchors[at], b.window_hashes()[at]]), axis=1)
                anchors.append(pairs[0])
                windows.append(pairs[1])
                ids.append(i)
                counts.append(pairs.shape[1])
            if ids:
                keys = batch.column("doc_key").take(pa.array(np.repeat(ids, counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(windows).view(np.int64)), keys], ["anchor", "hit", "doc_key"])

    return run


def _factor(window: int, gram: int):
    """Factors of each text, from its repeated blocks and windows."""

    def spans(words, blocks, hits):
        b = Blocks(words, window, gram)
        same = np.zeros(len(b.anchors), bool)
        if blocks is not None:
            same |= b.members(np.isin(b.content.view(np.int64), blocks))
        if hits is not None:
            same |= np.isin(b.window_hashes().view(np.int64), hits)
        out, end = [], -1
        for start in np.flatnonzero(same).tolist():  # greedy: a factor runs on while it can
            if start <= end:
                out[-1][1] = start + window
            else:
                out.append([start, start + window])
            end = start + window
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, factors, kept = [], [], [], []
            for data, blocks, hits in zip(batch.column("data").to_pylist(), batch.column("blocks"), batch.column("hits"), strict=True):
                words = (data or b"").split()
                known = [x.values.to_numpy() if x.is_valid and len(x) else None for x in (blocks, hits)]
                found = spans(words, *known) if len(words) >= window and any(k is not None for k in known) else []
                at, left = 0, []
                for start, end in found:
                    left += words[at:start]
                    at = end
                left += words[at:]
                n_words.append(len(words))
                removed.append(len(words) - len(left))
                factors.append([{"start": s, "end": e} for s, e in found])
                kept.append(b" ".join(left).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(factors, kind), pa.array(kept, pa.string())], ["doc_key", "n_words", "n_removed", "factors", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col, n_words, n_removed, factors, kept_text`` for every document.

    ``factors`` are word ranges ``(start, end)`` whose every window of ``window`` words also
    starts in a document with a smaller id; ``kept_text`` joins the other words by a space.
    A null or empty text, or one shorter than a window, keeps all it has. Rows with equal ids
    don't count as earlier than each other. A row with a null id is neither earlier nor
    later than any, and keeps all its words. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("data"))
    key = rows.schema["doc_key"].dataType
    schema = lambda *names: T.StructType([*[T.StructField(n, T.LongType()) for n in names], T.StructField("doc_key", key)])
    blocks = written(rows.filter("doc_key is not null").mapInArrow(_blocks(window, gram), schema("anchor", "block")), "blocks")
    # the reference index: each block with the first document that has it, under anchors that
    # two documents or more have; both sums are made before rows are exchanged
    first = blocks.groupBy("anchor", "block").agg(F.min("doc_key").alias("first"), F.max("doc_key").alias("last"))
    first = written(first, "first")
    anchors = first.groupBy("anchor").agg(F.min("first").alias("low"), F.max("last").alias("high"), (F.count("*") > 1).alias("several")).filter("low < high").select("anchor", "several")
    index = written(first.join(anchors, "anchor").select("anchor", "block", "first", "several"), "index")
    judged = blocks.join(index, ["anchor", "block"])
    marks = (
        judged.filter("doc_key > first or several").groupBy("doc_key")
        .agg(F.collect_list(F.when(F.expr("doc_key > first"), F.col("block"))).alias("blocks"), F.collect_list(F.when(F.expr("doc_key = first"), F.col("block"))).alias("edges"))
    )
    marks = written(marks, "marks")
    discard(blocks, first, index)
    # one exchange of the texts serves all three reads below
    dealt = rows.filter("doc_key is not null").repartition("doc_key")
    edges = dealt.join(marks.select(F.col("doc_key").alias("marked"), "blocks", "edges"), F.col("doc_key") == F.col("marked"), "left").drop("marked")
    windows = edges.select("doc_key", "data", "edges").mapInArrow(_edge_windows(window, gram), schema("anchor", "hit"))
    earliest = windows.groupBy("anchor", "hit").agg(F.min("doc_key").alias("first"), F.max("doc_key").alias("last")).filter("first < last").drop("last")
    hits = windows.join(earliest, ["anchor", "hit"]).filter("doc_key > first").groupBy(F.col("doc_key").alias("hit_key")).agg(F.collect_list("hit").alias("hits"))
    out = f"doc_key {key.simpleString()}, n_words long, n_removed long, factors array<struct<start:long,end:long>>, kept_text string"
    joined = edges.join(hits, F.col("doc_key") == F.col("hit_key"), "left").select("doc_key", "data", "blocks", "hits")
    none = F.lit(None).cast("array<long>")
    joined = joined.unionByName(rows.filter("doc_key is null").select("doc_key", "data", none.alias("blocks"), none.alias("hits")))
    return joined.mapInArrow(_factor(window, gram), out).withColumnRenamed("doc_key", id_col)
