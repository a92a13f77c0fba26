"""Maximal periodic runs of words, found online by catchers over completed dyadic blocks.

Words arrive in order. Every aligned block of 2^k words, once complete, becomes a catcher: it
waits for its own words to come again, some q words later, where q lies in the range of
periods that level k answers for. Each appended word completes one window of every block
size; a window that equals a live catcher's block is a hit (block, q), and comparing words
leftwards and rightwards from it gives the longest stretch of period q around it. A stretch
of two periods or more is a square's, squares of one period that overlap lie in one stretch,
and what reaches the end of the words so far stays open and grows as words are appended.

Which level answers for a period follows from the shortest run that counts: a run of at least
max(least, times * q) words holds an aligned block of 2^k words, and its copy q later, as
long as 2^(k+1) - 1 <= max(least, times * q) - q. So no run is missed, a catcher lives for
2^(k+1) words or so, and each word is compared with one or two catchers of each level.

Windows are compared by 64-bit hashes that are built from those of their halves; stretches
are compared word by word (64-bit hashes of words), so a false hit costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.llm.words import WORD, mixed, slices, word_hashes

LEAST, TIMES = 24, 3
#: Words that are appended at once, and that the texts looked at together have at least.
APPENDED = 1 << 16
_RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
_LEFT, _BREAK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def levels(least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """``(k, q)`` for ascending k: level k answers for periods from q to the next level's.

    With blocks of 2^k words, q is the smallest period from which on every run has room for one.
    """
    room = lambda q: max(least, times * q) - q
    lowest = min(map(room, range(1, least + 1)))
    out = [((lowest + 1).bit_length() - 2, 1)]
    while len(out) < 40:
        k = out[-1][0] + 1
        out.append((k, -(-((1 << (k + 1)) - 1) // (times - 1))))  # room(q) = (times - 1) q there
    return out


class Catchers:
    """The runs of a growing sequence of word hashes.

    ``longest`` bounds a run's length where it is known, so that levels beyond it are left out.
    """

    def __init__(self, least: int = LEAST, times: int = TIMES, longest: int | None = None):
        self.least, self.times = least, times
        steps = levels(least, times)
        self.levels = {k: (low, high) for (k, low), (_, high) in zip(steps[:-1], steps[1:], strict=True) if longest is None or max(least, times * low) <= longest}
        self.words, self.n = np.zeros(0, np.uint64), 0
        self.tails: dict[int, np.ndarray] = {}  # the last 2^k window hashes of level k
        self.blocks: dict[int, tuple[int, np.ndarray]] = {}  # live catchers: number of the first, hashes
        self.stretches: dict[int, tuple[int, int]] = {}  # of each period, the last one found
        self.open: list[tuple[int, int]] = []  # (start, period) of stretches that reach the end
        self.closed: list[tuple[int, int, int]] = []  # (start, end, period) of runs

    def append(self, hashes: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(hashes)
        if self.n > len(self.words):
            grown = np.empty(max(2 * len(self.words), self.n), np.uint64)
            grown[:old] = self.words[:old]
            self.words = grown
        self.words[old : self.n] = hashes
        still, self.open = self.open, []
        for start, period in still:
            self._keep(start, old + self._common(old - period, old), period)
        windows = hashes
        for k in range(max(self.levels, default=-1) + 1):
            size, first = 1 << k, max(old - (1 << k) + 1, 0)  # the first window that ends among the new words
            if not len(windows):
                break
            if k in self.levels:
                self._meet(k, first, windows)
            both = np.concatenate([self.tails.get(k, windows[:0]), windows])
            self.tails[k] = both[-size:].copy()
            windows = mixed(both[:-size] * _LEFT + both[size:]) if len(both) > size else both[:0]

    def _meet(self, k: int, first: int, windows: np.ndarray) -> None:
        """Compares the new windows of level k, from ``first`` on, with its catchers."""
        (low, high), size = self.levels[k], 1 << k
        base, live = self.blocks.get(k, (0, windows[:0]))
        live = np.concatenate([live, windows[-first % size :: size]])
        places = np.arange(first, first + len(windows))
        hits = []
        newest = (places - low) >> k
        for back in range(-(-(high - low) // size)):
            block = newest - (back + base)
            ok = np.flatnonzero((block >= 0) & (places - ((block + base) << k) < high))
            ok = ok[windows[ok] == live[block[ok]]]
            start = (block[ok] + base) << k
            hits.append(np.stack([places[ok] - start, start]))
        retired = max(((first + len(windows) - high) >> k) - base, 0)
        self.blocks[k] = (base + retired, live[retired:])
        found = np.concatenate(hits, axis=1)
        if found.shape[1]:
            self._follow(found[0], found[1], size)

    def _follow(self, periods: np.ndarray, starts: np.ndarray, size: int) -> None:
        """Turns hits into stretches, periods and starts ascending; hits inside known ones are passed over."""
        known = self._cover()
        new = self._outside(known, periods, starts)
        periods, starts = periods[new], starts[new]
        order = np.lexsort((starts, periods))
        periods, starts = periods[order], starts[order]
        count = len(self.closed) + len(self.open)
        for group in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(periods)) + 1) if len(periods) else ():
            q, at = int(periods[group[0]]), starts[group]
            if count != len(self.closed) + len(self.open):
                known, count = self._cover(), len(self.closed) + len(self.open)
            at = at[self._outside(known, q, at)]
            done = self.stretches.get(q, (0, -1))
            at = at[(at < done[0]) | (at + q + size > done[1])]
            while len(at):
                s = int(at[0])
                right = self._common(s, s + q)
                if right < size:
                    at = at[1:]
                    continue
                end = s + q + right
                self._keep(s - self._common_left(s, s + q), end, q)
                at = at[at + q + size > end]

    def _cover(self):
        """Of the runs so far by start: starts, the furthest end of those up to there, and its period."""
        runs = self.closed + [(s, self.n, q) for s, q in self.open if self._counts(s, self.n, q)]
        if not runs:
            return None
        start, end, period = np.array(sorted(runs)).T
        best = np.maximum.accumulate(end)
        leads = np.maximum.accumulate(np.where(end == best, np.arange(len(end)), 0))
        return start, best, period[leads]

    @staticmethod
    def _outside(cover, periods, starts: np.ndarray) -> np.ndarray:
        """Which hits lie in no known run of a divisor of their period.

        Such a run with a whole period of the hit's stretch inside holds all of the stretch.
        """
        if cover is None:
            return np.ones(len(starts), bool)
        i = np.searchsorted(cover[0], starts, "right") - 1
        return (i < 0) | (cover[1][i] < starts + periods) | (periods % cover[2][i] != 0)

    def _counts(self, start: int, end: int, period: int) -> bool:
        return end - start >= max(self.least, self.times * period)

    def _keep(self, start: int, end: int, period: int) -> None:
        self.stretches[period] = (start, end)
        if end == self.n:
            self.open.append((start, period))
        elif self._counts(start, end, period):
            self.closed.append((start, end, period))

    def _common(self, a: int, b: int) -> int:
        """How many words from a on equal those from b on, a < b."""
        words, total, step = self.words, 0, 32
        while b + total < self.n:
            c = min(step, self.n - b - total)
            other = np.flatnonzero(words[a + total : a + total + c] != words[b + total : b + total + c])
            if len(other):
                return total + int(other[0])
            total, step = total + c, min(4 * step, 1 << 20)
        return total

    def _common_left(self, a: int, b: int) -> int:
        """How many words before a equal those before b, a < b."""
        words, total, step = self.words, 0, 32
        while total < a:
            c = min(step, a - total)
            other = np.flatnonzero(words[a - total - c : a - total] != words[b - total - c : b - total])
            if len(other):
                return total + c - 1 - int(other[-1])
            total, step = total + c, min(4 * step, 1 << 20)
        return total

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, end, smallest period)`` of every run so far, by start, then period."""
        found: dict[tuple[int, int], int] = {}
        for start, end, period in self.closed + [(s, self.n, q) for s, q in self.open if self._counts(s, self.n, q)]:
            found[start, end] = min(period, found.get((start, end), period))
        return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words. All go through the same catchers, a word of its own after each text."""
    sizes = [len(words) for words in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if max(sizes, default=0) < least:
        return out
    catchers = Catchers(least, times, max(sizes))
    breaks = mixed(np.arange(1, len(texts) + 1, dtype=np.uint64) * _BREAK)
    parts: list[np.ndarray] = []
    held = 0
    for words, after in zip(texts, breaks, strict=True):
        for begin in range(0, len(words), APPENDED):
            parts.append(word_hashes(words[begin : begin + APPENDED]))
            held += len(parts[-1])
            if held >= APPENDED:
                catchers.append(np.concatenate(parts))
                parts, held = [], 0
        parts.append(after[None])
    catchers.append(np.concatenate(parts))
    begins = np.cumsum([0, *(n + 1 for n in sizes)])
    for start, end, period in catchers.runs():
        i = int(np.searchsorted(begins, start, "right")) - 1
        out[i].append((start - int(begins[i]), end - int(begins[i]), period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        steps[start + period] += 1
        steps[end] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``id_col, n_words, runs, collapsed_text`` for every document, without a shuffle.

    ``runs`` are ``(start, length, period)`` by start, then period: stretches of consecutive
    words of smallest period ``period`` that cannot be extended, of at least ``least`` words
    and ``times`` periods (2 or more). ``collapsed_text`` leaves out every word that a run
    holds after its first period and joins the others by one space. A null or empty text has
    no words, no runs and an empty collapsed text. Null, tied and repeated ids are passed
    through row by row; other columns are left out. Texts are read whole, at any length.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def flush(keys, texts):
        found = runs_of_texts(texts, least, times)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        runs = [[{"start": s, "length": e - s, "period": q} for s, e, q in r] for r in found]
        short = [(collapsed(w, r) if r else b" ".join(w)).decode() for w, r in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(map(len, texts), pa.int64()), pa.array(runs, kind), pa.array(short, pa.string())], ["doc_key", "n_words", "runs", "collapsed_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for batch in slices(batches, 64):
            keys.append(batch.column(0))
            texts += [(data or b"").split() for data in batch.column(1).to_pylist()]
            held += sum(map(len, texts[-batch.num_rows :]))
            if held >= APPENDED or len(texts) >= 1_024:
                yield flush(keys, texts)
                keys, texts, held = [], [], 0
        if texts:
            yield flush(keys, texts)

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("data"))
    schema = T.StructType([rows.schema["doc_key"]]).add("n_words", "long").add("runs", T.ArrayType(_RUN)).add("collapsed_text", "string")
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_key", id_col)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period, the first of equal ones; null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col``; where crc32 of the decimal id ends in 0, words repeat from one of them on.

    With g = crc32 div 10 and n words, the words from a = g % n on are replaced by the first
    p = 1 + (n - a) div (3 + g % 8) of them, again and again up to n words.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("doc_text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("doc_text"), F.lit(WORD), F.lit(0)))
    placed = chosen.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    placed = placed.withColumn("a", F.expr("CASE WHEN n > 0 THEN int(g % n) END")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a + p - 1) div p))), 1, int(n - a))"
    text = F.expr(f"CASE WHEN n > 0 THEN array_join(concat(slice(w, 1, a), {tail}), ' ') ELSE doc_text END")
    return placed.select(F.col("doc_key").alias(id_col), text.alias(text_col))
