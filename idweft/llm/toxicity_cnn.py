"""Toxicity by a small convolutional text classifier, trained in numpy.

Words, and their first four bytes, are hashed into one table of embeddings of a fixed size;
a word's vector is the sum of both. Filters of one, two and three words slide
over them; each keeps its largest response in the document (max pooling), and a logistic
layer turns these into a score. Case in A-Z and punctuation are dropped before hashing.
Language, source and id never enter a score; a threshold is calibrated for each language, on
labelled documents that training leaves out. Every labelled document outside the held-out fold
is used. Their rows are dealt to trainers of some thousands each; in a round every trainer
takes steps from the same model over its rows as they stream by, and what the trainers changed
is averaged by ranges of the embedding table. The driver holds only the model, of a fixed size.
A text crosses the network once, to its trainer, where it meets its label; a Bloom filter of
the labelled ids, of bounded size, leaves most other texts where they are.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweft.llm.storage import discard, written
from idweft.llm.words import mixed, slices, word_hashes

#: Labelled documents that a trainer takes on average, those that it holds at once, and buckets
#: of the embedding table that are averaged together.
TRAINER_ROWS, HELD_ROWS, RANGE = 4_096, 1_024, 8_192
#: Sizes of the model: hash buckets, embedding, widths of the filters, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 12
#: Words of fewer training documents than this have no embedding: they would be learned by heart.
LEAST_DOCS, PREFIX = 4, 4
#: Rounds over the labelled rows, rows of a step, and steps that few rows get at least (within ten times the passes).
EPOCHS, BATCH, LEAST_STEPS = 5, 32, 500
#: What a labelled row is for: steps, the choice of the round that is kept, thresholds.
TRAINS, CHECKS, SETS_LIMITS = 0, 1, 2
#: Words of a text that are convolved at once; the pieces overlap, so every window is seen.
PIECE = 4_096
#: The Bloom filter of labelled ids has a word of 64 bits for so many ids, at most so many words, and bits for an id.
IDS_A_WORD, MOST_WORDS, BITS = 4, 1 << 20, 3
#: Of crc32(id) mod FOLDS: the rows never learned from, and those that only calibrate.
HELD_OUT, CALIBRATES, FOLDS = 0, 1, 5

_TABLE = bytearray(range(256))
for _c in range(128):
    if not chr(_c).isalnum():
        _TABLE[_c] = 32
    elif chr(_c).isupper():
        _TABLE[_c] = _c + 32
_TABLE = bytes(_TABLE)


def buckets(data: bytes | None) -> np.ndarray:
    """Embedding rows of a text's words: of the word itself, and of its first bytes."""
    words = (data or b"").translate(_TABLE).split()
    both = word_hashes(words), mixed(word_hashes([w[:PREFIX] for w in words]))
    return (np.stack(both) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Weights of the classifier, and the score from which each language is flagged."""

    emb: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    default: float = 0.5

    @classmethod
    def new(cls, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype("f4") for w in WIDTHS]
        return cls(rng.normal(0, 0.1, (BUCKETS, DIM)).astype("f4"), filters, np.zeros(n, "f4"), rng.normal(0, 0.1, n).astype("f4"), 0.0)

    @classmethod
    def untrained(cls) -> Model:
        """Scores every text alike, below 0.5."""
        model = cls.new()
        model.out[:], model.bias = 0, -1.0
        return model

    def pool(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, and the word at which its window starts (-1: none).

        The window is padded with nothing: one that reaches past the end uses fewer words.
        """
        n = len(WIDTHS) * FILTERS
        best, where = np.full(n, -np.inf, "f4"), np.full(n, -1, np.int64)
        step = PIECE - max(WIDTHS) + 1
        for begin in range(0, max(1, ids.shape[1] - max(WIDTHS) + 1), step):
            part = self.emb[ids[0, begin : begin + PIECE]] + self.emb[ids[1, begin : begin + PIECE]]
            if not len(part):
                continue
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                got = part @ f[0]
                for j in range(1, min(w, len(part))):
                    got[: len(part) - j] += part[j:] @ f[j]
                at = got.argmax(axis=0)
                top = got[at, np.arange(FILTERS)]
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                more = top > best[s]
                best[s] = np.where(more, top, best[s])
                where[s] = np.where(more, at + begin, where[s])
        return np.where(where >= 0, best, 0.0).astype("f4"), where

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, where = self.pool(ids)
        return np.maximum(best + self.shift, 0) if ids.size else np.zeros_like(best), where

    def score(self, ids: np.ndarray) -> float:
        x = float(self.features(ids)[0] @ self.out + self.bias)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.default)


class Training:
    """A model while it is fit: Adam on the logistic loss, Adagrad for the embeddings that a step touches.

    The gradient of a max passes only to the winning window, so a pass costs little more
    than scoring its documents. ``rare`` are the buckets that are not learned.
    """

    def __init__(self, rare: np.ndarray, seed: int = 3):
        self.model, self.rare = Model.new(seed), rare
        self.model.emb[rare] = 0
        self.params = {"shift": self.model.shift, "out": self.model.out, **{f"f{k}": f for k, f in enumerate(self.model.filters)}}
        self.first = {k: np.zeros_like(p) for k, p in self.params.items()}
        self.second = {k: np.zeros_like(p) for k, p in self.params.items()}
        self.emb2 = np.full(BUCKETS, 1e-8, "f4")
        self.bias1 = self.bias2 = 0.0
        self.t = 0
        self.touched = np.zeros(BUCKETS, np.int64)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weigh: np.ndarray, rate: float = 0.01) -> None:
        model, params = self.model, self.params
        grads = {k: np.zeros_like(p) for k, p in params.items()}
        grad_bias, touched, deltas = 0.0, [], []
        for ids, label, weight in zip(texts, labels, weigh, strict=True):
            if not ids.size:
                continue
            x, where = model.features(ids)
            p = 1 / (1 + np.exp(-np.clip(float(x @ model.out + model.bias), -30, 30)))
            g = np.float32((p - label) * weight / len(texts))
            grads["out"] += g * x
            grad_bias += g
            back = np.where(x > 0, g * model.out, 0).astype("f4")
            grads["shift"] += back
            for k, w in enumerate(WIDTHS):
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                at, gb = where[s], back[s]
                live = np.flatnonzero(gb)
                for j in range(w):
                    inside = live[at[live] + j < ids.shape[1]]
                    if len(inside):
                        words = ids[:, at[inside] + j]
                        grads[f"f{k}"][j].T[inside] += gb[inside, None] * model.emb[words].sum(axis=0)
                        touched += [words[0], words[1]]
                        deltas += [gb[inside, None] * model.filters[k][j].T[inside]] * 2
        self.t += 1
        for k, p in params.items():
            self.first[k] += 0.1 * (grads[k] - self.first[k])
            self.second[k] += 0.001 * (grads[k] ** 2 - self.second[k])
            p -= rate * (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)
        self.bias1 += 0.1 * (grad_bias - self.bias1)
        self.bias2 += 0.001 * (grad_bias**2 - self.bias2)
        model.bias -= float(rate * (self.bias1 / (1 - 0.9**self.t)) / (np.sqrt(self.bias2 / (1 - 0.999**self.t)) + 1e-8))
        if touched:
            words, which = np.unique(np.concatenate(touched), return_inverse=True)
            delta = np.zeros((len(words), DIM), "f4")
            np.add.at(delta, which, np.concatenate(deltas))
            delta[self.rare[words]] = 0
            self.emb2[words] += (delta**2).mean(axis=1)
            model.emb[words] -= 5 * rate * delta / np.sqrt(self.emb2[words])[:, None]
            self.touched[words[~self.rare[words]]] += 1

    def small(self) -> np.ndarray:
        """All but the embeddings, as one vector."""
        parts = [p.ravel() for kind in (self.params, self.first, self.second) for p in kind.values()]
        return np.concatenate([*parts, [self.model.bias, self.bias1, self.bias2, self.t]]).astype("f8")

    def set_small(self, vector: np.ndarray) -> None:
        at = 0
        for kind in (self.params, self.first, self.second):
            for p in kind.values():
                p[...] = vector[at : at + p.size].reshape(p.shape)
                at += p.size
        self.model.bias, self.bias1, self.bias2 = map(float, vector[at : at + 3])
        self.t = round(float(vector[at + 3]))

    def changed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``range, buckets, their embeddings and squares`` of all that steps touched."""
        for k in range(0, BUCKETS, RANGE):
            at = np.flatnonzero(self.touched[k : k + RANGE]) + k
            if len(at):
                yield k, at, np.column_stack([self.model.emb[at], self.emb2[at]])

    def set_changed(self, at: np.ndarray, values: np.ndarray) -> None:
        self.model.emb[at], self.emb2[at] = values[:, :DIM], values[:, DIM]


_PART = "range int, trainer int, weights binary, at binary, data binary"


def _kind(k: int) -> str:
    """Embeddings are kept in the four bytes that they have in the model; the rest of it is small."""
    return "<f8" if k < 0 else "<f4"


def _part(k: int, trainer: int, weights: np.ndarray, at: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    row = [k, trainer, weights.astype("<i4").tobytes(), at.astype("<i4").tobytes(), data.astype(_kind(k)).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["range", "trainer", "weights", "at", "data"])


def _packed(ids: np.ndarray) -> bytes:
    """A word's two buckets side by side: words that recur are equal bytes, which compress."""
    return np.ascontiguousarray(ids.T, "<u4").tobytes()


def _texts(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4").reshape(-1, 2).T for x in column.to_pylist()]


def _trained(start, weigh: np.ndarray, times: int, turn: int):
    """What each trainer makes of the model ``start``; a trainer's rows stand together and stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, training, rows, rng = None, None, 0, None

        def done():
            yield _part(-1, at, np.array([rows]), np.zeros(1), training.small())
            for k, which, values in training.changed():
                yield _part(k, at, training.touched[which], which, values)

        for batch in slices(batches, HELD_ROWS):
            trainers = batch.column("trainer").to_numpy()
            labels, texts = batch.column("label").to_numpy(), _texts(batch.column("words"))
            cuts = [0, *(np.flatnonzero(np.diff(trainers)) + 1).tolist(), len(trainers)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if trainers[begin] != at:
                    if rows:
                        yield from done()
                    at, training, rows = int(trainers[begin]), copy.deepcopy(start.value), 0
                    rng = np.random.default_rng((turn, at))
                for _ in range(times):
                    order = begin + rng.permutation(end - begin)
                    for k in range(0, len(order), BATCH):
                        few = order[k : k + BATCH]
                        training.step([texts[i] for i in few], labels[few], weigh[labels[few]])
                rows += end - begin
        if rows:
            yield from done()

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of a range over the trainers that touched it, by how often; rows sorted by range."""
    k, sums, total = None, None, None

    def done():
        at = np.flatnonzero(total)
        yield _part(k, 0, total[:0], at + max(k, 0), sums[at] / total[at, None])

    for batch in batches:
        for key, _, weights, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            weights, at = np.frombuffer(weights, "<i4").astype("f8"), np.frombuffer(at, "<i4")
            data = np.frombuffer(data, _kind(key)).astype("f8").reshape(len(at), -1)
            if key != k:
                if k is not None:
                    yield from done()
                k, sums, total = key, np.zeros((RANGE if key >= 0 else 1, data.shape[1])), np.zeros(RANGE if key >= 0 else 1)
            sums[at - max(k, 0)] += weights[:, None] * data
            total[at - max(k, 0)] += weights
    if k is not None:
        yield from done()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each bucket occurs."""
    seen = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, HELD_ROWS):
        for ids in _texts(batch.column("words")):
            seen[np.unique(ids)] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "docs"])


_SCORED = "label int, lang string, score double, bits long"


def _scored(shared):
    """``label, lang, score`` of labelled rows, and the score's bits, which order as scores do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD_ROWS):
            scores = np.array([shared.value.score(ids) for ids in _texts(batch.column("words"))], "f8")
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("lang"), pa.array(scores), pa.array(scores.view("i8"))], ["label", "lang", "score", "bits"])

    return run


def train(rows: DataFrame, epochs: int = EPOCHS) -> Model:
    """Fits a model on all ``label, part, trainer, words``, both labels weighed alike.

    The rows that only check, which no step sees, choose the round that is kept.
    """
    spark = rows.sparkSession
    steps, checks = (rows.filter(F.col("part") == part) for part in (TRAINS, CHECKS))
    counts = {r["label"]: r["count"] for r in steps.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model.untrained()
    n = sum(counts.values())
    weigh = np.sqrt(np.array([0.5 / counts[label] * n for label in (0, 1)]))
    passes = max(epochs, min(10 * epochs, LEAST_STEPS * BATCH // n))  # few texts: more often
    often = steps.select("words").mapInArrow(_document_counts, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    rare = np.ones(BUCKETS, bool)
    rare[[r["bucket"] for r in often.select("bucket").collect()]] = False
    training, best, kept = Training(rare), np.inf, None
    for turn in range(epochs):
        start = spark.sparkContext.broadcast(training)
        parts = steps.select("trainer", "label", "words").mapInArrow(_trained(start, weigh, -(-passes // epochs), turn), _PART)
        for r in parts.repartition("range").sortWithinPartitions("range", "trainer", "at", "data").mapInArrow(_averaged, _PART).collect():
            values = np.frombuffer(r["data"], _kind(r["range"]))
            if r["range"] < 0:
                training.set_small(values)
            else:
                training.set_changed(np.frombuffer(r["at"], "<i4"), values.reshape(-1, DIM + 1))
        start.destroy()
        shared = spark.sparkContext.broadcast(training.model)
        right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
        scores = checks.select("label", "lang", "words").mapInArrow(_scored(shared), _SCORED)
        lost = scores.select("label", F.round(-F.log(right + 1e-7), 9).cast("decimal(20,9)").alias("loss")).groupBy("label").agg(F.sum("loss").alias("loss"))
        loss = sum(float(r["loss"]) * weigh[r["label"]] for r in lost.collect())
        shared.destroy()
        if kept is None or loss < best or not loss:
            best, kept = loss, copy.deepcopy(training.model)
    return kept


def calibrate(model: Model, rows: DataFrame, false_alarms: float = 0.005) -> None:
    """Sets each language's threshold: the lowest at which so few clean documents are flagged.

    ``rows`` are ``label, lang, words`` of the documents that set limits; all clean ones count.
    Languages with fewer than 50 clean documents use all languages' threshold. The thresholds
    are exact ranks, found by counting 16 bits of the scores at a time.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    clean = rows.filter("label = 0").select("label", "lang", "words").mapInArrow(_scored(shared), _SCORED)
    groups = F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("all"), F.col("lang"))))
    scores = written(clean.select(groups.alias("of"), "bits"), "scores")
    asked = scores.groupBy("of").agg(F.count("*").alias("n")).filter("n >= 50 or of.all")
    asked = written(asked.select("of", F.ceil((F.col("n") - 1) * F.lit(1 - false_alarms)).cast("long").alias("rank"), F.lit(0).cast("long").alias("high")), "asked")
    for shift in (48, 32, 16, 0):
        rows = scores.join(asked, scores["of"].eqNullSafe(asked["of"])).filter(F.shiftright("bits", shift + 16) == F.col("high"))
        digits = rows.groupBy(asked["of"], "rank", "high", F.shiftright("bits", shift).bitwiseAND(65535).alias("digit")).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = digits.withColumn("below", below).filter("below <= rank and rank < below + n")
        before, asked = asked, written(found.select("of", (F.col("rank") - F.col("below")).alias("rank"), (F.col("high") * 65536 + F.col("digit")).alias("high")), "asked")
        discard(before)
    limits = [(r["of"], max(0.5, float(np.int64(r["high"]).view("f8")))) for r in asked.collect()]
    discard(scores, asked)
    model.default = next((limit for of, limit in limits if of["all"]), 0.5)
    model.thresholds = {of["lang"]: limit for of, limit in limits if not of["all"]}


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 0 by five."""
    return fold(doc_id) == HELD_OUT


def _in_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text that has a label, from rows in which an id's label comes before its texts."""
    of = None, None
    for batch in slices(batches, HELD_ROWS):
        at, labels, words = [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_key", "label", "data")), strict=True)
        for i, (key, label, data) in enumerate(rows):
            if label is not None:
                of = key, label
            elif key == of[0]:
                at.append(i)
                labels.append(of[1])
                words.append(_packed(buckets(data)))
        part, trainer, draw, keys, lang = batch.select(["part", "trainer", "draw", "doc_key", "lang"]).take(pa.array(at, pa.int64())).columns
        yield pa.RecordBatch.from_arrays([part, trainer, draw, keys, pa.array(labels, pa.int32()), lang, pa.array(words, pa.binary())], ["part", "trainer", "draw", "doc_key", "label", "lang", "words"])


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_key").cast("string"))


def maybe_labelled(texts: DataFrame, truth: DataFrame, count: int) -> DataFrame:
    """All rows of ``texts`` whose ``doc_key`` is one of the ``count`` of ``truth``, and some one in a hundred of the others.

    Beyond ``MOST_WORDS * IDS_A_WORD`` ids the filter keeps its size and lets more of the others pass.
    """
    words = min(MOST_WORDS, max(1, count // IDS_A_WORD))
    word = F.pmod(_draw(41), F.lit(words)).alias("word")
    own = reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_draw(43 + i), F.lit(64)).cast("int")) for i in range(BITS))).alias("own")
    held = truth.select(word, own).groupBy("word").agg(F.bit_or("own").alias("held"))
    found = texts.select("*", word, own).join(F.broadcast(held), "word").filter(F.col("held").bitwiseAND(F.col("own")) == F.col("own"))
    return found.select(*texts.columns)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """``draw, label, lang, words, part, trainer`` of every labelled text outside the held-out fold, written by part and trainer.

    Labels and texts are dealt by what an id draws and meet there in order of the id, so no join moves texts before.
    """
    key = F.col("doc_key")
    texts = docs.select(F.col(id_col).alias("doc_key"), F.lit(None).cast("int").alias("label"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    texts = texts.filter("doc_key is not null").filter(~held_out(key))
    truth = labels.select(F.col(id_col).try_cast(texts.schema["doc_key"].dataType).alias("doc_key"), F.col(label_col).cast("int").alias("label")).filter("doc_key is not null and label in (0, 1)")
    truth = truth.groupBy("doc_key").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").filter(~held_out(key))
    truth = written(truth.select("doc_key", "label"), "truth")
    count = truth.count()
    part = F.when(fold(key) == CALIBRATES, SETS_LIMITS).when(F.pmod(_draw(31), F.lit(10)) == 0, CHECKS).otherwise(TRAINS)
    trainer = F.pmod(_draw(37), F.lit(max(1, count // TRAINER_ROWS))).cast("int")
    used = truth.filter((part != SETS_LIMITS) | (F.col("label") == 0)).select("doc_key", "label", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("data"))
    rows = used.unionByName(maybe_labelled(texts, used, count)).select(part.alias("part"), trainer.alias("trainer"), _draw(29).alias("draw"), key.cast("string").alias("doc_key"), "label", "lang", "data")
    dealt = rows.repartition("part", "trainer").sortWithinPartitions("part", "trainer", "draw", "doc_key", F.col("label").desc_nulls_last())
    dealt = dealt.mapInArrow(_in_words, "part int, trainer int, draw long, doc_key string, label int, lang string, words binary").sortWithinPartitions("part", "trainer", "draw", "doc_key", "words")
    out = written(dealt, "labelled", HELD_ROWS, by=("part", "trainer"), codec="zstd")
    discard(truth)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", epochs: int = EPOCHS) -> Model:
    """Fits on all labelled whole texts outside the held-out fold, of any length.

    Thresholds are set on all clean documents of a fold that training leaves out. Labels or ids
    that are null, and labels that disagree for one id, say nothing and are left out; rows that
    share an id have its label, each text of them. Without both labels the model stays
    untrained and scores 0.5 or less. Few texts are passed over more often: ``epochs`` times,
    or until some ``LEAST_STEPS`` steps are made, at most ten times ``epochs``.
    """
    rows = labelled(docs, labels, id_col, text_col, lang_col, label_col)
    model = train(rows, epochs)
    if model.out.any():
        calibrate(model, rows.filter(F.col("part") == SETS_LIMITS))
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, score, threshold, toxic`` for every document, in one pass without a shuffle.

    ``toxic`` is whether the score of the whole text reaches the threshold of its language
    (one not seen in training uses the common threshold). A null or empty text has no word
    and gets the score of the bias alone. Rows are passed through one by one, null and tied
    ids too; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(buckets(x)) for x in batch.column("data").to_pylist()]
            least = [m.threshold(x) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array(scores, pa.float64()), pa.array(least, pa.float64()), pa.array([s >= t for s, t in zip(scores, least, strict=True)], pa.bool_())], ["doc_key", "score", "threshold", "toxic"])

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("data"), F.col(lang_col).cast("string").alias("lang"))
    schema = T.StructType([rows.schema["doc_key"]]).add("score", "double").add("threshold", "double").add("toxic", "boolean")
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_key", id_col)


def toxic_flag(spark: SparkSession, model: Model):
    """A Column function of (text, lang): whether :func:`score` would call the row toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def flag(text: pd.Series, lang: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(buckets((t or "").encode())) >= m.threshold(x) for t, x in zip(text, lang, strict=True)], dtype=bool)

    return flag
