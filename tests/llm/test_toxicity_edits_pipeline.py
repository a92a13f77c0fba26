"""The classifier on held-out rows, edit-aware counts against recounts, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from idweft.llm import byte_bpe, edit_counts, secret_scan, source_mix, toxicity_cnn
from tests.llm.data import PATTERN, RANKS, prose, rows, table
from tests.llm.test_dedup_join_store_ann import plain_join
from tests.llm.test_scan_mix_bands_bpe import SECRETS, plain_spans

BAD = ["grumblefoo", "snarkbar", "vexbaz"]


def labelled(n=500, seed=2):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(5, 90)).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD).upper() + ",")
        data.append((i, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2"]), 0, None))
        labels.append((i, int(bad)))
    return data, labels


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    data, labels = labelled()
    docs = table(spark, data + rows()[:12])
    truth = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity_cnn.fit(docs, truth, epochs=4)
    out = toxicity_cnn.score(docs, model)
    got = out.withColumn("held_out", toxicity_cnn.held_out(out.doc_id)).collect()
    assert len(got) == len(data) + 12 and all(0 <= r["score"] <= 1 for r in got)
    want = dict(labels)
    fold = [(r["score"] >= 0.5) == bool(want[r["doc_id"]]) for r in got[: len(data)] if r["held_out"] and r["doc_id"] in want]
    assert np.mean(fold) > 0.9
    flag = toxicity_cnn.toxic_flag(spark, model)
    flagged = docs.select("doc_id", flag("text", "lang").alias("toxic")).collect()
    assert Counter((r[0], r[1]) for r in flagged) == Counter((r["doc_id"], r["toxic"]) for r in got)


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    data, labels = labelled(60)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = truth.withColumn("toxic", (1 - truth.toxic).cast("int")).filter(toxicity_cnn.held_out(truth.doc_id)).unionByName(truth.filter(~toxicity_cnn.held_out(truth.doc_id)))
    a, b = (toxicity_cnn.fit(table(spark, data), t, epochs=1) for t in (truth, turned))
    assert np.array_equal(a.emb, b.emb) and a.bias == b.bias


def test_toxicity_without_labels(spark):
    truth = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity_cnn.fit(table(spark), truth)
    assert all(r["score"] < 0.5 for r in toxicity_cnn.score(table(spark), model).collect())


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """more rows than one trainer takes, a text beyond any limit on its length, and exact thresholds."""
    monkeypatch.setattr(toxicity_cnn, "TRAINER_ROWS", 60)
    data, labels = labelled(500)
    at = next(i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 3)
    data[at] = (at, data[at][1] + " longtail" * 60_000, *data[at][2:])
    docs, truth = table(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity_cnn.labelled(docs, truth)
    got = rows.collect()
    parts = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in labels}
    want = Counter((y, parts[i] == 1) for i, y in labels if parts[i] > 1 or (parts[i] == 1 and not y))
    assert Counter((r["label"], r["part"] == toxicity_cnn.SETS_LIMITS) for r in got) == want
    assert max(len(r["words"]) for r in got) > 8 * 60_000 and len({r["trainer"] for r in got}) > 3
    model = toxicity_cnn.fit(docs, truth, epochs=3)
    scores = toxicity_cnn.score(docs, model).collect()
    clean = [(r["score"], data[r["doc_id"]][2]) for r in scores if parts[r["doc_id"]] == 1 and not labels[r["doc_id"]][1]]
    limit = lambda lang: max(0.5, np.quantile([x for x, of in clean if of == lang or lang == "all"], 0.995, method="higher"))
    assert model.default == limit("all")
    assert all(model.thresholds.get(of) == (limit(of) if sum(x == of for _, x in clean) >= 50 else None) for of in ("en", "fr", None))
    fold = [(r["score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in scores if parts[r["doc_id"]] == 0]
    assert np.mean(fold) > 0.9


def test_toxicity_texts_cross_the_network_once(spark, monkeypatch):
    """labels and texts meet where the text is trained on, and texts without a label stay behind, with no table broadcast for its size."""
    monkeypatch.setattr(toxicity_cnn, "TRAINER_ROWS", 60)
    monkeypatch.setattr(toxicity_cnn, "HELD_ROWS", 3)
    plans, real = {}, toxicity_cnn.written

    def noted(df, name, *more, **others):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *more, **others)

    monkeypatch.setattr(toxicity_cnn, "written", noted)
    data, labels = labelled(300)
    data += [(i, f"again {i}", None, None, 0, None) for i in range(0, 300, 7)] + [(11, None, "en", None, 0, None), (None, "no id", "en", None, 0, None)]
    data += [(1000 + i, "unlabelled", "en", None, 0, None) for i in range(200)]
    labels += [(8, 1 - labels[8][1]), (9, labels[9][1]), (None, 1), (5000, 1)]
    # ids of another type: compared as the documents' own, what is no number is nobody's
    truth = spark.createDataFrame([*((None if i is None else str(i), y) for i, y in labels), ("x7", 1)], "doc_id string, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toxicity_cnn.labelled(table(spark, data), truth).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = {i: zlib.crc32(str(i).encode()) % 5 for i in range(300)}
    known = {i: y for i, y in labels[:300] if i != 8 and parts[i] and (parts[i] > 1 or not y)}
    words = lambda t: toxicity_cnn.buckets((t or "").encode()).T.astype("<u4").tobytes()
    want = Counter((str(r[0]), known[r[0]], r[2], words(r[1])) for r in data if r[0] in known)
    assert Counter((r["doc_key"], r["label"], r["lang"], bytes(r["words"])) for r in got) == want
    assert "SortMergeJoin" not in plans["labelled"] and plans["labelled"].count("Exchange hashpartitioning(part") == 1
    docs, few = spark.range(20_000).withColumnRenamed("id", "doc_key"), spark.range(0, 20_000, 10).withColumnRenamed("id", "doc_key")
    passed = {r[0] for r in toxicity_cnn.maybe_labelled(docs, few, 2_000).collect()}
    assert passed >= set(range(0, 20_000, 10)) and len(passed) < 2_000 + 18_000 * 0.03


def test_trainers_send_embeddings_as_they_are(spark):
    """F2: four bytes a value, as the model has them; the rest of the model keeps its precision."""
    sent = toxicity_cnn._part(0, 1, np.array([3]), np.array([7]), np.full((1, toxicity_cnn.DIM + 1), 0.1, "f4"))
    assert sum(len(sent.column(c)[0].as_py()) for c in ("weights", "at", "data")) == 4 * (toxicity_cnn.DIM + 3)
    both = [toxicity_cnn._part(k, t, np.array([n]), np.array([k if k > 0 else 0]), np.array([[x] * 17], "f8")) for k in (-1, 0) for t, n, x in ((1, 1, 0.5), (2, 3, 0.1))]
    out = [r for b in toxicity_cnn._averaged(iter(both)) for r in b.to_pylist()]
    mean = (0.5 + 3 * 0.1) / 4
    assert np.allclose(np.frombuffer(out[0]["data"], "<f8"), mean, rtol=1e-15) and np.allclose(np.frombuffer(out[1]["data"], "<f4"), mean, rtol=1e-6)


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    model = toxicity_cnn.Model.new()
    ids = toxicity_cnn.buckets(prose(random.Random(1), 900).encode())
    whole = model.pool(ids)[0]
    monkeypatch.setattr(toxicity_cnn, "PIECE", 50)
    assert np.allclose(model.pool(ids)[0], whole, atol=1e-5)


# ---- edit-aware counts


@pytest.mark.parametrize("leaf", [8, 64, 512])
def test_edits_equal_a_recount(leaf):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    rng = random.Random(leaf)
    for r in rows()[:30]:
        text = r[1] or ""
        tree = edit_counts.CountTree(text, enc, leaf)
        assert tree.total == len(enc.split.encode_ordinary(text))
        for _ in range(25):
            a = rng.randrange(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 3, 40, 700])
            new = rng.choice(["", " ", "x", "  ", "\n", " word", "word ", "'s", "é", prose(rng, 30), " 1"])
            a, b = sorted((min(a, len(text)), min(b, len(text))))
            text = text[:a] + new + text[b:]
            assert tree.replace(a, b, new) == len(enc.split.encode_ordinary(text))
            assert tree.text == text and tree.chars[0] == [len(x) for x in tree.leaves]
            for sums in (tree.chars, tree.counts):
                assert all(s == sum(sums[k][2 * i : 2 * i + 2]) for k, level in enumerate(sums[1:]) for i, s in enumerate(level))


def test_edits_touch_few_characters():
    enc = byte_bpe.encoding(RANKS, PATTERN)
    for text in (prose(random.Random(3), 20_000), "слово и дело, " * 20_000, "中文没有空格，但有标点。" * 20_000):
        tree = edit_counts.CountTree(text, enc)
        before = tree.encoded
        tree.replace(50_000, 50_010, "changed")
        assert before == len(text) and tree.encoded - before < 6 * edit_counts.LEAF
        assert tree.total == len(enc.split.encode_ordinary(tree.text)) and len(tree.leaves) > 150


def test_edits_in_a_table(spark):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    state = edit_counts.build(table(spark), RANKS, PATTERN)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in state.collect()) == Counter((r[0], len(enc.split.encode_ordinary(r[1] or ""))) for r in rows())
    out = edit_counts.apply_edits(state.withColumn("edits", edit_counts.derived_edits(state.text, state.doc_id)), RANKS, PATTERN).collect()
    assert len(out) == len(rows())
    for r in out:
        assert r["n_tokens"] == len(enc.split.encode_ordinary(r["text"])) and r["n_tokens"] == sum(r["leaf_counts"])
    none = state.withColumn("edits", state.doc_id.cast("string").cast("binary")).selectExpr("doc_id", "text", "leaf_lengths", "leaf_counts", "cast(null as array<struct<start:int,end:int,new:string>>) as edits")
    assert all(r["n_tokens"] == r["n_before"] and r["n_recoded"] == 0 for r in edit_counts.apply_edits(none, RANKS, PATTERN).collect())


# ---- pipeline


def test_pipeline_equals_plain_stages(spark, tmp_path):
    data, labels = labelled(120)
    data += [(1000 + (r[0] or 0), *r[1:]) for r in rows() if r[0] is not None][:-2]
    data += [(2000 + i, (t or "") + " " + prose(random.Random(i), 20), "en", "s2", 0, None) for i, t in enumerate(SECRETS)]
    docs = table(spark, data)
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(now)
    kept, unique, clean, mix, ids = steps
    model = toxicity_cnn.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in data if model.score(toxicity_cnn.buckets((r[1] or "").encode())) < model.threshold(r[2])]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in left)
    first = [r for r, (_, _, group) in zip(left, plain_join(left), strict=True) if r[0] == group]
    assert Counter(r["doc_id"] for r in unique.collect()) == Counter(r[0] for r in first)
    plain = {r[0]: (r[1], sorted({s for rule in secret_scan.RULES for s in plain_spans(r[1], rule)})) for r in first}
    for r in clean.collect():
        text, spans = plain[r["doc_id"]]
        assert (r["text"] == text) == (not spans) and list(clean.columns) == list(corpus_pipeline.COLUMNS)
        assert not spans or "[SECRET]" in r["text"]
    copies = {r["doc_id"]: r["copies"] for r in source_mix.mix(clean).collect()}
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({k: v for k, v in copies.items() if v})
    enc = byte_bpe.encoding(RANKS, PATTERN)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in ids.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.split.encode_ordinary(texts[r["doc_id"]] or "") and 4 * r["n_tokens"] == len(r["ids"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == Counter((r["doc_id"], r["ids_sha256"]) for r in ids.collect())
    assert public_tokenizers.PATTERN == PATTERN


def test_pipeline_stages_in_python_bound_their_batches(spark, monkeypatch):
    """whoever writes a stage's result does so in batches of the session's size, so encode writes its own in small ones."""
    asked, real = {}, corpus_pipeline.written

    def noted(df, name, *more):
        asked[name] = more
        return real(df, name, *more)

    monkeypatch.setattr(corpus_pipeline, "written", noted)
    out = corpus_pipeline.encode(spark, table(spark), "")
    assert asked["encoded"][0] <= 256 and "MapInArrow" not in out._jdf.queryExecution().toString()
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows())
