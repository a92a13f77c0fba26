"""Substring dedup, the Jaccard join, the token store and vector search against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from idweft.llm import multi_index_hash, ngram_join, substring_dedup, token_store
from idweft.llm.components import components
from tests.llm.data import prose, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def same(found, wanted):
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted))


# ---- substring dedup


def plain_dedup(data, window=50):
    starts = defaultdict(list)
    for r in data:
        words = WORD.findall(r[1] or "")
        if r[0] is not None:
            for i in range(len(words) - window + 1):
                starts[tuple(words[i : i + window])].append(r[0])
    for r in data:
        words = WORD.findall(r[1] or "")
        gone = set()
        if r[0] is not None:
            for i in range(len(words) - window + 1):
                if min(starts[tuple(words[i : i + window])]) < r[0]:
                    gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        yield r[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def repeated(seed):
    """Documents cut and pasted from a few passages, so that factors meet and overlap."""
    rng = random.Random(seed)
    passages = [prose(rng, n).split() for n in (49, 50, 51, 80, 200)] + [["again"] * 130]
    data = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            cut = rng.randrange(0, len(p) // 3)
            words += p[cut : len(p) - rng.randrange(0, 20)] + (prose(rng, rng.randrange(0, 9)).split() if rng.random() < 0.7 else [])
        data.append((rng.randrange(60), " ".join(words), None, None, 0, None))
    return data


@pytest.mark.parametrize("data", [rows(), repeated(1), repeated(2), []], ids=["odd", "cut1", "cut2", "none"])
def test_dedup_matches_a_plain_loop(spark, data):
    got = substring_dedup.remove_repeats(table(spark, data)).collect()
    same([(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got], plain_dedup(data))
    for r in got:
        assert sum(f["end"] - f["start"] for f in r["factors"]) == r["n_removed"]
        assert all(f["end"] - f["start"] >= 50 for f in r["factors"])


# ---- n-gram Jaccard join


def plain_sets(data):
    for r in data:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        yield frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_join(data):
    sets = list(plain_sets(data))
    up = {r[0]: r[0] for r in data}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if data[i][0] is not None and data[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(data[i][0]), top(data[j][0])))
                up[y] = x
    return [(r[0], len(s), None if r[0] is None else top(r[0])) for r, s in zip(data, sets, strict=True)]


def near(seed, n=420):
    """A large group of near copies around the threshold, with small groups and loners."""
    rng = random.Random(seed)
    base, data = prose(rng, 90).split(), []
    for i in range(n):
        words = list(base) if i % 7 else prose(rng, 60).split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
        data.append((i * 3, " ".join(words), None, None, 0, None))
    return data


def twins():
    """Ids with several texts, which link groups of others."""
    data = near(11, 60)
    return data + [(data[0][0], data[7][1], None, None, 0, None), (data[0][0], "a text of its own with some words", None, None, 0, None), (data[14][0], data[0][1], None, None, 0, None), data[20], data[20]]


@pytest.mark.parametrize("data", [rows(), near(4), twins(), []], ids=["odd", "near", "twins", "none"])
def test_join_matches_all_pairs(spark, data):
    got = ngram_join.link_documents(table(spark, data)).collect()
    same([tuple(r) for r in got], plain_join(data))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90}


# ---- token store


@pytest.mark.parametrize("data", [rows(), rows()[:3], []], ids=["odd", "few", "none"])
def test_store_reads_back_what_the_library_encodes(spark, tmp_path, data):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    path = token_store.write(table(spark, data), VOCABULARY, f"file://{tmp_path}/t", shard_bytes=5_000)
    assert (spark.read.parquet(f"{path}/dictionary").first()["dictionary"] != b"") == any(r[0] is not None for r in data)
    got = token_store.read(spark, path, digests=True).collect()
    wanted, start = [], 0
    for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode() if r[1] is not None else b"")):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        wanted.append((r[0], start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    same(got, wanted)


def test_store_gives_one_document_alone(spark, tmp_path):
    path = token_store.write(table(spark), VOCABULARY, f"file://{tmp_path}/t", shard_bytes=20_000)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    content = bytes(spark.read.parquet(f"{path}/shards").orderBy("part", "no").first()["content"])
    shard = token_store.Shard(content, dictionary)
    assert shard.ids(len(shard.keys) - 1)[-1] == 1 and len(shard.ids(0)) == shard.counts[0]
    with pytest.raises(ValueError):
        token_store.Shard(content, dictionary + b"x")


def test_word_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    encoder = token_store.WordEncoder(VOCABULARY)
    texts = [r[1] or "" for r in rows()] + ["It's a test. don't, U.S.A. e.g., 3.14 x. ... 'S 's. <|endoftext|> a.b, É. H̱. KK İx.", "ÁB ç,  x y\x1cz"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_store_gives_special_tokens_their_ids(spark, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = ["<|startoftext|>", "one<|endoftext|>two <|endoftext|>, <|STARTOFTEXT|> <|end oftext|> (<|endoftext|>) é<|startoftext|><|endoftext|>"]
    path = token_store.write(table(spark, [(i, t, None, None, 0, None) for i, t in enumerate(texts)]), VOCABULARY, f"file://{tmp_path}/t")
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids[0] == [49406, 1] and 49407 in ids[1]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.read(spark, path, digests=True).collect()}
    assert got == {i: (len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in enumerate(ids)}


@pytest.mark.parametrize("width", [2, 4])
def test_dictionary_sample_spans_long_texts(width):
    data = np.arange(50_001, dtype=f"<u{width}").tobytes()
    pieces = token_store.spread(data, width)
    got = [np.frombuffer(p, f"<u{width}") for p in pieces]
    assert sum(map(len, pieces)) <= token_store.SAMPLE_TEXT_BYTES and got[0][0] == 0 and got[-1][-1] == 50_000
    assert all((np.diff(p) == 1).all() for p in got) and max(np.diff([p[0] for p in got])) < 50_000 / 6
    assert token_store.spread(data[:400], width) == [data[:400]]


# ---- nearest neighbours


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=32) + 3 * (i % 5 == 0)).astype("f4").tolist(), 1) for i in range(1500)]
    frame = vectors(spark, data)
    found = multi_index_hash.search(frame, shard_bytes=400 * 32 * 8)
    assert multi_index_hash.recall(frame, found) >= 0.9
    values = {i: np.array(v, "f4").astype(float) for i, v, _ in data}
    by = defaultdict(list)
    for r in found.collect():
        assert abs(r["score"] - values[r["query_id"]] @ values[r["vec_id"]]) < 1e-9 and r["query_id"] != r["vec_id"]
        by[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert set(by) == set(range(0, 1500, 20))
    for got in by.values():
        assert [g[0] for g in sorted(got)] == list(range(1, 21)) and [g[1:] for g in sorted(got)] == sorted(g[1:] for g in got)


def test_search_odd_vectors_and_ties(spark):
    good = [1.0, 2.0, 3.0, -1.0, 0.5, 0.0, 1.0, 1.0]
    bad = [None, [0.0] * 8, [float("nan")] + good[1:], [float("inf")] + good[1:], [None] + good[1:], [1.0], []]
    data = [(i, good, 0) for i in range(45)] + [(100 + 20 * i, b, 0) for i, b in enumerate(bad)] + [(None, good, 0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in multi_index_hash.search(vectors(spark, data)).collect())
    wanted = [(q, n + 1, v) for q in (0, 20, 40) for n, v in enumerate([i for i in range(45) if i != q][:20])]
    assert got == sorted(wanted)
    assert multi_index_hash.search(vectors(spark, data[:3])).count() == 2
    assert multi_index_hash.search(vectors(spark, [])).count() == 0


def test_search_recall_on_the_given_vectors_and_beyond_the_sample(spark, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(multi_index_hash, "SAMPLE", 400)  # a fifth of the table
    assert multi_index_hash.recall(frame, multi_index_hash.search(frame)) >= 0.95


def test_search_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    data = [(i % 50, rng.normal(size=16).tolist(), 0) for i in range(120)] + [(7, [1.0] * 16, 0)] * 40
    found = multi_index_hash.search(vectors(spark, data), k=300, shard_bytes=64 * 16 * 8).collect()
    assert Counter(r["query_id"] for r in found) == {q: sum(d[0] != q for d in data) for q in (0, 20, 40)}
    assert all(r["query_id"] != r["vec_id"] for r in found) and len({(r["query_id"], r["rank"]) for r in found}) == len(found)


def test_probes_keep_every_code_within_the_radius():
    for radius in range(0, 40):
        reach = multi_index_hash.probe_radii(radius, 8)
        assert sum(r + 1 for r in reach) == radius + 1
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(500, 64))
    codes = multi_index_hash.Codes(sample, 64)
    shard = multi_index_hash.Shard(np.arange(500), sample, codes)
    own = codes.of(sample)
    for radius in (0, 7, 19, 28, 64):
        assert shard.within(own[3], radius).tolist() == np.flatnonzero(multi_index_hash.distances(own, own[3]) <= radius).tolist()


def test_join_does_not_depend_on_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        data = near(9, 90) + [(r[0] + 1000, *r[1:]) for r in rows()[10:30]]
        got = ngram_join.link_documents(table(spark, data)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same([tuple(r) for r in got], plain_join(data))


def test_join_deals_hot_shingles_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "HOT_TIMES", 0)
    data = near(5, 300)
    same([tuple(r) for r in ngram_join.link_documents(table(spark, data)).collect()], plain_join(data))


def test_near_copies_that_do_not_link_are_no_rows(spark, monkeypatch):
    """pairs near the threshold are verified in their block, so no table grows with a group's square."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(8, 190), 2 + i % 2):
            words[at] = f"edit{i}x{at}"
        data.append((i, " ".join(words), "en", "s1", 0, None))
    counts, real = {}, ngram_join.written

    def counted(df, name, *more):
        out = real(df, name, *more)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    same([tuple(r) for r in ngram_join.link_documents(table(spark, data)).collect()], plain_join(data))
    assert "met" in counts and all(counts.get(name, 0) <= 4 * len(data) for name in ("pairs", "links", "tried"))


@pytest.mark.parametrize("longest", [1 << 15, 100])
def test_join_of_sets_too_long_for_a_block(spark, monkeypatch, longest):
    monkeypatch.setattr(ngram_join, "MOST_IN_BLOCK", longest)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    data = near(6, 120)
    same([tuple(r) for r in ngram_join.link_documents(table(spark, data)).collect()], plain_join(data))
