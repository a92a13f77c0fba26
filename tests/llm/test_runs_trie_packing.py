"""Periodic runs, conversation tries and packing, against brute force, SQL and the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from idweft.llm import conversation_trie, grouped_packing, periodic_runs
from idweft.llm.queries import ORACLE_SQL, QUERIES
from idweft.llm.words import word_hashes
from tests.compare import differences
from tests.llm.data import prose, rows, table

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# ---- periodic runs


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            k = i
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k > i and k + q - i >= max(least, times * q):
                found.setdefault((i, k + q), q)
            i = max(k, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kinds, out = rng.choice([1, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 6)):
        base = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
        out += (base * 8)[: rng.randint(1, 6) * len(base) + rng.randint(0, len(base))]
        if rng.random() < 0.3:
            out += [b"x"] * rng.randint(0, 40)
    return out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (1, 2), (10, 4), (2, 3)])
def test_catchers_find_what_brute_force_finds(least, times):
    rng = random.Random(least)
    for _ in range(25):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        wanted = [brute_runs(t, least, times) for t in texts]
        assert periodic_runs.runs_of_texts(texts, least, times) == wanted
        catchers, hashes, at = periodic_runs.Catchers(least, times), word_hashes(texts[0]), 0
        while at < len(hashes):  # online: in steps of any size, often one word
            step = rng.choice([1, 1, 2, 7, 30])
            catchers.append(hashes[at : at + step])
            at += step
        assert catchers.runs() == wanted[0]


def test_runs_are_reported_while_words_come():
    catchers = periodic_runs.Catchers()
    hashes = word_hashes([b"a", b"b", b"c"] * 20)
    catchers.append(hashes[:23])
    assert catchers.runs() == []
    for n in (24, 25, 60):
        catchers.append(hashes[catchers.n : n])
        assert catchers.runs() == [(0, n, 3)]


def test_long_and_structured_texts():
    thue = [0]
    for _ in range(12):
        thue += [1 - x for x in thue]
    assert periodic_runs.runs_of_texts([[b"ab"[x : x + 1] for x in thue]]) == [[]]  # no cube in it
    assert periodic_runs.runs_of_texts([[b"a"] * 400_000]) == [[(0, 400_000, 1)]]
    period = [b"%d" % (i * i % 1_000_003) for i in range(50_000)]
    assert periodic_runs.runs_of_texts([[b"x"] + period * 4 + [b"y"]]) == [[(1, 200_001, 50_000)]]


def test_runs_of_documents(spark):
    data = rows(5, 20)
    data += [(900 + i, t, "en", "s", 0, "x") for i, t in enumerate(["na " * 24, "na " * 23, "a b c " * 9 + "d " * 30, prose(random.Random(1), 30) * 4, "\n".join(["same"] * 300)])]
    got = {(r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed_text"]) for r in periodic_runs.find_runs(table(spark, data)).collect()}
    wanted = set()
    for doc_id, text, *_ in data:
        words = (text or "").encode().split()
        found = brute_runs(words) if len(words) < 3_000 else periodic_runs.runs_of_texts([words])[0]
        gone = {i for s, e, q in found for i in range(s + q, e)}
        wanted.add((doc_id, len(words), tuple((s, e - s, q) for s, e, q in found), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == wanted


def test_repeats_are_placed_as_stated(spark):
    data = [(i, prose(random.Random(i), i % 90), None, None, 0, None) for i in range(150)] + [(None, "a b c", None, None, 0, None), (44, None, None, None, 0, None)]
    changed = 0
    for doc_id, text in periodic_runs.with_repeats(table(spark, data)).collect():
        before = next(t for i, t, *_ in data if i == doc_id and (doc_id != 44 or (t is None) == (text is None)))
        words, h = (before or "").split(), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            a, n, changed = h // 10 % len(words), len(words), changed + 1
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            assert text == " ".join(words)
        else:
            assert text == before
    assert changed > 5


# ---- conversations


def plain_trie(data, family=1, most=1):
    """Rows of the trie by walking every prefix of every conversation."""
    turns = {}
    for conv, turn, role, text in data:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        seq = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [x for x in out if len(x) == len(node) + 1 and x[:-1] == node]
        size = len(node[-1][1].encode()) if node else 0
        saved = (len(members[node]) - 1) * size + sum(out[k][6] for k in kids)
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), sum(out[k][5] for k in kids) or 1, saved, hashlib.sha256(listed.encode()).hexdigest())
    return Counter(out.values())


def chats(seed, n=60, kinds=3, longest=7):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        c = rng.choice([c, c, -c])
        length = rng.choice([1, 1, 2, 3, longest])
        for t in range(length):
            hot = t == 0 and rng.random() < 0.6
            out.append((c, rng.choice([t, t, None, 5]), rng.choice(["user", "bot", None, ""]) if not hot else "user", "Hello there" if hot else rng.choice([None, "", "é" * t, *[f"text {k}" for k in range(kinds)]])))
    out += out[:5] + [(None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def chat_table(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("seed", "family", "most", "parts"), [(1, 1, 1, 1), (2, 5, 9, 4), (3, 5, 9, 23), (4, 2, 3, 60)])
def test_trie_equals_plain_prefixes(spark, seed, family, most, parts):
    data = chats(seed)
    got = conversation_trie.prefix_trie(conversation_trie.sequences(chat_table(spark, data), family=family, most=most), parts=parts)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == plain_trie(data, family, most)


def test_one_conversation_may_be_long_and_one_text_common(spark):
    data = [(5, t, "user", f"turn {t % 50}") for t in range(1_500)] + [(c, t, "user", f"turn {t}") for c in range(10, 300) for t in range(2)] + [(400, t, "user", f"turn {t % 50}") for t in range(700)]
    got = conversation_trie.prefix_trie(conversation_trie.sequences(chat_table(spark, data)), parts=5).collect()
    assert len(got) == 1_501 and max(r["depth"] for r in got) == 1_500
    by_depth = {r["depth"]: r for r in got}
    assert [by_depth[d]["n_convs"] for d in (0, 2, 3, 700, 701)] == [292, 292, 2, 2, 1]
    assert by_depth[2]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(10, 300))).encode()).hexdigest()
    assert all(r["n_leaves"] == 1 for r in got) and by_depth[1_500]["n_children"] == 0


def test_stretches_of_ids_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "GATHERED", 3)
    data = [(c, 0, "user", "hi") for c in range(1, 200)]
    seqs = conversation_trie.sequences(chat_table(spark, data))
    got = {r["depth"]: r for r in conversation_trie.prefix_trie(seqs, parts=3).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1, 200))).encode()).hexdigest()


def test_z_fast_trie_in_any_order():
    """The exit node by fat binary search is the one that walking down from the root finds."""
    rng = random.Random(8)
    for _ in range(40):
        trie, paths = conversation_trie.ZFastTrie(), set()
        for _ in range(60):
            path = b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randint(0, 12)))
            for probe in (path, path + b"\x07" * 16):
                node = trie.root
                while len(probe) >= node.depth * 16 and probe[: node.depth * 16] == node.path[: node.depth * 16]:
                    child = node.kids.get(probe[node.depth * 16 : node.depth * 16 + 16])
                    if child is None:
                        break
                    node = child
                assert trie.exit_node(probe) is node
            if path not in paths:
                paths.add(path)
                trie.insert(path, [1] * (len(path) // 16), 1, len(paths), "")
        stack = [trie.root]
        while stack:
            node = stack.pop()
            assert node is trie.root or trie.table[node.handle] is node and (len(node.kids) > 1 or node.own is not None)
            stack += node.kids.values()


@pytest.mark.parametrize("high", range(1, 70))
def test_two_fattest(high):
    for low in range(high):
        best = max(range(low + 1, high + 1), key=lambda x: x & -x)
        assert conversation_trie.two_fattest(low, high) == best


# ---- packing


def test_vocabulary_encoder_equals_the_library():
    encoder, rng = grouped_packing.vocabulary_encoder(VOCABULARY), random.Random(3)
    letters = [chr(c) for c in range(1, 0x180)] + list("αβШщ中文字हिन्दी한글ไทย😀​ 　ﷺ́ǅ٣Ⅷ²") + ["<|endoftext|>", "'s", "'LL", " the", "\n\n", "   "]
    for _ in range(2_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert encoder.whole_ids(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    for text in ("x" * 100_000, " " * 20_000 + "end", "word, " * 30_000, "\n" * 9_000):
        assert encoder.whole_ids(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_plans_hold_every_piece_once():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([1, 5, 16, 64, 1_024])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        plan = grouped_packing.Plan(counts, capacity, rng.choice([1, 3, 20]), rng.choice([0, 0.05, 0.3]))
        held, got = {}, Counter()
        for length, rank, n, first, per, offset in plan.moves:
            assert rank == got[length]
            got[length] += n
            for r in range(n):
                held.setdefault(first + r // per, []).append((offset + r % per * length, length))
        assert got == counts and sorted(held) == list(range(plan.n_sequences))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_grouping_and_configurations_pack_well():
    groups = grouped_packing.groups_of({7: 5, 5: 10, 3: 1}, 4)
    assert [(size, sum(members.values())) for size, members in groups] == [(7, 4), (7, 4), (5, 4), (5, 4)] and groups[1][1] == {7: 1, 5: 3}
    rng = random.Random(4)
    mixes = {  # first fit decreasing takes 2 % more than the least on the first of these
        "pairs": (Counter({511: 500, 513: 500, 342: 600, 341: 600, 340: 600}), 1.0),
        "middle": (Counter(rng.randint(200, 500) for _ in range(20_000)), 1.015),
        "any": (Counter(rng.randint(1, 1_024) for _ in range(20_000)), 1.01),
    }
    for counts, most in mixes.values():
        least = -(-sum(n * c for n, c in counts.items()) // 1_024)
        assert grouped_packing.best_plan(counts).n_sequences <= most * least + 1


def test_configurations_solve_the_linear_program():
    """Sizes 6, 4 and 3 in 12: four times 3, three times 4 or two of 6 leave no room."""
    found = grouped_packing.configurations(np.array([3, 4, 6]), np.array([40.0, 30.0, 20.0]), 12)
    assert abs(sum(times for _, times in found) - 30) < 1e-6
    found = grouped_packing.configurations(np.array([4, 5, 7]), np.array([10.0, 10.0, 10.0]), 12)
    assert abs(sum(times for _, times in found) - 10 - 10 / 3) < 1e-6  # 7 with 5; 4 in threes


def test_packed_documents_are_whole(spark):
    data = rows() + [(800, "long text here, " * 3_000, "en", "s", 0, "x")]
    packed = grouped_packing.pack(table(spark, data), VOCABULARY)
    got = packed.collect()
    encoder, wanted = grouped_packing.vocabulary_encoder(VOCABULARY), Counter()
    for doc_id, text, *_ in data:
        ids, at = [*encoder.library.encode(text or "", add_special_tokens=False).ids, 2], 0
        head = len(ids) % 1_024 if len(ids) > 1_024 else len(ids)
        for i, size in enumerate([x for x in [head, *[1_024] * ((len(ids) - head) // 1_024)] if x]):
            wanted[doc_id, i, at, size, zlib.crc32(np.asarray(ids[at : at + size], "<u4").tobytes())] += 1
            at += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in held.values():
        parts.sort()
        assert [o for o, *_ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and sum(n for _, n, _ in parts) <= 1_024
    total = sum(r["length"] for r in got)
    assert len(held) <= 1.05 * total / 1_024 + 1
    blocks = {r["sequence_id"]: r for r in grouped_packing.sequences(packed).collect()}
    assert {k: b"".join(x for *_, x in parts) for k, parts in held.items()} == {k: bytes(r["ids"]) for k, r in blocks.items()}
    assert sum(len(r["segments"]) for r in blocks.values()) == len(got)


# ---- all three


def test_queries_equal_sql(spark):
    for name in ("op11_periodic_runs", "op12_conversation_trie"):
        same_columns, here, there, n = differences(spark, SF, QUERIES[name], ORACLE_SQL[name])
        assert same_columns and not here and not there and n > 0, name


def test_packing_query_keeps_all_tokens(spark):
    got = QUERIES["op13_grouped_packing"](spark, SF)
    sizes = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    assert max(r["n"] for r in sizes) <= 1_024 and len(sizes) <= 1.02 * total / 1_024 + 1
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_clashing_columns_and_empty_tables(spark):
    names = ("doc_key", "data", "h", "w", "n", "g", "a", "p", "part", "no", "length", "rank", "key", "kin", "conv", "digest", "size", "path", "low", "ids")
    docs = table(spark, rows()[:14])
    clash = lambda df: df.withColumns({c: F.lit("clash") for c in names})
    as_rows = lambda df: Counter(str(r.asDict()) for r in df.collect())
    runs = lambda df: periodic_runs.find_runs(periodic_runs.with_repeats(df))
    assert as_rows(runs(clash(docs))) == as_rows(runs(docs))
    pack = lambda df: grouped_packing.pack(df, VOCABULARY).drop("sequence_id", "offset")
    assert as_rows(pack(clash(docs))) == as_rows(pack(docs))
    trie = lambda df: conversation_trie.prefix_trie(conversation_trie.sequences(df))
    turns = chat_table(spark, chats(9, 15))
    assert as_rows(trie(clash(turns))) == as_rows(trie(turns))
    nobody = chat_table(spark, [(None, 1, "a", "b")])
    for empty in (runs(table(spark, [])), grouped_packing.pack(table(spark, []), VOCABULARY), trie(chat_table(spark, [])), trie(nobody)):
        assert empty.count() == 0
