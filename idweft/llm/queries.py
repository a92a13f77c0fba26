"""The registered queries of this package: thin digests of the operators' outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweft.llm import byte_bpe, compression_bands, conversation_trie, edit_counts, grouped_packing, multi_index_hash, ngram_join, periodic_runs, secret_scan, source_mix, substring_dedup, token_store, toxicity_cnn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compression_bands.score(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_low", "chunk_high", "mark_share", "mark_cost")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_documents(spark, sf_dir))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity_cnn.score(docs, model)
    return out.select("doc_id", F.coalesce(toxicity_cnn.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, path, digests=True)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_multi_index_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_hash.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("found")
    base = F.filter(spans, lambda s: s["place"] < len(secret_scan.BASE_RULES))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.scan(_documents(spark, sf_dir)).select("doc_id", *[count(r.kind) for r in secret_scan.BASE_RULES], F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(spans).alias("spans"))


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document, and what was encoded again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = edit_counts.build(_documents(spark, sf_dir), ranks, pattern)
    edited = edit_counts.apply_edits(state.withColumn("edits", edit_counts.derived_edits(F.col("text"), F.col("doc_id"))), ranks, pattern)
    return edited.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_recoded", F.sha2("text", 256).alias("edited_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(periodic_runs.with_repeats(_documents(spark, sf_dir)))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_trie.prefix_trie(conversation_trie.sequences(turns, family=5, most=9))


def op13_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_compression_bands": op2_compression_bands,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity_cnn": op4_toxicity_cnn,
    "op5_token_store": op5_token_store,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_multi_index_hash": op7_multi_index_hash,
    "op8_source_mix": op8_source_mix,
    "op9_secret_scan": op9_secret_scan,
    "op10_edit_counts": op10_edit_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_grouped_packing": op13_grouped_packing,
}


def _crc32(number: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a number's decimal digits."""
    shift = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, b: {shift.format('xor(a, b)')}), 4294967295)"


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT links.b, root FROM reach JOIN links ON links.a = reach.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op11_periodic_runs": f"""
WITH own AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS o, {_crc32("doc_id")} AS h FROM documents),
d AS (SELECT *, len(o) AS n, h // 10 AS g FROM own),
e AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d),
w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM e),
grams AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 8], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(n - 7)) AS i FROM w WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS s, max(i) + 8 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, s, e, min(q) AS q FROM islands WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(e - s AS DECIMAL(38, 12)) / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period, 1000 * (e - s) // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_conversation_trie": f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS b, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k) AS o FROM t GROUP BY c),
h AS (SELECT *, {_crc32("c")} % 9 AS h FROM own),
seqs AS MATERIALIZED (SELECT x.c, coalesce(list_concat(y.o[:x.h], x.o[x.h + 1:]), x.o[x.h + 1:]) AS p FROM h x LEFT JOIN own y ON y.c = x.c - x.c % 5),
steps AS MATERIALIZED (
  SELECT c, p, 0 AS depth, 0 AS b, '' AS node, '' AS parent FROM seqs
  UNION ALL SELECT c, p, depth + 1, p[depth + 1].b, md5(node || p[depth + 1].k), node FROM steps WHERE depth < len(p)),
nodes AS MATERIALIZED (SELECT node, depth, any_value(parent) AS parent, any_value(b) AS b, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(p) = depth) AS ends FROM steps GROUP BY node, depth),
kids AS MATERIALIZED (SELECT parent AS node, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY parent),
up AS (SELECT node AS below, node, depth FROM nodes UNION ALL SELECT below, parent, up.depth - 1 FROM up JOIN nodes USING (node) WHERE up.depth > 0),
sums AS (SELECT up.node, count(*) FILTER (WHERE kids.kids IS NULL) AS n_leaves, sum((low.n - 1) * low.b) AS saved FROM up JOIN nodes low ON low.node = up.below LEFT JOIN kids ON kids.node = up.below GROUP BY up.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes y ON y.node = x.parent AND x.depth > 0""",
}
