"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, decontamination, embeddings, minhash, packing, periodic, quality, substrings, token_counts, token_files, toxicity, trie
from .common import read

#: Vocabulary of the token operators; a parameter of each of them.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return toxicity.with_fold(scored).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.with_planted_runs(read(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_trie(trie.rebuilt(trie.turn_lists(read(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict:
    own = (op1_chat_formatting, op2_suffix_array_dedup, op3_quality_classifier, op4_token_counts, op5_packing, op6_minhash_dedup, op7_token_files, op8_embedding_dedup, op9_toxicity, op10_decontamination, op11_periodic_runs, op12_prefix_trie, op13_bestfit_packing)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') || chr(1) || (role IS NULL)::varchar || chr(2) || coalesce(text, '') || chr(1) || (text IS NULL)::varchar || chr(3) AS k,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, pos, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
w AS (SELECT pos, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY pos, prefix),
m AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.pos AND p.prefix = w.prefix))
SELECT m.conv_id, m.pos AS n_turns, m.n_copies, string_agg(t.piece, '' ORDER BY t.pos) AS chat
FROM m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY m.conv_id, m.pos, m.n_copies
"""


OP10_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
o AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p ON p.k = g.k AND p.g = g.g),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


#: crc32 of an id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}::varchar, ''), lambda ch: ascii(ch)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::bigint ELSE 0 END))), 4294967295::bigint)"""

OP12_SQL = f"""
WITH o AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations GROUP BY conv_id),
h AS (SELECT c, own, {_CRC.format("c")} % 4 AS h FROM o),
m AS (
  SELECT h.c, list_concat(coalesce(b.own, [])[1 : h.h], h.own[h.h + 1 :]) AS turns
  FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, d, turns[1 : d] AS seq, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM m)),
n AS (
  SELECT d, seq, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(seq[d].t), '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM p GROUP BY d, seq),
k AS (SELECT d - 1 AS d, seq[1 : d - 1] AS seq, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, seq)),
s AS (
  SELECT a AS d, seq[1 : a] AS seq, sum((n_convs - 1) * words) AS saved, sum((n_children = 0)::bigint) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d::bigint AS depth, u.conv_id AS parent_conv_id, f.n_convs::bigint AS n_convs, f.n_children::bigint AS n_children,
       s.leaves::bigint AS n_leaves, s.saved::bigint AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM f JOIN s USING (d, seq) LEFT JOIN f u ON u.d = f.d - 1 AND u.seq = f.seq[1 : f.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op10_decontamination": OP10_SQL, "op12_prefix_trie": OP12_SQL}
