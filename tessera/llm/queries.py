"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_fst, collocations, compact_windows, disclosure, langid, line_rules, packing, pitman_yor, pivot_index, prefix_trie, sharding, simhash, suffix_dedup
from .common import split_remainder, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"), split_remainder("doc_id", 10) != 0)


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.shared_passages(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_fst.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = split_remainder("doc_id", 4)
    model = langid.fit(docs, learn=remainder != 2)
    return langid.predict(docs, model, carried={"held_out": remainder == 2})


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefixes(table(spark, sf_dir, "conversations"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_compact_windows": op4_compact_windows,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_disclosure": op13_disclosure,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op6_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w)
), repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated)
  GROUP BY doc_id
), judged AS (
  SELECT doc_id,
    list_filter(lines, lambda l:
      (len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) < 4
        AND NOT regexp_matches(trim(translate(l, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')), '[.!?:;…"''”’»)\]]$'))
      OR 2 * (length(l) - length(replace(l, '!', ''))) > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
      OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.1::DOUBLE * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))
      OR (length(regexp_replace(l, '[^|»›>•·]', '', 'g')) >= 3
        AND 4 * length(regexp_replace(l, '[^|»›>•·]', '', 'g')) >= len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
      OR regexp_matches(lower(l), 'all rights reserved|privacy policy|cookie policy|uses cookies|accept cookies|terms of use|terms of service|enable javascript|licensed under|copyright ©|subscribe to our newsletter|click here|lorem ipsum')
    ) AS failed
  FROM w
), counts AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    CAST(len(j.failed) AS BIGINT) AS n_failed_lines,
    CAST(len(regexp_extract_all(array_to_string(j.failed, chr(10)), '[^\x20\x09-\x0D]+')) AS BIGINT) AS lost_words
  FROM w JOIN judged j USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT lost_words > 0.5::DOUBLE * n_words AS kept,
  n_failed_lines, lost_words
FROM counts""",
    "op8_sharding": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), digest AS (
  SELECT r, doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size,
    CAST(xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS BIGINT) AS text_crc32
  FROM docs, crc_table
), jump AS (
  SELECT r, n, CAST(coalesce(doc_id, 0) AS HUGEINT) AS key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM docs, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT r, n, k, j, CAST(trunc((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT r, n, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k, j FROM jump WHERE j < n)
), placed AS (
  SELECT r, CAST(max(b) FILTER (WHERE n = 8) AS INT) AS shard, CAST(max(b) FILTER (WHERE n = 9) AS INT) AS grown_shard FROM jump GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM digest JOIN placed USING (r)""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), tot AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, phrase, CAST(count(*) AS BIGINT) AS f, any_value(k) AS k FROM (
    SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(words) >= k)
  ) GROUP BY lang, phrase HAVING count(*) >= 100
), split AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(list_slice(words, 1, k - 1), ' '), array_to_string(list_slice(words, 2, k), ' ')]) AS part FROM split WHERE k > 2
  ) GROUP BY lang, part
), kept AS (
  SELECT s.* FROM split s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase WHERE g.f IS NULL OR 100 * g.f < 100 * s.f
), cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(list_slice(words, 1, c), ' ') AS lp, array_to_string(list_slice(words, c + 1, k), ' ') AS rp
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score, c.c
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp JOIN tot t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
) WHERE rank <= 2000""",
    "op12_prefix_trie": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS src, len, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 9 AS h
  FROM (SELECT conv_id, count(*) AS len FROM turns GROUP BY conv_id), crc_table
), taken AS (
  SELECT c.*, least(c.h, coalesce(s.len, 0)) AS nb FROM convs c LEFT JOIN convs s ON s.conv_id = c.src
), rebuilt AS (
  SELECT c.conv_id, t.i AS pos, t.role, t.text FROM taken c JOIN turns t ON t.conv_id = c.src AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, c.nb + t.i - c.h AS pos, t.role, t.text FROM taken c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h
), seq AS (
  SELECT c.conv_id, coalesce(r.path, '') AS path, coalesce(r.n, 0) AS n, r.bytes FROM convs c LEFT JOIN (
    SELECT conv_id, string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY pos) AS path, list(strlen(text) ORDER BY pos) AS bytes, count(*) AS n FROM rebuilt GROUP BY conv_id) r USING (conv_id)
), member AS (
  SELECT conv_id, n, bytes, d, left(path, 64 * d) AS node FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM seq)
), node AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes[d]), 0) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM member GROUP BY node, d
), child AS (
  SELECT left(node, 64 * (d - 1)) AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), whole AS (
  SELECT left(x.node, 64 * x.k) AS node, sum(CASE WHEN x.leaf THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM (SELECT node.*, c.node IS NULL AS leaf, unnest(range(0, d + 1)) AS k FROM node LEFT JOIN child c USING (node)) x GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(w.n_leaves AS BIGINT) AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n LEFT JOIN node p ON n.d > 0 AND p.node = left(n.node, 64 * (n.d - 1)) AND p.d = n.d - 1 LEFT JOIN child c ON c.node = n.node JOIN whole w ON w.node = n.node""",
}
