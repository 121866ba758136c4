"""The operators as queries over the test tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, group_join, language_id, multi_index, packing, phrases, prefix_trie, secret_scan, suffix_tree, templates, token_store, url_filter, warc
from ._store import new_folder

# The rules of the url query
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op2_token_store(spark: SparkSession, folder: str) -> DataFrame:
    to = new_folder(spark, "tokens")
    token_store.write_tokens(table(spark, folder, "documents"), to, tokenizer())
    return token_store.read_tokens(spark, to, with_ids=False)


def op3_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages"), rules)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    to = new_folder(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), to)
    return warc.read_warc(spark, to, with_payload=False).drop("url")


def op6_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    items = multi_index.codes(table(spark, folder, "embeddings"))
    return multi_index.top_k(items, items.where("vec_id % 100 = 0"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    filters = language_id.learn(docs.where("not held_out"))
    return language_id.predict(docs, filters, ["doc_id", "held_out"])


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer())


def op10_group_join(spark: SparkSession, folder: str) -> DataFrame:
    return group_join.join_groups(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(table(spark, folder, "documents"), ranks, pattern), ranks, pattern))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_templates, op2_token_store, op3_suffix_tree, op4_url_filter, op5_warc, op6_multi_index, op7_language_id, op8_secret_scan, op9_packing, op10_group_join, op11_prefix_trie, op12_byte_bpe, op13_phrases)
}

_PAGES = r"""
pages_cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM pages_cut)"""

ORACLE: dict[str, str] = {
    "op4_url_filter": f"""
WITH {_PAGES},
rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS nth
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE nth = 1) f ON p.page_id = f.page_id""",
    "op5_warc": """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM rows),
last AS (SELECT digest, max(page_id) AS origin FROM sized WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, s.digest AS payload_digest,
  CASE WHEN page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM sized s LEFT JOIN last l ON s.digest = l.digest""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
numbered AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
  FROM own),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS path
  FROM numbered c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (SELECT conv_id, path, len(path) AS size, unnest(range(0, len(path) + 1)) AS depth FROM whole),
nodes AS (
  SELECT depth, CASE WHEN depth = 0 THEN [] ELSE path[1:depth] END AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
linked AS (
  SELECT n.*, u.node AS up, u.conv_id AS parent_conv_id,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.node[n.depth].text, '[^\x20\x09-\x0D]+')) END AS gain
  FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.node = CASE WHEN n.depth < 2 THEN [] ELSE n.node[1:n.depth - 1] END),
children AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON l.depth = c.depth AND l.node = c.node),
upward AS (SELECT gain, n_children, node, unnest(range(0, depth + 1)) AS k FROM counted),
sums AS (
  SELECT k AS depth, CASE WHEN k = 0 THEN [] ELSE node[1:k] END AS node, sum(gain)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM upward GROUP BY 1, 2)
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON c.depth = s.depth AND c.node = s.node""",
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS m)),
often AS (SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM starts GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cuts AS (
  SELECT p.lang, p.m, p.g, p.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * p.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM often p JOIN totals t ON p.lang = t.lang, (SELECT unnest(range(1, 5)) AS k)
  JOIN often l ON l.lang = p.lang AND l.g = p.g[1:k] JOIN often r ON r.lang = p.lang AND r.g = p.g[k + 1:]
  WHERE p.m >= 2 AND k < p.m),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM weakest c WHERE NOT EXISTS (
    SELECT 1 FROM often q WHERE q.lang = c.lang AND q.m > c.m AND 100 * q.f >= 100 * c.a
      AND list_contains(list_transform(range(1, q.m - c.m + 2), lambda o: q.g[o:o + c.m - 1]), c.g))),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
