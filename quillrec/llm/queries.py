"""Registered queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrec.llm import (
    byte_bpe, decontaminate, fingerprint, language, lexical, merkle, ngram_join, packing, quality, shards, substring, suffixes, tokens, urls,
)
from quillrec.session import stage

TOKEN_LIMIT = 4096
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `build(spark, folder) -> DataFrame` under `name`."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


SHINGLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, least(len(w), 1))),
                                              lambda s: array_to_string(w[s:s + 4], ' '))) AS g
  FROM words),
members AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n + b.n) AS total
  FROM members a JOIN members b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * shared >= 75 * (total - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, least_id) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT y, least_id FROM reach JOIN edges ON x = reach.doc_id WHERE least_id < y)
SELECT doc_id, len(g)::BIGINT AS n_shingles, min(least_id) AS component_id
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, len(g)
"""


@query("op1_ngram_jaccard_join", SHINGLE_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        shards.from_key("id").alias("doc_id"), "n_shingles", shards.from_key("component").alias("component_id")
    )


SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
starts AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS run FROM starts),
firsts AS (SELECT run, min(doc_id) AS first_id FROM windows GROUP BY run),
cut AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS pos
  FROM windows JOIN firsts USING (run) WHERE doc_id > first_id),
marks AS (SELECT doc_id, list(pos) AS gone FROM cut GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM words LEFT JOIN marks USING (doc_id)
"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.dedup_substrings(table(spark, folder, "documents"), "doc_id")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_document_fingerprints")
def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, folder, "documents"))


@query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffixes.dedup_suffixes(table(spark, folder, "documents"), "doc_id")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"), TOKEN_LIMIT)


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), TOKEN_LIMIT, end_id=1)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    network = language.fit(docs.where(~held_out))
    return language.predict(docs, network, "doc_id", held_out.alias("held_out"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Documents' sources are the hosts, their languages the paths below."""
    labels = table(spark, folder, "labels").withColumnRenamed("quality", "good")
    return quality.classify(table(spark, folder, "documents"), labels, F.col("source"), F.col("lang"))


URL_RULES = [
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
]

URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(host, ':[0-9]*$', '') AS plain
  FROM parts LEFT JOIN marks ON page_id = doc_id GROUP BY host),
labels_of AS (
  SELECT *, string_split(plain, '.') AS l FROM counts),
hosts AS (
  SELECT host, n, k,
         CASE WHEN len(l) > 2 AND regexp_matches(l[-2] || '.' || l[-1], '^(ac|co|com|edu|gov|net|org)\.[a-z]{2}$')
              THEN 1 ELSE 0 END AS deep, l,
         array_to_string(l[greatest(len(l) - deep, 1):], '.') AS suffix,
         array_to_string(l[greatest(len(l) - deep - 1, 1):], '.') AS domain
  FROM labels_of),
total AS (SELECT coalesce(sum(k)::DOUBLE / nullif(sum(n), 0), 0) AS rate FROM hosts),
g1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(rate) AS m FROM hosts, total GROUP BY suffix),
s1 AS (SELECT 1 / coalesce(greatest(1e-4, least(0.5, (sum(n * (k::DOUBLE / n - m) ** 2) - sum(m * (1 - m)))
                  / nullif(sum(m * (1 - m) * (n - 1)), 0))), 1e-4) - 1 AS strength FROM g1 WHERE n > 0),
p1 AS (SELECT suffix, (strength * m + k) / (strength + n) AS mean FROM g1, s1),
g2 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS m
       FROM hosts JOIN p1 USING (suffix) GROUP BY suffix, domain),
s2 AS (SELECT 1 / coalesce(greatest(1e-4, least(0.5, (sum(n * (k::DOUBLE / n - m) ** 2) - sum(m * (1 - m)))
                  / nullif(sum(m * (1 - m) * (n - 1)), 0))), 1e-4) - 1 AS strength FROM g2 WHERE n > 0),
p2 AS (SELECT suffix, domain, (strength * m + k) / (strength + n) AS mean FROM g2, s2),
g3 AS (SELECT host, n, k, mean AS m FROM hosts JOIN p2 USING (suffix, domain)),
s3 AS (SELECT 1 / coalesce(greatest(1e-4, least(0.5, (sum(n * (k::DOUBLE / n - m) ** 2) - sum(m * (1 - m)))
                  / nullif(sum(m * (1 - m) * (n - 1)), 0))), 1e-4) - 1 AS strength FROM g3 WHERE n > 0),
p3 AS (SELECT host, strength + n AS t, (strength * m + k) / (strength + n) AS mean FROM g3, s3),
judged AS (SELECT host, rate > 0 AND mean - 1.645 * sqrt(mean * (1 - mean) / (t + 1)) > rate AS bad FROM p3, total),
fit AS (
  SELECT p.page_id, p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules
    ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.rverdict, CASE WHEN j.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p
LEFT JOIN fit f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path
JOIN judged j ON j.host = p.host
"""


@query("op10_url_filters", URL_SQL)
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by its URL; a page counts as bad if its document is of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.filter_urls(table(spark, folder, "pages"), outcomes, URL_RULES)


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer("byte_bpe_50k.tiktoken")
    # Ids are written before they are read again, so no executor runs encoders and decoders at once.
    encoded = stage(byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, "doc_id"))
    decoded = byte_bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


RANKED_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
holders AS (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM holders, total),
scores AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


@query("op12_ranked_search", RANKED_SQL)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


MANIFEST_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id,
         xor(4294967295, list_reduce(
           flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                                  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END,
           4294967295)) % 7 = 0 AS touched
  FROM documents),
parts AS (
  SELECT doc_id, lang, coalesce(touched, false) AS touched, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
         sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + touched::BIGINT)::VARCHAR) || ':' || (n_chars + touched::BIGINT), '-') || tail) AS later
  FROM parts),
nodes(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, n, idx // 2),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
tops(level, idx, n, digest) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, count(*) OVER (), digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1
  GROUP BY level, n, idx // 2),
both_trees AS (
  SELECT tree, level, idx, n, digest FROM nodes UNION ALL SELECT 0, level, idx, n, digest FROM tops),
sides AS (
  SELECT a.tree, a.level, a.idx, a.n, coalesce(b.digest, '') AS other
  FROM both_trees a LEFT JOIN both_trees b ON b.tree = a.tree AND b.level = a.level AND b.idx = xor(a.idx, 1)),
walk(doc_id, part, tree, level, idx, digest, proof) AS (
  SELECT doc_id, tree, tree, 0, idx, later, '' FROM leaves
  UNION ALL
  SELECT w.doc_id, w.part,
         CASE WHEN s.n > 1 THEN w.tree ELSE 0 END, CASE WHEN s.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN s.n > 1 THEN w.idx // 2 ELSE w.part - 1 END,
         CASE WHEN s.n = 1 THEN w.digest WHEN w.idx % 2 = 0 THEN sha256(w.digest || s.other) ELSE sha256(s.other || w.digest) END,
         CASE WHEN s.n > 1 THEN w.proof || s.other ELSE w.proof END
  FROM walk w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx
  WHERE s.n > 1 OR w.tree > 0),
ends AS (
  SELECT w.doc_id, w.digest, w.proof FROM walk w JOIN tops t ON w.tree = 0 AND w.level = t.level AND w.idx = t.idx WHERE t.n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root,
       e.digest = t.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN ends e USING (doc_id), (SELECT digest FROM tops WHERE n = 1) t
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    later = [*fields[:3], fields[3] + touched.cast("long"), fields[4]]
    return merkle.verified_rows(
        table(spark, folder, "documents"), "lang", "doc_id", merkle.digest_of(fields), merkle.digest_of(later)
    )
