"""Registered queries of the training-data operators, one per operator, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.llm import (
    byte_bpe, fingerprints, line_dedup, lm_scoring, mixing, ngram_join, packing, prefix_trie, quality_classifier, quality_rules, structure_repair,
    substring_dedup, url_filters,
)
from canopyframe.llm import digests as digests_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Where the tokenizer files of the installation lie.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL filter, and the labels whose hosts are listed as blocked.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED_LABELS = ("adult-x", "casino-win", "free-bets", "spam-farm")


@_query("op1_url_filters", f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, {_LOWER.format(x="raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host = url_filters.host_path(F.col("url"))[0]
    listed = F.arrays_overlap(F.split("key", "[.]"), F.array(*map(F.lit, BLOCKED_LABELS)))
    universe = pages.select(host.alias("key")).distinct().select("key", listed.alias("listed"))
    return url_filters.judge(pages, URL_RULES, universe)


@_query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


@_query("op3_ngram_jaccard_join", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format(x="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 90 * (len(p.sh) + len(q.sh) - n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.a = s.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"), k=3, percent=90)


@_query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, size=2048)


@_query("op7_winnowing_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@_query("op8_line_dedup", f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (
  SELECT doc_id, i, line, {_LOWER.format(x="trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_shared_lines(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=5, min_chars=40, n_lines="n_lines", n_dropped="n_dropped")
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return lm_scoring.scored(_table(spark, sf_dir, "documents"), good)


@_query("op10_poisson_mixing", """
WITH z AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, pow(CAST(size AS DOUBLE), 0.7) AS w FROM z),
r AS (SELECT source, CASE WHEN size > 0 THEN CAST(sum(size) OVER () AS DOUBLE) * (w / sum(w) OVER ()) / size ELSE 0.0 END AS rate FROM w),
p AS (SELECT source, k, sum(exp(-rate) * pow(rate, k) / factorial(CAST(k AS INTEGER))) OVER (PARTITION BY source ORDER BY k) AS c
      FROM r, range(0, 30) AS g(k)),
u AS (SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, count(*) FILTER (p.c <= u.u) AS n FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source GROUP BY ALL)
SELECT doc_id, source, text, CAST(unnest(range(n)) AS INTEGER) AS copy FROM n""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicate(docs, mixing.temperature_rates(docs, exponent=0.7), copy="copy")


#: CRC-32 of an ASCII string in SQL, bit by bit.
_CRC = ("xor(4294967295, list_reduce(flatten(list_transform(string_split({x}, ''), lambda ch: list_transform(range(8), lambda k: (ord(ch) >> k) & 1))), "
        "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))")


@_query("op11_prefix_trie", f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC.format(x="conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (
  SELECT c.conv_id, 0 AS own, o.n, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.n <= c.h
  UNION ALL SELECT c.conv_id, 1, o.n, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.n > c.h),
s AS (
  SELECT c.conv_id, coalesce(list({{'r': b.role, 't': b.text}} ORDER BY own, n) FILTER (b.conv_id IS NOT NULL), []) AS seq
  FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, seq[:d] AS prefix, len(seq) = d AS ends FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
g AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN (count(*) - 1) * length(prefix[d].t) ELSE 0 END AS saved
  FROM p GROUP BY prefix, d),
k AS (SELECT q.prefix, q.d, count(x.d) AS n_children FROM g q LEFT JOIN g x ON x.d = q.d + 1 AND x.prefix[:x.d - 1] = q.prefix GROUP BY q.prefix, q.d)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, g.n_convs, k.n_children,
       (SELECT count(*) FROM g y JOIN k z USING (prefix, d) WHERE z.n_children = 0 AND y.d >= g.d AND y.prefix[:g.d] = g.prefix) AS n_leaves,
       (SELECT CAST(sum(y.saved) AS BIGINT) FROM g y WHERE y.d >= g.d AND y.prefix[:g.d] = g.prefix) AS saved_tokens,
       g.ends_sha256
FROM g JOIN k USING (prefix, d) LEFT JOIN g u ON u.d = g.d - 1 AND u.prefix = g.prefix[:g.d - 1]""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@_query("op12_structure_repair", f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE fate <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS i FROM d),
f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS dup, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS trunc,
         lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM n),
g AS (
  SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup,
         count(*) FILTER (trunc) AS trunc, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
steps(p, q, role) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
m AS (
  SELECT conv_id, n, p.p, p.p AS q, 3 AS c, 'D' AS a FROM f, (VALUES (0), (1), (2), (3)) AS p(p)
  UNION ALL SELECT conv_id, n, p, q, trunc::INT, 'K' FROM f JOIN steps ON steps.role = i WHERE NOT blank AND NOT dup
  UNION ALL SELECT conv_id, n, p, q, 2 + trunc::INT, 'R' FROM f JOIN steps ON steps.role <> 's' WHERE NOT blank AND NOT dup),
v AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, {{'c': 0, 'a': ''}} AS b FROM g
  UNION ALL
  SELECT v.conv_id, v.n + 1, m.q, min({{'c': v.b.c + ins.c + m.c, 'a': v.b.a || ins.a || m.a}})
  FROM v JOIN ins ON ins.p = v.q JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.n = v.n + 1 AND m.p = ins.q GROUP BY v.conv_id, v.n, m.q),
w AS (
  SELECT g.conv_id, min({{'c': v.b.c + ins.c, 'a': v.b.a || ins.a}}) AS b
  FROM g JOIN v ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND v.n = g.n JOIN ins ON ins.p = v.q AND ins.q IN (0, 3) GROUP BY g.conv_id),
l AS (SELECT conv_id, unnest(string_split(b.a, '')) AS a, unnest(range(length(b.a))) AS i FROM w),
x AS (SELECT *, count(*) FILTER (a <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n FROM l),
y AS (
  SELECT x.conv_id, x.i, x.a, f.role, f.text, row_number() OVER (PARTITION BY x.conv_id ORDER BY x.i) AS pos
  FROM x LEFT JOIN f ON x.a <> 'I' AND f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.n = x.n WHERE x.a <> 'D' AND x.a <> ''),
z AS (SELECT *, first_value(a = 'K' AND role LIKE 's%') OVER (PARTITION BY conv_id ORDER BY pos)::INT AS sys FROM y),
r AS (
  SELECT conv_id, string_agg(CASE WHEN a = 'K' THEN role WHEN (pos - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN a = 'I' THEN '' ELSE text END,
                             chr(10) ORDER BY pos) AS t FROM z GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate, coalesce(trunc, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(w.b.c, 0) AS BIGINT) AS cost, coalesce(w.b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    reports, repaired = structure_repair.repair(structure_repair.damage(conversations))
    lines = repaired.select("conv_id", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = digests_of.joined_sha256(lines, "conv_id", "at", "line", "\n", "repaired_sha256")
    every = conversations.select("conv_id").distinct()
    for found in (reports, digests):
        found = found.withColumnRenamed("conv_id", "_id")
        every = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    empty = {"audit": "", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)}
    return every.fillna(empty).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@_query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN, packed=True, keep=["doc_id"])
    return byte_bpe.decode(encoded, BYTE_RANKS).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
