"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelyard.llm import (
    bloom_lines, config_packing, count_streams, gear_chunks, hamming_topk, poisson_mix, robust_quality, secret_crf, slot_shards, token_groups,
    toxicity_cnn, turn_repair, url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("""
WITH codes AS (
  SELECT vec_id, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS low,
    list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS high
  FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, (bit_count(xor(q.low, r.low)) + bit_count(xor(q.high, r.high)))::INT AS distance
  FROM codes q JOIN codes r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
""")
def op1_hamming_topk(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), hamming_topk.sign_code("embedding").alias("code"))
    return hamming_topk.nearest(rows, rows.filter(F.col("id") % 100 == 0), k=10)


@query()
def op2_robust_quality(spark, sf):
    return robust_quality.judged(table(spark, sf, "documents"))


@query()
def op3_gear_chunks(spark, sf):
    kept = gear_chunks.drop_repeated_passages(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_chunks", "spans", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op4_token_groups(spark, sf):
    return token_groups.near_duplicates(table(spark, sf, "documents"), words=4, threshold=85).select("doc_id", "n_shingles", "component_id")


@query()
def op5_config_packing(spark, sf):
    return config_packing.pack_documents(table(spark, sf, "documents"), tokenizer_path())


@query()
def op6_toxicity_cnn(spark, sf):
    return toxicity_cnn.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("lang")


@query(r"""
WITH params AS (SELECT 0.5 AS exponent, '17' AS seed),
docs AS (SELECT *, coalesce(source, '\N') AS k FROM documents),
sizes AS (SELECT k, sum(length(text))::DOUBLE AS size, pow(sum(length(text))::DOUBLE, 0.5) AS wanted FROM docs GROUP BY k),
rates AS (SELECT k, (SELECT sum(size) FROM sizes) * wanted / (SELECT sum(wanted) FROM sizes) / size AS mean FROM sizes),
terms AS (SELECT k, i, exp(-mean + i * ln(mean) - lgamma(i + 1.0)) AS p FROM rates, range(0, 80) r(i)),
sums AS (SELECT k, i, sum(p) OVER (PARTITION BY k ORDER BY i) AS total FROM terms),
draws AS (
  SELECT doc_id, k, ('0x' || substr(md5('17-1-' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM docs),
counts AS (SELECT d.doc_id, count(*) FILTER (WHERE total <= u) AS n FROM draws d JOIN sums USING (k) GROUP BY d.doc_id)
SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, c.copy::INT AS copy,
  ('0x' || substr(md5('17-order-' || d.doc_id || '-' || c.copy), 1, 13))::BIGINT AS shuffle_key
FROM documents d JOIN counts USING (doc_id), range(0, 80) c(copy) WHERE c.copy < n
""")
def op7_poisson_mix(spark, sf):
    docs = table(spark, sf, "documents")
    return poisson_mix.replicate(docs, poisson_mix.source_rates(docs)).select(
        "doc_id", "source", "lang", "text", "n_chars", "copy", "shuffle_key"
    )


@query(r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op8_bloom_lines(spark, sf):
    kept = bloom_lines.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_secret_crf(spark, sf):
    found = secret_crf.find_secrets(table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query()
def op10_slot_shards(spark, sf):
    placed, _ = slot_shards.shard_documents(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
tokens AS (SELECT lang, id, unnest(words) AS w1, unnest(range(0, len(words))) AS pos FROM numbered),
ahead AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5 FROM tokens WINDOW p AS (PARTITION BY id ORDER BY pos)),
sizes AS (SELECT lang, count(*) AS n FROM ahead GROUP BY lang),
found AS (
  SELECT lang, [w1] AS words, count(*) AS a FROM ahead GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM ahead WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT lang, a, unnest(flatten(list_transform(range(1, len(words)), lambda m: list_transform(range(0, len(words) - m + 1), lambda i: words[i + 1:i + m])))) AS words
  FROM found),
covered AS (SELECT lang, words, max(a) AS most FROM inside GROUP BY lang, words),
cuts AS (SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM found WHERE len(words) >= 2),
scored AS (
  SELECT c.lang, c.words, c.a, x.a AS l, y.a AS r, s.n, (1000::HUGEINT * c.a * s.n // (x.a::HUGEINT * y.a))::BIGINT AS score, k
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.words = c.words[1:k] JOIN found y ON y.lang = c.lang AND y.words = c.words[k + 1:] JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
kept AS (
  SELECT l.*, array_to_string(l.words, ' ') AS phrase FROM lowest l LEFT JOIN covered v ON v.lang = l.lang AND v.words = l.words
  WHERE v.most IS NULL OR 100 * v.most < 100 * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""")
def op11_count_streams(spark, sf):
    return count_streams.collocations(table(spark, sf, "documents"))


@query(r"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
paths AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path, substr(rest, length(h) + 1) AS behind FROM hosts),
listing(verdict, domain, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
numbered AS (SELECT *, row_number() OVER () AS id, substr(behind, length(path) + 1) AS tail FROM paths),
lowered AS (
  SELECT id, 'h:' AS mark, host AS said FROM numbered UNION ALL
  SELECT id, 'p:', translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM numbered UNION ALL
  SELECT id, 'q:', translate(tail, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM numbered),
words AS (SELECT id, mark, unnest(regexp_extract_all(said, '[a-z0-9\x{80}-\x{10FFFF}]+')) AS word FROM lowered),
tokens AS (SELECT DISTINCT id, mark || word AS token FROM words),
fitting AS (
  SELECT n.id, domain || start AS rule, verdict FROM numbered n JOIN listing ON (host = domain OR host LIKE '%.' || domain) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY length(domain || start) DESC) = 1),
least AS (SELECT greatest(5, ceil(count(*) / 100))::BIGINT AS least FROM fitting),
frequent AS (SELECT token FROM tokens JOIN fitting USING (id) GROUP BY token HAVING count(*) >= (SELECT least FROM least)),
held AS (SELECT id, verdict, token FROM tokens JOIN fitting USING (id) JOIN frequent USING (token)),
sets AS (
  SELECT id, verdict, [token] AS items FROM held UNION ALL
  SELECT a.id, a.verdict, [a.token, b.token] FROM held a JOIN held b ON a.id = b.id AND a.token < b.token UNION ALL
  SELECT a.id, a.verdict, [a.token, b.token, c.token] FROM held a JOIN held b ON a.id = b.id AND a.token < b.token JOIN held c ON a.id = c.id AND b.token < c.token UNION ALL
  SELECT a.id, a.verdict, [a.token, b.token, c.token, d.token] FROM held a JOIN held b ON a.id = b.id AND a.token < b.token JOIN held c ON a.id = c.id AND b.token < c.token JOIN held d ON a.id = d.id AND c.token < d.token),
counts AS (SELECT items, verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY items) AS whole FROM sets GROUP BY items, verdict),
rules AS (SELECT items, verdict, n, n::DOUBLE / whole::DOUBLE AS confidence FROM counts WHERE n >= (SELECT least FROM least) AND n::DOUBLE / whole::DOUBLE >= 0.7),
kept AS (
  SELECT r.* FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules s WHERE s.verdict = r.verdict AND len(s.items) < len(r.items) AND list_has_all(r.items, s.items) AND s.confidence >= r.confidence)),
bags AS (SELECT id, list(token) AS bag FROM tokens GROUP BY id),
mined AS (
  SELECT b.id, k.verdict, array_to_string(k.items, ' ') AS mined, k.confidence FROM bags b JOIN kept k ON list_has_all(b.bag, k.items)
  QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY k.confidence DESC, k.n DESC, len(k.items) DESC, k.verdict, k.items) = 1)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, m.verdict, 'allow') AS verdict,
  CASE WHEN f.rule IS NULL THEN m.mined END AS mined, CASE WHEN f.rule IS NULL THEN m.confidence END AS confidence
FROM numbered n LEFT JOIN fitting f USING (id) LEFT JOIN mined m USING (id)
""")
def op12_url_rules(spark, sf):
    return url_rules.judge(table(spark, sf, "pages"))


@query(r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS remainders),
coded AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said, coalesce(text, ' ') AS t, coalesce(role, ' ') AS ro FROM conversations),
drawn AS (
  SELECT coded.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(said, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c // 256, remainders[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind
  FROM coded, bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE ro END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS text
  FROM drawn, range(0, 2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
faults AS (
  SELECT *, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered),
turns AS (
  SELECT conv_id, i, turn, role, text, initial, earlier, blank, duplicate, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM faults),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
moves(origin, state, inserts, wrote) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', 'user:' || chr(10)), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 'I', 'user:' || chr(10)),
  (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)), (3, 2, 'I', 'user:' || chr(10))),
kept(state, initial, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given(state, target, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ways AS (
  SELECT t.conv_id, t.i, m.origin, m.state AS target, 2 * length(inserts) + 3 AS price, inserts || 'D' AS edits, wrote FROM turns t, moves m
  UNION ALL
  SELECT t.conv_id, t.i, m.origin, k.target, 2 * length(inserts) + t.truncated::INT, inserts || 'K', wrote || t.role || ':' || t.text || chr(10)
  FROM turns t JOIN kept k USING (initial) JOIN moves m USING (state) WHERE NOT t.blank AND NOT t.duplicate
  UNION ALL
  SELECT t.conv_id, t.i, m.origin, g.target, 2 * length(inserts) + 2 + t.truncated::INT, inserts || 'R', wrote || g.role || ':' || t.text || chr(10)
  FROM turns t, given g JOIN moves m USING (state) WHERE NOT t.blank AND NOT t.duplicate),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i, w.target, b.cost + w.price, b.audit || w.edits, b.said || w.wrote
  FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.origin = b.state
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, w.target ORDER BY b.cost + w.price, b.audit || w.edits) = 1),
closed AS (
  SELECT b.conv_id, cost + 2 * length(inserts) AS cost, audit || inserts AS audit, said || wrote AS said
  FROM best b JOIN moves m ON m.origin = b.state AND m.state = CASE b.state WHEN 0 THEN 0 ELSE 3 END
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
  WHERE b.i = coalesce(c.n, 0)
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY cost + 2 * length(inserts), audit || inserts) = 1)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, x.cost, x.audit, sha256(CASE WHEN said = '' THEN '' ELSE left(said, length(said) - 1) END) AS repaired_sha256
FROM closed x LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM x.conv_id
""")
def op13_turn_repair(spark, sf):
    return turn_repair.repair(turn_repair.damage(table(spark, sf, "conversations")))
