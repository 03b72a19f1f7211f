"""Common table expressions shared by the reference SQL."""

from __future__ import annotations

from .bindings import REPLY_LABELS, WORDS

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
IS_TRAIN = "('0x' || md5('0-' || doc_id)[1:8])::BIGINT < 2147483648"

SIDES = """
WITH l AS ({labels}),
o AS (SELECT label, row_number() OVER (ORDER BY md5('0-' || label), label) AS pos, count(*) OVER () AS n FROM l),
sides AS (SELECT label, CASE WHEN pos <= floor(n * 0.5) THEN 'a' ELSE 'b' END AS side FROM o)
"""


def words(n: int) -> str:
    rows = ", ".join(
        f"('{lang}', {pos}, '{w}')" for pos, (lang, ws) in enumerate(WORDS.items()) for w in ws[:n]
    )
    return f"(VALUES {rows}) w(label, ord, word)"


def route(table: str, **heads: int) -> str:
    """CTEs ``<head>_grid`` (score of every label) and ``<head>_ans`` (the answer)."""
    parts = [f"tok AS (SELECT doc_id AS item_id, unnest({TOKENS}) AS tok FROM {table})"]
    for head, n in heads.items():
        parts.append(
            f"{head}_hits AS (SELECT item_id, label, count(*) AS score FROM tok JOIN {words(n)} ON word = tok GROUP BY 1, 2)"
        )
        parts.append(
            f"{head}_grid AS (SELECT doc_id AS item_id, l.label, l.ord, coalesce(score, 0) AS score FROM {table} "
            f"CROSS JOIN (SELECT DISTINCT label, ord FROM {words(n)}) l "
            f"LEFT JOIN {head}_hits h ON h.item_id = doc_id AND h.label = l.label)"
        )
        parts.append(
            f"{head}_ans AS (SELECT item_id, arg_max(label, score * 1000 - ord) AS label, "
            f"max(score)::DOUBLE / nullif(sum(score), 0) AS confidence FROM {head}_grid GROUP BY 1)"
        )
    return "WITH " + ",\n".join(parts) + "\n"


LANGUAGE_SCORED = route("documents", lex10=10, lex3=3) + """
, preds AS (SELECT 'lex10' AS system, item_id, label FROM lex10_ans UNION ALL SELECT 'lex3', item_id, label FROM lex3_ans),
scored AS (SELECT system, item_id, label AS pred, lang AS gold, label = lang AS correct FROM preds JOIN documents ON doc_id = item_id)
"""

FLAG_SCORED = """
WITH f AS (SELECT d.doc_id AS item_id,
    list_filter([CASE WHEN n_chars > 200 THEN 'quality' END, CASE WHEN contains(text, '***') THEN 'toxic' END], lambda x: x IS NOT NULL) AS pred,
    list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS gold
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

# Exact distribution of the resampled number of hits.
ACCURACY_CI = """
, nk AS (SELECT system, count(*) AS n, count(*) FILTER (correct) AS k FROM scored GROUP BY 1),
pmf AS (SELECT system, n, k, i, CASE WHEN k = 0 THEN (i = 0)::INT::DOUBLE WHEN k = n THEN (i = n)::INT::DOUBLE
    ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n) + (n - i) * ln(1 - k / n)) END AS p
  FROM nk, LATERAL (SELECT unnest(range(n + 1)) AS i)),
cdf AS (SELECT system, n, k, i, sum(p) OVER (PARTITION BY system ORDER BY i) AS c FROM pmf),
ci AS (SELECT system, n, k, min(i) FILTER (c >= 0.025) / n AS ci_low, min(i) FILTER (c >= 0.975) / n AS ci_high FROM cdf GROUP BY 1, 2, 3)
"""

LABEL_COUNTS = """
, seen AS (SELECT system, pred AS label FROM scored UNION SELECT system, gold FROM scored),
per_label AS (SELECT s.system, s.label, count(*) FILTER (pred = label AND gold = label) AS tp,
    count(*) FILTER (pred = label AND gold <> label) AS fp, count(*) FILTER (pred <> label AND gold = label) AS fn,
    CASE WHEN count(*) FILTER (pred = label AND gold = label) = 0 THEN 0.0 ELSE
      2.0 * count(*) FILTER (pred = label AND gold = label)
        / (count(*) FILTER (pred = label) + count(*) FILTER (gold = label)) END AS f1
  FROM seen s JOIN scored x ON x.system = s.system GROUP BY 1, 2)
"""

CELLS = """
, cells AS (SELECT 'lex10' AS a, 'lex3' AS b, count(*) FILTER (x.correct AND y.correct) AS n11,
    count(*) FILTER (x.correct AND NOT y.correct) AS n10, count(*) FILTER (NOT x.correct AND y.correct) AS n01,
    count(*) FILTER (NOT x.correct AND NOT y.correct) AS n00
  FROM scored x JOIN scored y ON x.item_id = y.item_id AND x.system = 'lex10' AND y.system = 'lex3')
"""

MCNEMAR = """
, mcnemar AS (SELECT a, b, n10, n01, CASE WHEN n10 + n01 = 0 THEN 1.0 ELSE least(1.0, 2 * (
    SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2)))
    FROM (SELECT unnest(range(least(n10, n01) + 1)) AS i))) END AS mcnemar_p FROM cells)
"""

# Exact distribution of the resampled difference: a trinomial summed along diagonals.
PAIR_CI = """
, t AS (SELECT a, b, n10, n01, n11 + n10 + n01 + n00 AS n FROM cells),
side_i AS (SELECT t.*, unnest(range(n + 1)) AS i FROM t),
grid AS (SELECT a, b, n10, n01, n, i, unnest(range(n - i + 1)) AS j FROM side_i WHERE n10 > 0 OR i = 0),
mass AS (SELECT a, b, n10, n01, n, i - j AS d, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(j + 1) - lgamma(n - i - j + 1)
      + CASE WHEN i = 0 THEN 0 ELSE i * ln(n10 / n) END + CASE WHEN j = 0 THEN 0 ELSE j * ln(n01 / n) END
      + CASE WHEN n - i - j = 0 THEN 0 ELSE (n - i - j) * ln(1 - (n10 + n01) / n) END)) AS p
  FROM grid WHERE n01 > 0 OR j = 0 GROUP BY ALL),
run AS (SELECT *, sum(p) OVER (PARTITION BY a, b ORDER BY d) AS c FROM mass),
pair_ci AS (SELECT a, b, (n10 - n01) / n AS diff, min(d) FILTER (c >= 0.025) / n AS ci_low, min(d) FILTER (c >= 0.975) / n AS ci_high,
    least(1.0, 2 * least(sum(p) FILTER (d <= 0), sum(p) FILTER (d >= 0))) AS p_value FROM run GROUP BY a, b, n10, n01, n)
"""

DOC_LATENCY = """
, lat AS (SELECT n_chars / 100.0 AS ms, row_number() OVER (ORDER BY n_chars) - 1 AS pos, count(*) OVER () AS m FROM documents),
latency AS (SELECT median(ms) AS p50, max(ms) FILTER (pos = least(m - 1, floor(0.95 * m))) AS p95 FROM lat)
"""

_FLOOR = """
floor AS (SELECT lang AS label, count(*) AS c, (SELECT count(*) FROM documents) AS n, (SELECT count(DISTINCT lang) FROM documents) AS k
  FROM documents GROUP BY 1 ORDER BY c DESC, min(doc_id) LIMIT 1)
"""
DOC_FLOOR = ", " + _FLOOR
DOC_FLOOR_ONLY = "WITH " + _FLOOR

# Schema rows of four heads over the nations; AFRICA has no descriptions.
NATION_SCHEMA = SIDES.format(labels="SELECT DISTINCT n_name AS label FROM nation") + """
, named AS (SELECT n_name AS label, (row_number() OVER (ORDER BY n_name) - 1)::INT AS ord,
    CASE WHEN r_name <> 'AFRICA' THEN r_name END AS description FROM nation JOIN region ON n_regionkey = r_regionkey),
heads AS (
  SELECT 'plain' AS head, label, ord, NULL::VARCHAR AS description, false AS multi_label, NULL::DOUBLE AS cls_threshold FROM named
  UNION ALL SELECT 'described', label, ord, description, false, NULL FROM named WHERE description IS NOT NULL
  UNION ALL SELECT 'multi', label, ord, NULL, true, 0.25 FROM named
  UNION ALL SELECT 'subset', label, ord, NULL, false, NULL FROM named WHERE label IN (SELECT label FROM sides WHERE side = 'a'))
"""

_REPLY_VALUES = ", ".join(f"('{x}', {i})" for i, x in enumerate(REPLY_LABELS))
REPLIES = f"""
WITH r AS (SELECT doc_id AS item_id, CASE doc_id % 8 WHEN 0 THEN 'lang_' || lang WHEN 1 THEN upper('lang_' || lang)
    WHEN 2 THEN '  "lang_' || lang || '".' WHEN 3 THEN '```' || chr(10) || 'lang_' || lang || chr(10) || '```'
    WHEN 4 THEN 'The answer is lang-' || lang WHEN 5 THEN (array_position(['de','en','es','fr'], lang) - 1)::VARCHAR
    WHEN 6 THEN 'It depends.' || chr(10) || 'lang_' || lang ELSE text END AS content FROM documents),
keyed AS (SELECT item_id, content, trim(regexp_replace(lower(string_split(
    trim(trim(trim(content, ' ' || chr(10) || chr(13) || chr(9)), '`'), ' ' || chr(10) || chr(13) || chr(9)), chr(10))[1]),
    '[^a-z0-9]+', '_', 'g'), '_') AS key FROM r),
opts(label, ord) AS (VALUES {_REPLY_VALUES}),
named AS (SELECT item_id, arg_max(label, length(label)) AS label FROM keyed JOIN opts ON key = label OR ends_with(key, '_' || label) GROUP BY 1),
parsed AS (SELECT k.item_id, content, coalesce(n.label, o.label) AS label FROM keyed k LEFT JOIN named n ON n.item_id = k.item_id
  LEFT JOIN opts o ON regexp_full_match(key, '[0-9]+') AND try_cast(key AS INT) = o.ord)
"""

TFIDF = f"""
WITH w AS (SELECT doc_id AS item_id, {TOKENS} AS w FROM documents),
terms AS (SELECT item_id, unnest(w) AS term FROM w
  UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT item_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT item_id, term, tf, df, idf, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term)),
weighted AS (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS norm FROM raw)
"""

_SWAP = SIDES.format(labels="SELECT DISTINCT lang AS label FROM documents") + f"""
, tok AS (SELECT doc_id AS item_id, unnest({TOKENS}) AS tok FROM documents),
hits AS (SELECT item_id, label, count(*) AS score FROM tok JOIN {words(10)} ON word = tok GROUP BY 1, 2),
cand AS (SELECT doc_id AS item_id, lang AS gold, own.side, l.label, l.ord, coalesce(score, 0) AS score FROM documents
  JOIN sides own ON own.label = lang JOIN (SELECT DISTINCT label, ord FROM {words(10)}) l ON true JOIN sides theirs ON theirs.label = l.label
  LEFT JOIN hits h ON h.item_id = doc_id AND h.label = l.label WHERE FILTER),
scored AS (SELECT side AS system, item_id, arg_max(label, score * 1000 - ord) = gold AS correct FROM cand GROUP BY side, item_id, gold),
sizes AS (SELECT side, count(*) AS n_labels FROM sides GROUP BY 1)
""" + ACCURACY_CI
SWAP_SUBSET = _SWAP.replace("FILTER)", "theirs.side = own.side)")
SWAP_FULL = _SWAP.replace("FILTER)", "true)")


# --- logistic regression -------------------------------------------------------------------
# The optimum of the regularised objective, found by accelerated gradient descent on the weights of
# the training rows (a weight vector is their combination), so only dot products of rows are needed.

DOCUMENT_ROWS = f"rows AS (SELECT doc_id AS id, lang AS label, text, ({IS_TRAIN}) AS train FROM documents)"
EMBEDDING_ROWS = f"""rows AS (SELECT vec_id AS id, label::VARCHAR AS label, embedding::DOUBLE[] AS v, ({IS_TRAIN.replace("doc_id", "vec_id")}) AS train FROM embeddings)"""

_CLASSES = """
sizes AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS c, count(*) OVER () AS m, sum(count(*)) OVER ()::BIGINT AS total FROM rows WHERE train GROUP BY label),
classes AS (SELECT max(m) AS m, max(total) AS n, list(label ORDER BY c) AS names FROM sizes),
known AS (SELECT id, row_number() OVER (ORDER BY id) AS i, c, total / (m * n) AS w FROM rows JOIN sizes USING (label) WHERE train),
facts AS (SELECT list(c ORDER BY i) AS c, list(w ORDER BY i) AS w FROM known)"""
_TEXT_DOTS = f"""
words AS (SELECT id, train, {TOKENS} AS w FROM rows),
terms AS (SELECT id, train, unnest(w) AS term FROM words UNION ALL SELECT id, train, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
tf AS (SELECT id, train, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT n FROM classes)) / (1 + count(*))) + 1 AS idf FROM tf WHERE train GROUP BY term),
raw AS (SELECT id, train, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term)),
scaled AS (SELECT id, train, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS x FROM raw),
met AS (SELECT a.id, b.id AS other, sum(a.x * b.x) AS dot FROM scaled a JOIN scaled b ON a.term = b.term AND b.train GROUP BY ALL),
dots AS MATERIALIZED (SELECT r.id, list(coalesce(dot, 0) ORDER BY i) AS row FROM rows r CROSS JOIN known k LEFT JOIN met ON met.id = r.id AND met.other = k.id GROUP BY r.id)"""
_VECTOR_DOTS = """
dots AS MATERIALIZED (SELECT r.id, list(list_dot_product(r.v, y.v) ORDER BY i) AS row FROM rows r CROSS JOIN known k JOIN rows y ON y.id = k.id GROUP BY r.id)"""
_DESCENT = """
gram AS MATERIALIZED (SELECT list(row ORDER BY i) AS k FROM dots JOIN known USING (id)),
fit AS (
  SELECT 0 AS t, list_transform(range(0, m), lambda c: list_transform(range(0, n), lambda i: 0.0::DOUBLE)) AS a, a AS y,
    list_transform(range(0, m), lambda c: 0.0::DOUBLE) AS b, b AS z FROM classes
  UNION ALL
  SELECT t + 1, na, list_transform(range(1, m + 1), lambda c: list_transform(range(1, n + 1), lambda i: na[c][i] + mu * (na[c][i] - a[c][i]))),
    nb, list_transform(range(1, m + 1), lambda c: nb[c] + mu * (nb[c] - b[c]))
  FROM (
    SELECT t, a, b, m, n, (sqrt(n) - 1) / (sqrt(n) + 1) AS mu,
      list_transform(range(1, m + 1), lambda c: list_transform(range(1, n + 1), lambda i: y[c][i] - r[i][c] - y[c][i] / n)) AS na,
      list_transform(range(1, m + 1), lambda c: z[c] - list_sum(list_transform(range(1, n + 1), lambda i: r[i][c]))) AS nb
    FROM (
      SELECT t, a, b, y, z, m, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, m + 1),
        lambda c: facts.w[i] * (e[i][c] / list_sum(e[i]) - (facts.c[i] = c)::INT) / n)) AS r
      FROM (
        SELECT t, a, b, y, z, m, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, m + 1), lambda c: exp(list_dot_product(k[i], y[c]) + z[c]))) AS e
        FROM fit, gram, classes WHERE t < PASSES)
      , facts))
),
solved AS (SELECT a, b FROM fit ORDER BY t DESC LIMIT 1),
shares AS (
  SELECT id, label, names, list_transform(range(1, m + 1), lambda c: exp(list_dot_product(row, a[c]) + b[c])) AS e
  FROM rows JOIN dots USING (id), solved, classes WHERE NOT train),
answers AS (SELECT id AS item_id, label AS gold, names[list_position(e, list_max(e))] AS pred, list_max(e) / list_sum(e) AS confidence FROM shares)
"""


def logistic(rows: str, text: bool, passes: int = 800) -> str:
    """CTEs up to ``answers`` (item_id, gold, pred, confidence) for the rows that are not for training."""
    return f"WITH RECURSIVE {rows}," + _CLASSES + "," + (_TEXT_DOTS if text else _VECTOR_DOTS) + "," + _DESCENT.replace("PASSES", str(passes))


def scored_answers(system: str) -> str:
    return f", scored AS (SELECT '{system}' AS system, item_id, pred, gold, pred = gold AS correct FROM answers)"


SYSTEM_ROWS = ACCURACY_CI + LABEL_COUNTS + """
SELECT ci.system AS name, ci.n, round(k / ci.n, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(mf, 6) AS macro_f1
FROM ci JOIN (SELECT system, avg(f1) AS mf FROM per_label GROUP BY 1) m ON m.system = ci.system
"""


def curve(sizes: list[int]) -> str:
    """Held-out accuracy of models fitted on the first rows in random order."""
    parts = []
    for size in sizes:
        rows = f"""placed AS (SELECT *, row_number() OVER (ORDER BY md5('0-' || doc_id), doc_id) AS place FROM documents WHERE {IS_TRAIN}),
rows AS (SELECT doc_id AS id, lang AS label, text, true AS train FROM placed WHERE place <= {size}
  UNION ALL SELECT doc_id, lang, text, false FROM documents WHERE NOT ({IS_TRAIN}))"""
        parts.append(f"SELECT * FROM ({logistic(rows, True)} SELECT {size}::BIGINT AS trained_on, count(*) AS n, round(avg((pred = gold)::INT), 6) AS accuracy FROM answers)")
    return "\nUNION ALL\n".join(parts)


# The panel over the held-out half of the documents, labels written lang_xx.
_PANEL_ROWS = DOCUMENT_ROWS.replace("lang AS label", "'lang_' || lang AS label")
PANEL = logistic(_PANEL_ROWS, True) + ", " + route("documents", lex10=10).removeprefix("WITH ") + ", " + REPLIES.strip().removeprefix("WITH ") + f""",
asked AS (SELECT doc_id AS item_id, 'lang_' || lang AS gold, n_chars FROM documents WHERE NOT ({IS_TRAIN})),
given AS (
  SELECT 'TF-IDF + logistic regression' AS system, item_id, pred FROM answers
  UNION ALL SELECT 'Word overlap (zero-shot)', a.item_id, arg_max(o.label, (SELECT count(*) FROM tok t WHERE t.item_id = a.item_id AND 'lang_' || t.tok = o.label) * 1000 - o.ord)
    FROM asked a CROSS JOIN opts o GROUP BY a.item_id
  UNION ALL SELECT 'Word overlap + label descriptions', item_id, 'lang_' || label FROM lex10_ans
  UNION ALL SELECT 'External model (zero-shot)', item_id, coalesce(label, '__none__') FROM parsed),
scored AS (SELECT system, item_id, pred, gold, pred = gold AS correct FROM given JOIN asked USING (item_id))
""" + ACCURACY_CI + LABEL_COUNTS + """,
macro AS (SELECT system, avg(f1) AS mf FROM per_label GROUP BY 1)
"""
