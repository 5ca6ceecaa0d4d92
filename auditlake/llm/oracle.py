"""SQL that the queries of the operators are compared with, where SQL can express them."""

from __future__ import annotations

from auditlake.llm.license_scan import NOTICES, UPPER, WORD, notice_words
from auditlake.llm.sharding import MULTIPLIERS, SHARDS, Permutation
from auditlake.llm.sharding import WORD as WORD_VALUES

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding]::DOUBLE[] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.c) AS INTEGER) AS rank,
       n.c AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

# Bytes of ``v`` one by one through the table of the reflected polynomial 0xEDB88320; DuckDB has no crc32.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS entries FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
    FROM (SELECT unnest(range(256)) AS n)))"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of ``text``, next to ``crc_table``."""
    return (
        f"xor(list_reduce([CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode({text})), '..')],"
        " lambda c, b: xor(c >> 8, entries[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"
    )


def _sharding() -> str:
    """The Feistel rounds as lateral steps of one recursive walk."""
    bits = "half_bits"
    steps, left, right = [], f"(v >> {bits})", f"(v % (1::BIGINT << {bits}))"
    first, second = (f"{m}::HUGEINT" for m in MULTIPLIERS)
    for n, key in enumerate(Permutation(1).keys):
        steps.append(
            f"LATERAL (SELECT CAST((xor({right}, {key}) * {first}) % {WORD_VALUES} AS BIGINT) AS x) a{n},"
            f" LATERAL (SELECT CAST((xor(a{n}.x, a{n}.x >> 15) * {second}) % {WORD_VALUES} AS BIGINT) AS x) b{n},"
            f" LATERAL (SELECT {right} AS l, xor({left}, xor(b{n}.x, b{n}.x >> 13) % (1::BIGINT << {bits})) AS r) s{n}"
        )
        left, right = f"s{n}.l", f"s{n}.r"
    lateral = ",\n    ".join(steps)
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table),
t AS (SELECT count(*) AS total, CAST(greatest(1, ceil(ceil(log2(greatest(count(*), 2))) / 2)) AS INTEGER) AS half_bits FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM d),
walk AS (
  SELECT row_number, row_number AS v, 0 AS steps FROM r
  UNION ALL
  SELECT row_number, ({left} << {bits}) + {right} AS v, steps + 1
  FROM walk, t, {lateral}
  WHERE steps = 0 OR v >= total)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {SHARDS} AS INTEGER) AS shard, v // {SHARDS} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, row_number
FROM walk JOIN r USING (row_number), t
WHERE steps > 0 AND v < total
"""


SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE},
o AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{UPPER.lower()}') AS run
  FROM documents),
k AS (SELECT doc_id, run, count(*) AS times FROM o WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, times, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM k, crc_table),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         CAST(sum(times) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
-- Words that agree but for one letter, or that one deletion makes equal.
m AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM m a JOIN m b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT DISTINCT m.word, w.word, w.n FROM m JOIN w ON m.less = w.word
  UNION ALL SELECT DISTINCT w.word, m.word, m.n FROM m JOIN w ON m.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM f
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, first(root ORDER BY depth DESC) AS root FROM chain GROUP BY word) AS last USING (word)
"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_scan() -> str:
    """Every place of every phrase by comparing slices, and the IDF share of its notice there."""
    places, covers = [], []
    for n, notice in enumerate(NOTICES):
        phrase, text = notice.phrase.split(), notice.notice.split()
        at = next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)
        places.append(
            f"SELECT doc_id, '{notice.label}' AS label, {str(notice.base).lower()} AS base, {n} AS n, s,"
            f" w FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {len(phrase) - 1}, 0))) AS s"
            f" FROM d WHERE list_contains(w, '{phrase[0]}')) WHERE w[s + 1 : s + {len(phrase)}] = {_list(phrase)}"
        )
        mass = " + ".join(
            f"CASE WHEN s - {at} + {i} >= 0 AND w[s - {at} + {i} + 1] = '{word}' THEN idf['{word}'] ELSE 0 END"
            for i, word in enumerate(text)
        )
        total = " + ".join(f"idf['{word}']" for word in text)
        covers.append(f"WHEN {n} THEN CASE WHEN ({total}) > 0 THEN ({mass}) / ({total}) ELSE 1 END")
    union = "\nUNION ALL\n".join(places)
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w
  FROM documents),
v AS (SELECT unnest({_list(notice_words())}) AS word),
f AS (SELECT word, count(doc_id) AS n FROM v LEFT JOIN (
        SELECT doc_id, unnest(list_distinct(w)) AS word FROM d) x USING (word) GROUP BY word),
i AS (SELECT map(list(word), list(ln((c.total + 1) / (f.n + 1)))) AS idf
      FROM f, (SELECT count(*) AS total FROM d) c),
p AS ({union}),
h AS (SELECT doc_id, label, base, s, CASE n {' '.join(covers)} END AS coverage FROM p, i),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word,
             max(s) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(coverage), 6) AS score
      FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "op1_license_scan": _license_scan(),
        "op5_kd_search": TOP_K,
        "op9_exact_dedup": EXACT_DEDUP,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_sharding": _sharding(),
        "op13_spelling_variants": SPELLING_VARIANTS,
    }
