"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said,
         coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS part
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
pieces AS (
  SELECT t.*, s.perspective, t.role = s.perspective AS own,
         CASE WHEN t.role = s.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || regexp_replace(regexp_replace(t.role, '<\|(im_start|im_end)\|>', '< |\1| >', 'g'), '[\r\n]+', ' ', 'g') || chr(10)
         END AS head,
         regexp_replace(t.said, '<\|(im_start|im_end)\|>', '< |\1| >', 'g') || '<|im_end|>' AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
           PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, said
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM pieces),
parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, sum(length(head) + length(body) + 1) AS size,
         sum(CASE WHEN own THEN length(body) ELSE 0 END) AS n_masked,
         coalesce(string_agg(CASE WHEN own THEN CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT) END,
                    ',' ORDER BY turn NULLS FIRST, role, said), '') AS masks,
         string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, said) AS text
  FROM placed GROUP BY ALL)
SELECT conv_id, perspective, part,
       CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY part
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_start,
       CAST(n_turns AS BIGINT) AS n_turns, CAST(n_masked AS BIGINT) AS n_masked, masks, text
FROM parts
"""

SHINGLES = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
"""

OP1 = f"""
WITH RECURSIVE {SHINGLES}
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM each x JOIN each y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, n AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM sizes JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY 1) USING (doc_id)
"""

OP3 = f"""
WITH {SHINGLES}
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x20\\x09-\\x0D]+') AS w
  FROM benchmark),
item_sets AS (
  SELECT item_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM items),
doc_each AS (SELECT doc_id, unnest(s) AS g FROM sets),
item_each AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM item_sets)
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM item_each JOIN doc_each USING (g) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""

OP6 = f"""
WITH {SHINGLES}
each AS (SELECT doc_id, unnest(w) AS g FROM words),
bags AS (SELECT doc_id, g, count(*) AS tf FROM each GROUP BY ALL),
lengths AS (SELECT doc_id, len(w) AS dl, avg(len(w)) OVER () AS mean, count(*) OVER () AS n FROM words),
df AS (SELECT g, count(*) AS df FROM bags GROUP BY g),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM bags q JOIN df USING (g) JOIN bags d USING (g) JOIN lengths l ON l.doc_id = d.doc_id
  WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP11 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, count(DISTINCT struct_pack(doc_id := doc_id, place := place)) AS n_rows,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS w FROM sources),
levels AS (
  SELECT *, CAST(3 * s AS DOUBLE) / w AS level, sum(s) OVER () AS words, sum(w) OVER () AS w_all,
         coalesce(sum(3 * s) OVER o, 0) AS stopped, coalesce(sum(w) OVER o, 0) AS w_before
  FROM weighted WINDOW o AS (ORDER BY CAST(3 * s AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (
  SELECT words - stopped AS rest, w_all - w_before AS open FROM levels
  WHERE level >= CAST(words - stopped AS DOUBLE) / (w_all - w_before) ORDER BY level, rank LIMIT 1),
targets AS (
  SELECT source, rank, s, least(CAST(3 * s AS DOUBLE), CAST(w * rest AS DOUBLE) / open) AS target,
         greatest(1, ceil(s / 262144.0), ceil(n_rows / 4096.0)) AS shards
  FROM levels, first),
placed AS (
  SELECT d.*, t.rank, t.s, t.target, CAST(CAST('0x' || place[1:8] AS BIGINT) % t.shards AS BIGINT) AS shard
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cells AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / s * n * 1000000) AS BIGINT) ELSE 0 END AS votes,
         CAST('0x' || md5('1:' || rank || ':' || shard)[1:8] AS BIGINT) % greatest(n, 1) AS start
  FROM (SELECT rank, shard, s, target, sum(size) AS words, CAST(ceil(sum(size) / 32.0) AS BIGINT) AS n FROM placed GROUP BY ALL)),
seats AS (SELECT rank, shard, unnest(range(1, 3 * n + 1)) AS i, votes FROM cells),
won AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY votes / (i - 0.5) DESC, rank, shard, i) AS nth FROM seats)
  WHERE nth <= (SELECT (sum(votes) + 500000) // 1000000 FROM cells) GROUP BY ALL),
drawn AS (
  SELECT rank, shard, n, start, coalesce(quota, 0) // greatest(n, 1) AS laps, coalesce(quota, 0) % greatest(n, 1) AS extra
  FROM cells LEFT JOIN won USING (rank, shard)),
ordered AS (
  SELECT p.*, n, start, laps, extra, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY place, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM placed p JOIN drawn USING (rank, shard)),
blocks AS (
  SELECT *, CAST(a + size AS BIGINT) AS z, CAST(a // 32 AS BIGINT) AS i, CAST((a + size) // 32 AS BIGINT) AS j, greatest(n, 1) AS m FROM ordered)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target,
       CAST(laps * size
            + 32 * ((j * extra + start) // m) + CASE WHEN ((j + 1) * extra + start) // m > (j * extra + start) // m THEN z % 32 ELSE 0 END
            - 32 * ((i * extra + start) // m) - CASE WHEN ((i + 1) * extra + start) // m > (i * extra + start) // m THEN a % 32 ELSE 0 END AS BIGINT) AS taken
FROM blocks
"""


def op12(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other; of each part the 16 entries and their distances."""
    book = """
b{k} AS MATERIALIZED (
  SELECT b.p, b.e, CASE WHEN n > 0 THEN list_transform(s, lambda v: CAST(floor(v / n) AS BIGINT)) ELSE b.x END AS x
  FROM b{j} b LEFT JOIN (
    SELECT p, e, max(n) AS n, list(v ORDER BY i) AS s
    FROM (SELECT p, e, i, sum(x[i]) AS v, count(*) AS n FROM a{j} a, range(1, 9) r(i) GROUP BY ALL) GROUP BY p, e) USING (p, e)),"""
    assigned = """
a{j} AS MATERIALIZED (
  SELECT vec_id, label, p, x, least_of.e AS e, least_of.d AS d FROM (
    SELECT vec_id, label, p, x, min(struct_pack(d := d, e := e)) AS least_of FROM (
      SELECT a.*, b.e, list_sum(list_transform(range(1, 9), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d
      FROM parts a JOIN b{j} b USING (p)) GROUP BY ALL)),"""
    steps = "".join(assigned.format(j=k) + book.format(j=k, k=k + 1) for k in range(rounds)) + assigned.format(j=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, x[8 * p + 1:8 * p + 8] AS x FROM kept, range(8) r(p)),
b0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{steps}
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""


OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {
    "op6_topk_search": OP6,
    "op3_decontaminate": OP3,
    "op1_near_dedup": OP1,
    "op10_chat_format": OP10,
    "op11_source_mix": OP11,
    "op12_vector_codes": op12(),
    "op13_fill_middle": OP13,
}
