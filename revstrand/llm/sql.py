"""DuckDB SQL of the operators that SQL can express."""

#: Prefixes of the ranking, as in `mixing`.
ROUNDS = 3
MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE / count(*)::DOUBLE AS mean_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, row_number() OVER o AS n,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_w
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST)
), f AS (
  SELECT n AS nf, rest AS f_rest, rest_w AS f_w FROM r WHERE rest::DOUBLE / rest_w::DOUBLE * w <= cap ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, mean_size, CASE WHEN n >= nf THEN (f_rest * w)::DOUBLE / f_w::DOUBLE ELSE cap::DOUBLE END AS target FROM r, f
), m AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END AS mean FROM t
), g AS (
  SELECT *, floor(mean)::BIGINT AS whole, mean - floor(mean) AS part, target - (floor(mean)::BIGINT * source_size)::DOUBLE AS budget FROM m
), p AS (
  SELECT d.doc_id, d.source, d.size, d.u, g.source_size, g.mean_size, g.target, g.whole, g.part, g.budget FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), o AS (
  SELECT *, rank() OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size) AS k, count(*) OVER (PARTITION BY source, doc_id, size) AS alike FROM (
    SELECT *, (u / (1 - u)) / ((part / (1 - part)) * sqrt(greatest(size, 1)::DOUBLE / mean_size)) AS q FROM p WHERE part > 0 AND mean_size > 0)
), e0 AS (
  SELECT source, 0::BIGINT AS stop, budget AS gap FROM g
)""" + "".join(f""", c{i} AS (
  SELECT o.*, gap, sum(size) OVER (PARTITION BY o.source ORDER BY k RANGE UNBOUNDED PRECEDING)::DOUBLE AS upto
  FROM o JOIN e{i - 1} e ON o.source IS NOT DISTINCT FROM e.source WHERE k > e.stop AND size <= e.gap
), s{i} AS (
  SELECT source, coalesce(min(k) FILTER (upto > gap), 9000000000000000000) AS stop, coalesce(max(upto) FILTER (upto <= gap), 0) AS used FROM c{i} GROUP BY source
), e{i} AS (
  SELECT e.source, coalesce(s.stop, 9000000000000000000) AS stop, e.gap - coalesce(s.used, 0) AS gap FROM e{i - 1} e LEFT JOIN s{i} s ON e.source IS NOT DISTINCT FROM s.source
), t{i} AS (
  SELECT DISTINCT c.source, c.k FROM c{i} c JOIN e{i} e ON c.source IS NOT DISTINCT FROM e.source WHERE c.k < e.stop
)""" for i in range(1, ROUNDS + 1)) + """, tk AS (
""" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, ROUNDS + 1)) + f"""
), n AS (
  SELECT o.*, e.gap FROM o JOIN e{ROUNDS} e ON o.source IS NOT DISTINCT FROM e.source WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.source IS NOT DISTINCT FROM o.source AND tk.k = o.k)
), z AS (
  SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), k) AS rn FROM n) WHERE rn = 1 AND abs(size - gap) < gap AND alike = 1
), x AS (
  SELECT DISTINCT o.source, o.doc_id, o.size FROM o JOIN (SELECT * FROM tk UNION ALL SELECT * FROM z) y ON o.source IS NOT DISTINCT FROM y.source AND o.k = y.k
)
SELECT p.doc_id, p.size, p.source_size, p.target, ((p.whole + CASE WHEN x.size IS NULL THEN 0 ELSE 1 END) * p.size)::BIGINT AS taken
FROM p LEFT JOIN x ON p.source IS NOT DISTINCT FROM x.source AND p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.size = x.size
"""

SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s
), m AS (
  SELECT h, min(doc_id) AS first FROM g GROUP BY h
), r AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m USING (h) WHERE m.first < g.doc_id
), k AS (
  SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id
), e AS (
  SELECT d.doc_id, d.w, coalesce(k.gone, []) AS gone FROM d LEFT JOIN k USING (doc_id)
), p AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM e
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS t FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.i WHERE r.p IS NULL GROUP BY p.doc_id
)
SELECT e.doc_id, len(e.w)::BIGINT AS n_words, len(e.gone)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM e LEFT JOIN kept USING (doc_id)
"""
