"""SQL (DuckDB) for the queries of this subpackage that SQL can express; the others are tested against brute force."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES = {
    "op4_vantage_point_trees": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(c.v, q.v), lambda z: z[1] * z[2])) / (c.size * q.size) AS score
      FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND q.size > 0 AND c.size > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5""",
    "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
  lambda i: substr('{BASE32}', 1 + ((('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, NULL::VARCHAR AS problem FROM g""",
    "op10_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM r),
o AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total, sum(cap) OVER (ORDER BY cap / weight, n ROWS UNBOUNDED PRECEDING) - cap AS spent,
  sum(weight) OVER (ORDER BY cap / weight DESC, n DESC ROWS UNBOUNDED PRECEDING) AS rest FROM w),
u AS (SELECT arg_min((total - spent) / rest, cap / weight) AS unit FROM o WHERE cap > (total - spent) / rest * weight),
t AS (SELECT source, source_size, CASE WHEN unit IS NULL THEN cap ELSE least(cap, unit * weight) END AS target FROM w, u),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
l AS (SELECT *, greatest(target - whole * source_size, 0) AS remainder FROM x),
g AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM d GROUP BY source, h),
b AS (SELECT g.source, max(g.h) AS edge, arg_max((remainder - before) * 2 > words AND words > 0, g.h) AS also FROM g JOIN l ON g.source IS NOT DISTINCT FROM l.source
  WHERE before <= remainder GROUP BY g.source),
c AS (SELECT d.*, l.source_size, l.target, least(whole + CASE WHEN whole < 2 AND (h < edge OR (h = edge AND also)) THEN 1 ELSE 0 END, 2)::BIGINT AS copies
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM c""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY part, m),
l AS (SELECT substr('ABCDE', i::INT + 1, 1) AS c, (1 << i)::INT AS b FROM range(5) r(i)),
o AS (SELECT q.c || r.c || s.c || t.c || u.c AS filter_order, [q.b, r.b, s.b, t.b, u.b] AS seq FROM l q, l r, l s, l t, l u WHERE q.b | r.b | s.b | t.b | u.b = 31),
p AS (SELECT filter_order, step::INT AS step, seq[step] AS b, coalesce(list_sum(seq[:step - 1]), 0)::INT AS before FROM o, range(1, 6) v(step)),
e AS (SELECT part, filter_order, step, b, sum(CASE WHEN m & (before | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN m & b > 0 AND m & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN m & b > 0 AND m & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN m = b THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN m & b > 0 AND m & before = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN m & b > 0 AND m & before = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM p, c GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, b)::BIGINT AS shapley FROM e""",
}
