"""DuckDB SQL that must give the rows of a query."""

#: Words as the contracts define them: runs outside blank, tab, line feed, vertical tab, form feed and carriage return.
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER.format(text='text'))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP2 = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) < 20 THEN [] ELSE range(1, len(ws) - 18) END) AS start FROM w),
h AS (SELECT doc_id, start, array_to_string(ws[start:start + 19], ' ') AS words FROM g),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY words ORDER BY doc_id, start) AS turn FROM h),
gone AS (SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS place FROM r WHERE turn > 1),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w),
k AS (SELECT t.doc_id, count(gone.place) AS n_removed, string_agg(t.word, ' ' ORDER BY t.place) FILTER (gone.place IS NULL) AS kept
  FROM t LEFT JOIN gone USING (doc_id, place) GROUP BY t.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

#: Runs of letters, digits and characters beyond ASCII.
PLAIN = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN.format(text=LOWER.format(text='text'))} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {PLAIN.format(text=LOWER.format(text='text'))} AS ws FROM benchmark),
v AS (SELECT item, least(len(ws), 10) AS n, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS start FROM i WHERE len(ws) > 0),
b AS (SELECT DISTINCT item, n, array_to_string(ws[start:start + n - 1], ' ') AS words FROM v),
l AS (SELECT DISTINCT n FROM b),
g AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS start FROM w, l WHERE len(ws) >= n),
h AS (SELECT r, start, g.n, item FROM (SELECT r, n, start, array_to_string(ws[start:start + n - 1], ' ') AS words FROM g) g JOIN b ON b.words = g.words AND b.n = g.n),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(start, start + n)) AS place FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

#: The CRC-32 of every distinct feature, byte by byte from the table of its polynomial.
CRC = """
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
hx AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM u)),
bs AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM hx),
z AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8))) % 10000 AS bucket FROM bs, tab)"""

OP13 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN.format(text=LOWER.format(text='text'))} AS ws FROM documents),
i AS (SELECT {PLAIN.format(text=LOWER.format(text='text'))} AS ws FROM benchmark),
src AS (SELECT r, ws FROM w UNION ALL SELECT NULL, ws FROM i),
u AS (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS f FROM src),
{CRC.strip()},
x AS (SELECT r, bucket FROM u JOIN z USING (f)),
k AS (SELECT n.bucket, count(*) FILTER (r IS NOT NULL)::DOUBLE AS s, count(*) FILTER (r IS NULL)::DOUBLE AS t FROM range(10000) n(bucket) JOIN x USING (bucket) GROUP BY n.bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM k),
y AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM x JOIN g USING (bucket) WHERE r IS NOT NULL GROUP BY r),
d AS (SELECT r, doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN y USING (r)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS able FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank FROM e LEFT JOIN o USING (r)
"""

SQL = {"op1_minhash": OP1, "op2_substrings": OP2, "op12_decontamination": OP12, "op13_resampling": OP13}
