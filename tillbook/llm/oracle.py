"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

_LINE_DEDUP = """
WITH docs AS (
  SELECT doc_id, text, md5(text) AS body, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, body, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos
  FROM (SELECT DISTINCT doc_id, body, lines FROM docs WHERE text IS NOT NULL)
), full_lines AS (
  SELECT doc_id, body, trim(line, ' ') AS line, pos,
         row_number() OVER (PARTITION BY doc_id, body ORDER BY pos) AS k
  FROM numbered WHERE trim(line, ' ') <> ''
), windows AS (
  SELECT a.doc_id, a.body, a.pos AS first, c.pos AS last,
         md5(a.line || chr(10) || b.line || chr(10) || c.line) AS w
  FROM full_lines a
  JOIN full_lines b ON a.doc_id = b.doc_id AND a.body = b.body AND b.k = a.k + 1
  JOIN full_lines c ON a.doc_id = c.doc_id AND a.body = c.body AND c.k = a.k + 2
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, body, first) AS nth FROM windows
), covered AS (
  SELECT DISTINCT doc_id, body, unnest(range(first, last + 1)) AS pos FROM placed WHERE nth > 1
), kept AS (
  SELECT n.doc_id, n.body, string_agg(n.line, chr(10) ORDER BY n.pos) AS text
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.body = c.body AND n.pos = c.pos
  WHERE c.pos IS NULL GROUP BY n.doc_id, n.body
), counted AS (
  SELECT doc_id, body, count(*) AS n_removed FROM covered GROUP BY doc_id, body
)
SELECT d.doc_id,
       CASE WHEN r.n_removed IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
FROM docs d
LEFT JOIN counted r ON d.doc_id = r.doc_id AND d.body = r.body
LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.body = k.body
"""

_WORDS = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS words FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(text="text")} AS words FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT item_id, least(13, len(words)) AS size,
         unnest(list_transform(range(1, greatest(1, len(words) - 12) + 1),
                lambda i: array_to_string(list_slice(words, i, i + 12), ' '))) AS w
  FROM items WHERE len(words) > 0
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size,
         unnest(list_transform(range(1, len(words) - size + 2),
                lambda i: array_to_string(list_slice(words, i, i + size - 1), ' '))) AS w,
         unnest(range(1, len(words) - size + 2)) AS pos
  FROM docs, sizes WHERE len(words) >= size
), hits AS (
  SELECT d.doc_id, d.pos, d.size, i.item_id
  FROM doc_windows d JOIN item_windows i ON d.w = i.w AND d.size = i.size
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS at FROM hits) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
       CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       coalesce(m.digest, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN met m USING (doc_id)
"""

_MIXING = """
WITH sizes AS (
  SELECT coalesce(source, '') AS source, sum(length(text)) AS chars FROM documents GROUP BY 1 HAVING sum(length(text)) > 0
), weighted AS (
  SELECT *, pow(CAST(chars AS DOUBLE), 0.7) AS weight FROM sizes
), rated AS (
  SELECT source, CAST((SELECT sum(chars) FROM weighted) AS DOUBLE) * (weight / (SELECT sum(weight) FROM weighted)) / chars AS rate
  FROM weighted
), cdf AS (
  SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rated)
), drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5('count-0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source = coalesce(d.source, '') AND c.below <= d.u) AS n FROM drawn d
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n)) AS copy FROM counted
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('order-0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM copies
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {shift}) & 31) + 1, 1)"
_WARC = f"""
WITH bodies AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), digested AS (
  SELECT page_id, octet_length(body) AS size, sha1(body) AS hex FROM bodies
), named AS (
  SELECT page_id, size, array_to_string(list_transform(range(0, 8), lambda i:
    list_transform([CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)],
      lambda v: {" || ".join(_DIGIT.format(shift=s) for s in (15, 10, 5, 0))})[1]), '') AS digest
  FROM digested
), placed AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, size) AS keeper FROM named
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM placed
"""

_TOP_SCORES = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_BLANK_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MINHASH_DEDUP = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_BLANK_WORDS.format(text=_LOWER)} AS words FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(words) - 3) + 1),
         lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) AS s
  FROM docs WHERE len(words) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), named AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       CAST(coalesce(c.component_id, d.doc_id) AS BIGINT) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN named c USING (doc_id)
"""

# pairs of equal eight-word grams a period apart; consecutive ones make a stretch of that period
_PERIODIC_RUNS = f"""
WITH split AS (
  SELECT doc_id, {_BLANK_WORDS.format(text="coalesce(text, '')")} AS w,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(0, 8)),
                 lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents
), ruled AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted,
         CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts
  FROM split
), docs AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n),
           lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w
  FROM ruled
), grams AS (
  SELECT doc_id, unnest(range(0, n - 7)) AS i,
         unnest(list_transform(range(1, n - 6), lambda k: array_to_string(list_slice(w, k, k + 7), ' '))) AS g
  FROM docs WHERE n >= 24
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS nth FROM runs
), summed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text
  FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM docs) p
  LEFT JOIN dropped d ON d.doc_id = p.doc_id AND d.i = p.i WHERE d.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n_runs, 0) AS BIGINT) AS n_runs, CAST(r.start AS BIGINT) AS start,
       CAST(r.length AS BIGINT) AS length, CAST(r.period AS BIGINT) AS period,
       CAST(1000 * r.length // r.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(s.listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN summed s USING (doc_id) LEFT JOIN kept k USING (doc_id)
LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.nth = 1
"""

SQL: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op2_decontamination": _DECONTAMINATION,
    "op5_top_scores": _TOP_SCORES,
    "op6_mixing": _MIXING,
    "op9_warc": _WARC,
    "op11_minhash_dedup": _MINHASH_DEDUP,
    "op12_periodic_runs": _PERIODIC_RUNS,
}
