"""DuckDB SQL of the operators that SQL can express, over whole tables."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)
), met AS (
  SELECT doc_id, i, doc_windows.n, item_id FROM doc_windows JOIN item_windows USING (run) WHERE doc_windows.n = item_windows.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b AS r FROM reach JOIN link ON link.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), g AS (
  SELECT html, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND payload_bytes >= 1000
"""

VARIANTS = r"""
WITH RECURSIVE bits AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_byte AS (
  SELECT b, c FROM bits WHERE k = 8
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), d AS (
  SELECT doc_id, run, count(*) AS times, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run) AS said FROM r GROUP BY doc_id, run
), bytes AS (
  SELECT said, flatten(list_transform(string_split(said, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)]
    ELSE [195, unicode(c) - 64] END)) AS bs
  FROM d
), far AS (  -- what a byte does to the sum when so many bytes are left, itself included
  SELECT 1 AS dist, b, c FROM crc_byte
  UNION ALL SELECT dist + 1, far.b, xor(far.c >> 8, t.c) FROM far JOIN crc_byte t ON t.b = far.c & 255
  WHERE dist < (SELECT max(len(bs)) FROM bytes)
), start AS (  -- the same of the initial ones
  SELECT 0 AS dist, 4294967295 AS c
  UNION ALL SELECT dist + 1, xor(start.c >> 8, t.c) FROM start JOIN crc_byte t ON t.b = start.c & 255
  WHERE dist < (SELECT max(len(bs)) FROM bytes)
), crc AS (
  SELECT said, xor(xor(any_value(start.c), 4294967295), bit_xor(far.c)) AS h
  FROM (SELECT said, len(bs) AS size, unnest(bs) AS b, len(bs) - generate_subscripts(bs, 1) + 1 AS dist FROM bytes) x
    JOIN far ON far.dist = x.dist AND far.b = x.b JOIN start ON start.dist = size
  GROUP BY said
), slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, times
  FROM d JOIN crc USING (said)
), v AS (
  SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), holes AS (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), shorter AS (
  SELECT DISTINCT h.word AS long, h.n AS long_n, v.word AS short, v.n AS short_n FROM holes h JOIN v ON v.word = h.a || h.z
), near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.a = y.a AND x.z = y.z WHERE x.word <> y.word
  UNION ALL SELECT long, long_n, short, short_n FROM shorter
  UNION ALL SELECT short, short_n, long, long_n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -other_n, 'form': other}) AS b FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= 2 * v.n THEN b.form END AS form,
    CASE WHEN -b.less >= 2 * v.n THEN -b.less END AS form_n
  FROM v LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT path.word, f.form FROM path JOIN forms f ON f.word = path.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, path.root, f.n, f.n_near, f.form_n
FROM forms f JOIN path USING (word) JOIN forms last ON last.word = path.root AND last.form IS NULL
"""
