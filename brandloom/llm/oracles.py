"""DuckDB SQL for the opN_ queries that SQL can express."""

OP1 = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
starts AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM folded, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size),
found AS (
  SELECT s.doc_id, s.i, s.size, g.item_id
  FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM starts) s JOIN grams g USING (size, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT f.doc_id, coalesce(len(f.w), 0)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(f.w), FALSE) AS contaminated
FROM folded f LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

OP3 = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
least AS (SELECT gram, min(doc_id) AS first FROM windows GROUP BY gram HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (gram) WHERE doc_id > first)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM split),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 20 + length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(role, '\[/?INST\]|</?s>')) + len(regexp_extract_all(text, '\[/?INST\]|</?s>')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP11 = r"""
WITH RECURSIVE slow AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs
  WHERE length(run) >= 5 GROUP BY ALL),
crcs AS (
  SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(hx) // 2 + 1), lambda i: ('0x' || hx[2 * i - 1 : 2 * i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT w, n, hex(encode(id || ':' || w)) AS hx FROM lowered), slow),
words AS (
  SELECT w, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM crcs)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
shorter AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (
  SELECT a.w, b.w AS v, b.n FROM shorter a JOIN shorter b USING (i, v) WHERE a.w <> b.w AND length(a.w) = length(b.w)
  UNION SELECT a.w, b.w, b.n FROM shorter a JOIN words b ON a.v = b.w
  UNION SELECT a.w, b.w, b.n FROM words a JOIN shorter b ON a.w = b.v),
best AS (SELECT w, count(*) AS n_near, max(n) AS most, arg_min(v, (-n, v)) AS v FROM near GROUP BY w),
formed AS (
  SELECT w AS word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * n THEN v END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (w)),
up AS (
  SELECT word, form AS top FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT u.word, f.form FROM up u JOIN formed f ON u.top = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT u.word, u.top FROM up u JOIN formed f ON u.top = f.word WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, coalesce(top, word) AS root FROM formed LEFT JOIN ends USING (word)
"""

OP12 = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || x[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM split),
cut AS (
  SELECT *, array_to_string(u[1 : least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1 : n], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

ORACLES = {"op6_chat": OP6, "op1_decontamination": OP1, "op3_substring_dedup": OP3, "op11_spelling": OP11, "op12_fill_middle": OP12}
