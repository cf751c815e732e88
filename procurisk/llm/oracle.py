"""SQL for DuckDB that gives the rows of the registered queries by another road, where SQL can express them."""

from __future__ import annotations

IMPACT_TOPK = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

REPETITION_RULES = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sized AS (
  SELECT *, len(w) AS n FROM split
), places AS (
  SELECT doc_id, w, n, unnest(range(1, n + 1)) AS i FROM sized
), grams AS (
  SELECT doc_id, i,
    CASE WHEN i + 2 <= n THEN hash(w[i:i + 2]) END AS g3,
    CASE WHEN i + 15 <= n THEN hash(w[i:i + 15]) END AS g16,
    CASE WHEN i + 200 <= n THEN hash(w[i:i + 200]) END AS g201
  FROM places
), marked AS (
  SELECT doc_id, i,
    g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
    g16 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g16) > 1 AS r16,
    g201 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g201) > 1 AS r201
  FROM grams
), spread AS (
  SELECT doc_id, r201,
    bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    bool_or(r16) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS c16
  FROM marked
), counted AS (
  SELECT doc_id, count(*) FILTER (c3) AS n3, count(*) FILTER (c16) AS n16, bool_or(r201) AS long FROM spread GROUP BY doc_id
), rows AS (
  SELECT s.doc_id, s.n::BIGINT AS n_words,
    coalesce(list_sum(list_transform(s.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(s.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines(s.text)) - len(list_distinct(lines(s.text))))::BIGINT AS n_dup_lines,
    coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n16, 0)::BIGINT AS n_covered_words, coalesce(long, false) AS long
  FROM (SELECT * FROM sized) s LEFT JOIN counted USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rows
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT base_failed AND 100 * n_covered_words <= 20 * n_words AND NOT long AS kept
FROM judged
""".replace("lines(s.text)", r"list_filter(string_split(s.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))")

LICENSE_DIGESTS = r"""
WITH known(license, sentence) AS (VALUES
  ('MIT', 'released under the mit license'), ('MIT', 'licensed under the mit license'), ('MIT', 'spdx license identifier mit'),
  ('Apache-2.0', 'licensed under the apache license version 2 0'), ('Apache-2.0', 'spdx license identifier apache 2 0'),
  ('GPL-3.0', 'this work is licensed under the gnu general public license version 3'),
  ('GPL-3.0', 'spdx license identifier gpl 3 0'), ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0'),
  ('CC-BY-4.0', 'licensed under cc by 4 0'), ('CC-BY-SA-4.0', 'licensed under cc by sa 4 0'),
  ('all-rights-reserved', 'all rights reserved')
), units AS (
  SELECT doc_id, coalesce(text, '') AS unit, true AS whole FROM documents
  UNION ALL
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))), false FROM documents
), plain AS (
  SELECT doc_id, whole, ' ' || trim(regexp_replace(
    regexp_replace(lower(unit), '(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x
  FROM units
), spelled AS (
  SELECT doc_id, whole, trim(replace(replace(replace(replace(replace(replace(x, ' licence ', ' license '),
    ' licenced ', ' licensed '), ' favour ', ' favor '), ' merchantibility ', ' merchantability '),
    ' noncommercial ', ' non commercial '), ' whilst ', ' while ')) AS x
  FROM plain
), found AS (
  SELECT s.doc_id, s.whole, s.x, k.license FROM spelled s LEFT JOIN known k ON s.x = k.sentence
), heads AS (
  SELECT doc_id, md5(x) AS text_digest, license AS whole_license FROM found WHERE whole
), lists AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM found GROUP BY doc_id
)
SELECT doc_id, text_digest, whole_license, coalesce(licenses, '') AS licenses FROM heads JOIN lists USING (doc_id)
"""

WARC_SALVAGE = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), marked AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, hex,
    max(page_id) OVER (PARTITION BY payload) AS response FROM payloads
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * i)::INTEGER, 5))::INTEGER >> s) & 31), 1)
  ), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM marked
"""

LSH_FOREST = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), cut AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END AS s
  FROM split
), sized AS (
  SELECT doc_id, len(s)::BIGINT AS n, s FROM cut
), items AS (
  SELECT doc_id, n, unnest(s) AS shingle FROM sized
), pairs AS (
  SELECT a.doc_id AS one, b.doc_id AS two
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT one, two FROM pairs UNION SELECT two, one FROM pairs
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sized
  UNION
  SELECT r.doc_id, e.two FROM reached r JOIN edges e ON r.other = e.one
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""

TEMPERATURE_MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096 AS fine
  FROM documents
), totals AS (
  SELECT name, sum(n)::BIGINT AS tokens FROM rows GROUP BY name
), ends AS (
  SELECT max(ln(tokens)) - min(ln(tokens)) AS span FROM totals WHERE tokens > 0
), chosen AS (
  SELECT CASE WHEN coalesce(span, 0) <= ln(2.0) THEN 0.0 ELSE ceil((1 - ln(2.0) / span) * 1073741824) / 1073741824 END AS a FROM ends
), powers AS (
  SELECT name, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) ELSE 0.0 END AS power FROM totals, chosen
), weighted AS (
  SELECT name, tokens, CASE WHEN tokens > 0 THEN greatest(round(1000000 * power / sum(power) OVER ()), 1)::BIGINT ELSE 0 END AS parts
  FROM powers
), need AS (
  SELECT max(tokens::DOUBLE * 1000000 / parts) AS budget FROM weighted WHERE tokens > 0
), quotas AS (
  SELECT name, tokens, greatest(tokens, floor(coalesce(budget, 0) * parts / 1000000 + 0.5)::BIGINT) AS quota FROM weighted, need
), sources AS (
  SELECT name, tokens, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS epochs,
    least(4096, pow(2, ceil(log2(greatest(1, ceil(tokens / 20000.0))))))::BIGINT AS blocks
  FROM quotas
), blocked AS (
  SELECT r.name, r.fine % s.blocks AS block, sum(r.n)::BIGINT AS n FROM rows r JOIN sources s USING (name) GROUP BY ALL
), epochs AS (
  SELECT b.*, s.tokens, s.quota, s.epochs, unnest(range(0, s.epochs + 1)) AS epoch FROM blocked b JOIN sources s USING (name)
), passed AS (
  SELECT *, sum(n) OVER (PARTITION BY name, epoch ORDER BY md5(name || '|' || epoch || '|' || block), block
    ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM epochs
), plan AS (
  SELECT *, CASE WHEN quota > 0 THEN floor((epoch * tokens + done - n)::DOUBLE * 1000000 / quota)::BIGINT ELSE 0 END AS progress
  FROM passed WHERE epoch < epochs OR (done <= quota - epochs * tokens AND tokens > 0)
)
SELECT r.doc_id, r.source, p.epoch::BIGINT AS mix_epoch, p.block::BIGINT AS mix_block, p.progress AS mix_progress
FROM rows r JOIN sources s USING (name) JOIN plan p ON p.name = r.name AND p.block = r.fine % s.blocks
"""

CHAT_SEGMENTS = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), ordered AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), marked AS (
  SELECT *,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 1 + length(replace(escaped(role), ': ', '\3')) END AS label_chars,
    CASE WHEN i = 1 THEN role IN ('system', 'user')
      ELSE (prev, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS in_order
  FROM ordered
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + label_chars + 2 + length(escaped(text)) + 8)::BIGINT AS formatted_chars,
  bool_and(in_order) AND bool_or(i = 1 AND role IN ('system', 'user')) AND bool_or(next IS NULL AND role = 'assistant') AS valid,
  CASE WHEN NOT bool_and(in_order) THEN min(i) FILTER (NOT in_order) END::BIGINT AS invalid_turn
FROM marked GROUP BY conv_id
"""
for _column in ("role", "text"):
    CHAT_SEGMENTS = CHAT_SEGMENTS.replace(
        f"escaped({_column})", rf"replace(replace(replace({_column}, '\', '\0'), '### ', '\1'), '</turn>', '\2')"
    )

#: One round: the nearest entry of every part, and the entries moved to the floored means.
_ASSIGNED = """, near{n} AS (
  SELECT vec_id, label, p, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT s.vec_id, s.label, s.p, b.entry,
      (list_inner_product(s.part, s.part) - 2 * list_inner_product(s.part, b.c) + list_inner_product(b.c, b.c))::BIGINT AS d
    FROM parts s JOIN book{n} b ON s.p = b.p
  ) GROUP BY ALL
)"""
_MOVED = """, book{m} AS (
  SELECT b.p, b.entry, coalesce(any_value(moved.c), any_value(b.c)) AS c FROM book{n} b LEFT JOIN (
    SELECT p, entry, list(floor(total / n) ORDER BY place) AS c FROM (
      SELECT p, entry, place, sum(x) AS total, count(*) AS n FROM (
        SELECT near{n}.p, near{n}.entry, unnest(part) AS x, unnest(range(len(part))) AS place
        FROM near{n} JOIN parts ON near{n}.vec_id = parts.vec_id AND near{n}.p = parts.p
      ) GROUP BY ALL
    ) GROUP BY p, entry
  ) moved ON b.p = moved.p AND b.entry = moved.entry GROUP BY b.p, b.entry
)"""

LAESA_CODES = (
    """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS part FROM kept, range(16) t(p)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (
  SELECT p, entry, part AS c FROM parts JOIN firsts USING (vec_id)
)"""
    + "".join((_ASSIGNED + _MOVED).format(n=n, m=n + 1) for n in range(2))
    + _ASSIGNED.format(n=2)
    + """, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, entry)) AS codebooks_sha256
  FROM book2
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
)

PREFIX_TRIE = """
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i, digest, bytes FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
  )
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda x: list_prepend(ord(x)::BIGINT, list_transform(range(8), lambda s: (-1)::BIGINT))))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END
    ), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), rebuilt AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM (
    SELECT c.conv_id, 0 AS own, i, digest, bytes FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.i <= c.h
    UNION ALL
    SELECT c.conv_id, 1, i, digest, bytes FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.i > c.h
  )
), prefixes AS (
  SELECT conv_id, d, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ends AS (
  SELECT conv_id, max(d) AS d, max_by(path, d) AS path FROM prefixes GROUP BY conv_id
), members AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY path
), nodes AS (
  SELECT path, d AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY path, d
), childless AS (
  SELECT path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.depth = n.depth + 1 AND m.path[:64 * n.depth] = n.path)
), below AS (
  SELECT n.path, sum((m.n_convs - 1) * m.bytes) AS saved_tokens, count(*) FILTER (m.depth = n.depth + 1) AS n_children,
    count(c.path) AS n_leaves
  FROM nodes n JOIN nodes m ON m.depth >= n.depth AND m.path[:64 * n.depth] = n.path LEFT JOIN childless c ON c.path = m.path
  GROUP BY n.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.path[:64 * (n.depth - 1)]
LEFT JOIN members e ON e.path = n.path
"""

ORACLE_SQL = {
    "op1_impact_topk": IMPACT_TOPK,
    "op2_repetition_rules": REPETITION_RULES,
    "op3_license_digests": LICENSE_DIGESTS,
    "op4_warc_salvage": WARC_SALVAGE,
    "op6_lsh_forest": LSH_FOREST,
    "op9_temperature_mixing": TEMPERATURE_MIXING,
    "op11_chat_segments": CHAT_SEGMENTS,
    "op12_laesa_codes": LAESA_CODES,
    "op13_prefix_trie": PREFIX_TRIE,
}
