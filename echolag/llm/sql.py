"""SQL equal to the queries, in DuckDB's dialect."""

from __future__ import annotations

from . import licenses, quality_rules

_STOP_WORDS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

QUALITY_RULES = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS place FROM split)),
repeated AS (
  SELECT doc_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, sum(reach) AS n FROM (
    SELECT doc_id, least(5, place - coalesce(lag(place) OVER (PARTITION BY doc_id ORDER BY place), -5)) AS reach
    FROM repeated) GROUP BY doc_id),
base AS (
  SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(words, lambda w: w IN ({_STOP_WORDS}))) AS n_stop_words,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15
       AND n_symbols / greatest(n_words, 1) <= 0.1
       AND (n_words < 50 OR n_stop_words / greatest(n_words, 1) >= 0.02)
       AND n_stop_words / greatest(n_words, 1) <= 0.9
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM judged
"""

EXACT_DEDUP = r"""
WITH normalised AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM normalised WINDOW same AS (PARTITION BY body)
"""

# the target is capped where the rate at which the rest is shared passes the cap; sources are taken in the order in which
# they fill up
SOURCE_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS place,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source),
filling AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER earlier, 0) AS full_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weight_left
  FROM sources WINDOW earlier AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT max((budget - full_before)::DOUBLE / weight_left::DOUBLE) AS r FROM filling
  WHERE weight * ((budget - full_before)::DOUBLE / weight_left::DOUBLE) <= 2 * source_size),
targets AS (
  SELECT source, source_size,
         CASE WHEN weight * r > 2 * source_size THEN (2 * source_size)::DOUBLE ELSE weight * r END AS target
  FROM sources, rate),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id) AS upto FROM sizes),
queued AS (
  SELECT s.*, t.source_size, t.target, turn, (upto + turn * t.source_size)::DOUBLE / target AS finish
  FROM laid s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) turns(turn)),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, place, doc_id) AS line FROM queued)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN line <= (SELECT floor(1.5 * sum(size)) FROM sizes) THEN size ELSE 0 END)::BIGINT AS taken
FROM merged GROUP BY doc_id, size, source_size, target
"""

# base 32 takes five bits at a time from the 160 bits of the digest
WARC = """
WITH bits AS (
  SELECT page_id, coalesce(html, '') AS payload, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS b FROM pages),
digests AS (
  SELECT page_id, payload, strlen(payload) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda k:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j:
             CASE WHEN b[5 * k + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END))::BIGINT]), '') AS payload_digest
  FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM digests WINDOW same AS (PARTITION BY payload)
"""

# crc32 goes byte by byte with a table of 256 entries; a replaced letter leaves words that are equal around one place, and a
# deleted one leaves a word
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
      CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS k FROM runs GROUP BY 1, 2),
spelt AS (SELECT named, run, k, hex(encode(named)) AS h FROM counted),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS crc
  FROM spelt, crc_table),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2)
              ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cuts AS (
  SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
replaced AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word),
deleted AS (SELECT DISTINCT c.word, w.word AS other FROM cuts c JOIN words w ON w.word = c.head || c.tail),
near AS (SELECT * FROM replaced UNION SELECT * FROM deleted UNION SELECT other, word FROM deleted),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, struct_pack(a := -o.n, b := p.other)) AS other, max(o.n) AS other_n
  FROM near p JOIN words o ON o.word = p.other GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
         CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
path(word, reached, step) AS (
  SELECT word, form, 1 FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT p.word, f.form, step + 1 FROM path p JOIN formed f ON f.word = p.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM path GROUP BY 1)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN roots r ON r.word = f.word
"""

_TEMPLATES = ", ".join(
    f"('{name}', [{', '.join(repr(pair) for pair in pairs)}])" for name, pairs in licenses.template_rows()
)

LICENSE_SCAN = rf"""
WITH clean AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS body FROM documents),
parts AS (
  SELECT doc_id, list_concat(string_split(body, chr(10)), string_split_regex(body, '\n *\n'), [body]) AS parts FROM clean),
units AS (
  SELECT doc_id, list_filter(list_distinct(list_transform(parts, lambda p:
           trim(regexp_replace(replace(p, chr(10), ' '), ' +', ' ', 'g')))), lambda u: u <> '') AS units FROM parts),
paired AS (
  SELECT doc_id, unit_no, list_distinct(list_transform(range(1, len(words)), lambda i:
           words[i] || ' ' || words[i + 1])) AS pairs
  FROM (SELECT doc_id, generate_subscripts(units, 1) AS unit_no, string_split(unnest(units), ' ') AS words FROM units)),
scored AS (
  SELECT doc_id, unit_no, license, 2 * len(list_intersect(pairs, p)) / (len(pairs) + len(p)) AS dice
  FROM paired, (VALUES {_TEMPLATES}) templates(license, p)),
best AS (
  SELECT * FROM scored WHERE dice >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY dice DESC, license) = 1)
SELECT u.doc_id, len(units)::BIGINT AS n_units, count(license) AS n_matches,
       coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, max(dice) AS best_dice
FROM units u LEFT JOIN best b ON u.doc_id = b.doc_id GROUP BY u.doc_id, units
"""
