"""DuckDB SQL for the queries that SQL can express; the others have brute-force tests."""

from __future__ import annotations

from codelens.llm import licences

# All windows of all items against all windows of all documents, by their words.
CONTAMINATION = r"""
WITH lowered AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, least(len(words), 13) AS size, words[place + 1 : place + least(len(words), 13)] AS run
    FROM (SELECT item_id, words, unnest(range(0, len(words) - least(len(words), 13) + 1)) AS place FROM items WHERE len(words) > 0)
),
runs AS (
    SELECT rid, size, place, words[place + 1 : place + size] AS run
    FROM (SELECT rid, words, size, unnest(range(0, len(words) - size + 1)) AS place
          FROM lowered, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
),
hits AS (SELECT rid, place, size, item_id FROM runs JOIN windows USING (size, run)),
hit_words AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(place, place + size)) AS word FROM hits) GROUP BY rid),
listed AS (
    SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM lowered LEFT JOIN hit_words USING (rid) LEFT JOIN listed USING (rid)
"""

# Five hexadecimal digits are four base-32 digits.
WARC = r"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
)
SELECT page_id,
       CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(
           list_transform(range(0, 32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)),
           '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
FROM payloads
WINDOW same AS (PARTITION BY payload)
"""

EXACT_DEDUP = r"""
WITH normal AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       text_sha256
FROM normal
WINDOW same AS (PARTITION BY text_sha256)
"""

# Every query term against every document that holds it.
RANKED = r"""
WITH counted AS (
    SELECT rid, doc_id, len(terms) AS n, unnest(map_entries(histogram)) AS entry
    FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, list_histogram(terms) AS histogram
          FROM documents WHERE text IS NOT NULL)
    WHERE len(terms) > 0
),
entries AS (SELECT rid, doc_id, CAST(n AS BIGINT) AS n, entry.key AS term, CAST(entry.value AS BIGINT) AS tf FROM counted),
totals AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM (SELECT DISTINCT rid, n FROM entries)),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM entries, totals GROUP BY term, documents
),
asked AS (
    SELECT item, item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark WHERE text IS NOT NULL)
),
scored AS (
    SELECT item, item_id, rid, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // totals.terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN entries USING (term), totals
    GROUP BY item, item_id, rid, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

# Every anchor against every row.
NEGATIVES = """
WITH rows AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i])) AS BIGINT) AS score
    FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid
),
positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5
),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) AS place
    FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 10
"""


def _licences() -> str:
    """The sentences and rules are the operator's fixed values; the steps are written anew."""
    known = ", ".join(
        f"({name!r}, {licences.normalise(text.replace('{}', ' '))!r}, {'{}' not in text}, "
        f"'^(' || {' (?:[a-z0-9]+ ){{0,12}}?'.replace('{{', '{').replace('}}', '}').join(licences.normalise(part) for part in text.split('{}'))!r} || ') ')"
        for name, text in licences.SENTENCES.items()
    )
    rules = ", ".join(f"('{licence}', '{rule.replace(chr(39), chr(39) * 2)}', {ids!r})" for licence, rule, ids in licences.RULES)
    reach = licences.longest(list(licences.SENTENCES.values()))
    return rf"""
WITH known(id, sentence, exact, pattern) AS (VALUES {known}),
rules(licence, rule, ids) AS (VALUES {rules}),
cut AS (
    SELECT row_number() OVER () AS rid, doc_id,
           list_filter(string_split(lower(regexp_replace(
               translate(regexp_replace(
                   regexp_replace(coalesce(text, ''), '[.;:!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n', chr(1), 'g'),
                   '\n[\x20\x09-\x0D]*([A-Z][a-z]|[0-9*-])', chr(1) || '\1', 'g'), chr(10) || chr(13), chr(2) || chr(2)),
               '[^A-Za-z0-9\x01\x02]+', ' ', 'g')), chr(1)), lambda x: regexp_matches(x, '[a-z0-9]')) AS sentences
    FROM documents
),
-- Each line with its number in the text and the number of its sentence.
listed AS (
    SELECT rid, doc_id, list_filter(flatten(list_transform(range(1, len(sentences) + 1), lambda i: list_transform(
               string_split(sentences[i], chr(2)), lambda l: struct_pack(line := trim(l), at := i - 1)))), lambda x: x.line <> '') AS lines
    FROM cut
),
places AS (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM listed),
ahead AS (
    SELECT rid, doc_id, k - 1 AS k, lines[k : k + {reach} - 1] AS ahead,
           array_to_string(list_transform(lines[k : k + {reach} - 1], lambda x: x.line), ' ') || ' ' AS tail
    FROM places WHERE split_part(lines[k].line, ' ', 1) IN (SELECT split_part(sentence, ' ', 1) FROM known)
),
tried AS (
    SELECT rid, doc_id, k, id, exact, ahead, regexp_extract(tail, pattern, 1) AS said
    FROM ahead JOIN known ON split_part(sentence, ' ', 1) = split_part(tail, ' ', 1)
),
ended AS (
    SELECT rid, doc_id, k, id, exact, ahead, list_position(list_transform(range(1, len(ahead) + 1),
               lambda n: length(array_to_string(list_transform(ahead[1 : n], lambda x: x.line), ' '))), length(said)) AS n
    FROM tried WHERE said <> ''
),
longest AS (
    SELECT rid, doc_id, k, max(n) AS n, arg_max(id, struct_pack(n := n, exact := exact, id := id)) AS id, any_value(ahead) AS ahead
    FROM ended WHERE n > 0 GROUP BY rid, doc_id, k
),
hits AS (
    SELECT rid, doc_id, k, n, id, ahead[1].at AS at, ahead[n].at AS last, row_number() OVER (PARTITION BY rid ORDER BY k) AS i
    FROM longest h
    WHERE NOT EXISTS (SELECT 1 FROM longest o WHERE o.rid = h.rid AND o.k < h.k AND o.k + o.n >= h.k + h.n)
),
matches AS (
    SELECT h.rid, h.doc_id, licence, rule, h.at AS first_sentence, max(e.last) AS last_sentence, len(ids) AS n_known,
           h.k AS first_line, max(e.k + e.n - 1) AS last_line
    FROM hits h
    JOIN rules ON ids[1] = h.id
    JOIN hits e ON e.rid = h.rid AND e.i BETWEEN h.i AND h.i + len(ids) - 1
    LEFT JOIN hits f ON f.rid = e.rid AND f.i = e.i + 1 AND e.i < h.i + len(ids) - 1
    GROUP BY h.rid, h.doc_id, licence, rule, h.at, h.k, ids
    HAVING list(e.id ORDER BY e.i) = ids AND coalesce(bool_and(f.k >= e.k + e.n), true) AND coalesce(max(f.at - e.last - 1), 0) <= 3
)
SELECT doc_id, licence, rule, CAST(first_sentence AS INT) AS first_sentence,
       CAST(last_sentence AS INT) AS last_sentence, CAST(n_known AS INT) AS n_known
FROM matches m
WHERE NOT EXISTS (
    SELECT 1 FROM matches o
    WHERE o.rid = m.rid AND o.first_line <= m.first_line AND o.last_line >= m.last_line
      AND (o.first_line < m.first_line OR o.last_line > m.last_line)
)
"""


def build() -> dict[str, str]:
    return {
        "op2_winnowing": CONTAMINATION,
        "op3_warc": WARC,
        "op4_exact_dedup": EXACT_DEDUP,
        "op9_licence_rules": _licences(),
        "op11_nra_search": RANKED,
        "op12_bond_negatives": NEGATIVES,
    }
