"""DuckDB SQL with the results of those queries that SQL can express."""

SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op9_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), wins AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k,
                   array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
                  FROM b WHERE len(w) > 0)
        ), cut AS (
            SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
                  FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)
        ), hits AS (
            SELECT doc_id, s, cut.k, item_id FROM cut JOIN wins USING (win, k)
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hits))
            GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord
            FROM documents
        ), k AS (
            SELECT *, translate(
                regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), often AS (
            SELECT key, max(doc_id) AS best FROM k WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), m AS (
            SELECT doc_id, ord, line, best IS NOT NULL AND best <> doc_id AS gone
            FROM k LEFT JOIN often USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op8_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(range(0, 8), lambda i:
                list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    ((('0x' || substr(h, (i * 5 + 1)::INTEGER, 5))::INTEGER >> s) & 31) + 1, 1)))), '')
                AS payload_digest
            FROM p
        ), b AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM b
    """,
    "op1_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS t
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), links AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (t)
                WHERE x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * i >= 85 * (na.n + nb.n - i)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM d
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_dot_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0
        ),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
             AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3
    """,
    "op13_chat_format": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL
            SELECT -7, turn, role, '\### Assistant: </turn> ok'
            FROM (VALUES (0, 'user'), (1, 'assistant')) AS planted(turn, role)
        ),
        turns AS (
            SELECT *,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
                   count(*) OVER (PARTITION BY conv_id) AS n,
                   replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS name,
                   replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS body
            FROM given
        ),
        placed AS (
            SELECT *,
                   sum(14 + length(replace(name, ': ', ':\ ')) + length(body))
                       OVER (PARTITION BY conv_id ORDER BY place) AS chars
            FROM turns
        )
        SELECT conv_id,
               max(n) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               (sum(chars) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars
        FROM placed
        GROUP BY conv_id
    """,
}
