"""DuckDB SQL for the queries that SQL can express; written on its own, not derived from the operators."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
        g AS (SELECT doc_id, i, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram FROM w),
        f AS (SELECT doc_id, i, word, CASE WHEN i + 12 <= n AND min(doc_id) OVER (PARTITION BY CASE WHEN i + 12 <= n THEN gram ELSE doc_id || '/' || i END) < doc_id THEN 1 ELSE 0 END AS hit FROM g),
        r AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
        k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op4_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h##'), '</turn>', '\l/turn>')) + length(role) + length('### ' || ':' || chr(10) || chr(10) || '</turn>' || chr(10)) AS size FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op6_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
        b AS (SELECT doc_id, unnest(range(0, octet_length(h))) AS i, h FROM d),
        w AS (SELECT doc_id, i, CASE WHEN i + 400 <= octet_length(h) THEN md5(array_slice(h, i + 1, i + 400)) END AS s, CASE WHEN i + 200 <= octet_length(h) THEN md5(array_slice(h, i + 1, i + 200)) END AS p, hex(array_slice(h, i + 1, i + 1)) AS byte FROM b),
        s2 AS (SELECT s FROM w WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1), p2 AS (SELECT p FROM w WHERE p IS NOT NULL GROUP BY p HAVING count(*) > 1),
        t AS (SELECT doc_id, i, byte, CASE WHEN s2.s IS NULL THEN 0 ELSE 1 END AS twice, CASE WHEN p2.p IS NULL THEN 0 ELSE 1 END AS again FROM w LEFT JOIN s2 ON s2.s = w.s LEFT JOIN p2 ON p2.p = w.p),
        r AS (SELECT doc_id, i, byte, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS repeated FROM t),
        e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS begins FROM r),
        k AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, sum(begins) AS n_spans, sum(repeated) AS n_repeated, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
               coalesce(n_repeated, 0)::BIGINT AS n_repeated
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    # The driver's pages are simple enough for patterns: one article of h1 and p blocks, and few character references.
    "op10_html_extraction": r"""
        WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
        t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
            replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM a)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
}
