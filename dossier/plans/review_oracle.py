"""DuckDB SQL for the queries of review.py, written on its own from their rules."""

from .oracle import CHOOSE, JUDGMENTS, LABELS, NOTICE, PAPERS, PARSED, STREAMS, STRIP, TWICE, USED, _rounds, case_ctes

D = "CAST(doc_id AS VARCHAR) AS paper_id"


def pick(n: str, *values: str | None) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[({n}) % {len(values)} + 1]"


# --- rounds ---

ROUNDS = f"""{LABELS}, lab AS (SELECT paper_id, doc_id, split, exclusion_reason, stratum, split = 'build' AND doc_id % 13 <> 0 AND doc_id % 10 <> 3 AS ok FROM labs),
rnd AS (SELECT 'exclusion' AS task, 1 AS round, doc_id AS nth, paper_id FROM lab WHERE ok UNION ALL SELECT 'exclusion', 2, doc_id, paper_id FROM lab WHERE ok AND doc_id % 5 = 0 UNION ALL SELECT 'exclusion', 2, doc_id, paper_id FROM lab WHERE ok AND doc_id % 50 = 0
    UNION ALL SELECT 'exclusion', 3, doc_id, paper_id FROM lab WHERE doc_id % 13 <> 0 UNION ALL SELECT 'power_analysis', 1, doc_id, paper_id FROM lab WHERE ok AND exclusion_reason IS NULL UNION ALL SELECT 'power_analysis', 2, doc_id, paper_id FROM lab WHERE ok
    UNION ALL SELECT 'data_analysis', 1, doc_id, paper_id FROM lab WHERE split = 'build' AND exclusion_reason IS NULL UNION ALL SELECT 'exclusion', 4, doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' || paper_id ELSE paper_id END FROM lab WHERE ok AND doc_id % 3 = 0
    UNION ALL SELECT 'exclusion', 5, doc_id, paper_id FROM lab WHERE ok AND doc_id % 3 = 0),
want AS (SELECT * FROM (VALUES ('exclusion', 1), ('exclusion', 2), ('exclusion', 3), ('exclusion', 4), ('exclusion', 5), ('exclusion', 9), ('power_analysis', 1), ('power_analysis', 2), ('data_analysis', 1)) w(task, round)),
one AS (SELECT task, round, paper_id, count(*) AS times, min(nth) AS nth FROM rnd GROUP BY ALL),
bad AS (SELECT o.*, coalesce(o.nth % 13 = 0 AND NOT o.paper_id LIKE 'x%', false) AS skipped, CASE WHEN coalesce(o.nth % 13 = 0 AND NOT o.paper_id LIKE 'x%', false) THEN NULL WHEN l.paper_id IS NULL THEN 'B2' WHEN l.split <> 'build' THEN 'B1' WHEN o.task <> 'exclusion' AND l.exclusion_reason IS NOT NULL THEN 'B4' WHEN o.nth % 10 = 3 THEN 'B7' END AS kind FROM one o LEFT JOIN labs l ON l.paper_id = o.paper_id),
per AS (SELECT task, round, max(times) AS times, count(*) FILTER (NOT skipped) AS kept, count(*) FILTER (skipped) AS skipped, min_by(kind, nth) FILTER (kind IS NOT NULL) AS kind, min_by(paper_id, nth) FILTER (kind IS NOT NULL) AS who,
    count(*) FILTER (skipped OR task = 'exclusion' AND round = 5 AND nth % 2 = 0) AS off FROM bad GROUP BY ALL),
out AS (SELECT w.task, w.round, kept, skipped, CASE WHEN times IS NULL THEN 'B3' WHEN times > 1 THEN 'B10' WHEN kind IS NOT NULL THEN kind WHEN off > 0 THEN 'B5' END AS refusal, kind, who FROM want w LEFT JOIN per USING (task, round))"""

COMBINED = f"""src AS (SELECT doc_id, {D}, 'tok' || doc_id AS token, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN 'other' ELSE 'tok' || doc_id END AS echo FROM documents),
hv AS (SELECT src.*, t.task, t.k, t.p, {pick('doc_id + k', 'yes', 'no', 'undecidable')} AS decision, (doc_id + k) % 17 = 0 AS leans, CASE WHEN (doc_id + k) % 19 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS confidence,
    CASE WHEN t.k = 1 AND doc_id % 5 = 0 THEN 'missing' WHEN (doc_id + k) % 23 = 0 THEN 'wrapper_field' WHEN (doc_id + k) % 19 = 0 THEN 'confidence' END AS bad FROM src, (VALUES ('power_analysis', 0, 'P'), ('data_analysis', 1, 'D')) t(task, k, p)),
fl AS (SELECT *, min_by(task || ':' || bad, k) FILTER (bad IS NOT NULL) OVER (PARTITION BY doc_id) AS failure FROM hv)"""


CHECKED = f"""{PARSED}, base AS (SELECT *, doc_id % 9 = 0 AS silent, {pick('doc_id', '1', '2', '3', '', 'x', '0')} AS raw_attempt FROM par WHERE task = 'exclusion'),
fal AS (SELECT *, CASE WHEN doc_id % 37 = 1 THEN ['process', ''] WHEN doc_id % 61 = 2 THEN ['process', ''] WHEN doc_id % 97 = 6 THEN ['FATAL', 'A1/A2'] WHEN doc_id % 71 = 3 THEN ['FATAL', 'G3/G8/G12'] WHEN doc_id % 43 = 4 THEN ['truncation', 'G9'] WHEN doc_id % 47 = 5 THEN ['incomplete', 'G6']
    WHEN doc_id % 89 = 7 THEN ['FATAL', 'E11'] WHEN failure IS NOT NULL THEN ['parse', 'D'] WHEN doc_id % 83 = 0 AND NOT silent THEN ['FATAL', 'E9'] WHEN silent THEN ['semantic', 'E10'] WHEN decision = 'wrong_text' THEN CASE WHEN doc_id % 4 <> 3 THEN ['semantic', 'E6'] ELSE ['', ''] END
    WHEN cited = '' THEN ['semantic', 'E6'] WHEN doc_id % 6 = 5 THEN ['semantic', 'E4'] WHEN doc_id % 4 = 3 THEN ['semantic', 'E3/E5'] ELSE ['', ''] END AS f, CASE WHEN raw_attempt IN ('1', '2', '3') THEN raw_attempt::INTEGER ELSE 1 END AS attempt FROM base),
chk AS (SELECT paper_id, doc_id, attempt, f[1] AS failure_kind, f[2] AS failure_case, CASE f[1] WHEN '' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN f[1] = '' THEN '' WHEN f[1] <> 'FATAL' AND attempt < 3 THEN 'yes' ELSE 'no' END AS retry_eligible,
    CASE WHEN f[1] NOT IN ('', 'FATAL') AND attempt >= 3 THEN 'review_required' ELSE '' END AS terminal_status FROM fal)"""

MORE: dict[str, str] = {
    "round_plans": f"WITH {ROUNDS} SELECT task, round, CASE WHEN refusal IS NULL THEN kept END AS kept, CASE WHEN refusal IS NULL THEN skipped END AS skipped, refusal, CASE WHEN refusal = kind THEN who END AS refused_paper FROM out",
    "round_combined": f"""WITH {LABELS}, r AS {_rounds("split = 'build' AND stratum = 'survivor'")} SELECT count(*) AS places, count(*) FILTER (paper_id::BIGINT % 26 = 0) AS differing, min(nth) FILTER (paper_id::BIGINT % 26 = 0) AS first_difference, CASE WHEN count(*) FILTER (paper_id::BIGINT % 26 = 0) > 0 THEN 'DC54' END AS refusal FROM r""",
    "rounds_membership_difference": f"""WITH {LABELS}, r AS {_rounds("split = 'build'")} SELECT paper_id, CASE WHEN nth <= 25 THEN 'a' ELSE 'b' END AS only_in FROM r WHERE nth <= 25 OR nth BETWEEN 51 AND 75""",
    "round_severity": f"""WITH {CHECKED} SELECT left(paper_id, 1) AS round, count(*) AS n, count(*) FILTER (failure_kind = 'process') AS n_process, count(*) FILTER (failure_kind = 'parse') AS n_parse, count(*) FILTER (failure_kind = 'semantic') AS n_semantic, count(*) FILTER (failure_kind = 'truncation') AS n_truncation,
        count(*) FILTER (failure_kind = 'incomplete') AS n_incomplete, count(*) FILTER (failure_kind = 'FATAL') AS n_fatal, count(*) FILTER (failure_kind = 'FATAL') > 0 AS discarded FROM chk GROUP BY 1""",
    "responses_checked": f"""WITH {CHECKED} SELECT paper_id, 'r' || doc_id % 40 AS round, attempt, status, failure_kind, failure_case, retry_eligible, terminal_status, count(*) FILTER (failure_kind = 'FATAL') OVER (PARTITION BY doc_id % 40) > 0 AS round_discarded FROM chk""",
    "reply_provenance_checks": f"""WITH {STREAMS}, {USED}, x AS (SELECT stream_id, CASE WHEN conv_id % 17 = 0 THEN ['REFUSE', 'G4'] WHEN conv_id % 19 <> 0 AND conv_id % 23 = 0 THEN ['FATAL', 'G3'] WHEN NOT ended THEN ['RETRY', 'G5'] WHEN conv_id % 29 = 0 THEN ['FATAL', 'G8'] WHEN own AND conv_id % 37 = 0 THEN ['FATAL', 'G12']
        WHEN conv_id % 31 = 0 THEN ['RETRY', 'G9'] WHEN conv_id % 11 = 0 OR said = 0 THEN ['RETRY', 'G6'] END AS f FROM used) SELECT stream_id, f[1] AS severity, f[2] AS case FROM x""",
    "round_versions": "WITH v AS (SELECT DISTINCT conv_id, right(CAST(conv_id AS VARCHAR), 1) AS round, CASE WHEN conv_id % 17 <> 0 THEN '2.' || conv_id % 2 END AS version FROM conversations) SELECT round, count(DISTINCT version) AS versions, coalesce(string_agg(DISTINCT version, ';' ORDER BY version), '') AS seen, count(DISTINCT version) > 1 AS discarded FROM v GROUP BY round",
    "environments_compare": """WITH m AS (SELECT n_nationkey, concat_ws(';', CASE WHEN n_regionkey = 1 THEN 'model' END, CASE WHEN n_nationkey % 5 = 0 THEN 'effort' END, CASE WHEN n_nationkey % 7 = 0 AND n_nationkey % 14 <> 0 THEN 'promptbook_sha256' END) AS moved FROM nation) SELECT n_nationkey, moved, moved <> '' AS refused FROM m""",
    "reply_combined": f"WITH {COMBINED} SELECT paper_id, task, failure, CASE WHEN failure IS NULL THEN decision END AS decision, CASE WHEN failure IS NULL THEN confidence END AS confidence FROM fl",
    "reply_combined_checks": f"""WITH {COMBINED}, x AS (SELECT *, CASE WHEN echo <> token THEN 'E9' WHEN echo IS NULL THEN 'E10' WHEN (doc_id + k) % 12 = 0 THEN 'E4' WHEN leans THEN 'DC54' END AS why FROM fl WHERE failure IS NULL)
        SELECT paper_id, min_by(why, k) FILTER (why IS NOT NULL) AS case, min_by(task, k) FILTER (why IS NOT NULL) AS failed_task FROM x GROUP BY paper_id""",
    "resume_states": f"""WITH s AS (SELECT doc_id, {D}, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS attempt, doc_id % 7 = 0 AS crashed, doc_id % 11 <> 0 AND CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN true ELSE doc_id % 13 <> 0 END AS matched,
            {pick('doc_id', 'ok', 'failed', 'odd', 'failed')} AS status, {pick('doc_id', 'parse', 'FATAL', '')} AS kind, {pick('doc_id', '', 'yes', 'no', 'true')} AS again FROM documents),
        k AS (SELECT *, CASE WHEN crashed THEN 'process' WHEN matched AND kind <> '' THEN kind ELSE 'semantic' END AS why, crashed OR matched AND status = 'failed' AS failed FROM s),
        e AS (SELECT *, crashed OR CASE WHEN matched AND again <> '' THEN again IN ('yes', 'true') ELSE why <> 'FATAL' END AS eligible FROM k),
        t AS (SELECT *, CASE WHEN NOT failed AND matched AND status = 'ok' THEN 'accepted' WHEN NOT failed THEN 'awaiting_check' WHEN NOT eligible OR attempt >= 3 THEN 'review_required' ELSE 'retry' END AS state FROM e)
        SELECT paper_id, attempt, state, CASE WHEN state = 'retry' THEN attempt + 1 END AS next_attempt, CASE WHEN state IN ('retry', 'review_required') THEN why ELSE '' END AS failure_kind FROM t""",
    "run_billing": f"""WITH {STREAMS}, {USED} SELECT right(stream_id, 1) AS task, count(*) AS calls, sum(input_tokens + coalesce(cached, 0))::BIGINT AS billed_input_tokens, count(*) FILTER (input_tokens IS NULL) AS unreported, sum(CASE WHEN ended THEN chars / 64.0::DOUBLE END) AS cost FROM used GROUP BY 1""",
    "attempt_numbers": f"SELECT {D}, {pick('doc_id', '1', ' 7 ', '0', '-4', 'x', '', '2.5', '+3')} AS raw, ([1, 7, 1, 1, 1, 1, 1, 3])[doc_id % 8 + 1]::INTEGER AS attempt FROM documents",
    "library_identifiers": f"""SELECT {D}, CASE doc_id % 4 WHEN 1 THEN '12' WHEN 2 THEN '77' ELSE CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 <> 0 AND doc_id % 4 <> 3 THEN CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END END AS pmid,
        CASE doc_id % 3 WHEN 1 THEN 'PMC5' WHEN 2 THEN 'PMC6' ELSE CASE WHEN doc_id % 5 <> 0 THEN 'PMC' || doc_id ELSE 'PMC9' END END AS pmcid, CASE WHEN doc_id % 5 <> 0 THEN '10.1234/ab' || doc_id ELSE '' END AS doi FROM documents""",
    "library_metadata": f"""SELECT {D}, md5(CASE WHEN doc_id % 9 <> 0 THEN left(text, 30) ELSE '' END) AS title, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'Trial Group|Roe' ELSE 'Li|Roe' END AS authors, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'Trial Group' ELSE 'Li' END AS first_author,
        CASE WHEN doc_id % 2 = 0 THEN '10.5555/x' || doc_id ELSE '10.6666/extra' END AS doi, '' AS pmid, '' AS pmcid, {pick('doc_id', '2004', '1899', '', '')} AS year FROM documents""",
    "attachments_pick": f"""WITH k AS (SELECT user_id AS item, event_id AS nth, event_id % 3 <> 1 AS pdf, list_position(['imported_file', 'imported_url', 'linked_url'], {pick('event_id', 'linked_file', 'linked_url', 'imported_url', 'imported_file', 'linked_file')}) AS mode, 'k' || event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'f' ELSE 'k' END || event_id AS name FROM events)
        SELECT item, min_by(key, (mode, nth)) FILTER (pdf AND mode > 0) AS key, CASE WHEN count(*) FILTER (pdf) = 0 THEN 'no PDF attachment on record' WHEN count(*) FILTER (pdf AND mode > 0) = 0 THEN 'linked_file not in cloud storage' ELSE '' END AS problem,
        md5(CASE WHEN count(*) FILTER (pdf) > 1 THEN count(*) FILTER (pdf) || ' PDF attachments, picked highest priority: ' || string_agg(name, '; ' ORDER BY nth) FILTER (pdf) ELSE '' END) AS warning FROM k GROUP BY item""",
    "library_placements": "WITH f AS (SELECT user_id AS key, event_type AS folder, min(event_id) AS nth FROM events GROUP BY ALL) SELECT key, string_agg(folder, '; ' ORDER BY nth) AS folders, count(*) AS n_folders FROM f GROUP BY key",
    "placement_totals": "WITH k AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1) SELECT sum(k)::BIGINT AS placements, count(*) AS unique_keys, count(*) FILTER (k > 1) AS multi_filed FROM k",
    "identity_signals": f"""WITH h AS (SELECT doc_id, {D}, CASE WHEN doc_id % 4 = 0 THEN 'doi 10.1000/' || md5(text) || ' ' WHEN doc_id % 9 = 1 THEN 'Summary Statement ' ELSE '' END || left(text, 900) AS head, '10.1000/' || md5(text) AS doi, string_split(text, ' ') AS w FROM documents)
        SELECT paper_id, length(head) AS head_chars, regexp_matches(lower(regexp_replace(head, '\\s+', ' ', 'g')), 'privileged\\s+communication|\\bsummary\\s+statement\\b|resume\\s+and\\s+summar\\w*\\s+of\\s+discussion') AS admin_doc, contains(regexp_replace(lower(head), '\\s+', '', 'g'), doi) AS doi_hit,
        len(list_distinct(list_filter(list_transform(regexp_extract_all(head, '10\\.[0-9]{{4,9}}/[^\\s"''<>]+'), lambda x: lower(regexp_replace(x, '[.,;)]+$', ''))), lambda x: x <> doi)))::INTEGER AS n_other_dois, CASE WHEN coalesce(w[3], '') = '' THEN 1 ELSE 2 END::INTEGER AS author_count, contains(head, '2001') AS year_hit FROM h""",
    "identity_batch": f"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'doi 10.1000/' || md5(text) || ' ' WHEN doc_id % 9 = 1 THEN 'Summary Statement ' ELSE '' END || left(text, 900) AS head, '10.1000/' || md5(text) AS doi FROM documents),
        v AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'NO_METADATA' WHEN doc_id % 5 = 0 THEN 'NO_FILE' WHEN length(head) < 200 THEN 'NO_TEXT' WHEN regexp_matches(lower(regexp_replace(head, '\\s+', ' ', 'g')), 'privileged\\s+communication|\\bsummary\\s+statement\\b|resume\\s+and\\s+summar\\w*\\s+of\\s+discussion') THEN 'ADMIN_DOCUMENT'
            WHEN contains(regexp_replace(lower(head), '\\s+', '', 'g'), doi) THEN 'DOI_MATCH' END AS verdict_reason FROM h) SELECT verdict_reason, count(*) AS n FROM v WHERE verdict_reason IS NOT NULL GROUP BY 1""",
}

DERIVED = f"""der AS (SELECT {D}, doc_id, CASE WHEN doc_id % 17 <> 0 THEN 'p' || doc_id % 90 ELSE '' END AS claims, {pick('doc_id', '', 'pilot_study', '', 'other', '')} AS exclusion_reason, {pick('doc_id', 'yes', 'no', '', '')} AS power_correct, {pick('doc_id', '', 'no', 'yes')} AS data_correct, {pick('doc_id', '', 'B')} AS review_category,
    {pick('doc_id', 'no', 'yes', 'unclear')} AS restricted_rand, {pick('doc_id', 'no', '')} AS stepped_wedge, 'f' || doc_id % 3 AS source_file FROM documents),
drv AS (SELECT *, CASE WHEN exclusion_reason <> '' THEN '1' ELSE '0' END AS excluded, CASE WHEN exclusion_reason || power_correct || data_correct || review_category <> '' THEN '1' ELSE '0' END AS labeled FROM der)"""

MORE |= {
    "labels_derive": f"WITH {DERIVED} SELECT paper_id, exclusion_reason, power_correct, data_correct, review_category, restricted_rand, stepped_wedge, excluded, labeled FROM drv",
    "labels_rows": f"""WITH {DERIVED} SELECT paper_id, CASE excluded WHEN '1' THEN exclusion_reason END AS exclusion_reason, CASE excluded WHEN '0' THEN nullif(power_correct, '') END AS power, CASE excluded WHEN '0' THEN nullif(data_correct, '') END AS stats, CASE excluded WHEN '0' THEN nullif(review_category, '') END AS review_category,
        {pick('doc_id', 'doi', 'pmid')} AS matched_by, ([1.0, NULL, 0.85])[doc_id % 3 + 1]::DOUBLE AS match_score FROM drv""",
    "labels_claims": f"WITH {DERIVED} SELECT claims AS paper_id, count(*) AS n_rows, count(DISTINCT source_file) = count(*) AND claims IN (SELECT 'p' || n_nationkey FROM nation) AS expected FROM drv WHERE claims <> '' GROUP BY claims HAVING count(*) > 1",
    "labels_remap": f"WITH {DERIVED} SELECT d.paper_id AS row_id, CASE WHEN n_nationkey IS NULL THEN claims ELSE 'q' || n_nationkey END AS paper_id, CASE WHEN n_nationkey IS NULL THEN '' ELSE 'merged from ' || claims END AS remap_note FROM drv d LEFT JOIN nation ON claims = 'p' || n_nationkey",
    "labels_pool": f"WITH {PAPERS} SELECT paper_id FROM pap WHERE set = 'human_labelled' AND (lang = 'en' OR source = 'en') AND NOT (verdict = 'DROPPED' AND doc_id % 2 = 0)",
    "labels_load_report": f"WITH {DERIVED} SELECT count(*) AS n, count(*) FILTER (doc_id % 17 <> 0) AS papers, count(*) FILTER (doc_id % 17 = 0) AS unresolved, count(*) FILTER (labeled = '0') AS pending, count(*) FILTER (doc_id % 17 <> 0 AND doc_id % 13 = 0) AS dropped FROM drv",
    "sets_by_precedence": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'a_and_b_minus_c' AS form FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 3 = 0 AND doc_id % 2 <> 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'a_and_b_less_c' FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 5 = 0 AND doc_id % 2 <> 0",
}

CLOSURE = f"""{LABELS}, {PAPERS}, man AS (SELECT pap.* REPLACE (CASE WHEN pap.doc_id % 401 = 7 THEN 'Erratum: a trial' ELSE title END AS title), documents.n_chars FROM pap JOIN documents USING (doc_id)),
act AS (SELECT * FROM man WHERE verdict <> 'DROPPED'), lact AS (SELECT * FROM act WHERE set = 'human_labelled'), uact AS (SELECT * FROM act WHERE set = 'unlabelled'),
rem AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'gone' ELSE '' END || doc_id AS removed, CAST(doc_id + 1 AS VARCHAR) AS kept, 'same ' || doc_id % 3 AS reason FROM man WHERE doc_id % 59 = 0),
fil AS (SELECT CASE WHEN doc_id % 101 = 9 THEN 'stray' ELSE '' END || paper_id AS paper_id FROM man WHERE doc_id % 97 <> 6),
dup AS (SELECT paper_id, doc_id FROM man WHERE doc_id % 53 = 0), stl AS (SELECT d.paper_id, d.doc_id FROM dup d JOIN lact USING (paper_id) WHERE d.doc_id % 2 <> 0)"""
SHARED = "(SELECT count(*) FROM (SELECT doi FROM {0} GROUP BY doi HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT md5 FROM {0} GROUP BY md5 HAVING count(*) > 1))"
CORPUS = f"""{CLOSURE}, k AS (SELECT 'U1' AS tag, count(*) AS offending FROM uact WHERE doc_id % 83 = 5 OR n_chars + 2500 < 3000 UNION ALL SELECT 'U2', count(*) FROM uact WHERE verdict <> 'VERIFIED' UNION ALL SELECT 'U3', count(*) FROM man WHERE set = 'unlabelled' AND doc_id % 10 = 1 AND doc_id % 20 <> 1 AND doc_id % 58 <> 3
    UNION ALL SELECT 'U4', count(*) FROM uact WHERE doc_id % 29 = 3 AND doc_id % 58 <> 3 UNION ALL SELECT 'U5', count(*) FROM uact WHERE regexp_matches(title, '{NOTICE}') UNION ALL SELECT 'U6', {SHARED.format('uact')}
    UNION ALL SELECT 'U7', count(*) FROM uact WHERE md5 IN (SELECT md5 FROM lact) UNION ALL SELECT 'U8', count(*) FROM rem WHERE doc_id % 2 <> 0 AND doc_id % 177 <> 0 UNION ALL SELECT 'U9', count(*) FROM rem WHERE doc_id % 2 = 0 AND kept NOT IN (SELECT paper_id FROM labs)
    UNION ALL SELECT 'U10', count(*) FROM uact WHERE doc_id % 13 = 0 OR doc_id % 131 = 5 UNION ALL SELECT 'U11', (SELECT count(*) FROM fil WHERE paper_id NOT IN (SELECT paper_id FROM man WHERE set = 'unlabelled')) + (SELECT count(*) FROM uact WHERE paper_id NOT IN (SELECT paper_id FROM fil))
    UNION ALL SELECT 'U12', abs(count(*) - 500) FROM uact)"""

MORE |= {
    "checks_labels_closure": f"""WITH {CLOSURE}, k AS (SELECT 'C1' AS tag, (SELECT count(*) FROM lact WHERE paper_id NOT IN (SELECT paper_id FROM labs)) + (SELECT count(*) FROM labs WHERE paper_id NOT IN (SELECT paper_id FROM lact)) AS offending UNION ALL SELECT 'C2', count(*) FROM lact WHERE verdict <> 'VERIFIED'
        UNION ALL SELECT 'C3', count(*) FROM man WHERE set = 'human_labelled' AND doc_id % 10 = 1 AND doc_id % 20 <> 1 UNION ALL SELECT 'C4', count(*) FROM lact WHERE doc_id % 29 = 3 UNION ALL SELECT 'C5', count(*) FROM lact WHERE doc_id % 83 = 5 OR n_chars + 2500 < 3000 UNION ALL SELECT 'C6', 0
        UNION ALL SELECT 'C7', count(*) FROM labs WHERE CASE WHEN exclusion_reason IS NOT NULL THEN power IS NOT NULL OR stats IS NOT NULL ELSE power IS NULL OR stats IS NULL END UNION ALL SELECT 'C8', 0 UNION ALL SELECT 'C9', {SHARED.format('lact')} UNION ALL SELECT 'C10', count(*) FROM lact WHERE doc_id % 37 = 4
        UNION ALL SELECT 'C11', count(*) FROM nation WHERE n_nationkey % 9 = 0 UNION ALL SELECT 'C12', greatest((SELECT count(*) FROM stl) - (SELECT count(*) // 2 FROM dup), 0) UNION ALL SELECT 'C13', count(*) FROM labs WHERE split IS NULL UNION ALL SELECT 'C14', count(*) FROM lact WHERE doc_id % 13 = 0 OR doc_id % 131 = 5)
        SELECT tag, offending::BIGINT AS offending, CASE tag WHEN 'C13' THEN offending = 0 AND (SELECT count(*) FROM labs WHERE split = 'holdout' AND stratum = 'survivor') > 0 ELSE offending = 0 END AS ok FROM k""",
    "checks_corpus_closure": f"WITH {CORPUS} SELECT tag, offending::BIGINT AS offending, offending = 0 AS ok FROM k",
    "checks_summary": f"WITH {CORPUS} SELECT count(*) AS checks, count(*) FILTER (offending > 0) AS failed_n, coalesce(string_agg(tag, ';' ORDER BY tag) FILTER (offending > 0), '') AS failed, count(*) FILTER (offending > 0) = 0 AS closed FROM k",
    "restore_preview": f"WITH {CLOSURE} SELECT reason, count(*) AS n FROM rem WHERE kept NOT IN (SELECT paper_id FROM labs) AND removed NOT IN (SELECT paper_id FROM man WHERE doc_id % 177 = 0) GROUP BY reason",
    "records_files": f"WITH {CLOSURE} SELECT paper_id, 'orphan_file' AS problem FROM fil WHERE paper_id NOT IN (SELECT paper_id FROM man) UNION ALL SELECT paper_id, 'missing_file' FROM man WHERE paper_id NOT IN (SELECT paper_id FROM fil)",
}

TABLE = f"""{LABELS}, tb AS (SELECT doc_id, {D}, t.task, t.prefix, (doc_id + t.t) % 13 = 0 AS failed, CASE WHEN (doc_id + t) % 7 = 0 THEN 'undecidable' WHEN (doc_id + t) % 11 = 0 AND t = 0 THEN 'wrong_text' WHEN (doc_id + t) % 3 = 0 THEN 'yes' ELSE 'no' END AS d,
    CASE doc_id % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE CAST((50 + doc_id % 50) / 100.0::DOUBLE AS VARCHAR) END AS confidence, left(text, 60) AS title FROM documents, (VALUES ('exclusion', 0, 'E'), ('power_analysis', 1, 'P')) t(task, t, prefix)),
rv AS (SELECT tb.doc_id, tb.paper_id, tb.task, tb.prefix, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status, CASE WHEN tb.doc_id % 21 = 0 THEN '' ELSE title END AS title, coalesce(split, '') AS split, CASE WHEN l.paper_id IS NULL THEN '' WHEN tb.task = 'exclusion' THEN CASE WHEN exclusion_reason IS NULL THEN 'no' ELSE 'yes' END ELSE coalesce(power, '') END AS truth,
    CASE WHEN failed THEN '' ELSE d END AS decision, confidence, failed FROM tb LEFT JOIN labs l ON l.paper_id = tb.paper_id),
rw AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN decision IN ('undecidable', 'wrong_text') THEN decision WHEN truth = '' THEN 'unlabelled' WHEN truth = 'yes' THEN CASE decision WHEN 'yes' THEN 'true_positive' ELSE 'false_negative' END ELSE CASE decision WHEN 'no' THEN 'true_negative' ELSE 'false_positive' END END AS outcome FROM rv)"""


def _said(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN chr(8212) WHEN task = 'exclusion' THEN CASE {column} WHEN 'yes' THEN 'exclude' WHEN 'no' THEN 'keep' ELSE replace({column}, '_', ' ') END ELSE CASE {column} WHEN 'yes' THEN 'correct' WHEN 'no' THEN 'flawed' ELSE replace({column}, '_', ' ') END END"


MORE |= {
    "review_table": f"WITH {TABLE} SELECT paper_id, task, status, md5(title) AS title_md5, split, truth, decision, outcome FROM rw",
    "review_tally": f"""WITH {TABLE}, g AS (SELECT task, count(*) AS n, count(*) FILTER (outcome LIKE 'true%') AS correct, count(*) FILTER (outcome LIKE 'true%' OR outcome LIKE 'false%') AS scored, count(*) FILTER (title = '') AS missing_title, count(*) FILTER (truth = '') AS missing_truth FROM rw GROUP BY task)
        SELECT *, round(correct / scored::DOUBLE, 4) AS accuracy FROM g""",
    "review_top": f"""WITH {TABLE} SELECT paper_id, outcome, confidence FROM rw WHERE task = 'power_analysis' ORDER BY list_position(['false_negative', 'false_positive', 'undecidable', 'wrong_text', 'failed', 'unlabelled', 'true_positive', 'true_negative'], outcome), coalesce(-TRY_CAST(confidence AS DOUBLE), 0), paper_id LIMIT 40""",
    "review_sample": f"WITH {PAPERS}, f AS (SELECT paper_id FROM pap WHERE verdict = 'DROPPED' ORDER BY paper_id LIMIT 9), n AS (SELECT row_number() OVER (ORDER BY paper_id) AS i, paper_id FROM f) SELECT string_agg(paper_id, ', ' ORDER BY i) FILTER (i <= 8) || CASE WHEN count(*) > 8 THEN ', ...' ELSE '' END AS sample FROM n",
    "review_words": f"""WITH {TABLE} SELECT paper_id, task, {_said('decision')} AS said, {_said('truth')} AS wanted, CASE outcome WHEN 'undecidable' THEN 'Model abstained' WHEN 'wrong_text' THEN 'Wrong paper text' WHEN 'failed' THEN 'Response failed checks' WHEN 'unlabelled' THEN 'No human label'
        ELSE CASE task WHEN 'exclusion' THEN CASE outcome WHEN 'true_positive' THEN 'Correctly excluded' WHEN 'true_negative' THEN 'Correctly kept' WHEN 'false_positive' THEN 'Wrongly excluded' ELSE 'Wrongly kept' END
        ELSE CASE outcome WHEN 'true_positive' THEN 'Correct, and model agreed' WHEN 'true_negative' THEN 'Flawed, and model agreed' WHEN 'false_positive' THEN 'Model too lenient' ELSE 'Model too strict' END END END AS heading FROM rw""",
    "review_cited_rules": f"""WITH {TABLE}, c AS (SELECT paper_id, task, 0 AS nth, CASE WHEN NOT failed THEN prefix || doc_id % 4 END AS rule FROM rw UNION ALL SELECT paper_id, task, 1, 'X9' FROM rw WHERE NOT failed AND doc_id % 2 = 0)
        SELECT paper_id, task, nth::INTEGER AS nth, rule, CASE WHEN rule IS NULL THEN 'none' WHEN rule = 'X9' OR rule LIKE '%3' THEN 'the promptbook in force does not define this rule' ELSE '<strong>' || rule || '.</strong> &lt;b&gt; &amp; <code>x</code> <em>it</em>' END AS text FROM c""",
    "review_unsettled": "SELECT CAST(doc_id AS VARCHAR) AS paper_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 1",
    "exclusion_reasons": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'note' WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'problem' ELSE 'no reason recorded' END AS reason FROM documents WHERE doc_id % 13 = 0",
    "exclusion_log_titles": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, md5(CASE WHEN doc_id % 2 = 0 AND regexp_matches(left(text, 60), '\\S') THEN left(text, 60) ELSE '(title unknown)' END) AS title_md5 FROM documents WHERE doc_id % 13 = 0",
    "strip_totals": f"WITH {STRIP} SELECT reason, count(*) AS n, sum(source_chars)::BIGINT AS chars_in, sum(length(kept))::BIGINT AS chars_out, sum(CASE reason WHEN '' THEN length(rest) ELSE 0 END)::BIGINT AS tail_chars, round(100.0::DOUBLE * (sum(source_chars) - sum(length(kept))) / greatest(sum(source_chars), 1), 1) AS removed_percent FROM done GROUP BY reason",
    "strip_records": f"""WITH {STRIP} SELECT doc_id, 'reference_heading_v1' AS method, reason = '' AS stripped, sha256(text) AS source_text_sha256, doc_id % 4 <> 0 AS current, CASE reason WHEN 'no_heading' THEN 'no standalone references heading found' WHEN 'heading_too_early' THEN 'references heading sits too early to be the bibliography' WHEN 'cut_too_large' THEN 'cut would remove more than the safety fraction' WHEN 'empty' THEN 'no text to strip' ELSE '' END AS why FROM done""",
    "eval_statuses": f"WITH {case_ctes('exclusion')} SELECT CASE WHEN truth IS NULL THEN 'unlabeled' WHEN NOT judged THEN 'missing' WHEN decision = 'undecidable' THEN 'abstained' WHEN decision = 'wrong_text' THEN 'not_scored' ELSE 'scored' END AS status, count(*) AS n FROM cases GROUP BY 1",
    "eval_presentation": f"""WITH {case_ctes('power_analysis')}, r AS (SELECT (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS a, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f, undecidable / (eligible - missing)::DOUBLE AS u FROM conf)
        SELECT printf('%.1f%%', a * 100) AS accuracy, printf('%.3f', f) AS f1, printf('%.1f%%', u * 100) AS undecidable_rate, chr(8212) AS none, round(a, 4) AS rounded FROM r""",
}

MORE |= {
    "records_history": f"""WITH b AS (SELECT n_nationkey AS nth, {pick('n_nationkey', 'exclusion', 'power_analysis', 'data_analysis')} AS task, 'run' || n_nationkey AS run_ids, CASE n_nationkey % 3 WHEN 2 THEN 'mixed_configuration' ELSE 'comparable' END AS status, n_nationkey % 2 AS f FROM nation),
        e AS (SELECT * FROM b WHERE nth < 12 AND task <> 'data_analysis'), l AS (SELECT task, max_by(status, nth) AS last_status, max_by(f, nth) AS last_f FROM e GROUP BY task),
        x AS (SELECT b.*, CASE WHEN status <> 'comparable' THEN 'configuration' WHEN nth < 12 AND b.task <> 'data_analysis' THEN 'duplicate' END AS refusal, last_status, coalesce(last_status = 'comparable' AND last_f = f, false) AS same FROM b LEFT JOIN l ON l.task = b.task WHERE nth >= 6)
        SELECT task, run_ids, refusal, CASE WHEN refusal IS NULL AND same THEN 'yes' ELSE 'no' END AS comparable_to_previous, CASE WHEN refusal IS NOT NULL THEN '' WHEN last_status IS NULL THEN 'first fully-provenanced observation for this task/split' WHEN same THEN 'same configuration as previous row; eligible for comparison' ELSE 'configuration changed; comparison to previous row is forbidden' END AS comparison_note FROM x""",
    "records_unwritten": f"WITH {JUDGMENTS} SELECT paper_id, task, judgment_index FROM jud WHERE run_id IS NOT NULL AND doc_id % 3 <> 0",
    "records_response_tasks": f"WITH {JUDGMENTS} SELECT 'r' || paper_id AS response_id, string_agg(DISTINCT task, ';' ORDER BY task) AS tasks FROM jud WHERE run_id IS NOT NULL GROUP BY paper_id",
    "records_next_judgments": f"WITH {JUDGMENTS} SELECT a.paper_id, a.task, (max(b.judgment_index) + 1)::INTEGER AS judgment_index FROM jud a JOIN jud b ON a.paper_id = b.paper_id AND a.task = b.task WHERE a.judgment_index = 1 AND a.run_id IS NOT NULL GROUP BY ALL",
    "records_ledger": f"""SELECT t.task, 'r1' AS round, {D}, 'tok' || doc_id AS token, (1 + doc_id % 3)::INTEGER AS attempt, CASE WHEN (doc_id + t) % 13 = 0 THEN 'failure' ELSE 'ok' END AS outcome, CASE WHEN (doc_id + t) % 13 <> 0 THEN '' WHEN doc_id % 2 = 0 THEN 'parse' ELSE 'process' END AS failure_kind,
        CASE WHEN (doc_id + t) % 13 = 0 THEN least(400, 7 * (doc_id % 90)) ELSE 0 END::INTEGER AS detail, CASE WHEN (doc_id + t) % 13 = 0 AND doc_id % 2 = 1 THEN '1' ELSE '0' END AS exit_code, 'raw/' || doc_id || '.' || t AS raw_path FROM documents, (VALUES ('exclusion', 0), ('power_analysis', 1)) t(task, t)""",
    "records_response_ids": f"SELECT {D}, 'response-' || sha256(CASE WHEN doc_id % 2 = 0 THEN 'provider:req' || doc_id ELSE 'attempt:run-1:' || doc_id || ':' || (doc_id % 3 + 1) END) AS response_id FROM documents",
    "records_tokens": f"SELECT {D}, left(sha256('s' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ':1' ELSE ':0' END), 16) AS token FROM documents",
    "records_prompts": f"""WITH p AS (SELECT doc_id, {D}, text, {pick('doc_id', 'exclusion', 'power_analysis', 'data_analysis')} AS task, chr(10) || chr(10) AS n FROM documents)
        SELECT paper_id, sha256('# ' || task || n || '<<PAPER t' || doc_id || '>>' || n || text || n || '<<END t' || doc_id || '>>' || n || '# ' || task || n || 'Task: ' || task || '. Answer with one of: yes, no, undecidable' || CASE task WHEN 'exclusion' THEN ', wrong_text' ELSE '' END || '. Echo paper_id t' || doc_id || '.') AS prompt_sha256 FROM p""",
    "records_drift": f"SELECT {D}, CASE doc_id % 3 WHEN 0 THEN 'same' WHEN 1 THEN CASE WHEN text = 'x' THEN 'same' ELSE 'changed' END ELSE '' END AS drift FROM documents",
    "records_repairs": "SELECT CAST(user_id AS VARCHAR) AS paper_id, 'f' || min(event_id) AS file FROM events WHERE event_id % 3 = 1 GROUP BY user_id",
    "records_to_score": f"SELECT {D} FROM documents WHERE doc_id % 6 <> 0",
    "extraction_report": f"SELECT {D}, CASE WHEN doc_id % 10 = 0 THEN 'missing' ELSE 'extracted' END AS state, CASE WHEN doc_id % 10 <> 0 AND doc_id % 7 > 0 THEN round_even(n_chars / (doc_id % 7)::DOUBLE, 0) ELSE 0 END::BIGINT AS chars_per_page FROM documents",
    "fetch_protected": f"SELECT {D}, doc_id % 4 = 0 AS protected, doc_id % 4 <> 0 AND n_chars <= 2000 AS preflight_ok, {pick('doc_id', 'pdfs_unlabelled', 'pdfs_labelled')} AS folder FROM documents",
    "round_run_log": f"SELECT {D}, CASE WHEN n_chars > 500 THEN 'sent' ELSE 'no_text' END AS state FROM documents",
    "corpus_active": f"WITH {PAPERS} SELECT paper_id, verdict FROM pap WHERE verdict <> 'DROPPED' AND status = 'OK'",
    "dedupe_first_per_key": "SELECT user_id, max(event_id) AS nth FROM events GROUP BY user_id",
}

TRIALS = f"""tri AS (SELECT doc_id, {D}, {pick('doc_id', '', '', '', 'Baseline paper', '', 'secondary data; baseline', 'Second study, same group', '', 'Pilot; not a group-randomized trial', 'review of methods', '')} AS reason, ([1, 0, NULL, 0])[doc_id % 4 + 1] AS dc, ([0, 1, NULL])[doc_id % 3 + 1] AS pc,
    doc_id % 6 IN (0, 2) AS plain, {pick('doc_id', 'none', 'Stratified', '', 'pair matched', 'constrained', 'minimised')} AS rand, doc_id % 4 < 2 AS data_clustering, doc_id % 2 = 1 AS power_clustering, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 5 + 1 END AS n_levels, doc_id % 3 < 2 AS wedge, ([12.0, 30.0, NULL, NULL, 8.0, NULL, NULL])[doc_id % 7 + 1] AS n_outer_n FROM documents),
dsg AS (SELECT *, CASE WHEN reason = '' THEN 0 ELSE 1 END AS excluded, CASE WHEN reason <> '' THEN '' WHEN plain THEN 'no' ELSE 'yes' END AS rr_flag, CASE WHEN reason <> '' THEN '' WHEN plain THEN 'Clustering alone' ELSE 'Clustering + RR' END AS design_type FROM tri),
ign AS (SELECT *, CASE WHEN design_type = '' OR dc IS NULL THEN '' WHEN dc = 1 THEN 'correct' WHEN plain THEN 'ignored clustering' WHEN NOT data_clustering THEN 'ignored both' ELSE 'ignored RR only' END AS ignored_data_c,
    CASE WHEN design_type = '' OR pc IS NULL THEN '' WHEN pc = 1 THEN 'correct' WHEN plain THEN 'ignored clustering' WHEN NOT power_clustering THEN 'ignored both' ELSE 'ignored RR only' END AS ignored_power_c FROM dsg)"""


def _long(column: str) -> str:
    return f"""nci AS (SELECT * FROM (VALUES ('Clustering alone', 1, 20), ('Clustering alone', 0, 10), ('Ignored RR only', 1, 32), ('Ignored RR only', 0, 34), ('Ignored both', 1, 19), ('Ignored both', 0, 47)) v(stratum, ignored, count)),
    lng AS (SELECT 'Clustering alone' AS stratum, CASE {column} WHEN 'correct' THEN 0 ELSE 1 END AS ignored FROM ign WHERE {column} = 'ignored clustering' OR {column} = 'correct' AND plain UNION ALL SELECT 'Ignored RR only', CASE {column} WHEN 'ignored RR only' THEN 1 ELSE 0 END FROM ign WHERE {column} IN ('ignored RR only', 'ignored both') OR {column} = 'correct' AND NOT plain
        UNION ALL SELECT 'Ignored both', CASE {column} WHEN 'ignored both' THEN 1 ELSE 0 END FROM ign WHERE {column} IN ('ignored RR only', 'ignored both') OR {column} = 'correct' AND NOT plain),
    two AS (SELECT stratum, ignored::INTEGER AS ignored, count::BIGINT AS count, 'A' AS agency FROM nci UNION ALL SELECT stratum, ignored::INTEGER, count(*), 'B' FROM lng GROUP BY ALL)"""


_HYPER = f"exp({CHOOSE.format('r1', 'k')} + {CHOOSE.format('r2', '(c1 - k)')} - {CHOOSE.format('n', 'c1')})"
MORE |= {
    "trials_design": f"WITH {TRIALS} SELECT paper_id, excluded, dc AS data_correct_n, pc AS power_correct_n, rr_flag, design_type, ignored_data_c, ignored_power_c, n_outer_n::DOUBLE AS n_outer_n FROM ign",
    "trials_characteristics": f"""WITH {TRIALS}, g AS (SELECT count(*) AS total, [('clustering_alone', count(*) FILTER (plain)), ('clustering_rr', count(*) FILTER (NOT plain)), ('stratified', count(*) FILTER (rand = 'Stratified')), ('constrained', count(*) FILTER (rand = 'constrained')), ('paired', count(*) FILTER (rand = 'pair matched')), ('other_restriction', count(*) FILTER (rand = 'minimised')),
            ('levels_1', count(*) FILTER (n_levels = 1)), ('levels_2', count(*) FILTER (n_levels = 2)), ('levels_3', count(*) FILTER (n_levels = 3)), ('levels_4_plus', count(*) FILTER (n_levels >= 4)), ('levels_missing', count(*) FILTER (n_levels IS NULL)), ('stepped_wedge', count(*) FILTER (wedge))] AS x FROM ign WHERE excluded = 0),
        u AS (SELECT total, unnest(x) AS x FROM g) SELECT x[1] AS name, x[2] AS n, round(100.0::DOUBLE * x[2] / total, 1) AS percent FROM u""",
    "trials_flow": f"""WITH {TRIALS}, k AS (SELECT reason, count(*) AS n FROM ign WHERE excluded = 1 GROUP BY reason), c AS (SELECT * FROM (VALUES ('baseline', ['Baseline paper']), ('implementation', []), ('methods', ['review of methods']), ('not_group_randomized', ['Pilot; not a group-randomized trial']), ('pilot', ['Pilot; not a group-randomized trial']), ('qualitative', []),
        ('secondary_data', ['secondary data; baseline']), ('second_study', ['Second study, same group']), ('stepped_wedge', []), ('review', ['review of methods']), ('secondary_outcomes', [])) v(category, reasons)) SELECT category, coalesce((SELECT sum(n) FROM k WHERE list_contains(reasons, reason)), 0)::BIGINT AS n FROM c""",
    "trials_ignored": f"WITH {TRIALS}, {_long('ignored_power_c')} SELECT * FROM two",
    "trials_marginals": f"""WITH {TRIALS}, {_long('ignored_data_c')}, t AS (SELECT agency, sum(count) AS total FROM two GROUP BY agency), m AS (SELECT agency, 'ignored' AS flag, ignored AS value, sum(count)::BIGINT AS n FROM two GROUP BY ALL UNION ALL SELECT agency, 'alone', (stratum = 'Clustering alone')::INTEGER, sum(count)::BIGINT FROM two GROUP BY ALL)
        SELECT agency, flag, value, n, round(100.0::DOUBLE * n / total, 1) AS percent FROM m JOIN t USING (agency)""",
    "trials_cmh": f"""WITH {TRIALS}, {_long('ignored_power_c')}, t AS (SELECT stratum, coalesce(sum(count) FILTER (agency = 'A' AND ignored = 1), 0)::DOUBLE AS a, coalesce(sum(count) FILTER (agency = 'A' AND ignored = 0), 0)::DOUBLE AS b, coalesce(sum(count) FILTER (agency <> 'A' AND ignored = 1), 0)::DOUBLE AS c, coalesce(sum(count) FILTER (agency <> 'A' AND ignored = 0), 0)::DOUBLE AS d FROM two GROUP BY stratum),
        s AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1, a + b + c + d AS n, row_number() OVER (ORDER BY stratum) AS i FROM t), k AS (SELECT i, r1, r2, c1, n, unnest(range(greatest(0, c1 - r2)::BIGINT, least(r1, c1)::BIGINT + 1)) AS k FROM s), p AS (SELECT i, k, {_HYPER} AS p FROM k),
        x AS (SELECT u.k + v.k AS k, sum(u.p * v.p) AS p FROM p u, p v WHERE u.i = 1 AND v.i = 2 GROUP BY 1), y AS (SELECT x.k + w.k AS k, sum(x.p * w.p) AS p FROM x, p w WHERE w.i = 3 GROUP BY 1), z AS (SELECT sum(a) AS seen, sum(r1 * c1 / n) AS mean FROM s)
        SELECT (SELECT count(*) FROM s) AS strata, (SELECT round(sum(a - r1 * c1 / n) ** 2 / sum(r1 * r2 * c1 * (b + d) / (n * n * (n - 1))), 6) FROM s) AS statistic, (SELECT round(sum(a * d / n) / sum(b * c / n), 6) FROM s) AS odds_ratio, round(least(1, sum(p) FILTER (abs(k - mean) >= abs(seen - mean) - 1e-9)), 6) AS p_value FROM y, z""",
}
