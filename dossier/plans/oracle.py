"""DuckDB SQL for the queries, written on its own from their rules."""

NOTICE = r"(?i)^\s*[\[(]?\s*(?:author|publisher|editorial)?\s*(?:erratum|errata|corrigend(?:um|a)|correction|retract(?:ion|ed)?|withdrawn|addendum|expression\s+of\s+concern)\b[^:]{0,12}[:\])]"
OTHER = r"\b[A-Z][a-z]{2,}\s+(?:et\s+al\.?|and\s+[A-Z][a-z]{2,}|&\s+[A-Z][a-z]{2,})[\s,]*\(?(?:19|20)\d{2}\)?|\b[A-Z][a-z]{2,}\s+\((?:19|20)\d{2}\)"
REFERRED = r"""src AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text || chr(10) || ' 5. References:' || chr(10) || repeat('1. Someone 2001.' || chr(10), (doc_id % 40)::INTEGER) || CASE WHEN doc_id % 3 = 0 THEN 'Appendix A' || chr(10) || 'more' ELSE '' END ELSE text END AS text FROM documents)"""
STRIP = REFERRED + r""", ln AS (SELECT doc_id, text, length(text) AS source_chars, string_split(text, chr(10)) AS lines FROM src),
hd AS (SELECT *, len(lines) - list_position(list_reverse(list_transform(lines, lambda x: regexp_matches(x, '(?i)^[\s\d.)*•#]*(?:references?|reference list|bibliography|works cited|literature cited)\s*[:.]?\s*$'))), true) AS pos FROM ln),
bd AS (SELECT *, array_to_string(lines[1:pos], chr(10)) AS body, lines[pos + 1:] AS tail FROM hd),
rs AS (SELECT *, coalesce(list_position(list_transform(tail, lambda x: regexp_matches(x, '(?i)^[\s\d.)*•#]*(?:appendix|appendices|supplement(?:ary|al)?|additional file|supporting information|online supplement|web appendix|e-?appendix|annex)\b')), true), 0) AS after FROM bd),
ct AS (SELECT *, CASE WHEN after > 1 THEN array_to_string(tail[after:], chr(10)) ELSE '' END AS rest FROM rs),
cu AS (SELECT *, regexp_replace(body, '\s+$', '') || chr(10) || chr(10) || '[REFERENCES SECTION REMOVED]' || CASE WHEN rest <> '' THEN chr(10) || chr(10) || regexp_replace(rest, '^\n+', '') ELSE '' END || chr(10) AS cut FROM ct),
why AS (SELECT *, CASE WHEN NOT regexp_matches(text, '\S') THEN 'empty' WHEN pos IS NULL THEN 'no_heading' WHEN length(body) < 0.3 * source_chars THEN 'heading_too_early' WHEN source_chars - length(cut) > 0.6 * source_chars THEN 'cut_too_large' ELSE '' END AS reason FROM cu),
done AS (SELECT *, CASE WHEN reason IN ('empty', 'no_heading') THEN '' ELSE regexp_replace(lines[pos + 1], '^\s+|\s+$', '', 'g') END AS heading, CASE WHEN reason IN ('empty', 'no_heading') THEN -1 ELSE pos END::INTEGER AS heading_line, CASE reason WHEN '' THEN cut ELSE text END AS kept FROM why)"""
FLAGS = r"""WITH d AS (SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN text || chr(10) || 'References' || chr(10) || '1. One 2001.' || chr(10) || ' Abstract' || chr(10) || 'more' WHEN 2 THEN 'Submission Form' || chr(10) || text WHEN 3 THEN text || chr(65533) || ' doi: 10.1' WHEN 4 THEN text || ' doing' ELSE text END AS whole, CASE WHEN doc_id % 5 = 0 THEN length(text) ELSE length(left(text, 100)) END AS abstract FROM documents),
p AS (SELECT *, ceil(length(whole) / 3000::DOUBLE) AS pages FROM d), m AS (SELECT median(length(whole) / pages) AS m FROM p WHERE pages > 0),
t AS (SELECT *, regexp_replace(whole, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+$', '', 'g') AS t FROM p, m),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15) AS long, regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', '', 'g') AS solid FROM t)
SELECT doc_id, concat_ws(';', CASE WHEN regexp_matches(t, chr(65533) || '|Ã¢â‚¬|Ã©|Ã¨|â€œ|â€\x{9d}|Ã\x{ad}') THEN 'F1_MOJIBAKE' END, CASE WHEN regexp_matches(t, '(?ims)^\s*(?:references|bibliography|literature cited)\b.*?^\s*abstract\b') THEN 'F2_MULTI_ARTICLE' END,
    CASE WHEN t <> '' AND NOT regexp_matches(t, '(?i)\breferences\b|\bbibliography\b|doi:\s*10\.') THEN 'F3_NO_REFERENCES' END, CASE WHEN pages > 0 AND m > 0 AND length(t) / pages < 0.4 * m THEN 'F4_THIN_PER_PAGE' END, CASE WHEN abstract > 0 AND length(t) < 3 * abstract THEN 'F5_SHORT_VS_ABSTRACT' END,
    CASE WHEN length(regexp_replace(solid, '[^\pL]', '', 'g')) / nullif(length(solid), 0)::DOUBLE < 0.6 THEN 'F6_LOW_ALPHA' END, CASE WHEN len(long) > 50 AND (len(long) - len(list_distinct(long))) / len(long)::DOUBLE > 0.3 THEN 'F7_REPETITIVE' END,
    CASE WHEN regexp_matches(left(t, 600), '(?i)CONSORT-EHEALTH|Submission\s*/?\s*Publication Form|\bSubmission Form\b|\bPublication Form\b') THEN 'F8_SUBMISSION_FORM' END) AS flags FROM l"""

LABELS = """
gate AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN quality = 0 THEN 'low_quality' END AS exclusion_reason,
        CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'yes' ELSE 'no' END END AS power, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'no' ELSE 'yes' END END AS stats,
        'doc ' || doc_id AS citation_raw, CASE WHEN quality = 0 THEN 'excluded' ELSE 'survivor' END AS stratum FROM labels),
place AS (
    SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || left(sha256('dossier-split:' || paper_id), 8))::BIGINT, paper_id) AS rn, count(*) OVER (PARTITION BY stratum) AS size FROM gate),
labs AS (SELECT *, CASE WHEN rn <= round_even(0.3 * size, 0) THEN 'holdout' ELSE 'build' END AS split FROM place)"""

JUDGMENTS = """
grid AS (SELECT t, task, i FROM (VALUES (0, 'exclusion'), (1, 'power_analysis'), (2, 'data_analysis')) a(t, task), (VALUES (1), (2), (3)) b(i)),
jud AS (
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id, task, i AS judgment_index, CASE WHEN i < 3 THEN 'v1' ELSE 'v2' END AS promptbook_version,
        CASE WHEN t = 0 THEN CASE WHEN n_chars < 600 THEN 'yes' WHEN n_chars > 8000 THEN 'undecidable' WHEN doc_id % 97 = 5 THEN 'wrong_text' ELSE 'no' END
             WHEN (doc_id + i + t) % 5 = 0 THEN 'yes' WHEN (doc_id + i + t) % 11 = 0 THEN 'undecidable' ELSE 'no' END AS decision,
        CASE WHEN doc_id % 41 <> 0 THEN CAST(50 + (doc_id * 7 + i) % 50 AS DOUBLE) / 100 END AS confidence,
        CASE WHEN doc_id % 29 <> 0 THEN 'run-' || task || '-' || CASE WHEN i < 3 THEN 'v1' ELSE 'v2' END END AS run_id
    FROM documents, grid WHERE doc_id % 7 <> 0 AND (doc_id + i + t) % 4 <> 0)"""


def case_ctes(task: str, version: str | None = "v1") -> str:
    truth = {"exclusion": "CASE WHEN exclusion_reason IS NOT NULL THEN 'yes' ELSE 'no' END", "power_analysis": "power", "data_analysis": "stats"}[task]
    scope = f"AND promptbook_version = '{version}'" if version else ""
    return f"""{LABELS}, {JUDGMENTS},
    truth AS (SELECT paper_id, {truth} AS truth FROM labs WHERE split = 'build' AND {truth} IS NOT NULL),
    latest AS (SELECT * FROM jud WHERE task = '{task}' {scope} QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY judgment_index DESC) = 1),
    cases AS (
        SELECT coalesce(t.paper_id, l.paper_id) AS paper_id, truth, decision, confidence, run_id,
            CASE WHEN t.paper_id IS NULL THEN 'unlabeled' WHEN l.paper_id IS NULL THEN 'missing' WHEN decision IN ('undecidable', 'wrong_text') THEN decision
                 WHEN truth = 'yes' THEN CASE decision WHEN 'yes' THEN 'true_positive' ELSE 'false_negative' END ELSE CASE decision WHEN 'yes' THEN 'false_positive' ELSE 'true_negative' END END AS outcome,
            l.paper_id IS NOT NULL AS judged
        FROM truth t FULL OUTER JOIN latest l ON t.paper_id = l.paper_id),
    conf AS (
        SELECT count(truth) AS eligible, count(*) FILTER (outcome = 'true_positive') AS tp, count(*) FILTER (outcome = 'true_negative') AS tn, count(*) FILTER (outcome = 'false_positive') AS fp,
            count(*) FILTER (outcome = 'false_negative') AS fn, count(*) FILTER (outcome = 'undecidable') AS undecidable, count(*) FILTER (outcome = 'wrong_text') AS wrong_text,
            count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'unlabeled') AS unlabeled FROM cases),
    scored AS (SELECT *, CASE WHEN outcome IN ('true_positive', 'true_negative') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct FROM cases
        WHERE outcome IN ('true_positive', 'true_negative', 'false_positive', 'false_negative') AND confidence IS NOT NULL)"""


def _wilson(name: str, k: str, n: str) -> str:
    z = 1.959963984540054
    mid, half = f"({k} / ({n})::DOUBLE + {z * z} / (2 * ({n})))", f"{z} * sqrt({k} / ({n})::DOUBLE * (1 - {k} / ({n})::DOUBLE) / ({n}) + {z * z} / (4.0 * ({n}) * ({n})))"
    return f"greatest(({mid} - {half}) / (1 + {z * z} / ({n})), 0) AS {name}_low, least(({mid} + {half}) / (1 + {z * z} / ({n})), 1) AS {name}_high"


ATTEMPTS = """att AS (
    SELECT CAST(user_id AS VARCHAR) AS paper_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)::INTEGER AS attempt,
        CASE event_type WHEN 'error' THEN 'process' WHEN 'signup' THEN 'parse' WHEN 'view' THEN 'semantic' ELSE '' END AS failure_kind, event_type FROM events),
att_ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY attempt DESC, started_at DESC, event_id DESC) AS nth FROM att)"""

_BINS = "bins AS (SELECT i::INTEGER AS bin, round(i * 0.1, 2)::DOUBLE AS lower, round(i * 0.1 + 0.1, 2)::DOUBLE AS upper FROM range(10) r(i)), binned AS (SELECT bin, lower, upper, count(*) AS n, avg(confidence) AS mc, avg(correct) AS acc FROM scored JOIN bins ON confidence >= lower AND (confidence < upper OR bin = 9 AND confidence <= 1) GROUP BY ALL)"


def _rounds(where: str) -> str:
    return f"""(SELECT paper_id, stratum, nth::INTEGER AS nth, ((nth - 1) // 50 + 1)::INTEGER AS round FROM (
        SELECT *, row_number() OVER (ORDER BY pos, stratum, paper_id) AS nth FROM (
            SELECT paper_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || left(sha256('dossier-rounds:' || paper_id), 8))::BIGINT, paper_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS pos
            FROM labs WHERE {where})))"""


ORACLE: dict[str, str] = {
    "eval_cases": f"WITH {case_ctes('exclusion')} SELECT * FROM cases",
    "eval_confusion": " UNION ALL ".join(f"(WITH {case_ctes(t)} SELECT *, '{t}' AS task FROM conf)" for t in ("exclusion", "power_analysis", "data_analysis")),
    "eval_rates": f"""WITH {case_ctes('exclusion')} SELECT *, tp + tn + fp + fn AS scored, eligible - missing AS judged_eligible, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, tp / (tp + fn)::DOUBLE AS sensitivity,
        tn / (tn + fp)::DOUBLE AS specificity, tp / (tp + fp)::DOUBLE AS precision, tn / (tn + fn)::DOUBLE AS npv, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1,
        (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 AS balanced_accuracy, (eligible - missing) / eligible::DOUBLE AS coverage, (tp + tn + fp + fn) / eligible::DOUBLE AS scoreable_coverage FROM conf""",
    "eval_kappa": f"""WITH {case_ctes('data_analysis')}, p AS (SELECT (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS observed, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn))::DOUBLE AS expected FROM conf)
        SELECT observed, expected, (observed - expected) / nullif(1 - expected, 0) AS kappa FROM p""",
    "eval_wilson": f"WITH {case_ctes('exclusion')} SELECT {_wilson('accuracy', '(tp + tn)', 'tp + tn + fp + fn')}, {_wilson('sensitivity', 'tp', 'tp + fn')}, {_wilson('specificity', 'tn', 'tn + fp')} FROM conf",
    "eval_confidence_summary": f"WITH {case_ctes('exclusion')} SELECT count(confidence) AS n, min(confidence) AS lowest, max(confidence) AS highest, avg(confidence) AS mean, count(DISTINCT confidence) AS distinct_n FROM cases WHERE truth IS NOT NULL AND judged",
    "eval_calibration_bins": f"WITH {case_ctes('exclusion')}, {_BINS} SELECT bin, lower, upper, n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM binned",
    "eval_calibration_summary": f"""WITH {case_ctes('exclusion')}, {_BINS} SELECT count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(correct), 6) AS accuracy, round(avg((confidence - correct) ** 2), 6) AS brier,
        round(avg(confidence) - avg(correct), 6) AS gap, (SELECT round(sum(n * abs(mc - acc)) / sum(n), 6) FROM binned) AS ece FROM scored""",
    "eval_thresholds": f"""WITH {case_ctes('exclusion')}, cuts AS (SELECT round(0.5 + i * 0.05, 2)::DOUBLE AS threshold FROM range(10) r(i)), k AS (
        SELECT threshold, count(*) AS n, count(*) FILTER (confidence < threshold) AS low_n, count(*) FILTER (confidence >= threshold AND outcome = 'true_positive') AS tp, count(*) FILTER (confidence >= threshold AND outcome = 'true_negative') AS tn,
            count(*) FILTER (confidence >= threshold AND outcome = 'false_positive') AS fp, count(*) FILTER (confidence >= threshold AND outcome = 'false_negative') AS fn FROM scored, cuts GROUP BY threshold)
        SELECT threshold, low_n, low_n / n::DOUBLE AS low_rate, tp + tn + fp + fn AS retained_n, (tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE AS accuracy, tp / nullif(tp + fn, 0)::DOUBLE AS sensitivity, tn / nullif(tn + fp, 0)::DOUBLE AS specificity FROM k""",
    "eval_configuration": f"""WITH {case_ctes('exclusion', None)}, j AS (SELECT run_id, promptbook_version, CASE WHEN run_id IS NULL THEN NULL WHEN promptbook_version = 'v1' THEN 'medium' ELSE 'high' END AS effort FROM latest)
        SELECT count(*) AS judgments, count(*) FILTER (run_id IS NULL) AS unprovenanced, count(DISTINCT run_id) AS configs, string_agg(DISTINCT run_id, ';' ORDER BY run_id) AS run_ids, string_agg(DISTINCT effort, ';' ORDER BY effort) AS efforts, 'm-1' AS models,
            string_agg(DISTINCT promptbook_version, ';' ORDER BY promptbook_version) AS promptbook_versions,
            CASE WHEN count(*) = 0 THEN 'no_judgments' WHEN count(run_id) = 0 THEN 'unprovenanced_legacy' WHEN count(*) > count(run_id) THEN 'mixed_with_unprovenanced' WHEN count(DISTINCT run_id) > 1 THEN 'mixed_configuration' ELSE 'comparable' END AS status FROM j""",
    "accuracy_judgment_first": f"""WITH {LABELS}, {JUDGMENTS}, l AS (SELECT * FROM jud WHERE task = 'power_analysis' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY judgment_index DESC) = 1),
        o AS (SELECT CASE WHEN b.paper_id IS NULL THEN 'unlabeled' WHEN decision IN ('undecidable', 'wrong_text') THEN 'abstained' WHEN power IS NULL THEN 'unlabeled' WHEN power = decision THEN 'correct' ELSE 'wrong' END AS o FROM l LEFT JOIN labs b USING (paper_id))
        SELECT count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'wrong') AS wrong, count(*) FILTER (o = 'abstained') AS abstained, count(*) FILTER (o = 'unlabeled') AS unlabeled, count(*) FILTER (o = 'correct') / (count(*) FILTER (o IN ('correct', 'wrong')))::DOUBLE AS accuracy FROM o""",
    "review_outcomes": f"""WITH {case_ctes('power_analysis')} SELECT outcome, count(*) AS n, max(confidence) AS top_confidence,
        list_position(['false_negative', 'false_positive', 'undecidable', 'wrong_text', 'missing', 'unlabeled', 'true_positive', 'true_negative'], outcome)::BIGINT AS review_order FROM cases GROUP BY outcome""",
    "judgments_latest": f"WITH {JUDGMENTS} SELECT paper_id, task, judgment_index, promptbook_version, decision, confidence FROM jud QUALIFY row_number() OVER (PARTITION BY paper_id, task ORDER BY judgment_index DESC) = 1",
    "judgments_latest_by_version": f"WITH {JUDGMENTS} SELECT paper_id, task, judgment_index, decision FROM jud WHERE promptbook_version = 'v1' QUALIFY row_number() OVER (PARTITION BY paper_id, task ORDER BY judgment_index DESC) = 1",
    "judgments_next_index": f"""WITH {JUDGMENTS}, m AS (SELECT paper_id, task, max(judgment_index) AS top FROM jud GROUP BY ALL)
        SELECT CAST(doc_id AS VARCHAR) AS paper_id, t.task, (coalesce(top, 0) + 1)::INTEGER AS next_index FROM documents d CROSS JOIN (SELECT DISTINCT task FROM grid) t LEFT JOIN m ON m.paper_id = CAST(d.doc_id AS VARCHAR) AND m.task = t.task""",
    "judgments_integrity": f"""WITH {JUDGMENTS} SELECT 'repeated_key' AS violation, count(*) AS n FROM (SELECT 1 FROM jud GROUP BY paper_id, task, judgment_index HAVING count(*) > 1)
        UNION ALL SELECT 'repeated_response', 0 UNION ALL SELECT 'unknown_run', count(*) FROM jud WHERE run_id NOT IN (SELECT 'run-' || task || '-' || v FROM grid, (VALUES ('v1'), ('v2')) x(v))
        UNION ALL SELECT 'run_of_other_task', count(*) FROM jud WHERE run_id NOT LIKE 'run-' || task || '-%' UNION ALL SELECT 'decision_outside_vocabulary', count(*) FROM jud WHERE decision NOT IN ('yes', 'no', 'undecidable', 'wrong_text') OR decision = 'wrong_text' AND task <> 'exclusion'
        UNION ALL SELECT 'confidence_outside_bounds', count(*) FROM jud WHERE confidence NOT BETWEEN 0 AND 1""",
    "attempts_latest": f"WITH {ATTEMPTS} SELECT paper_id, attempt, started_at, failure_kind FROM att_ranked WHERE nth = 1",
    "attempts_superseded": f"WITH {ATTEMPTS} SELECT paper_id, count(*) AS superseded FROM att_ranked WHERE nth > 1 GROUP BY paper_id",
    "retry_rate": f"WITH {ATTEMPTS} SELECT count(*) AS attempts, count(DISTINCT paper_id) AS papers, count(*) FILTER (attempt > 1) AS retries, round(count(*) FILTER (attempt > 1) / nullif(count(*), 0)::DOUBLE, 4) AS retry_rate FROM att",
    "retry_by_kind": f"WITH {ATTEMPTS} SELECT CASE failure_kind WHEN '' THEN 'none' ELSE failure_kind END AS kind, count(*) AS n FROM att WHERE attempt > 1 GROUP BY ALL",
    "retry_state": f"WITH {ATTEMPTS} SELECT paper_id, attempt, failure_kind, CASE WHEN failure_kind = '' THEN 'accepted' WHEN attempt < 3 THEN 'retry' ELSE 'review_required' END AS state FROM att_ranked WHERE nth = 1",
    "decisions_last_by_time": f"WITH {ATTEMPTS} SELECT paper_id, left(started_at, 10) AS decided_at, event_type AS verdict FROM att QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY left(started_at, 10) DESC, event_id DESC) = 1",
    "history_lag": f"""WITH {LABELS}, {JUDGMENTS}, x AS (SELECT j.task, promptbook_version AS seq, decision, CASE j.task WHEN 'exclusion' THEN CASE WHEN exclusion_reason IS NULL THEN 'no' ELSE 'yes' END WHEN 'power_analysis' THEN power ELSE stats END AS truth FROM jud j JOIN labs USING (paper_id)),
        a AS (SELECT task, seq, round(avg((truth = decision)::INTEGER), 6) AS accuracy FROM x WHERE truth IS NOT NULL AND decision IN ('yes', 'no') GROUP BY ALL)
        SELECT task, seq, accuracy, lag(accuracy) OVER (PARTITION BY task ORDER BY seq) AS previous_accuracy, row_number() OVER (PARTITION BY task ORDER BY seq) > 1 AS comparable_to_previous FROM a""",
    "split_rank": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, ('0x' || left(sha256('dossier-split:' || doc_id), 8))::BIGINT / 4294967296.0::DOUBLE AS rank FROM documents",
    "split_assign": f"WITH {LABELS} SELECT paper_id, stratum, split FROM labs",
    "split_counts": f"WITH {LABELS} SELECT stratum, split, count(*) AS n FROM labs GROUP BY ALL",
    "rounds_interleave": f"WITH {LABELS} SELECT * FROM {_rounds("split = 'build'")}",
    "rounds_membership_equal": f"""WITH {LABELS}, a AS (SELECT * FROM {_rounds("split = 'build' AND stratum = 'survivor'")} WHERE round = 1), b AS (SELECT * FROM {_rounds("split = 'build'")} WHERE round = 1)
        SELECT count(*) FILTER (b.paper_id IS NULL) AS only_a, count(*) FILTER (a.paper_id IS NULL) AS only_b, count(*) FILTER (a.paper_id IS NOT NULL AND b.paper_id IS NOT NULL) AS both_n FROM a FULL OUTER JOIN b ON a.paper_id = b.paper_id""",
}


SOURCES = f"""{LABELS}, base AS (SELECT paper_id, doc_id, coalesce(exclusion_reason, '') AS exclusion_reason, coalesce(power, '') AS power, coalesce(stats, '') AS stats, citation_raw FROM labs),
src AS (SELECT *, 'A' AS source, 'labels_a.csv' AS source_file FROM base WHERE doc_id % 3 <> 0
    UNION ALL SELECT paper_id, doc_id, exclusion_reason, CASE WHEN doc_id % 11 = 0 AND power = 'yes' THEN 'no' WHEN doc_id % 11 = 0 AND power = 'no' THEN 'yes' ELSE power END, stats, citation_raw, 'B', 'labels_b.csv' FROM base WHERE doc_id % 5 <> 0)"""
RAW = """raw AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, (['Yes', ' no (see text)', 'N', 'y, partly', '', 'maybe', 'Pilot Study', ' Secondary  DATA analysis ', 'None', 'unclear', 'strange reason', '17', ' 8 ', '8.5'])[doc_id % 14 + 1] AS raw FROM documents)"""
PAPERS = """pap AS (SELECT CAST(d.doc_id AS VARCHAR) AS paper_id, d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'human_labelled' END AS set, source, lang, left(text, 60) AS title, md5(text) AS md5, '10.1000/' || md5(text) AS doi,
    CAST(d.doc_id AS VARCHAR) AS pmid, CASE WHEN d.doc_id % 13 = 0 THEN 'DROPPED' WHEN d.doc_id % 17 = 0 THEN 'WEAK' ELSE 'VERIFIED' END AS verdict, CASE WHEN d.doc_id % 31 = 0 THEN 'PDF_MISSING' ELSE 'OK' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
NEW = "newl AS (SELECT paper_id, CASE WHEN doc_id % 5 = 0 THEN citation_raw || ' (rev)' ELSE citation_raw END AS citation_raw FROM labs WHERE doc_id % 7 <> 0)"
IDS = f"{PAPERS}, ids AS (SELECT paper_id, set, 'doi' AS field, doi AS value FROM pap UNION ALL SELECT paper_id, set, 'pmid', pmid FROM pap UNION ALL SELECT paper_id, set, 'md5', md5 FROM pap)"
PAIRS = f"{PAPERS}, pairs AS (SELECT md5 AS pair_id, max(paper_id) FILTER (set = 'human_labelled') AS keep, max(paper_id) FILTER (set <> 'human_labelled') AS remove FROM pap GROUP BY md5 HAVING count(*) = 2 AND count(*) FILTER (set = 'human_labelled') = 1)"
LEDGER = f"""{PAPERS}, book AS (SELECT paper_id, (['cross_set_duplicate', 'internal_duplicate', 'identity', 'unreviewed', 'cross_paper_reason', 'disagreement', 'expert_review', 'text_integrity'])[doc_id % 8 + 1] AS stage,
    (['rule', 'rule', 'human', 'rule', 'rule', 'human', 'human', 'model'])[doc_id % 8 + 1] AS decided_by, 'rule ' || doc_id % 3 AS reason FROM pap WHERE verdict = 'DROPPED' UNION ALL SELECT paper_id, 'pdf_missing', 'rule', 'PDF_MISSING' FROM pap WHERE status = 'PDF_MISSING')"""
DECIDED = "dec AS (SELECT paper_id, CASE WHEN doc_id % 2 = 0 THEN 'VERIFIED' ELSE 'DROPPED' END AS decided FROM pap WHERE doc_id % 9 = 0)"
AUTHORS = f"{PAPERS}, aut AS (SELECT paper_id, doc_id, source AS surname, 1990 + doc_id % 23 AS year, ['co' || doc_id % 11, 'third' || doc_id % 3] AS rest FROM pap)"

ORACLE |= {
    "labels_union": f"WITH {SOURCES} SELECT paper_id, source, power, CASE source WHEN 'A' THEN '' ELSE stats END AS stats, CASE source WHEN 'A' THEN 'n' ELSE '' END AS note FROM src",
    "labels_agree": f"WITH {SOURCES} SELECT paper_id, count(*) AS n_rows, min(exclusion_reason) AS exclusion_reason, min(power) AS power, min(stats) AS stats FROM src GROUP BY paper_id HAVING count(DISTINCT (exclusion_reason, power, stats)) = 1",
    "labels_disagree": f"WITH {SOURCES} SELECT paper_id, count(*) AS n_rows, count(DISTINCT (exclusion_reason, power, stats)) AS n_answers FROM src GROUP BY paper_id HAVING count(DISTINCT (exclusion_reason, power, stats)) > 1",
    "labels_collapse": f"WITH {SOURCES} SELECT paper_id, string_agg(source_file, '; ' ORDER BY source) AS source_files, min(citation_raw) AS citations FROM src GROUP BY paper_id HAVING count(DISTINCT (exclusion_reason, power, stats)) = 1",
    "labels_gate": f"WITH {SOURCES} SELECT paper_id, source, nullif(exclusion_reason, '') AS exclusion_reason, CASE WHEN exclusion_reason = '' THEN 'yes' END AS power, CASE WHEN exclusion_reason = '' THEN nullif(stats, '') END AS stats FROM src",
    "labels_clean_yes_no": f"WITH {RAW} SELECT *, CASE WHEN lower(regexp_extract(trim(raw), '^[^ (,-]*')) IN ('y', 'yes') THEN 'yes' WHEN lower(regexp_extract(trim(raw), '^[^ (,-]*')) IN ('n', 'no') THEN 'no' ELSE '' END AS clean FROM raw",
    "labels_clean_reason": f"WITH {RAW} SELECT *, CASE trim(raw) WHEN '' THEN '' WHEN 'Pilot Study' THEN 'pilot_study' WHEN 'Secondary  DATA analysis' THEN 'secondary_analysis' ELSE 'other' END AS clean FROM raw",
    "labels_restricted": f"WITH {RAW} SELECT *, CASE lower(trim(raw)) WHEN '' THEN '' WHEN 'none' THEN 'no' WHEN 'no' THEN 'no' WHEN 'unclear' THEN 'unclear' ELSE 'yes' END AS restricted, CASE WHEN regexp_full_match(trim(raw), '[0-9]+') THEN trim(raw) ELSE '' END AS number FROM raw",
    "labels_upsert_keep_split": f"WITH {LABELS}, {NEW} SELECT n.paper_id, n.citation_raw, CASE WHEN o.citation_raw = n.citation_raw THEN split END AS split FROM newl n JOIN labs o USING (paper_id) UNION ALL SELECT paper_id, citation_raw, split FROM labs WHERE doc_id % 7 = 0",
    "labels_stale": f"WITH {LABELS} SELECT paper_id, citation_raw, split FROM labs WHERE doc_id % 7 = 0",
    "labels_identifier_join": f"""WITH {PAPERS}, u AS (SELECT doi, min(paper_id) AS p FROM pap GROUP BY doi HAVING count(*) = 1)
        SELECT 'r' || paper_id AS row_id, coalesce(u.p, CASE WHEN doc_id % 3 = 0 THEN paper_id END) AS paper_id, CASE WHEN u.p IS NOT NULL THEN 'doi' WHEN doc_id % 3 = 0 THEN 'pmid' ELSE 'none' END AS rule FROM pap LEFT JOIN u ON u.doi = pap.doi AND doc_id % 4 <> 0""",
    "labels_author_year_join": f"WITH {AUTHORS}, k AS (SELECT surname, year, count(*) AS n FROM aut GROUP BY ALL) SELECT 'r' || paper_id AS row_id, CASE WHEN n = 1 THEN paper_id END AS paper_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN doc_id % 9 = 0 THEN 'author_year_suffix_sole_candidate' ELSE 'author_year' END AS rule FROM aut JOIN k USING (surname, year)",
    "labels_positional_join": f"""WITH {AUTHORS}, k AS (SELECT surname, year, count(*) AS n FROM aut GROUP BY ALL), h AS (SELECT a.paper_id, min(b.paper_id) AS p, count(*) AS hits FROM aut a JOIN aut b ON a.surname = b.surname AND a.year = b.year AND a.rest = b.rest GROUP BY a.paper_id)
        SELECT 'r' || paper_id AS row_id, CASE WHEN n = 1 THEN paper_id ELSE p END AS paper_id, CASE WHEN n = 1 THEN 'author_year' ELSE 'author_position' END AS rule, hits AS positional_hits FROM aut JOIN k USING (surname, year) JOIN h USING (paper_id)""",
    "ledger_union": f"WITH {LEDGER} SELECT * FROM book",
    "ledger_by_stage": f"WITH {LEDGER} SELECT stage, count(*) AS n, string_agg(DISTINCT decided_by, ';' ORDER BY decided_by) AS decided_by, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM book GROUP BY stage",
    "ledger_reconcile": f"""WITH {LEDGER}, x AS (SELECT p.*, b.paper_id IS NOT NULL AS listed FROM pap p LEFT JOIN (SELECT DISTINCT paper_id FROM book) b ON p.paper_id = b.paper_id)
        SELECT count(*) AS manifest_n, count(*) FILTER (verdict = 'DROPPED') AS dropped_n, count(*) FILTER (listed) AS listed_n, count(*) FILTER (verdict = 'DROPPED' AND NOT listed) AS dropped_unlisted, count(*) FILTER (verdict <> 'DROPPED' AND listed) AS listed_active,
        count(*) FILTER (verdict <> 'DROPPED' AND status = 'OK') AS active_n, count(*) FILTER ((verdict = 'DROPPED') <> listed) = 0 AS reconciles FROM x""",
    "dedupe_identifier_collisions": f"WITH {IDS} SELECT field, value, count(DISTINCT paper_id) AS n_papers, min(paper_id) AS first_paper FROM ids GROUP BY field, value HAVING count(DISTINCT paper_id) > 1",
    "dedupe_cross_set": f"WITH {IDS} SELECT paper_id, string_agg(DISTINCT field, ';' ORDER BY field) AS fields FROM ids a WHERE set = 'unlabelled' AND EXISTS (SELECT 1 FROM ids b WHERE b.set = 'human_labelled' AND b.field = a.field AND b.value = a.value) GROUP BY paper_id",
    "dedupe_pairs_merge": f"WITH {PAIRS} SELECT * FROM pairs",
    "dedupe_orphans": f"WITH {LABELS}, {PAIRS} SELECT pairs.* FROM pairs WHERE keep NOT IN (SELECT paper_id FROM labs WHERE split = 'build')",
    "corpus_upsert": f"WITH {PAPERS}, {DECIDED} SELECT pap.paper_id, coalesce(decided, verdict) AS verdict, CASE WHEN decided IS NULL THEN status ELSE 'DECIDED' END AS status FROM pap LEFT JOIN dec USING (paper_id)",
    "corpus_apply_verdict": f"WITH {PAPERS}, {DECIDED} SELECT pap.paper_id, coalesce(decided, verdict) AS verdict, CASE WHEN decided IS NULL THEN 'untouched' WHEN decided = verdict THEN 'already' ELSE 'changed' END AS action FROM pap LEFT JOIN dec USING (paper_id)",
    "corpus_drop_plan": f"WITH {PAIRS} SELECT paper_id, verdict, CASE WHEN remove IS NOT NULL THEN 'duplicate' ELSE 'no_pdf' END AS reason FROM pap LEFT JOIN pairs ON remove = paper_id WHERE verdict <> 'DROPPED' AND (remove IS NOT NULL OR status = 'PDF_MISSING')",
    "source_summary_rollup": f"""WITH {LABELS}, {PAPERS}, x AS (SELECT source, stratum FROM pap LEFT JOIN labs USING (paper_id))
        SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, count(stratum) AS labelled, count(*) FILTER (stratum = 'excluded') AS excluded, count(*) FILTER (stratum = 'survivor') AS kept FROM x GROUP BY ROLLUP (source)""",
    "tree_subtree_paths": """SELECT 'root' AS node, 'root' AS path, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, 'root/r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 'root/r' || n_regionkey || '/n' || n_nationkey, 2 FROM nation""",
    "text_normalize_doi": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, '10.1000/' || md5(text) AS doi, CASE doc_id % 4 WHEN 1 THEN 'doi: ' ELSE '' END || '10.1000/' || md5(text) || '.,' AS label_doi FROM documents",
    "text_other_dois": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, '10.2000/a' || doc_id % 5 || ' 10.2000/b' AS others FROM documents",
    "text_correction_title": f"SELECT CAST(doc_id AS VARCHAR) AS paper_id, regexp_matches((['Correction: ', 'ERRATUM to ', 'The correction of ', '[Retracted] ', 'Publisher Corrigendum to a: ', '(withdrawn)', ''])[doc_id % 7 + 1] || left(text, 60), '{NOTICE}') AS is_correction FROM documents",
    "text_admin_head": """SELECT doc_id, regexp_matches(lower(regexp_replace(left(CASE WHEN doc_id % 5 = 0 THEN (['Summary' || chr(10) || ' Statement' || chr(10), 'Principal Investigator: ', 'PRIVILEGED  Communication '])[doc_id % 3 + 1] ELSE '' END || text, 1500), '\\s+', ' ', 'g')), 'privileged\\s+communication|\\bsummary\\s+statement\\b|resume\\s+and\\s+summar\\w*\\s+of\\s+discussion') AS is_administrative FROM documents""",
    "text_integrity_flags": FLAGS,
    "text_chars_per_page_median": "SELECT count(*) AS n, median(length(text) / ceil(length(text) / 3000::DOUBLE)) AS median FROM documents WHERE length(text) > 0",
    "text_clean": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 41 = 1 THEN '' ELSE text END AS text, doc_id % 4 <> 0 AND doc_id % 41 = 1 OR trim(text, ' ' || chr(10)) = '' AS empty FROM documents)
        SELECT doc_id, md5(text) AS text_md5, length(text) > 550000 AS refused, concat_ws(';', CASE WHEN doc_id % 3 = 0 THEN 'bom_stripped' END, CASE WHEN doc_id % 4 = 0 AND contains(text, chr(10)) THEN 'crlf_normalized' END, CASE WHEN empty THEN 'empty' END,
        CASE WHEN doc_id % 5 = 0 AND doc_id > 0 THEN 'refs_removed=' || doc_id WHEN doc_id % 7 = 0 THEN 'refs_kept:no_heading' END, CASE WHEN doc_id % 11 = 0 THEN 'refs_unprepared' END) AS notes FROM t""",
    "text_reference_strip": f"WITH {STRIP} SELECT doc_id, reason = '' AS stripped, reason, heading, heading_line, md5(kept) AS text_md5, source_chars, length(kept) AS result_chars, source_chars - length(kept) AS removed_chars, CASE reason WHEN '' THEN length(rest) ELSE 0 END AS tail_chars FROM done",
    "text_other_paper_flags": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('As Smith et al. (2001), Jones 1999 and Smith et al. (2001) say, Lee & Roe, 2020 and The 2019 cohort, not by ' || text || ' (' || (1900 + doc_id % 120) || ')', '{OTHER}'), lambda x: trim(x)))), '|') AS others FROM documents""",
    "text_rule_citations": "SELECT doc_id, 'E' || doc_id % 30 || ',P2,E1,E1,D7' AS cited, CASE doc_id % 30 WHEN 1 THEN 'E1' ELSE 'E' || doc_id % 30 || ',E1' END AS task_rules FROM documents",
}

TWICE = "tw AS (SELECT doc_id, doc_id % 10 AS k, task, prefix FROM documents, (VALUES ('exclusion', 'E'), ('power_analysis', 'P')) t(task, prefix))"
PARSED = f"""{TWICE}, par AS (SELECT *, CAST(doc_id AS VARCHAR) AS paper_id, k = 1 AS fenced, CASE k WHEN 2 THEN NULL WHEN 3 THEN 'perhaps' WHEN 7 THEN 'wrong_text' ELSE 'yes' END AS decision,
    CASE WHEN k = 2 THEN 'not_json' WHEN k = 6 THEN 'unknown_key' WHEN k = 3 THEN 'decision' WHEN k = 5 THEN 'reasoning' WHEN k = 8 THEN 'evidence' WHEN k = 4 THEN 'confidence' WHEN k = 7 AND task <> 'exclusion' THEN 'wrong_text_outside_exclusion' END AS failure,
    CASE WHEN k = 7 AND doc_id % 4 = 3 OR doc_id % 8 = 7 THEN '' ELSE CASE WHEN doc_id % 6 = 5 THEN 'D' ELSE prefix END || doc_id % 4 END AS cited FROM tw)"""
STREAMS = "str AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, conv_id, conv_id % 13 <> 0 AS ended, max(turn) AS top, sum(length(coalesce(text, ''))) AS chars, count(*) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id)"
USED = """firsts AS (SELECT conv_id, min_by(length(text), turn) FILTER (turn % 2 = 1) AS first_used, min(turn) AS first_said FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
used AS (SELECT str.*, first_said, ended AND str.conv_id % 4 <> 0 AS own, (CASE WHEN ended AND str.conv_id % 4 <> 0 THEN chars ELSE first_used END)::BIGINT AS input_tokens, CASE WHEN ended AND str.conv_id % 4 <> 0 AND str.conv_id % 2 = 0 THEN 5 END::BIGINT AS cached FROM str LEFT JOIN firsts ON firsts.conv_id = str.conv_id)"""
AGENCY = "ag AS (SELECT doc_id, doc_id % 2 = 0 AS agency, quality = 1 AS correct, toxic = 1 AS ignored, doc_id % 3 AS stratum, n_chars FROM labels JOIN documents USING (doc_id))"
CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"

ORACLE |= {
    "reply_parse": f"WITH {PARSED} SELECT paper_id, task, fenced, decision, failure FROM par",
    "reply_validate": f"WITH {PARSED} SELECT task, coalesce(failure, 'none') AS failure, count(*) AS n, count(*) FILTER (fenced) AS fenced_n, coalesce(string_agg(DISTINCT decision, ';' ORDER BY decision), '') AS decisions FROM par GROUP BY ALL",
    "reply_semantic": f"""WITH {PARSED} SELECT paper_id, task, decision, cited, CASE WHEN doc_id % 9 = 0 THEN 'E10' WHEN decision = 'wrong_text' THEN CASE WHEN doc_id % 4 <> 3 THEN 'E6' END WHEN cited = '' THEN 'E6' WHEN doc_id % 6 = 5 THEN 'E4' WHEN doc_id % 4 = 3 THEN 'E3/E5' END AS semantic_failure FROM par WHERE failure IS NULL""",
    "reply_text": "SELECT CAST(conv_id AS VARCHAR) AS stream_id, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), CASE WHEN conv_id % 13 <> 0 THEN 'done' END)) AS text_md5 FROM conversations GROUP BY conv_id",
    "reply_provenance": f"""WITH {STREAMS}, {USED}
        SELECT stream_id, CASE WHEN ended THEN 's' || stream_id END AS session_id, CASE WHEN ended THEN chars * 2 END::BIGINT AS duration_ms, NULL::BIGINT AS duration_api_ms, NULL::BIGINT AS ttft_ms, CASE WHEN ended THEN top END::BIGINT AS num_turns, CASE WHEN ended THEN CASE WHEN conv_id % 31 = 0 THEN 'max_tokens' ELSE 'end_turn' END END AS stop_reason,
            NULL::VARCHAR AS terminal_reason, CASE WHEN ended THEN chars / 64.0::DOUBLE END AS total_cost_usd, CASE WHEN own THEN 'standard' END AS service_tier, NULL::VARCHAR AS inference_geo, NULL::BIGINT AS context_window, NULL::BIGINT AS max_output_tokens, NULL::VARCHAR AS fast_mode_state,
            input_tokens, CASE WHEN own THEN 7 END::BIGINT AS output_tokens, cached AS cache_read_input_tokens, NULL::BIGINT AS cache_creation_input_tokens, CASE WHEN own THEN CASE WHEN conv_id % 37 = 0 THEN 'fast' ELSE 'standard' END END AS speed,
            CASE WHEN conv_id % 17 <> 0 THEN '2.' || conv_id % 2 END AS cli_version, CASE WHEN conv_id % 19 <> 0 THEN CASE WHEN conv_id % 23 = 0 THEN 'm-2' ELSE 'm-1' END END AS reported_model, input_tokens + coalesce(cached, 0) AS billed_input_tokens,
            CASE WHEN conv_id % 11 <> 0 THEN 'req-' || conv_id || '-' || first_said END AS request_id, CASE WHEN ended THEN CASE WHEN conv_id % 29 = 0 THEN 1 ELSE 0 END END::INTEGER AS permission_denials FROM used""",
    "reply_tokens": f"WITH {STREAMS}, {USED} SELECT stream_id, (input_tokens + coalesce(cached, 0))::BIGINT AS billed_input, CASE WHEN own THEN 7 END::BIGINT AS output_tokens FROM used",
    "reply_tools": f"WITH {STREAMS} SELECT stream_id, CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END::INTEGER AS n_tools FROM str",
    "reply_tool_use": "SELECT conv_id, turn, conv_id % 3 = 0 AS uses_tool FROM conversations",
    "constant_confidence": f"WITH {JUDGMENTS} SELECT task, promptbook_version, count(confidence) AS n, count(DISTINCT confidence) AS distinct_n, count(confidence) >= 10 AND count(DISTINCT confidence) = 1 AS constant FROM jud GROUP BY ALL",
    "stats_two_by_two": f"WITH {AGENCY} SELECT agency AS row_value, correct AS column_value, count(*) AS n FROM ag GROUP BY ALL",
    "stats_characteristics": f"WITH {AGENCY} SELECT agency, correct, count(n_chars) AS n, median(n_chars)::DOUBLE AS median, min(n_chars) AS lowest, max(n_chars) AS highest FROM ag GROUP BY ALL",
    "stats_flow_categories": """WITH h AS (SELECT regexp_matches(lower(text), 'licen[cs]e') AS l, contains(text, '@') AS a, contains(text, ' | ') AS t, regexp_matches(text, '[%&$]{2}') AS s FROM documents),
        g AS (SELECT count(*) AS total, unnest([{'category': 'licence', 'n': count(*) FILTER (l)}, {'category': 'address', 'n': count(*) FILTER (a)}, {'category': 'table', 'n': count(*) FILTER (t)}, {'category': 'symbol', 'n': count(*) FILTER (s)}]) AS c, count(*) FILTER (l) + count(*) FILTER (a) + count(*) FILTER (t) + count(*) FILTER (s) AS covered FROM h)
        SELECT c.category AS category, c.n AS n, round(100.0::DOUBLE * c.n / total, 1) AS percent, covered = total AS adds_up FROM g""",
    "stats_fisher_exact": f"""WITH {AGENCY}, t AS (SELECT stratum, count(*) FILTER (agency AND correct) AS a, count(*) FILTER (agency) AS r1, count(*) FILTER (NOT agency) AS r2, count(*) FILTER (correct) AS c1, count(*) AS n FROM ag GROUP BY stratum),
        k AS (SELECT *, unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS k FROM t),
        p AS (SELECT stratum, exp({CHOOSE.format('r1', 'k')} + {CHOOSE.format('r2', '(c1 - k)')} - {CHOOSE.format('n', 'c1')}) AS p, exp({CHOOSE.format('r1', 'a')} + {CHOOSE.format('r2', '(c1 - a)')} - {CHOOSE.format('n', 'c1')}) AS seen FROM k)
        SELECT stratum, round(least(1, sum(p) FILTER (p <= seen * (1 + 1e-7))), 8) AS p_value FROM p GROUP BY stratum""",
    "stats_cmh": f"""WITH {AGENCY}, t AS (SELECT stratum, count(*) FILTER (agency AND ignored)::DOUBLE AS a, count(*) FILTER (agency AND NOT ignored)::DOUBLE AS b, count(*) FILTER (NOT agency AND ignored)::DOUBLE AS c, count(*) FILTER (NOT agency AND NOT ignored)::DOUBLE AS d, count(*)::DOUBLE AS n FROM ag GROUP BY stratum)
        SELECT count(*) AS strata, round(sum(a - (a + b) * (a + c) / n) ** 2 / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 8) AS statistic, round(sum(a * d / n) / sum(b * c / n), 8) AS odds_ratio FROM t""",
    "canary_verdict": f"""WITH {case_ctes('exclusion')}, x AS (SELECT truth, decision, CASE WHEN paper_id::BIGINT % 2 = 0 THEN 'yes' ELSE 'no' END AS decoy FROM cases WHERE judged AND truth IS NOT NULL),
        r AS (SELECT count(*) AS n, count(*) FILTER (decision = truth) / count(*)::DOUBLE AS truth_rate, count(*) FILTER (decision = decoy) / count(*)::DOUBLE AS decoy_rate FROM x WHERE truth <> decoy)
        SELECT *, decoy_rate > truth_rate AS suspicious, decoy_rate >= truth_rate + 0.15 AS leaked FROM r""",
}

ORACLE |= {
    "manifest_extractable": f"WITH {PAPERS} SELECT paper_id, verdict, status FROM pap WHERE verdict IN ('VERIFIED', 'WEAK')",
    "manifest_extraction_flags": """SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 31 = 0 THEN 'FAILED' WHEN regexp_matches(left(text, 60), 'NOTICE_PATTERN') THEN 'CORRECTION'
        WHEN doc_id % 19 = 0 OR n_chars < 3000 THEN 'THIN' ELSE 'OK' END AS flag, CASE WHEN doc_id % 40 > 0 THEN n_chars / (doc_id % 40)::DOUBLE < 200 ELSE true END AS sparse FROM documents""".replace("NOTICE_PATTERN", NOTICE),
    "manifest_outstanding": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, md5(text) AS md5 FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "manifest_coverage": "SELECT count(*) AS n, count(*) FILTER (doc_id % 4 <> 0) / count(*)::DOUBLE AS doi_share, 1.0::DOUBLE AS pmid_share, 1.0::DOUBLE AS md5_share FROM documents",
    "manifest_histogram": f"WITH {SOURCES}, v AS (SELECT 'exclusion_reason' AS field, exclusion_reason AS value FROM src UNION ALL SELECT 'power', power FROM src UNION ALL SELECT 'stats', stats FROM src UNION ALL SELECT 'source', source FROM src) SELECT field, CASE value WHEN '' THEN '(blank)' ELSE value END AS value, count(*) AS n FROM v GROUP BY ALL",
    "label_counts": f"WITH {LABELS} SELECT count(*) AS n, count(exclusion_reason) AS excluded, count(power) AS with_power, count(stats) AS with_stats, count(*) FILTER (split = 'build') AS build, count(*) FILTER (split = 'holdout') AS holdout FROM labs",
    "label_descriptions": f"WITH {LABELS} SELECT paper_id, CASE WHEN exclusion_reason IS NOT NULL THEN 'excluded (' || exclusion_reason || ')' ELSE 'kept, power=' || coalesce(power, '?') || ' data=' || coalesce(stats, '?') || CASE WHEN doc_id % 4 = 0 THEN ' category=B' ELSE '' END END AS description FROM labs",
    "token_display": "SELECT doc_id, CASE WHEN n_chars * 97 >= 1000000 THEN printf('%.1fM', n_chars * 97 / 1e6) WHEN n_chars * 97 >= 1000 THEN (n_chars * 97 // 1000) || 'k' ELSE CAST(n_chars * 97 AS VARCHAR) END AS shown FROM documents",
    "run_fingerprints": """SELECT task, v AS promptbook_version, sha256('{"effort":"' || CASE v WHEN 'v1' THEN 'medium' ELSE 'high' END || '","promptbook_version":"' || v || '","task":"' || task || '"}') AS fingerprint, 'run-' || task || '-r1-' || left(sha256(v), 20) AS id
        FROM (VALUES ('exclusion'), ('power_analysis'), ('data_analysis')) t(task), (VALUES ('v1'), ('v2')) x(v)""",
    "run_snapshots": f"WITH {JUDGMENTS} SELECT task, count(*) AS n, 64 AS hash_chars FROM jud WHERE promptbook_version = 'v2' GROUP BY task",
    "run_registration": """SELECT 'run-' || task || '-' || v AS run_id, CASE task WHEN 'data_analysis' THEN 'new' WHEN 'exclusion' THEN 'conflict' ELSE 'same' END AS state, CASE task WHEN 'exclusion' THEN 'effort' ELSE '' END AS fields
        FROM (VALUES ('exclusion'), ('power_analysis'), ('data_analysis')) t(task), (VALUES ('v1'), ('v2')) x(v)""",
    "round_preparation": "WITH m AS (SELECT source, CASE WHEN doc_id % 40 = 0 THEN 'unprepared' ELSE 'strip-1' END AS m FROM documents) SELECT source, count(DISTINCT m) AS methods, string_agg(DISTINCT m, ';' ORDER BY m) AS names, count(DISTINCT m) > 1 AS refused FROM m GROUP BY source",
    "reply_leaked_ids": "SELECT 'id' || doc_id AS paper_id, 1::BIGINT AS n_leaked, 'id' || (doc_id + 1) AS first_leaked FROM documents WHERE doc_id % 3 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)",
    "citation_parse": """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS number, CASE WHEN doc_id % 7 <> 0 THEN CAST(1900 + doc_id % 120 AS VARCHAR) ELSE '' END AS year, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'b' ELSE '' END AS suffix, CASE WHEN doc_id % 7 <> 0 THEN 'Hershman|Bansal|Roe-Smith' ELSE '' END AS names FROM documents""",
    "citation_keys": """SELECT doc_id, (['smith', 'abrahamsgessel', ''])[doc_id % 3 + 1] AS surname, CASE doc_id % 2 WHEN 0 THEN 'effect of dna light' ELSE 'study' END || CASE WHEN doc_id % 35 = 0 THEN 'a' ELSE '' END AS words, CASE WHEN doc_id % 5 <> 0 THEN CAST(1900 + doc_id % 120 AS VARCHAR) ELSE '' END AS year FROM documents""",
    "latex_cells": "SELECT doc_id, 'Hernández et al. & Café — ' || doc_id || '% of ~5 ü & môre' AS text FROM documents",
    "reading_conditions": f"WITH {JUDGMENTS} SELECT task, CASE promptbook_version WHEN 'v1' THEN 'whole' ELSE 'stripped' END AS condition, count(*) AS n FROM jud GROUP BY ALL",
}

from .review_oracle import MORE  # noqa: E402

ORACLE |= MORE
