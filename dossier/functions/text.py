"""Text operators as columns: identifiers, notices, bibliographies, integrity flags, rule citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import SPACES, ladder, strip

# Patterns and limits.
DOI = r"10\.[0-9]{4,9}/[^\s\"'<>]+"
RULE = r"\b([EPD])([0-9]{1,2})\b"
# A notice names itself at the start of its title, before a colon or a closing bracket.
NOTICE = r"erratum|errata|corrigend(?:um|a)|correction|retract(?:ion|ed)?|withdrawn|addendum|expression\s+of\s+concern"
CORRECTION = rf"(?i)^\s*[\[(]?\s*(?:author|publisher|editorial)?\s*(?:{NOTICE})\b[^:]{{0,12}}[:\])]"
ADMIN = (r"privileged\s+communication", r"\bsummary\s+statement\b", r"resume\s+and\s+summar\w*\s+of\s+discussion")
ADMIN_CHARS = 1500
REFERENCES = r"(?i)^[\s\d.)*•#]*(?:references?|reference list|bibliography|works cited|literature cited)\s*[:.]?\s*$"
AFTER = r"(?i)^[\s\d.)*•#]*(?:appendix|appendices|supplement(?:ary|al)?|additional file|supporting information|online supplement|web appendix|e-?appendix|annex)\b"
LEAST_BODY, MOST_CUT, MOST_CHARS = 0.30, 0.60, 550_000
MARKER = "[REFERENCES SECTION REMOVED]"
STRIP_METHOD = "reference_heading_v1"
REASONS = {"no_heading": "no standalone references heading found", "heading_too_early": "references heading sits too early to be the bibliography", "cut_too_large": "cut would remove more than the safety fraction", "empty": "no text to strip"}
# Author and year of another paper: with et al., and or & between, or the year in brackets.
OTHER_PAPER = r"\b[A-Z][a-z]{2,}\s+(?:et\s+al\.?|and\s+[A-Z][a-z]{2,}|&\s+[A-Z][a-z]{2,})[\s,]*\(?(?:19|20)\d{2}\)?|\b[A-Z][a-z]{2,}\s+\((?:19|20)\d{2}\)"


def normalize_doi(c: Column) -> Column:
    """The DOI inside a text: first match, without closing punctuation, in lower case; blank without one."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"10\.[0-9]{4,9}/\S+", 0), r"[.,;]+$", ""))


def label_doi(c: Column) -> Column:
    """The labels' own rule: lower case without the resolver's address, nothing else."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")


def other_dois(expected: Column, c: Column) -> Column:
    """Distinct DOIs in a text other than its own, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(DOI), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"[.,;)]+$", "")))
    return F.array_distinct(F.filter(found, lambda x: x != F.lower(expected)))


def is_correction(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(CORRECTION)


def is_administrative(text: Column) -> Column:
    """Does a document open like grant paperwork?"""
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, ADMIN_CHARS), r"(?U)\s+", " "))
    return head.rlike("|".join(ADMIN))


def strip_references(c: Column) -> Column:
    """What a bibliography's removal leaves, as a record: stripped, reason, heading, heading_line, text, source_chars, result_chars, removed_chars, tail_chars.

    The last line that is a heading and nothing else begins the bibliography; what stands behind an appendix heading stays.
    Guards: no text; no heading; the body before it under 0.30 of the text; more than 0.60 cut.
    """
    text = F.coalesce(c, F.lit(""))
    lines = F.split(text, "\n", -1)
    n, size = F.size(lines), F.length(text)
    flags = F.transform(lines, lambda x: strip(x).rlike(REFERENCES))
    at = F.when(F.array_contains(flags, True), n - F.array_position(F.reverse(flags), True).cast("int"))  # lines before the last heading
    body = F.array_join(F.slice(lines, F.lit(1), at), "\n")
    tail = F.slice(lines, at + 1, n)
    after = F.array_position(F.transform(tail, lambda x: strip(x).rlike(AFTER)), True).cast("int")
    rest = F.when(after > 1, F.array_join(F.slice(tail, after, n), "\n")).otherwise("")
    cut = F.concat(F.regexp_replace(body, r"(?U)\s+\z", ""), F.lit("\n\n" + MARKER), F.when(rest != "", F.concat(F.lit("\n\n"), F.regexp_replace(rest, r"^\n+", ""))).otherwise(""), F.lit("\n"))
    reason = ladder([(strip(text) == "", "empty"), (at.isNull(), "no_heading"), (F.length(body) < LEAST_BODY * size, "heading_too_early"), (size - F.length(cut) > MOST_CUT * size, "cut_too_large")], "")
    done = reason == ""
    kept = F.when(done, cut).otherwise(text)
    found = reason.isin("empty", "no_heading")
    return F.struct(
        done.alias("stripped"), reason.alias("reason"), F.when(found, "").otherwise(strip(F.get(lines, at))).alias("heading"), F.when(found, -1).otherwise(at).alias("heading_line"), kept.alias("text"),
        size.alias("source_chars"), F.length(kept).alias("result_chars"), (size - F.length(kept)).alias("removed_chars"), F.when(done, F.length(rest)).otherwise(0).alias("tail_chars"),
    )


def strip_record(c: Column) -> Column:
    """The audit record that a stripped text carries: how it was made and from which text."""
    s = strip_references(c)
    return F.struct(
        F.lit(STRIP_METHOD).alias("method"), s["stripped"].alias("stripped"), s["reason"].alias("reason"), s["heading_line"].alias("heading_line"), s["source_chars"].alias("source_chars"), s["result_chars"].alias("result_chars"),
        s["removed_chars"].alias("removed_chars"), s["tail_chars"].alias("tail_chars"), F.sha2(F.coalesce(c, F.lit("")), 256).alias("source_text_sha256"),
    )


def is_current(record: Column, source: Column) -> Column:
    """Was the record made from this text by these rules?"""
    return F.coalesce((record["source_text_sha256"] == F.sha2(F.coalesce(source, F.lit("")), 256)) & (record["method"] == STRIP_METHOD), F.lit(False))


def explain(reason: Column) -> Column:
    """The sentence for a reason's code, or the code itself."""
    return ladder([(reason == k, v) for k, v in REASONS.items()], reason)


def clean_text(c: Column) -> Column:
    """struct(text, had_bom, had_crlf, replaced, is_empty, refused): a text made safe to send.

    No byte order mark in front, bad bytes as U+FFFD and counted (of a binary column; a string column holds none), line ends as newline;
    white space only is empty, more than 550,000 characters are refused and never cut.
    """
    raw = F.coalesce(c, F.lit(""))
    bom = raw.startswith("\ufeff")
    a = F.when(bom, F.substring(raw, 2, 1 << 30)).otherwise(raw)
    crlf = a.contains("\r")
    b = F.regexp_replace(a, "\r\n?", "\n")
    empty = strip(b) == ""
    return F.struct(F.when(empty, "").otherwise(b).alias("text"), bom.alias("had_bom"), crlf.alias("had_crlf"), F.lit(0).alias("replaced"), empty.alias("is_empty"), (~empty & (F.length(b) > MOST_CHARS)).alias("refused"))


def clean_bytes(c: Column) -> Column:
    """clean_text of UTF-8 bytes: what isn't valid becomes U+FFFD, and ``replaced`` counts how many the bytes themselves didn't hold."""
    valid = F.make_valid_utf8(c.cast("string"))
    own = F.size(F.split(F.hex(c), "EFBFBD", -1)) - 1
    made = F.length(valid) - F.length(F.replace(valid, F.lit("\ufffd"), F.lit("")))
    s = clean_text(valid)
    return F.struct(s["text"].alias("text"), s["had_bom"].alias("had_bom"), s["had_crlf"].alias("had_crlf"), F.greatest(made - own, F.lit(0)).alias("replaced"), s["is_empty"].alias("is_empty"), s["refused"].alias("refused"))


def text_notes(cleaned: Column, refs_removed: Column, refs_reason: Column, refs_method: Column) -> Column:
    """One field for the run log; blank if the text arrived clean."""
    return F.concat_ws(
        ";", F.when(cleaned["had_bom"], "bom_stripped"), F.when(cleaned["had_crlf"], "crlf_normalized"), F.when(cleaned["replaced"] > 0, F.concat(F.lit("replaced_chars="), cleaned["replaced"].cast("string"))), F.when(cleaned["is_empty"], "empty"),
        F.when(refs_removed > 0, F.concat(F.lit("refs_removed="), refs_removed.cast("string"))).when(refs_reason != "", F.concat(F.lit("refs_kept:"), refs_reason)), F.when(refs_method == "", "refs_unprepared"),
    )


# Fixed values of the integrity scan: its patterns (only a newline ends a line, Unicode blanks and words) and flags.
SECOND_ARTICLE = r"(?imsdU)^\s*(?:references|bibliography|literature cited)\b.*?^\s*abstract\b"
REFERENCES_HEAD = r"(?imdU)^\s*(?:references|bibliography|literature cited)\b"
ABSTRACT_HEAD = r"(?imdU)^\s*abstract\b"
ANY_REFERENCE = r"(?iU)\breferences\b|\bbibliography\b|doi:\s*10\."
FORM = r"(?iU)CONSORT-EHEALTH|Submission\s*/?\s*Publication Form|\bSubmission Form\b|\bPublication Form\b"
FORM_CHARS = 600
MOJIBAKE = "\ufffd|Ã¢â‚¬|Ã©|Ã¨|â€œ|â€\x9d|Ã\xad"


def integrity_scan(text: Column, pages: Column, abstract: Column, median: Column) -> Column:
    """The eight flags that make a text suspicious, in order; the text has no blanks at either end.

    The text and its lines are bound once, as each flag reads them.
    """

    def flags(t: Column, long: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / F.nullif(F.length(F.translate(t, SPACES, "")).cast("double"), F.lit(0.0))
        repeated = (F.size(long) - F.size(F.array_distinct(long))) / F.nullif(F.size(long).cast("double"), F.lit(0.0))
        second = t.rlike(REFERENCES_HEAD) & t.rlike(ABSTRACT_HEAD) & t.rlike(SECOND_ARTICLE)
        return F.array(
            F.when(t.rlike(MOJIBAKE), "F1_MOJIBAKE"), F.when(second, "F2_MULTI_ARTICLE"), F.when((t != "") & ~t.rlike(ANY_REFERENCE), "F3_NO_REFERENCES"),
            F.when((pages > 0) & (median > 0) & (F.length(t) / pages < 0.4 * median), "F4_THIN_PER_PAGE"), F.when((F.length(abstract) > 0) & (F.length(t) < 3 * F.length(abstract)), "F5_SHORT_VS_ABSTRACT"),
            F.when(letters < 0.6, "F6_LOW_ALPHA"), F.when((F.size(long) > 50) & (repeated > 0.3), "F7_REPETITIVE"), F.when(F.substring(t, 1, FORM_CHARS).rlike(FORM), "F8_SUBMISSION_FORM"),
        )

    whole = F.array(F.struct(strip(F.coalesce(text, F.lit(""))).alias("t")))
    lines = lambda t: F.filter(F.transform(F.split(t, "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1), strip), lambda x: F.length(x) > 15)
    both = F.transform(whole, lambda x: F.struct(x["t"].alias("t"), lines(x["t"]).alias("long")))
    found = F.transform(both, lambda x: flags(x["t"], x["long"]))[0]
    return F.filter(found, lambda x: x.isNotNull())


def rule_citations(c: Column, prefix: str | None = None) -> Column:
    """Rule ids in order, repeated ones too; with a prefix only that task's, distinct."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RULE), F.lit(0))
    return found if prefix is None else F.array_distinct(F.filter(found, lambda x: x.startswith(prefix)))


def other_papers(c: Column) -> Column:
    """Mentions of other papers by author and year, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(OTHER_PAPER), F.lit(0)), strip)))


# A claim that the other task's answer decided this one; naming the other analysis alone is fine.
_CONCLUDES = r"\b(?:{0}[_\s-]?analysis)\s+(?:decision|judg(?:e?ment)?|conclusion|answer|classification|result)\b|\b(?:according to|based on)\s+(?:the\s+)?{0}[_\s-]?analysis\b"


def leans_on_other_task(task: Column, said: Column) -> Column:
    """Does an answer to one of the two analyses refer to the other's conclusion?"""
    return ladder([(task == "power_analysis", said.rlike("(?i)" + _CONCLUDES.format("data"))), (task == "data_analysis", said.rlike("(?i)" + _CONCLUDES.format("power")))], False)


# Identifiers of a library record: dedicated field first, then free text, sources in order, patterns in order within each.
PMID = (r"(?i)PMID\s*[:=]?\s*(\d{1,8})\b", r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{1,8})", r"(?i)/pubmed/(\d{1,8})")
PMCID = (r"(?i)PMCID\s*[:=]?\s*(?:PMC)?(\d+)\b", r"(?i)\bPMC(\d+)\b", r"(?i)/pmc/articles/PMC(\d+)")
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"


def first_match(patterns: Sequence[str], *sources: Column) -> Column:
    """The first group of the first pattern that matches, sources outermost; blank without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(s, F.lit("")), p, 1), F.lit("")) for s in sources for p in patterns), F.lit(""))


def field_value(*names: Column) -> Column:
    """The first value that isn't empty among a field's spellings, without blanks around it."""
    return strip(F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit("")))


def identifiers(pmid: Column, pmcid: Column, extra: Column, archive: Column, url: Column) -> Column:
    """struct(pmid, pmcid, doi) of a record; pmcid with its prefix, doi only from the free text."""
    own_pmid, own_pmcid = first_match([*PMID, r"^\s*(\d{1,8})\s*$"], pmid), first_match([*PMCID, r"^\s*(\d+)\s*$"], pmcid)
    p = F.coalesce(F.nullif(own_pmid, F.lit("")), first_match(PMID, extra, archive, url))
    c = F.coalesce(F.nullif(own_pmcid, F.lit("")), first_match(PMCID, extra, archive, url))
    return F.struct(p.alias("pmid"), F.when(c != "", F.concat(F.lit("PMC"), c)).otherwise("").alias("pmcid"), normalize_doi(F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?i)DOI\s*[:=]?\s*(\S+)", 1)).alias("doi"))
