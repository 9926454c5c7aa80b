"""Citations and marked-up text of label tables: keys, author lists, LaTeX."""

from __future__ import annotations

import re
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import strip

# Accent commands of LaTeX and the combining marks that they stand for; letters that have a composed form with each.
_ACCENTS = (("\\'", "\u0301"), ("\\`", "\u0300"), ("\\^", "\u0302"), ('\\"', "\u0308"), ("\\~", "\u0303"))


def strip_latex(c: Column) -> Column:
    """Plain text of a table row or cell: citations and row ends gone, marked text bare, accents composed, braces as blanks."""
    out = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(out, r"\\textsuperscript\{\\cite\{[^}]+\}\}", "")
    out = F.regexp_replace(out, r"\\cite\{[^}]+\}", "")
    out = F.regexp_replace(strip(out), r"\\\\+\s*$", "")
    out = F.regexp_replace(out, r"\\text(?:it|bf)\{([^}]+)\}", "$1")
    out = F.regexp_replace(out, r"\\emph\{([^}]+)\}", "$1")
    for a, b in ((r"$\sim$", "~"), (r"\%", "%"), (r"\&", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for command, mark in _ACCENTS:
        out = F.regexp_replace(out, re.escape(command) + r"\{?([A-Za-z])\}?", "$1" + mark)
        for letter in string.ascii_letters:
            composed = unicodedata.normalize("NFC", letter + mark)
            if len(composed) == 1:
                out = F.replace(out, F.lit(letter + mark), F.lit(composed))
    out = F.regexp_replace(F.replace(out, F.lit("---"), F.lit("\u2014")), r"[{}]", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def cite_key(c: Column) -> Column:
    """struct(surname, words, year) of a key like abrahams-gesselPointOfCare2001a: the leading lower-case run with its hyphens, then words, then a year."""
    key = F.coalesce(c, F.lit(""))
    year = F.regexp_extract(key, r"^.*?(\d{4})[a-z]?$", 1)
    body = F.when(year != "", F.regexp_extract(key, r"^(.*?)\d{4}[a-z]?$", 1)).otherwise(key)
    lead = F.regexp_extract(body, r"^[a-z]+(?:-[a-z]+)*", 0)
    words = F.regexp_extract_all(F.substring(body, F.length(lead) + 1, F.length(body)), F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0))
    return F.struct(F.replace(lead, F.lit("-"), F.lit("")).alias("surname"), F.lower(F.array_join(words, " ")).alias("words"), year.alias("year"))


CITATION = r"^\s*(?:(\d+)\.)?\s*\((.+?),\s*(\d{4})([a-z]?)\)\s*$"


def citation(c: Column) -> Column:
    """struct(number, names, year, suffix) of a citation like ``83. (Hershman, Bansal, et al., 2023a)``; blanks if it isn't one."""
    return F.struct(*(F.regexp_extract(c, CITATION, i).alias(n) for i, n in ((1, "number"), (2, "names"), (3, "year"), (4, "suffix"))))


def cited_names(names: Column) -> Column:
    """The names of a citation in order, without et al."""
    parts = F.transform(F.split(F.regexp_replace(names, r"\bet\s+al\.?", ""), "[,&]"), strip)
    return F.filter(parts, lambda x: x != "")


def reading_condition(version: Column) -> Column:
    """The first promptbook read whole texts, later ones stripped texts."""
    return F.when(version == "v1", "whole").otherwise("stripped")
