"""Term and header-segment classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.text import any_part, any_word, col


def categorize(term: Column | str, soft: Sequence[str], with_synonyms: Sequence[str] | Column, tech: Sequence[str],
               qualification: Sequence[str], domain: Sequence[str], soft_words: Sequence[str]) -> Column:
    """soft-skill > domain-skill (has synonyms) > technology > qualification > domain > soft-skill > other.

    ``with_synonyms`` is a short list, or a BOOLEAN column set by a join.
    """
    t = T.normalize_keyword(term)
    if isinstance(with_synonyms, Column):
        known = with_synonyms
    else:
        known = t.isin(list(with_synonyms)) | F.regexp_replace(t, "s$", "").isin(list(with_synonyms))
    return (
        F.when(t == "", "other")
        .when(t.isin(list(soft)), "soft-skill")
        .when(known, "domain-skill")
        .when(any_word(t, tech), "technology")
        .when(any_word(t, qualification), "qualification")
        .when(any_part(t, domain), "domain")
        .when(any_word(t, soft_words), "soft-skill")
        .otherwise("other")
    )


def looks_like_role(c: Column | str, roles: Sequence[str]) -> Column:
    return any_word(c, roles)


def looks_like_company(c: Column | str, companies: Sequence[str]) -> Column:
    return any_word(c, companies)


def looks_like_location(c: Column | str, places: Sequence[str]) -> Column:
    """A known place, a work model, or ``City, ST`` with an upper-case code; at most 48 characters."""
    t = F.trim(col(c))
    return (t != "") & (F.length(t) <= 48) & (
        any_part(t, places) | t.rlike(r"(?i)remote|hybrid|on-?site") | t.rlike(r"^[^,]{2,28},\s*[A-Z]{2,3}$")
    )


def header_segments(c: Column | str) -> Column:
    """``Company | Role | City`` -> array of segments."""
    parts = F.split(col(c), r"\s*[|\x{2022}\x{00B7}]\s*|\s{3,}")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
