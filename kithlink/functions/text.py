"""Text normalisation as column functions; all stay inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithlink.functions.lookups import ADDRESS_ABBREVIATIONS, COUNTRY_ALIASES, LEGAL_SUFFIXES

#: Java's \w is ASCII only or keeps combining marks; letters, numbers and the low line are what is meant.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))


def tokens(c: Column) -> Column:
    """Lower case, & spelled out, punctuation to blanks, split."""
    words = F.regexp_replace(F.replace(F.lower(blank(c)), F.lit("&"), F.lit(" and ")), NOT_WORD, " ")
    return F.filter(F.split(F.trim(words), r"\s+"), lambda t: t != "")


def is_suffix(t: Column) -> Column:
    return t.isin(*LEGAL_SUFFIXES)


def core_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~is_suffix(t))


def last_suffix(toks: Column) -> Column:
    found = F.filter(toks, is_suffix)
    return F.when(F.size(found) > 0, F.try_element_at(_lookup(LEGAL_SUFFIXES), F.try_element_at(found, F.lit(-1)))).otherwise("")


def acronym(core: Column) -> Column:
    return F.when(F.size(core).between(2, 6), F.array_join(F.transform(core, lambda w: F.substring(w, 1, 1)), "")).otherwise("")


def expand_address(toks: Column) -> Column:
    table = _lookup(ADDRESS_ABBREVIATIONS)
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), t))


def pin(raw: Column) -> Column:
    return F.regexp_extract(blank(raw), r"\b(\d{5,6})\b", 1)


def street_number(addr: Column) -> Column:
    return F.regexp_extract(addr, r"^(\d+[a-z]?)\b", 1)


def landmark(addr: Column) -> Column:
    return F.regexp_extract(addr, r"near\s+(.+)$", 1)


def country(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.trim(blank(c))), NOT_WORD, ""))
    return F.coalesce(F.try_element_at(_lookup(COUNTRY_ALIASES), plain), plain)


def word_ngrams(text: Column, low: int, high: int) -> Column:
    """Character n-grams inside words padded by one blank on both sides; a word shorter than low counts whole."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        n = F.length(p)
        sized = F.transform(F.sequence(F.lit(low), F.least(F.lit(high), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(p, i, k)))
        return F.when(n < low, F.array(p)).otherwise(F.flatten(sized))

    return F.flatten(F.transform(words, grams))
