"""Text functions as column expressions: identifiers, tokens, trigrams, fuzzy ratios, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries leave out.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "find", "for", "from", "get", "how", "in", "is", "it", "of", "on", "or", "show", "that", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with"]


def normalize_identifier(name: Column) -> Column:
    """Words of an identifier: camel case, acronyms and digits split, everything else a blank, lower case."""
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, r"([0-9])([A-Za-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(s, r"[^A-Za-z0-9]+", " ")))


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())) if len(t) > 1 and t not in STOPWORDS]


def grams(text: Column, n: int = 3) -> Column:
    """All runs of n characters, in order; a shorter text is one run."""
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with a window of the longer one of its length."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    windows = F.transform(F.sequence(F.lit(1), F.length(long) - n + 1), lambda i: ratio(short, F.substring(long, i, n)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.array_max(windows))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(text), r"\s+")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the larger distinct set."""
    x, y = F.array_distinct(F.split(F.trim(a), r"\s+")), F.array_distinct(F.split(F.trim(b), r"\s+"))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def acronym(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.substring(w, 1, 1)), "")


def normalize_label(label: Column) -> Column:
    """Lower case, words joined by one underscore, without a version or number at the end."""
    s = F.regexp_replace(F.lower(F.trim(label)), r"[\s_.\-/]+", "_")
    s = F.regexp_replace(s, r"_?v?[0-9]+(_[0-9]+)*$", "")
    return F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_|_$", "")


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) == 0, 0.0).otherwise(-F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p)))


def passes_entropy(label: Column, threshold: float = 0.5) -> Column:
    """Labels under 3 characters pass; up to 5 they need more than 3 distinct ones; the rest go by entropy."""
    distinct = F.size(F.array_distinct(F.split(label, "")))
    return F.when(F.length(label) < 3, True).when((F.length(label) <= 5) & (distinct <= 3), False).otherwise(entropy(label) >= threshold)


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), (F.length(text) / 4).cast("long"))


# Intents and their keywords, in the order they are tried.
INTENTS = {
    "debug": ["error", "bug", "fail", "crash", "exception"],
    "test": ["test", "coverage", "assert"],
    "refactor": ["refactor", "rename", "cleanup", "extract"],
    "review": ["review", "change", "diff", "impact"],
    "architecture": ["architecture", "module", "design", "structure"],
}


def intent(query: Column) -> Column:
    """First rule whose keyword the query holds."""
    q = F.lower(query)
    out = F.lit("implementation")
    for name, keys in reversed(INTENTS.items()):
        out = F.when(q.rlike("|".join(keys)), name).otherwise(out)
    return out


def intent_of(query: str) -> str:
    low = query.lower()
    return next((name for name, keys in INTENTS.items() if any(k in low for k in keys)), "implementation")
