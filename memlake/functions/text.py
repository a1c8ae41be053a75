"""Text expressions: analysis, keywords, names, keys and small parsers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own short list of English function words; pass another where it matters.
STOP_WORDS = tuple(
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it "
    "its me my no not of on or our she should so than that the their them then there these they this to was we were "
    "what when where which who why will with would you your".split()
)


def _words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """The analyser: lower case, runs of letters and digits, without stop words."""
    parts = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.filter(parts, lambda w: ~w.isin(*stop)) if stop else parts


def matches_all(text: Column, query: str, stop: Sequence[str] = ()) -> Column:
    """Every query term occurs; a query without terms matches nothing."""
    terms = query_terms(query, stop)
    if not terms:
        return F.lit(False)
    return F.size(F.array_except(_words(terms), tokens(text, stop))) == 0


def query_terms(query: str, stop: Sequence[str] = ()) -> list[str]:
    """The analyser on the driver, for query texts."""
    import re

    return sorted({w for w in re.split("[^a-z0-9]+", query.lower()) if w and w not in stop})


def term_rank(text: Column, query: str, stop: Sequence[str] = ()) -> Column:
    """tf / (tf + 10) with tf the number of tokens that are query terms: rises with hits, below 1."""
    terms = query_terms(query, stop)
    hits = F.size(F.filter(tokens(text, stop), lambda w: w.isin(*terms))) if terms else F.lit(0)
    return hits / (hits + F.lit(10.0))


def keywords(text: Column, min_length: int = 3, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower case, without signs but hyphens, at least ``min_length`` long, no stop words, distinct."""
    plain = F.regexp_replace(F.lower(text), r"[^\w\s-]", "")
    parts = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= min_length))
    return F.array_distinct(F.array_except(parts, _words(stop)))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of more than two signs, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def claim_tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct content tokens of a claim: letters, digits, apostrophes and hyphens."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s'-]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are equal."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def token_count(text: Column) -> Column:
    """The default counter: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4.0)


def tag_label(tag: Column) -> Column:
    return F.regexp_replace(tag, "^tag:", "")


def tag_id(label: Column) -> Column:
    return F.concat(F.lit("tag:"), tag_label(label))


def topic_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def short_key(value: Column, length: int = 16) -> Column:
    """The first signs of a SHA-256."""
    return F.substring(F.sha2(value, 256), 1, length)


def stable_json(value: Column) -> Column:
    """JSON of a map with its keys in order."""
    entries = F.array_sort(F.map_entries(value))
    return F.to_json(F.map_from_entries(entries))


def timestamp_flag(value: Column) -> Column:
    """All digits are epoch milliseconds, else a date or timestamp; null if neither."""
    return F.coalesce(
        F.when(value.rlike("^[0-9]+$"), value.cast("bigint")), F.expr("unix_millis(try_to_timestamp({}))".format(_name(value)))
    )


def _name(value: Column) -> str:
    return value._jc.toString()


def json_block(text: Column) -> Column:
    """The JSON in a model's answer: a fenced block, else from the first bracket to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def temporal_signal(text: Column) -> Column:
    """Does a question speak of time: a year or one of a few words."""
    return F.lower(text).rlike(r"\b(19|20)\d\d\b|\b(when|before|after|during|since|until|year|month|week|ago|first|last)\b")


# The kinds of a source directory and the parts of names that tell them, the first that fits.
MODULE_KINDS = {"service": ("service", "api"), "lambda": ("lambda", "function"), "library": ("lib", "util", "shared"), "package": ("pkg", "package")}


def module_kind(path: Column) -> Column:
    """What a source directory is likely to hold, by its last name; ``subsystem`` if nothing tells."""
    name, kind = F.lower(F.substring_index(path, "/", -1)), F.lit("subsystem")
    for title, parts in reversed(MODULE_KINDS.items()):
        kind = F.when(name.rlike("|".join(parts)), title).otherwise(kind)
    return kind


def kebab(name: Column) -> Column:
    """Camel case and blanks to lower case with hyphens."""
    parted = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2")
    return F.lower(F.regexp_replace(F.trim(parted), r"[\s_]+", "-"))


# Parts of messages of errors that another try may mend.
TRANSIENT = (
    "timeout", "timed out", "rate limit", "too many requests", "temporarily unavailable", "service unavailable", "gateway timeout",
    "bad gateway", "connection reset", "connection refused", "socket hang up", "network", "econnreset", "econnrefused",
    "etimedout", "eai_again", "429", "503", "504", "overloaded",
)


def error_class(message: Column, name: Column | None = None) -> Column:
    """``transient`` for errors worth another try (by message, or an aborted one by its name), ``unknown``
    without a message, else ``permanent``."""
    again = F.lower(message).rlike("|".join(TRANSIENT))
    if name is not None:
        again = again | (F.lower(name) == "aborterror")
    return F.when(F.coalesce(again, F.lit(False)), "transient").when(message.isNull(), "unknown").otherwise("permanent")
