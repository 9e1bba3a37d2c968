"""Column functions over text. All are built-in expressions unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token patterns that results depend on.
WORD_TOKEN = "[a-z0-9_]+"
APOSTROPHE_TOKEN = "[a-z0-9_']+"
LETTER_TOKEN = "[a-z]+(?:['-][a-z]+)*"
IDENTIFIER = "[a-z_][a-z0-9_]{2,}"
#: The words that keyword operators leave out.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Units of durations in nanoseconds.
UNIT_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(text, pattern: str = WORD_TOKEN, least: int = 1, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-cased tokens in order, repeats included; null text has none."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(f"({pattern})"), F.lit(1))
    keep = []
    if least > 1:
        keep.append(lambda t: F.length(t) >= least)
    if stopwords:
        keep.append(lambda t: ~t.isin(*stopwords))
    for k in keep:
        found = F.filter(found, k)
    return found


def token_set(text, **options) -> Column:
    return F.array_distinct(tokens(text, **options))


def sentences(text) -> Column:
    """Pieces behind ``.``, ``!`` or ``?`` and white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_text(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text) -> Column:
    """Groups of lines between blank lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_text(text), r"\n\s*\n+"), lambda s: F.trim(s)), lambda s: s != "")


def lines(text) -> Column:
    return F.split(_text(text), "\n")


def occurrences(text, term) -> Column:
    """How often a term occurs without overlap, by the length that its removal takes away; 0 for an empty term."""
    text, term = _text(text), _text(term)
    return F.when(F.length(term) == 0, 0).otherwise(F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))).cast("long")


def snippet(text, start, length, radius: int) -> Column:
    """Text around a 1-based match, ``radius`` characters to each side, trimmed."""
    text = _text(text)
    first = F.greatest(start - radius, F.lit(1))
    return F.trim(F.substring(text, first, start + length + radius - first))


def preview(text, chars: int) -> Column:
    """The text, or its first characters with an ellipsis when it is longer."""
    text = _text(text)
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def token_estimate(text) -> Column:
    """A quarter of the characters, one at least; 0 for an empty text."""
    n = F.length(_text(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def title(text) -> Column:
    """First line that is not blank: a heading's text, what follows ``title:``, or 120 characters."""
    first = F.trim(F.coalesce(F.element_at(F.filter(lines(text), lambda s: F.trim(s) != ""), 1), F.lit("")))
    named = F.regexp_extract(first, r"(?i)^title:\s*(.*)$", 1)
    heading = F.regexp_extract(first, r"^#+\s*(.*)$", 1)
    return F.when(first.startswith("#"), heading).when(F.lower(first).startswith("title:"), named).otherwise(F.substring(first, 1, 120))


def link_target(url) -> Column:
    """A link without fragment and query; null for absolute http links when ``local`` targets are asked for."""
    bare = F.regexp_replace(F.regexp_replace(_text(url), "#.*$", ""), r"\?.*$", "")
    return F.trim(bare)


def tag(text) -> Column:
    """Trimmed, lower-cased, runs of white space one space."""
    return F.regexp_replace(F.trim(F.lower(_text(text))), r"\s+", " ")


def escape_xml(text) -> Column:
    out = _text(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def vowels(word) -> Column:
    """The letters aeiou of a word in order."""
    return F.regexp_replace(F.lower(_text(word)), "[^aeiou]", "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n neighbours of an array, joined by spaces."""
    size = F.size(words)
    # shifted copies are zipped: a lambda over places would compute ``words`` again for each of them
    shifted = lambda k: F.slice(words, k + 1, F.greatest(size - n + 1, F.lit(0)))
    runs = F.transform(shifted(0), lambda w: F.coalesce(w, F.lit("")))
    for k in range(1, n):
        runs = F.zip_with(shifted(0) if k == 1 else runs, shifted(k), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(size >= n, runs).otherwise(F.array().cast("array<string>"))


def word_forms(text) -> Column:
    """Counts of words by form: upper, capitalised, numeric, alphanumeric, contraction, hyphenated."""
    words = F.regexp_extract_all(_text(text), F.lit(r"([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"), F.lit(1))
    count = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern))).cast("long")
    return F.struct(
        F.size(words).cast("long").alias("words"),
        count("^[A-Z]{2,}$").alias("upper"),
        count("^[A-Z][a-z]+$").alias("capital"),
        count("^[0-9]+$").alias("numeric"),
        count("^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]+$").alias("mixed"),
        count("'").alias("contraction"),
        count("-").alias("hyphen"),
    )


def size_statistics(text) -> Column:
    """Tokens, words, distinct words, sentences, lines and characters."""
    text = _text(text)
    words = tokens(text)
    return F.struct(
        F.size(words).cast("long").alias("tokens"),
        F.size(F.array_distinct(words)).cast("long").alias("distinct_tokens"),
        F.size(sentences(text)).cast("long").alias("sentences"),
        F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("lines"),
        F.length(text).cast("long").alias("chars"),
    )


def named_terms(text) -> Column:
    """Distinct runs of capitalised words, in order of their first occurrence.

    The repeat is possessive: it matches the same, and a run of any length takes no stack.
    """
    found = F.regexp_extract_all(_text(text), F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*+)"), F.lit(1))
    return F.array_distinct(found)


def duration_ns(value, default_unit: str = "s") -> Column:
    """``<number><unit>`` in nanoseconds; null if it is no such thing."""
    value = F.lower(F.trim(_text(value)))
    number = F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 1)
    unit = F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 2)
    factor = F.create_map(*(x for k, v in UNIT_NS.items() for x in (F.lit(k), F.lit(v))))
    return F.when(number != "", (number.cast("double") * F.try_element_at(factor, F.when(unit == "", F.lit(default_unit)).otherwise(unit))).cast("long"))


def timestamp_ns(value) -> Column:
    """ISO text (no zone: UTC), seconds as a number, or ``[hh:]mm:ss`` as nanoseconds; null for anything else."""
    value = F.trim(_text(value))
    clock = F.split(value, ":")
    seconds = F.aggregate(clock, F.lit(0).cast("long"), lambda s, x: s * 60 + F.coalesce(x.try_cast("long"), F.lit(0)))
    return (
        F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), (value.try_cast("double") * 1_000_000_000).cast("long"))
        .when(value.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), seconds * 1_000_000_000)
        .otherwise(F.unix_micros(F.try_to_timestamp(value)) * 1000)
    )


def sequence_ratio(left, right) -> Column:
    """Ratio of matching blocks of two texts (Ratcliff-Obershelp), by a pandas UDF over Arrow batches."""
    import pandas as pd

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    ratio.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, "double")(left, right)


def unified_diff(left, right, context: int = 3) -> Column:
    """Unified diff of two texts, by a pandas UDF over Arrow batches."""
    import pandas as pd

    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import unified_diff as lines_of

        return pd.Series(["\n".join(lines_of((x or "").splitlines(), (y or "").splitlines(), "left", "right", n=context, lineterm="")) for x, y in zip(a, b, strict=True)], dtype=object)

    diff.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(diff, "string")(left, right)


def truncate_utf8(text, limit: int) -> Column:
    """The longest prefix of whole characters that takes ``limit`` bytes at most."""
    data = F.substring(F.encode(_text(text), "UTF-8"), 1, limit + 1)
    # step back over the bytes of a character that the limit cuts: they continue with 10xxxxxx
    lengths = F.array(*(F.lit(limit - k) for k in range(4)))
    follows = lambda n: F.hex(F.substring(data, n + 1, 1)).rlike("^[89AB]")
    fits = F.element_at(F.filter(lengths, lambda n: ~follows(n)), 1)
    return F.when(F.octet_length(_text(text)) <= limit, _text(text)).otherwise(F.decode(F.substring(data, F.lit(1), fits), "UTF-8"))


def lenient_json(text) -> Column:
    """The text from its first brace or bracket on."""
    return F.regexp_extract(_text(text), r"(?s)([\{\[].*)", 1)
