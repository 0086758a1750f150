"""Text normalisation as Catalyst expressions.

The character classes are spelled out so the JVM regex engine and an RE2
oracle agree with the Unicode semantics of the original cleaner:
whitespace is the Unicode ``isspace`` set, a word character is a letter,
a number or ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace (Python str.isspace): ASCII controls, FS/GS/RS/US, NEL
# and every Z* separator.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}"
WORD = r"\p{L}\p{N}_"

# Fixed patterns of the cleaning rules, applied in this order.
URL_RE = rf"https?://[^{WS}]+|www\.[^{WS}]+"
HTML_RE = r"<[^>]+>"
MENTION_RE = rf"@[{WORD}]+"
HASHTAG_RE = rf"#([{WORD}]+)"
NON_LETTER_RE = rf"[^a-zA-Z{WS}]"
WS_RUN_RE = rf"[{WS}]+"
# "non-letter -> space, then collapse whitespace runs" in one pass: every
# maximal run of characters that are not ASCII letters becomes one space.
SEPARATOR_RUN_RE = r"[^a-zA-Z]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """lower -> drop URLs -> drop tags -> drop @mentions -> unwrap #tags ->
    non-letters to space -> collapse whitespace -> trim.  Null -> ''."""
    t = F.lower(F.coalesce(_c(col), F.lit("")))
    # each rule can only fire when its marker occurs; a substring test is far
    # cheaper than a regex scan, so most texts skip four of the five scans
    t = _guarded(t, t.contains("http") | t.contains("www."), URL_RE, "")
    t = _guarded(t, t.contains("<"), HTML_RE, "")
    t = _guarded(t, t.contains("@"), MENTION_RE, "")
    t = _guarded(t, t.contains("#"), HASHTAG_RE, "$1")
    t = F.regexp_replace(t, SEPARATOR_RUN_RE, " ")
    return F.trim(t)


def _guarded(t: Column, cond: Column, pattern: str, repl: str) -> Column:
    return F.when(cond, F.regexp_replace(t, pattern, repl)).otherwise(t)


def with_clean(df, src: str = "text", out: str = "clean_text", drop_empty: bool = True, observation=None):
    """Add ``out = clean_text(src)`` and (optionally) drop empty results.

    The cleaned value is produced by a one-element generator: a filter on a
    generated column cannot be pushed below the generator, so the regex
    chain runs once per row instead of once in the Filter and again in the
    Project (Catalyst does not share sub-expressions across operators).

    ``observation`` (a ``pyspark.sql.Observation``) reports ``rows`` and
    ``empty_removed`` (P8) from the same job that consumes the result, not
    from a second pass."""
    res = df.select("*", F.explode(F.array(clean_text(src))).alias(out))
    if observation is not None:
        res = res.observe(observation, F.count(F.lit(1)).alias("rows"),
                          F.count_if(F.length(F.col(out)) == 0).alias("empty_removed"))
    return res.where(F.length(F.col(out)) > 0) if drop_empty else res


def word_count(col) -> Column:
    """``len(text.split())``: whitespace-separated pieces, nulls -> 0."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), WS_RUN_RE)
    return F.size(F.filter(parts, lambda w: w != "")).cast("int")


def char_length(col) -> Column:
    """Length in code points (what ``len(str)`` returns)."""
    return F.length(F.coalesce(_c(col), F.lit(""))).cast("int")


def split_clean(clean_col) -> Column:
    """Tokens of an already-cleaned text (single spaces, trimmed): a plain
    split, with the empty text mapped to an empty array (no lambda)."""
    c = _c(clean_col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def tokens(clean_col, min_len: int = 1) -> Column:
    """Split an already-cleaned text (single spaces, trimmed) into tokens.

    ``min_len=2`` reproduces the TF-IDF token pattern (words of >= 2 letters)
    on cleaned text."""
    arr = F.split(_c(clean_col), " ")
    return F.filter(arr, lambda w: F.length(w) >= max(min_len, 1))


# Spark's built-in English stop-word list, each entry passed
# through the cleaner so contractions appear as the fragments that occur in
# cleaned text (e.g. "don't" -> "don", "t").
def _default_stopwords() -> list[str]:
    import re

    from .stopwords import SPARK_ENGLISH_STOPWORDS

    out: set[str] = set()
    for w in SPARK_ENGLISH_STOPWORDS:
        for piece in re.sub(r"[^a-z\s]", " ", w.lower()).split():
            out.add(piece)
    return sorted(out)


class _Lazy:
    _v = None

    def __call__(self):
        if self._v is None:
            self._v = _default_stopwords()
        return self._v


DEFAULT_STOPWORDS = _Lazy()


def drop_stopwords(clean_col, stopwords: list[str] | None = None) -> Column:
    """Remove stop words from a cleaned text, keep order and duplicates."""
    sw = list(stopwords or DEFAULT_STOPWORDS())
    # a literal IN list becomes a hashed InSet in generated code
    kept = F.filter(F.split(_c(clean_col), " "), lambda w: (w != "") & ~w.isin(sw))
    return F.array_join(kept, " ")


def normalise_source_key(col) -> Column:
    """lower, trim, remove every whitespace character."""
    return F.regexp_replace(F.lower(F.trim(_c(col))), WS_RUN_RE, "")


def safe_name(col) -> Column:
    return F.replace(F.lower(_c(col)), F.lit(" "), F.lit("_"))


def assemble_statement(statement, subject) -> Column:
    """``statement [subject]`` when the subject is non-blank."""
    s, sub = _c(statement), _c(subject)
    return F.when(F.coalesce(F.trim(sub), F.lit("")) != "",
                  F.concat(s, F.lit(" ["), sub, F.lit("]"))).otherwise(s)


def assemble_title_content(title, content, max_content: int | None = None) -> Column:
    """``title. content`` (``content[:max]`` when a limit is given); title alone when content is null."""
    t = F.coalesce(_c(title), F.lit(""))
    c = _c(content)
    if max_content is not None:
        c = F.substring(c, 1, max_content)
    return F.when(c.isNull(), t).otherwise(F.concat(t, F.lit(". "), c))
