"""Text cleaning and composition as Column expressions.

Two Java regex flags matter throughout: ``(?d)`` makes LF the only line end
for ``^`` and ``.``, and ``(?U)`` makes ``\\s`` Unicode aware.  ``\\s`` still
misses U+001C to U+001F, which are added to the class by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposift import defaults

# Fixed patterns: what counts as noise in a Markdown/HTML text.  The URL class
# is one flat class on purpose: a repeated group around alternatives makes the
# Java matcher recurse once per character.
HTML_COMMENT = r"(?s)<!--.*?-->"
CODE_BLOCK = r"(?s)```.*?```"
INLINE_CODE = r"`[^`]*`"
URL = r"https?://[a-z!$-_]+"
LINK = r"\[([^\]]+)\]\([^\)]+\)"
HEADING = r"(?dmU)^#+[\s\x1c-\x1f]+"
BLOCKQUOTE = r"(?dmU)^>[\s\x1c-\x1f]+"
BOLD = r"(?d)(\*\*|__)(.*?)\1"
ITALICS = r"(?d)(\*|_)(.*?)\1"
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Fixed list: the white space of Unicode with U+001C to U+001F.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_OTHER_LINE_BREAK = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# A run of blanks is tried from its first one only and never given back, so long runs take linear time.
_BLANKS_BEFORE_BREAK = r"(?U)(?<![\s\x1c-\x1f&&[^\n]])[\s\x1c-\x1f&&[^\n]]++\n"


def _remove(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


strip_html_comments = _remove(HTML_COMMENT)
strip_code_blocks = _remove(CODE_BLOCK)
strip_inline_code = _remove(INLINE_CODE)
strip_urls = _remove(URL)
strip_headings = _remove(HEADING)
strip_blockquotes = _remove(BLOCKQUOTE)


def trim_unicode(c: Column) -> Column:
    """Strip white space of any kind; only the two ends are looked at."""
    return F.btrim(c, F.lit(_WHITESPACE))


def unwrap_links(c: Column) -> Column:
    return F.regexp_replace(c, LINK, "$1")


def strip_bold(c: Column) -> Column:
    return F.regexp_replace(c, BOLD, "$2")


def strip_italics(c: Column) -> Column:
    return F.regexp_replace(c, ITALICS, "$2")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def clean_text(c: Column, links_first: bool = False) -> Column:
    """Flat words from Markdown/HTML; null gives the empty string.

    URLs go before links are unwrapped, so a link to a web address loses its
    target and keeps ``[text](``.  ``links_first`` swaps the two steps.
    """
    middle = [unwrap_links, strip_urls] if links_first else [strip_urls, unwrap_links]
    steps = [strip_html_comments, strip_code_blocks, strip_inline_code, *middle,
             strip_headings, strip_blockquotes, strip_bold, strip_italics, collapse_whitespace]
    out = or_empty(c)
    for step in steps:
        out = step(out)
    return out


def normalize_text(c: Column) -> Column:
    """Unify line ends, strip both ends and the right side of every line."""
    out = F.regexp_replace(or_empty(c), r"\r\n?", "\n")
    out = trim_unicode(out)
    out = F.regexp_replace(out, _OTHER_LINE_BREAK, "\n")
    return F.regexp_replace(out, _BLANKS_BEFORE_BREAK, "\n")


def clip_issue_text(c: Column, max_chars: int = defaults.MAX_ISSUE_TEXT_CHARS) -> Column:
    text = normalize_text(c)
    return F.when(
        F.length(text) > max_chars,
        F.concat(F.substring(text, 1, max_chars), F.lit(defaults.TRUNCATION_NOTE)),
    ).otherwise(text)


def embedding_text(title: Column, body: Column) -> Column:
    return F.concat(trim_unicode(title), F.lit("\n"), trim_unicode(or_empty(body)))


def combine_text(title: Column, body: Column) -> Column:
    """Like :func:`embedding_text`, with the title left as it is."""
    return F.concat(title, F.lit("\n"), trim_unicode(or_empty(body)))


def issue_payload(title: Column, body: Column) -> Column:
    return F.format_string("TITLE: %s | BODY: %s", clean_text(title), clean_text(body))


def pr_payload(title: Column, commit_messages: Column, body: Column) -> Column:
    """The PR title is used raw; messages and description are cleaned."""
    return F.format_string(
        "TITLE: %s | COMMITS: %s | DESCRIPTION: %s",
        title, clean_text(commit_messages), clean_text(body),
    )


def issue_key(repo: Column, number: Column) -> Column:
    return F.concat(repo, F.lit("#"), number.cast("string"))


def fence_text(number: Column, text: Column) -> Column:
    """Mark a text as untrusted content of one issue."""
    return F.format_string(
        "BEGIN_UNTRUSTED_ISSUE_%1$d\n%2$s\nEND_UNTRUSTED_ISSUE_%1$d", number.cast("bigint"), text
    )


def escape_csv_formula(c: Column) -> Column:
    """Quote cells that a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def match_message(number: Column, score: Column, prefix: str = "") -> Column:
    return F.format_string(prefix + "Duplicate of #%d (%.0f%% match).", number.cast("bigint"), score * 100)


def pr_match_message(number: Column, score: Column, prefix: str = "") -> Column:
    return F.format_string(
        prefix + "PR appears to duplicate #%d (%.0f%% match).", number.cast("bigint"), score * 100
    )
