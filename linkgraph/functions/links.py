"""Resource links in note bodies: predicate, parser and extractor as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a link to a note begins with, the first that fits.  Notes may use a scheme of their
#: own: every function that looks for links takes ``prefixes``.
PREFIXES = ("note://", ":/")

# The link syntax that note bodies use.
WHITE_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LINE_END = r"\n\r\u2028\u2029"
_ID = "[A-Fa-f0-9]{32}"
#: After the prefix of a whole URL: 32 hex digits, perhaps a hash, perhaps white space and a quoted title.
RESOURCE = rf'({_ID})(#[^{WHITE_SPACE}]*)?(?:[{WHITE_SPACE}]"[^{LINE_END}]*")?\z'
FENCED, INLINE_CODE = r"```[\s\S]*?```", r"`[^`]+`"
#: ](url) on one line, where neither the bracket nor the closing parenthesis is escaped.
INLINE = rf"(?<!\\)\]\(([^{LINE_END}]*?)(?<!\\)\)"
#: ]: url up to the line feed or the end of the text; another line terminator before it voids it.
REFERENCE = rf"(?<!\\)\]:([^{LINE_END}]*)(?:\n|\z)"
#: What matters of HTML: the beginning of an img or a tag, a src or href with a URL (its prefix goes between
#: the two parts), and the end of a tag.
TAG, ATTRIBUTE, CLOSE = rf"<(?:img|a)[{WHITE_SPACE}]", (r"(?:src|href)=[\"']", rf"{_ID}(?:#[^\"'{WHITE_SPACE}]*+)?+[\"']"), ">"
#: A link in a text whose tags are line feeds, URLs quoted and ends tabs: the first URL after a tag, if an
#: end follows, be it within another URL.  Each match begins where the one before ended.
TAGGED = r'\G[^\n]*+\n[^"]*+"([^"]*+)"[^\t>]*+[\t>]'


def _either(prefixes: Sequence[str]) -> str:
    return "(?:" + "|".join(map(re.escape, prefixes)) + ")"


def candidate(prefixes: Sequence[str] = PREFIXES) -> str:
    """A pattern that is necessary for any link, and cheap; the others run only on texts that pass."""
    return f"{_either(prefixes)}{_ID}"


def may_link(text: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """Whether a text passes ``candidate``; most fail a plain search for the prefixes before."""
    shortest = [p for p in prefixes if not any(q in p and q != p for q in prefixes)]
    return reduce(Column.__or__, [text.contains(p) for p in dict.fromkeys(shortest)]) & text.rlike(candidate(prefixes))


URL = "struct<itemId:string,hash:string>"


def trim(text: Column) -> Column:
    """Strip all Unicode white space and U+FEFF from both ends (not only blanks)."""
    return F.regexp_replace(text, rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def _whole(prefixes: Sequence[str]) -> str:
    return rf"\A{_either(prefixes)}{RESOURCE}"


def is_resource_url(url: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    return F.coalesce(url.rlike(_whole(prefixes)), F.lit(False))


def decode_hash(encoded: Column) -> Column:
    """URL-decode with + as a blank; null where it is malformed or no UTF-8."""
    decoded = F.try_url_decode(encoded)
    broken = decoded.contains("\ufffd") & ~encoded.contains("\ufffd") & ~F.lower(encoded).contains("%ef%bf%bd")
    return F.when(~F.coalesce(broken, F.lit(False)), decoded)


def parse_resource_url(url: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """struct(itemId, hash) of a resource URL, null for any other; hash is '' where there is none."""
    whole = _whole(prefixes)
    encoded = F.substring(F.regexp_extract(url, whole, 2), 2, 1 << 30)
    parsed = F.struct(F.regexp_extract(url, whole, 1).alias("itemId"), decode_hash(encoded).alias("hash"))
    return F.when(is_resource_url(url, prefixes), parsed)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_code(text: Column) -> Column:
    """Delete fenced spans, then inline code spans; what stood around them is joined."""
    stripped = F.regexp_replace(F.regexp_replace(text, FENCED, ""), INLINE_CODE, "")
    return F.when(text.contains("`"), stripped).otherwise(text)


def _found(cleaned: Column, sign: str, pattern: str) -> Column:
    """Group 1 of all matches; ``sign`` is a plain string that every match holds."""
    found = F.regexp_extract_all(cleaned, F.lit(pattern), F.lit(1))
    return F.when(cleaned.contains(sign), found).otherwise(F.array().cast("array<string>"))


def inline_urls(cleaned: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    return F.filter(F.transform(_found(cleaned, "](", INLINE), trim), lambda u: is_resource_url(u, prefixes))


def reference_urls(cleaned: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    return F.filter(F.transform(_found(cleaned, "]:", REFERENCE), trim), lambda u: is_resource_url(u, prefixes))


def html_urls(cleaned: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """URLs of img and a tags: of each tag the first src or href with a URL that follows, even beyond its own
    end, up to the next end; what stands between is passed over.

    The text is reduced to tags, URLs and ends, and those are matched one link after another without going
    back, so the work is in proportion to the text, however many tags are left open.  The patterns ignore case,
    the predicate does not: a prefix in capitals is found and dropped.
    """
    token = rf"(?i){TAG}|{_either(prefixes).join(ATTRIBUTE)}|{CLOSE}"
    found = F.regexp_extract_all(cleaned, F.lit(token), F.lit(0))

    def reduced(t: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.substring(t, F.instr(t, "=") + 2, F.length(t) - F.instr(t, "=") - 2), F.lit('"'))
        return F.when(t == CLOSE, "\t").when(t.startswith("<"), "\n").otherwise(quoted)

    links = F.regexp_extract_all(F.array_join(F.transform(found, reduced), ""), F.lit(TAGGED), F.lit(1))
    some = F.when(cleaned.contains("<") & cleaned.contains(CLOSE), links).otherwise(F.array().cast("array<string>"))
    return F.filter(some, lambda u: is_resource_url(u, prefixes))


def resource_urls(body: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """array<struct(itemId, hash)> of all links outside of code: inline, reference, then HTML ones."""

    def urls(cleaned: Column) -> Column:
        found = F.concat(inline_urls(cleaned, prefixes), reference_urls(cleaned, prefixes), html_urls(cleaned, prefixes))
        # code may part an id, so the candidate test looks at the cleaned text
        some = F.when(may_link(cleaned, prefixes), F.transform(found, lambda u: parse_resource_url(u, prefixes)))
        return F.coalesce(some, F.array().cast(f"array<{URL}>"))

    return let(strip_code(F.coalesce(body, F.lit(""))), urls)


def linked_ids(body: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """Distinct linked ids in the order of their first link; ids differ by case."""
    return F.array_distinct(F.transform(resource_urls(body, prefixes), lambda u: u["itemId"]))
