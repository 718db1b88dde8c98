"""Text functions: normalisation, byte-level pre-tokens, token strings, HTML. Native where columns can say it."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow

FORMS = ("nfc", "nfd", "nfkc", "nfkd")
# Fixed value: the byte-level splitter of public byte-pair tokenizers, in Java's syntax.
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# What the translation normalizer drops, and what it turns into a blank.
_NMT_DROP = r"[\x01-\x08\x0B\x0E-\x1F\x7F\u008F\u009F]"
_NMT_BLANK = r"[\x09\x0A\x0C\x0D ​-‏  ▁﻿�]"
# Markers of tokenised code.
SPECIAL = ("<indent>", "<dedent>", "<newline>", "<strnewline>", "<tabsymbol>", "▁", "<spacetoken>", "<endcom>", "<endmarker>")


def unicode_form(form: str):
    """A UDF to a Unicode normal form; Spark has no built-in for it."""
    form = form.lower()
    if form not in FORMS:
        raise ValueError(f"unknown unicode form: {form}")

    return arrow.by_text(lambda t: unicodedata.normalize(form.upper(), t))


def normalize(text: Column, *, form: str | None = "nfkc", nmt: bool = False, collapse: bool = True, lower: bool = False) -> Column:
    """In this order: control characters (nmt), Unicode form, runs of blanks to one, lower case. ASCII texts pass by the UDF's work natively."""
    out = text
    if nmt:
        out = F.regexp_replace(F.regexp_replace(out, _NMT_DROP, ""), _NMT_BLANK, " ")
    if form:
        out = F.when(out.rlike(r"[^\x00-\x7F]"), unicode_form(form)(out)).otherwise(out)
    if collapse:
        out = F.regexp_replace(out, " {2,}", " ")
    return F.lower(out) if lower else out


def pre_tokens(text: Column, *, prefix_space: bool = False) -> Column:
    """array<string>: the byte-level pre-tokens, blanks with the word they precede."""
    if prefix_space:
        text = F.when(text.startswith(" ") | (text == ""), text).otherwise(F.concat(F.lit(" "), text))
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def stringify(tokens: Column, *, spaced: bool = True) -> Column:
    """Tokens joined by blanks; unless spaced, without blanks around markers."""
    line = F.array_join(tokens, " ")
    return line if spaced else F.regexp_replace(line, rf"\s*({'|'.join(SPECIAL)})\s*", "$1")


def destringify(line: Column, *, spaced: bool = True) -> Column:
    """Unless spaced, one blank on either side of each marker."""
    return line if spaced else F.regexp_replace(line, rf"\s*({'|'.join(SPECIAL)})\s*", " $1 ")


def clean_comment(text: Column, *, runs: str | None = None) -> Column:
    """A comment with runs of blanks as one, runs of a character (any but a newline, or of those in runs) cut to five, and empty if it has less than two word characters."""
    which = r"[^\n]" if runs is None else "[" + "".join(f"\\{c}" for c in runs) + "]"
    out = F.regexp_replace(F.regexp_replace(text, " +", " "), rf"({which})\1{{4,}}", "$1$1$1$1$1")
    return F.when(F.length(F.regexp_replace(out, r"[^\p{L}\p{N}_]", "")) < 2, F.lit("")).otherwise(out)


def diff_line(line: Column) -> Column:
    """A diff's line for a model: hunk heads as <newline>, a blank after a single leading + or -."""
    out = F.regexp_replace(line, "@@ .* @@", "<newline>")
    return F.regexp_replace(F.regexp_replace(out, r"^-([^-]+)", r"- $1"), r"^\+([^+]+)", r"+ $1")


class _Stripper(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def strip_tags(html: str | None) -> str | None:
    """The text of HTML: script and style bodies stay, comments go, and so does trailing text with an open character reference."""
    if html is None:
        return None
    parser = _Stripper()
    parser.feed(html)
    return "".join(parser.found)


#: strip_tags on a column: for any HTML.
strip_html = arrow.by_text(strip_tags)


_CHUNK = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+"


def strip_html_native(html: Column) -> Column:
    """The same without a UDF, for well-formed pages whose character references are amp, copy, middot and quot."""

    def text_of(chunk: Column) -> Column:
        body = F.regexp_extract(chunk, r"(?s)^<(?:script|style)[^>]*>(.*?)</(?:script|style)>$", 1)
        plain = chunk
        for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
            plain = F.regexp_replace(plain, f"&{name};?", char)
        return F.when(chunk.startswith("<script") | chunk.startswith("<style"), body).when(chunk.startswith("<"), F.lit("")).otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_CHUNK), F.lit(0)), text_of), "")
