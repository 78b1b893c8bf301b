"""Text expressions. All are native columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript trims it: Unicode's, and the byte order mark.
_WHITE = r"[\s\x{FEFF}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_WHITE}+|{_WHITE}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, then trimmed."""
    return trim(F.regexp_replace(c, rf"(?U){_WHITE}+", " "))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; length() counts code points."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def token_estimate(c: Column) -> Column:
    """Tokens that a text is taken to have: one for each 3.5 units, rounded up."""
    return F.ceil(utf16_length(c) / F.lit(3.5)).cast("bigint")


def checksum(markdown: Column) -> Column:
    """Content checksum of a document: of its trimmed Markdown, not of its bytes."""
    return F.sha2(trim(markdown), 256)


def _accents() -> tuple[str, str]:
    """Letters that decompose to one character and combining marks of U+0300-036F, and what they decompose to."""
    plain = {}
    for code in range(0x80, 0x3000):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(0x300 <= ord(m) <= 0x36F for m in marks):
            plain[chr(code)] = first
    return "".join(plain), "".join(plain.values())


_FROM, _TO = _accents()


def normalized(c: Column) -> Column:
    """For comparison: without accents, lower case, white space collapsed."""
    return collapse(F.lower(F.regexp_replace(F.translate(c, _FROM, _TO), r"[\x{300}-\x{36F}]", "")))


def comparable(c: Column) -> Column:
    """normalized() without punctuation that questions differ by."""
    return collapse(F.regexp_replace(normalized(c), r"[¿?¡!.,;:]", ""))


#: The named character references that converters decode, in the order of decoding.
ENTITIES = {
    "&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&aacute;": "á", "&eacute;": "é",
    "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ", "&Ntilde;": "Ñ", "&uuml;": "ü",
}


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    good = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0)), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _numeric(c: Column, pattern: str, base: int) -> Column:
    """c with each match of pattern replaced by the character that its group stands for, however many digits it has."""
    codes = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    gaps = F.split(c, pattern, -1)

    def number(digits: Column) -> Column:
        own = F.ltrim(digits, F.lit("0"))
        return F.when(F.length(own) <= 7, F.coalesce(F.conv(own, base, 10).cast("bigint"), F.lit(0))).otherwise(-1)

    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), codes.alias("n")), lambda x: F.concat(x["g"], F.when(x["n"].isNull(), F.lit("")).otherwise(_character(number(x["n"]))))), "")
    return F.when(c.rlike(pattern), joined).otherwise(c)


def decode_entities(c: Column) -> Column:
    for name, character in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(character))
    c = _numeric(c, r"&#([0-9]+);", 10)
    return _numeric(c, r"(?i)&#x([0-9a-f]+);", 16)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def normalize_blank_lines(c: Column) -> Column:
    """Lines without trailing blanks, at most one empty line in a row, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|\z)", ""), r"\n{3,}", "\n\n"))


def prohibited_marker(rule: Column) -> Column:
    """What a rule of the form "never mention X" forbids; null for other rules."""
    return F.nullif(F.regexp_extract(trim(rule), r"(?i)nunca\s+(?:menciones|digas|uses|nombres)\s+(.+?)[.;]?$", 1), F.lit(""))


def render_template(template: str | Column, values: Mapping[str, Column]) -> Column:
    """{{name}} replaced by values; a name without a value raises, listing all of them."""
    t = F.lit(template) if isinstance(template, str) else template
    names = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}"), F.lit(1)))
    missing = F.array_except(names, F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"))
    out = t
    for name, value in values.items():
        # one pass for each name over the text between its marks, so that values are never read as templates of other names
        out = F.array_join(F.split(out, rf"\{{\{{\s*{name}\s*\}}\}}", -1), "\u0000" + name + "\u0000")
    for name, value in values.items():
        out = F.replace(out, F.lit("\u0000" + name + "\u0000"), value.cast("string"))
    return F.when(F.size(missing) == 0, out).otherwise(F.raise_error(F.concat(F.lit("missing variables: "), F.array_join(missing, ", "))))


def canonical_url(c: Column) -> Column:
    """A URL without its fragment."""
    return F.regexp_replace(c, "#.*$", "")


#: Fixed value: characters of a storage key.
MOST_KEY = 512


def valid_storage_key(c: Column) -> Column:
    """Keys are path segments of letters, digits, dot, underscore and hyphen, none of them hidden or going up, and of 512 characters at most."""
    return (F.length(c) <= MOST_KEY) & F.forall(F.split(c, "/"), lambda part: part.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"))


def document_key(tenant: Column, document: Column, extension: Column) -> Column:
    ext = F.regexp_replace(F.lower(extension), "[^a-z0-9]", "")
    return F.concat(tenant, F.lit("/documents/"), document, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))
