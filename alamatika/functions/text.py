"""Text operators (T1..T15): Column in, Column out, all JVM-side regex expressions.

Character classes are spelled out: Java's ``\\b`` and ``\\w`` follow Unicode while the
published semantics are ASCII.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from alamatika.functions import constants as K

# Unicode white space besides the blank, with VT and NEL which Java's \s leaves out.
_SPACES = "".join(
    map(chr, (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
# A whole token of a text whose white space is already blanks.
_ADMIN_TOKEN = (
    r"(?:^| )(?:" + "|".join(re.escape(t) for t in K.ADMIN_TOKENS) + r")(?= |$)"
)
# Five digits between non-word characters; digits come first so that other characters
# are passed over quickly.
_POSTAL = r"([0-9]{5})(?<![0-9A-Za-z_][0-9]{5})(?![0-9A-Za-z_])"
_CODE_WORD = r"^[0-9]{5}$"
_CODE_BLOCKS = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
)
_TAG = r"(?s)<[A-Za-z/!?][^>]*>"

EVIDENCE_TYPE = "array<struct<type:string,value:string>>"


def request_error(address: Column, max_bytes: int = K.MAX_ADDRESS_BYTES) -> Column:
    """Why an address is refused, or null. Blanks count as text; length is bytes."""
    return (
        F.when(address.isNull() | (address == ""), F.lit(K.ADDRESS_REQUIRED))
        .when(F.octet_length(address) > max_bytes, F.lit(K.ADDRESS_TOO_LONG % max_bytes))
    )


def strip_html(text: Column) -> Column:
    """Drop comments, scripts and styles with their content, then every tag."""
    return F.regexp_replace(F.regexp_replace(text, _CODE_BLOCKS, ""), _TAG, "")


def unescape_newlines(text: Column) -> Column:
    """A literal backslash-n becomes a blank."""
    return F.replace(text, F.lit("\\n"), F.lit(" "))


def fold_words(text: Column) -> Column:
    """T4: lower case, words separated by blanks (T8 makes them single)."""
    return F.translate(F.lower(text), _SPACES, " " * len(_SPACES))


def drop_admin_tokens(folded: Column) -> Column:
    """T5: remove administrative words that stand as whole tokens, with the blank before."""
    return F.regexp_replace(folded, _ADMIN_TOKEN, " ")


def postal_codes(text: Column) -> Column:
    """Every standalone 5-digit code, in order, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(_POSTAL), F.lit(1))


def letters_only(text: Column) -> Column:
    """Delete all but ASCII letters and white space."""
    return F.regexp_replace(text, r"[^a-zA-Z\s]+", "")


def squeeze(text: Column) -> Column:
    """Single blanks, no blanks at the ends; a single blank is left as it is."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def normalize(text: Column) -> Column:
    """T3..T8, then the codes appended in order."""
    # No conditionals: the shared part is then computed once in generated code. The text
    # is lower case with blanks only, so one scan does T5 and T7: a token is decided on
    # the text as given, and dropping whole tokens neither makes nor breaks a code.
    folded = fold_words(unescape_newlines(text))
    codes = F.array_join(postal_codes(folded), " ")
    letters = F.regexp_replace(
        F.regexp_replace(folded, _ADMIN_TOKEN + "|[^a-z ]+", ""), " {2,}", " "
    )
    return F.trim(F.concat(F.trim(letters), F.lit(" "), codes))


def first_postal_code(text: Column) -> Column:
    """The first standalone 5-digit code, or ''."""
    return F.regexp_extract(text, _POSTAL, 1)


def words_of(normalized: Column) -> Column:
    """The words of a text; an empty text has none."""
    return F.array_remove(F.split(squeeze(normalized), " "), "")


def is_road_prefix(word: Column) -> Column:
    """The word is a road prefix."""
    return word.isin(*K.ROAD_PREFIXES)


def place_words(normalized: Column) -> Column:
    """Distinct words that count as place evidence, in text order."""
    return F.array_distinct(
        F.filter(
            words_of(normalized),
            lambda w: ~is_road_prefix(w) & ~F.rlike(w, F.lit(_CODE_WORD)),
        )
    )


def evidence_values(normalized: Column) -> Column:
    """Values of T12: the first postal code, then the place words."""
    code = first_postal_code(normalized)
    head = F.when(code != "", F.array(code)).otherwise(F.array().cast("array<string>"))
    return F.concat(head, place_words(normalized))


def extract_evidence(normalized: Column) -> Column:
    """Array of (type, value): the first postal code, then the place words."""
    code = first_postal_code(normalized)
    head = F.when(
        code != "", F.array(F.struct(F.lit(K.POSTAL_CODE).alias("type"), code.alias("value")))
    ).otherwise(F.array().cast(EVIDENCE_TYPE))
    places = F.transform(
        place_words(normalized),
        lambda w: F.struct(F.lit(K.PLACE_NAME).alias("type"), w.alias("value")),
    )
    return F.concat(head, places)


def format_location(
    sub_district: Column, district: Column, city: Column, province: Column, postal: Column
) -> Column:
    """T14: 'sub, district, city, province postal' without the empty parts."""
    parts = [F.nullif(c, F.lit("")) for c in (sub_district, district, city, province)]
    tail = F.when(F.coalesce(postal, F.lit("")) != "", F.concat(F.lit(" "), postal))
    return F.concat(F.concat_ws(", ", *parts), F.coalesce(tail, F.lit("")))


def trimmed(c: Column) -> Column:
    """Text without outer Unicode white space; null becomes ''."""
    return F.regexp_replace(
        F.coalesce(c, F.lit("")), r"^[\s\x0B\p{Z}\x{FEFF}]+|[\s\x0B\p{Z}\x{FEFF}]+$", ""
    )


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case and outer white space; null counts as ''."""
    return F.lower(trimmed(a)) == F.lower(trimmed(b))
