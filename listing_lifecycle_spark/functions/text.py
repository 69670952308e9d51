"""Text functions on columns, all on the JVM.

Those that bind a value or walk over pieces use higher-order functions, which Spark evaluates without code generation.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from listing_lifecycle_spark import fixed_values as fv

# White space as text splitting understands it: Unicode spaces and the ASCII separators.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` refers to it."""
    return F.try_element_at(F.transform(F.array(value), lambda bound: use(bound)), F.lit(1))


def present(text: Column) -> Column:
    """Null in place of an empty text."""
    return bind(text, lambda t: F.when(t != "", t))


def whole_number(text: Column) -> Column:
    """Text as an int, null if it is none; text without a digit isn't tried, as a cast that fails costs far more than one that doesn't."""
    return bind(text, lambda t: F.when(F.regexp_like(t, F.lit("[0-9]")), t).try_cast("int"))


def normalize_space(text: Column) -> Column:
    """Collapse white space; an empty result is null."""
    return present(F.trim(F.regexp_replace(text, _SPACES, " ")))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """All letters that full case folding changes: into one character, or into several."""
    single_from, single_to, several = [], [], {}
    for code in range(0x110000):
        letter, folded = chr(code), chr(code).casefold()
        if len(folded) > 1:
            several[letter] = folded
        elif folded != letter:
            single_from.append(letter)
            single_to.append(folded)
    return "".join(single_from), "".join(single_to), several


def fold_case(text: Column) -> Column:
    """Case-insensitive form by full case folding: ``Straße`` and ``STRASSE`` are one, a final sigma is a sigma."""
    single_from, single_to, several = _fold_table()

    def folded(t: Column) -> Column:
        written_out = F.try_element_at(F.call_function("transform", F.array(t), F.expr(_several_lambda(tuple(several.items())))), F.lit(1))
        return F.translate(written_out, single_from, single_to)

    return F.when(is_ascii(text), F.lower(text)).otherwise(folded(text))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, dict[str, str]]:
    """All code points whose compatibility decomposition leaves one ASCII character, or several."""
    single_from, single_to, several = [], [], {}
    for code in range(0x0080, 0x110000):
        letter = chr(code)
        if not unicodedata.decomposition(letter):
            continue
        ascii_form = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if len(ascii_form) == 1:
            single_from.append(letter)
            single_to.append(ascii_form)
        elif len(ascii_form) > 1:
            several[letter] = ascii_form
    return "".join(single_from), "".join(single_to), several


def _map_literal(pairs: dict[str, str]) -> str:
    """A constant map as SQL text."""
    joined = "\x1e".join(f"{key}\x1f{value}" for key, value in pairs.items())
    return f"str_to_map(decode(X'{joined.encode().hex()}', 'UTF-8'), chr(30), chr(31))"


@lru_cache(maxsize=2)
def _several_lambda(pairs: tuple[tuple[str, str], ...]) -> str:
    """SQL lambda that writes letters out that stand for several characters (ligatures, units, fractions, sharp s).

    The class of all these letters is slow to test, so that is done on letters beyond ASCII only; and text is cut at such
    letters, so that plain stretches are looked up in no table.
    """
    several = dict(pairs)

    def literal(text: str) -> str:
        return f"decode(X'{text.encode().hex()}', 'UTF-8')"

    letters = literal(f"[{''.join(several)}]")
    pieces = literal(r"[\x00-\x7F]+|[^\x00-\x7F]")
    return f"""t -> CASE WHEN NOT regexp_replace(t, {literal(r"[\x00-\x7F]+")}, '') RLIKE {letters} THEN t
      ELSE array_join(transform(regexp_extract_all(t, {pieces}, 0), c -> CASE WHEN octet_length(c) = char_length(c) THEN c ELSE coalesce(try_element_at({_map_literal(several)}, c), c) END), '') END"""


def is_ascii(text: Column) -> Column:
    """Whether all letters of a text are ASCII."""
    return F.octet_length(text) == F.char_length(text)


def slugify(label: Column) -> Column:
    """URL slug of a label: accents dropped, apostrophes removed, other runs become one dash."""
    single_from, single_to, several = _accent_table()

    def without_accents(t: Column) -> Column:
        plain = F.try_element_at(F.call_function("transform", F.array(t), F.expr(_several_lambda(tuple(several.items())))), F.lit(1))
        return F.regexp_replace(F.translate(plain, single_from, single_to), r"[^\x00-\x7F]", "")

    plain = F.lower(bind(label, lambda t: F.when(is_ascii(t), t).otherwise(without_accents(t))))
    plain = F.replace(F.replace(plain, F.lit("'"), F.lit("")), F.lit("&"), F.lit(" and "))
    return F.btrim(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), F.lit("-"))


@lru_cache(maxsize=1)
def _odd_numbers() -> dict[str, str]:
    """Numeric references that do not give the character of their number."""
    codes = [*range(0xA0), *range(0xFDD0, 0xFDF0), *[plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)]]
    return {str(code): html.unescape(f"&#{code};") for code in codes if html.unescape(f"&#{code};") != chr(code)}


@lru_cache(maxsize=2)
def _entity_lambda(in_attribute: bool) -> str:
    """SQL lambda that decodes character references; as text it is one node to build, however often it is used."""
    open_end = "(?![=a-zA-Z0-9])" if in_attribute else ""
    names, old = _map_literal(html5), "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    digits = """CASE WHEN lower(substring(n, 1, 2)) = '#x' THEN ltrim('0', rtrim(';', substring(n, 3))) ELSE ltrim('0', rtrim(';', substring(n, 2))) END"""
    number = f"""element_at(transform(array({digits}), d -> CASE WHEN d = '' THEN 0 WHEN length(d) > 7 THEN 1114112
      WHEN lower(substring(n, 1, 2)) = '#x' THEN CAST(conv(d, 16, 10) AS INT) ELSE CAST(d AS INT) END), 1)"""
    by_number = f"""element_at(transform(array({number}), c -> CASE WHEN c > 1114111 OR c BETWEEN 55296 AND 57343 THEN decode(X'EFBFBD', 'UTF-8')
      ELSE coalesce(try_element_at({_map_literal(_odd_numbers())}, CAST(c AS STRING)), decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')) END), 1)"""
    by_name = f"""coalesce(try_element_at({names}, n), element_at(transform(array(regexp_extract(n, '^({old}){open_end}', 1)),
      o -> CASE WHEN o = '' THEN concat('&', n) ELSE concat(try_element_at({names}, o), substring(n, length(o) + 1)) END), 1))"""
    reference = "^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\\\t\\\\n\\\\f <&#;]{1,32};?)"
    piece = f"""element_at(transform(array(regexp_extract(p, '{reference}', 1)),
      n -> CASE WHEN n = '' THEN p ELSE concat(CASE WHEN startswith(n, '#') THEN {by_number} ELSE {by_name} END, substring(p, length(n) + 2)) END), 1)"""
    return f"""t -> CASE WHEN instr(t, '&') = 0 THEN t
      ELSE array_join(transform(split(t, '(?=&)'), p -> {piece}), '') END"""


def decode_entities(text: Column, *, in_attribute: bool = False) -> Column:
    """Replace named (HTML 5) and numeric character references as an HTML parser does, final semicolon or not.

    In an attribute a name without semicolon stays if ``=``, a letter or a digit follows: ``?a=1&region=2`` is no sign.
    """
    return F.try_element_at(F.call_function("transform", F.array(text), F.expr(_entity_lambda(in_attribute))), F.lit(1))


def date_text(day: Column) -> Column:
    """``3 Jun 2026``, or ``Not stated``."""
    return F.coalesce(F.date_format(day, "d MMM yyyy"), F.lit("Not stated"))


def duration_text(days: Column) -> Column:
    """Whole weeks as weeks, anything else as days."""
    weeks = F.floor(days / 7)
    return (
        F.when(days.isNull(), "Not stated")
        .when(days == 7, "1 week")
        .when(days % 7 == 0, F.concat(weeks.cast("string"), F.lit(" weeks")))
        .when(days == 1, "1 day")
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def pets_text(no_pets: Column, counts: dict[str, Column]) -> Column:
    """``1 dog, 2 cats``; zero counters are left out."""
    parts = []
    for name, (one, many) in fv.PET_NAMES.items():
        count = counts[name]
        word = F.when(count == 1, F.lit(one)).otherwise(F.lit(many))
        parts.append(F.when(count > 0, F.concat(count.cast("string"), F.lit(" "), word)))
    listed = F.concat_ws(", ", *parts)
    return F.when(F.coalesce(no_pets, F.lit(False)), "No pets").otherwise(
        F.coalesce(F.nullif(listed, F.lit("")), F.lit("Not stated"))
    )


def alert_message(rule_name: Column, listing: dict[str, Column]) -> Column:
    """Text of one alert about one listing."""
    place = F.concat_ws(
        ", ", *[F.upper(F.nullif(listing[name], F.lit(""))) for name in ("city", "region")]
    )
    return F.concat_ws(
        "\n",
        F.coalesce(rule_name, F.lit("")),
        F.lit(""),
        F.coalesce(F.nullif(place, F.lit("")), F.lit("NEW MATCHING HOUSE SIT")),
        F.lit(""),
        F.concat(F.lit("DATES: "), date_text(listing["start_date"]), F.lit(" - "), date_text(listing["end_date"])),
        F.concat(F.lit("LENGTH: "), duration_text(listing["duration_days"])),
        F.concat(F.lit("PETS: "), pets_text(listing["no_pets"], listing)),
        F.lit(""),
        F.concat(F.lit("VIEW HOUSE AD: "), F.coalesce(listing["url"], F.lit(""))),
    )


def days_text(value: Column) -> Column:
    """Rounded days (half to even) or a dash."""
    return F.coalesce(F.concat(F.bround(value).cast("bigint").cast("string"), F.lit(" days")), F.lit("-"))


def age_text(seconds: Column) -> Column:
    """Age as minutes below 90 minutes, hours below 48 hours, else days."""

    def rounded(unit: int, suffix: str) -> Column:
        return F.concat(F.bround(seconds / unit).cast("bigint").cast("string"), F.lit(suffix))

    return (
        F.when(seconds < 90 * 60, rounded(60, "m"))
        .when(seconds < 48 * 3600, rounded(3600, "h"))
        .otherwise(rounded(86400, "d"))
    )


def week_labels(day: Column) -> dict[str, Column]:
    """Short and long label of a week start."""
    return {"week_label": F.date_format(day, "dd/MM"), "week_title": F.date_format(day, "dd MMM yyyy")}


def safe_error(message: Column, marker: str = fv.CHALLENGE_MARKER) -> Column:
    """A message that mentions the challenge marker is reduced to the marker."""
    return F.when(F.contains(message, F.lit(marker)), marker).otherwise(message)


def body_snippet(text: Column, length: int = fv.ERROR_SNIPPET_LENGTH) -> Column:
    """Collapsed text, cut with an ellipsis when longer than ``length``."""
    collapsed = F.trim(F.regexp_replace(text, _SPACES, " "))
    return F.when(F.length(collapsed) <= length, collapsed).otherwise(
        F.concat(F.substring(collapsed, 1, length), F.lit("..."))
    )
