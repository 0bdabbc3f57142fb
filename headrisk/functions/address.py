"""Addresses, message ids and header lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headrisk.constants import HEADER_TEXT_MAX
from headrisk.functions.binding import let

# blanks as a mail client trims them: ASCII blanks and the Unicode space characters
BLANK = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


ASCII_BLANK = " \t\n\x0b\f\r"


def by_alphabet(value: Column, plain: Column, full: Column) -> Column:
    """``plain`` for ASCII-only texts, where blanks are easy to tell, else ``full``."""
    return F.when(F.length(value) == F.octet_length(value), plain).otherwise(full)


def strip(s: Column) -> Column:
    return by_alphabet(s, F.btrim(s, F.lit(ASCII_BLANK)), F.regexp_replace(s, f"^[{BLANK}]+|[{BLANK}]+$", ""))


def filled(s: Column) -> Column:
    """Null for an empty text."""
    return F.when(s != "", s)


def header(headers: Column, name: str) -> Column:
    """First value of a header; header names are stored in lower case."""
    return F.get(F.try_element_at(headers, F.lit(name)), F.lit(0))


def mailbox_address(value: Column) -> Column:
    """Address inside angle brackets, else the first bare address; lowercased, null if none."""
    def angle_form(blank: str) -> Column:
        return F.regexp_extract(value, f"<([^@<>{blank}]+@[^@<>{blank}]+)>", 1)

    def bare_form(blank: str) -> Column:
        return F.regexp_extract(value, f'[^"<>{blank}]+@[^"<>{blank}]+', 0)
    angled = by_alphabet(value, angle_form(r"\s"), angle_form(BLANK))
    bare = by_alphabet(value, bare_form(r"\s"), bare_form(BLANK))
    return F.when(value.contains("@"), let(angled, lambda a: F.when(a != "", F.lower(a)).otherwise(
        let(bare, lambda b: F.when(b != "", F.lower(b))))))


def after_at(address: Column) -> Column:
    """Text after the first ``@``; null without one or when empty."""
    at = F.instr(address, "@")
    return F.when((at > 0) & (at < F.length(address)), F.substring(address, at + 1, F.length(address)))


def parse_from(value: Column, address: Column | None = None) -> Column:
    """Mailbox of a From header and how well it parsed; ``address`` if it is known already."""
    address = mailbox_address(value) if address is None else address
    domain = after_at(address)
    missing = value.isNull() | (value == "")
    return F.struct(
        F.when(~missing, F.left(value, F.lit(HEADER_TEXT_MAX))).alias("raw_from"),
        F.left(address, F.lit(HEADER_TEXT_MAX)).alias("mailbox_address"),
        F.when(missing, "missing").when(address.isNull(), "invalid")
        .when(domain.isNull(), "no_domain").otherwise("ok").alias("parse_status"),
        F.left(domain, F.lit(HEADER_TEXT_MAX)).alias("from_domain"),
    )


def message_id_domain(value: Column) -> Column:
    found = by_alphabet(value, F.regexp_extract(value, r"<[^@>\s]+@([^>\s]+)>", 1),
                        F.regexp_extract(value, f"<[^@>{BLANK}]+@([^>{BLANK}]+)>", 1))
    return let(found,
               lambda d: F.when(d != "", F.lower(d)))


def email_to_domain(value: Column) -> Column:
    """Part after the first ``@``, or the whole value; lowercased, null when empty."""
    return F.lower(F.when(value == "", None)
                   .when(F.instr(value, "@") > 0, F.substring(value, F.instr(value, "@") + 1, F.length(value)))
                   .otherwise(value))


def email_domain(value: Column) -> Column:
    """Part after the last ``@``, trimmed; null without one."""
    return F.when(value.contains("@"), filled(F.lower(strip(F.substring_index(value, "@", -1)))))


def dkim_domain(properties: Column) -> Column:
    """Signing domain: ``header.d``, ``d``, else the domain of ``header.i`` / ``i``."""
    def prop(name: str) -> Column:
        return F.try_element_at(properties, F.lit(name))
    identity = F.coalesce(prop("header.i"), prop("i"))
    return F.coalesce(filled(F.coalesce(prop("header.d"), prop("d"))), F.lower(after_at(identity)))


def _without_brackets(text: Column) -> Column:
    return F.when(text.startswith("<") & text.endswith(">"),
                  F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def normalise_message_id(value: Column) -> Column:
    return let(strip(value), _without_brackets)


def message_id_variants(value: Column) -> Column:
    """Lookup keys of a Message-ID: as written, and without angle brackets."""
    return let(strip(value), lambda text: F.when(filled(text).isNull(), F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array(text, _without_brackets(text)))))
