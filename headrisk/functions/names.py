"""Display-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headrisk.constants import HEADER_TEXT_MAX, NON_LATIN_RANGES
from headrisk.functions.address import BLANK, by_alphabet, filled, strip
from headrisk.functions.binding import let
from headrisk.functions.text import round3


def display_name(from_header: Column) -> Column:
    """Text before the angle-bracket address, outer quotes removed; null when empty."""
    def before_address(blank: str) -> Column:
        return F.regexp_extract(from_header, f"^(.*?)[{blank}]*<[^>]+>[{blank}]*$", 1)
    found = by_alphabet(from_header, before_address(r"\s"), before_address(BLANK))
    raw = let(F.regexp_replace(found, '^"|"$', ""), strip)
    return F.when(from_header.contains("<"), let(raw, lambda r: F.left(filled(r), F.lit(HEADER_TEXT_MAX))))


def normalise(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def trigrams(s: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))),
                        lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; two texts without trigrams are equal."""
    def of(g: Column) -> Column:
        ga, gb = g["a"], g["b"]
        return (F.when((F.size(ga) == 0) & (F.size(gb) == 0), F.lit(1.0))
                .when((F.size(ga) == 0) | (F.size(gb) == 0), F.lit(0.0))
                .otherwise(round3(F.try_divide(F.size(F.array_intersect(ga, gb)), F.size(F.array_union(ga, gb))))))
    return let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), of)


def has_non_latin(s: Column) -> Column:
    return s.rlike(f"[{NON_LATIN_RANGES}]")


def words(name: Column) -> Column:
    pieces = by_alphabet(name, F.split(name, r"\s+"), F.split(name, f"[{BLANK}]+"))
    return F.filter(pieces, lambda w: w != "")


def brand_like(w: Column) -> Column:
    """False only for two capitalised words, the shape of a personal name; ``w`` holds the words."""
    person = (F.size(w) == 2) & F.forall(w, lambda x: x.rlike("^[A-Z][a-z'-]+$"))
    return F.when(F.size(w) > 0, ~person)


def is_spaced(w: Column) -> Column:
    """At least five words, four of five of them single characters."""
    single = F.size(F.filter(w, lambda x: F.length(x) == 1))
    return F.coalesce((F.size(w) >= 5) & (F.try_divide(single, F.size(w)) >= 0.8), F.lit(False))


def is_email_shaped(name: Column) -> Column:
    return F.coalesce(name.contains("@") & strip(name).rlike(f"^[^@{BLANK}]+@[^@.{BLANK}]+\\.[^@{BLANK}]+$"), F.lit(False))


def embedded_domains(name: Column) -> Column:
    """Domains of all addresses inside a display name."""
    found = F.regexp_extract_all(
        F.lower(name), F.lit("[a-z0-9._%+-]+@([a-z0-9-]+(?:\\.[a-z0-9-]+)+)"), F.lit(1))
    return F.when(name.contains("@"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))
