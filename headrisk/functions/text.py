"""Character statistics of labels and local parts, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrisk.functions.binding import let

CONSONANTS = "[b-df-hj-np-tv-z]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BIGRAM_MIN_LETTERS = 4


def round3(x: Column) -> Column:
    """Half-up rounding to three decimals (``F.round`` differs on negative halves)."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def count_of(s: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{char_class}]", ""))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy over characters, summed in first-seen order."""
    def of(s: Column) -> Column:
        def add(total: Column, c: Column) -> Column:
            return let(F.try_divide(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.length(s)),
                       lambda p: total - p * F.log2(p))
        return F.aggregate(F.array_distinct(chars(s)), F.lit(0.0), add)
    return let(F.coalesce(text, F.lit("")), of)


def vowel_ratio(s: Column) -> Column:
    return ratio(count_of(s, "aeiou"), F.length(s))


def longest_match(s: Column, pattern: str) -> Column:
    runs = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def max_consonant_run(s: Column) -> Column:
    return longest_match(s, CONSONANTS)


def is_random_label(label: Column) -> Column:
    return ((F.length(label) >= 6)
            & ((vowel_ratio(label) <= 0.20) | (max_consonant_run(label) >= 4))
            & (entropy(label) >= 2.3))


def letters_of(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, "[^a-zA-Z]", ""))


def is_random_local(local: Column) -> Column:
    def shaped(letters: Column) -> Column:
        # the all-capitals branch cannot hold for the lowercased local parts of the pipeline
        shape = (vowel_ratio(letters) <= 0.25) | (max_consonant_run(letters) >= 4) | local.rlike("^[A-Z]{5,}$")
        return (F.length(letters) >= 5) & shape & (entropy(letters) >= 2.2)
    return F.coalesce(F.when(F.length(local) >= 5, let(letters_of(local), shaped)), F.lit(False))


def first_random_label(domain: Column) -> Column:
    return F.get(F.filter(F.split(domain, r"\."), is_random_label), F.lit(0))


def letter_digit_transitions(s: Column) -> Column:
    """Switches between letters and digits, other characters skipped."""
    runs = F.regexp_extract_all(F.regexp_replace(F.lower(s), "[^a-z0-9]", ""), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.greatest(F.size(runs) - 1, F.lit(0))


def has_long_hex_run(s: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(s), F.lit("[0-9a-f]{6,}"), F.lit(0))
    return F.exists(runs, lambda r: r.rlike("[0-9]"))


def lexical_metrics(text: Column) -> Column:
    return let(F.lower(text), _lexical_metrics)


def _lexical_metrics(s: Column) -> Column:
    n, letters, digits = F.length(s), count_of(s, "a-z"), count_of(s, "0-9")
    hyphens = count_of(s, "\\-")
    return F.struct(
        n.alias("length"),
        letters.alias("alpha_length"),
        digits.alias("digit_count"),
        round3(ratio(digits, n)).alias("digit_ratio"),
        count_of(s, "aeiouy").alias("vowel_count"),
        round3(ratio(count_of(s, "aeiouy"), letters)).alias("vowel_ratio_alpha_only"),
        F.size(F.array_distinct(chars(s))).alias("unique_char_count"),
        has_long_hex_run(s).alias("has_long_hex_like_run"),
        letter_digit_transitions(s).alias("letter_digit_transition_count"),
        hyphens.alias("hyphen_count"),
        round3(ratio(hyphens, n)).alias("hyphen_ratio"),
    )


def core_lexical_metrics(text: Column) -> Column:
    """Entropy over length, repeated characters and adjacent letter/digit switches."""
    return let(F.lower(text), _core_lexical_metrics)


def _core_lexical_metrics(s: Column) -> Column:
    n = F.length(s)
    border = "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])"
    switches = F.length(F.regexp_replace(s, border, "|")) - n
    return F.struct(
        entropy(s).alias("shannon_entropy"),
        F.when(n > 1, F.try_divide(entropy(s), F.log2(n.cast("double")))).otherwise(0.0).alias("normalized_entropy"),
        max_consonant_run(s).alias("max_consonant_run"),
        longest_match(s, r"(?s)(.)\1*").alias("max_repeated_char_run"),
        ratio(F.size(F.array_distinct(chars(s))), n).alias("unique_char_ratio"),
        switches.alias("letter_digit_transitions"),
        vowel_ratio(s).alias("vowel_ratio"),
    )


def lexical_flags(metrics: Column) -> Column:
    """Observations over ``lexical_metrics``."""
    def of(m: Column) -> Column:
        long_enough = m["length"] >= 6
        return F.struct(
            (long_enough & (m["digit_ratio"] >= 0.3)).alias("high_digit_ratio"),
            (long_enough & (m["letter_digit_transition_count"] >= 3)).alias("high_letter_digit_transitions"),
            ((m["hyphen_count"] >= 2) & (m["hyphen_ratio"] >= 0.25)).alias("hyphen_heavy"),
            ((m["hyphen_count"] >= 2) & long_enough).alias("hyphen_heavy_label"))
    return let(metrics, of)


# ------------------------------------------------------------------ bigrams

def bigram_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """How often each letter follows each other letter inside the words of a text table."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return (texts.select(F.explode(pairs).alias("pair")).groupBy("pair")
            .agg(F.count("*").alias("n")))


def bigram_model(counts: DataFrame) -> list[float]:
    """log2 P(second letter | first letter), 676 values in alphabetical order; unseen pairs count once."""
    seen = {r["pair"]: r["n"] for r in counts.limit(len(ALPHABET) ** 2).collect()}
    from math import log2
    model = []
    for a in ALPHABET:
        row = [seen.get(a + b, 0) or 1 for b in ALPHABET]
        model += [log2(c / sum(row)) for c in row]
    return model


def bigram_naturalness(label: Column, model: list[float]) -> Column:
    """Mean surprise per letter pair; null below four letters."""
    return let(F.regexp_replace(F.lower(label), "[^a-z]", ""), lambda s: _naturalness(s, model))


def _naturalness(s: Column, model: list[float]) -> Column:
    table = F.array(*[F.lit(v) for v in model])
    pairs = F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1)))
    value = F.aggregate(pairs, F.lit(0.0), lambda total, i: total - F.get(
        table, (F.ascii(F.substring(s, i, F.lit(1))) - 97) * 26
        + F.ascii(F.substring(s, i + 1, F.lit(1))) - 97))
    count = F.length(s) - 1
    return F.when(F.length(s) >= BIGRAM_MIN_LETTERS, F.struct(
        round3(value / count).alias("avg_neg_log_prob"), count.alias("bigram_count")))
