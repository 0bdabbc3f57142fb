"""Registrable domains, public suffixes and dot-suffix matching as column expressions.

The public-suffix rules are a bounded table (about ten thousand rows), so they are placed in
the plan as constant ``IN`` sets, which the optimizer turns into hash sets. Every host of a
message is resolved inside one projection: no join, no shuffle and no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX_CONF = "spark.headrisk.publicSuffixList"
SUFFIX_RULES_MAX = 50_000

PARTS_DDL = ("struct<host:string,registrable_domain:string,public_suffix:string,subdomain:string,"
             "subdomain_depth:int,is_icann:boolean,is_private:boolean>")

# Common registries with names on the second level, for tests and tables that need no full list. Nothing falls back to them.
COMMON_RULES = (
    [(tld, "exact", "icann") for tld in
     "com net org info biz edu gov mil int io co me ai tv cc xyz app dev jp uk de fr it es ca au br".split()]
    + [(f"{second}.{tld}", "exact", "icann")
       for second, tlds in {"co": "jp uk nz za kr in id il th", "com": "au br cn mx tr sg hk tw ar",
                            "ac": "jp uk", "or": "jp kr", "ne": "jp", "org": "uk au", "gov": "uk au"}.items()
       for tld in tlds.split()]
    + [("blogspot.com", "exact", "private"), ("github.io", "exact", "private")]
)


@dataclass(frozen=True)
class SuffixRules:
    """Suffix rules split by how they match."""

    exact: frozenset
    wildcard: frozenset
    exception: frozenset
    private_exact: frozenset
    private_wildcard: frozenset

    @staticmethod
    def from_rows(rows) -> "SuffixRules":
        picked = {k: set() for k in ("exact", "wildcard", "exception", "pe", "pw")}
        for rule, kind, section in rows:
            for name in _with_ascii_form(rule):
                picked[kind].add(name)
                if section == "private" and kind != "exception":
                    picked["pe" if kind == "exact" else "pw"].add(name)
        return SuffixRules(*(frozenset(picked[k]) for k in ("exact", "wildcard", "exception", "pe", "pw")))


def _with_ascii_form(rule: str) -> set:
    if rule.isascii():
        return {rule}
    try:
        return {rule, rule.encode("idna").decode("ascii")}
    except UnicodeError:
        return {rule}


def suffix_rules_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a public-suffix list: one row per rule, with how it matches and its section."""
    # the two sections are told apart by their marker lines, so the file must stay one string
    text = spark.read.text(path, wholetext=True)
    parts = F.split("value", "===BEGIN PRIVATE DOMAINS===")
    sections = F.array(
        F.struct(F.lit("icann").alias("section"), parts[0].alias("body")),
        F.struct(F.lit("private").alias("section"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body")),
    )
    lines = (
        text.select(F.explode(sections).alias("s"))
        .select("s.section", F.posexplode(F.split("s.body", r"\r?\n")).alias("line_no", "line"))
        .select("section", "line_no", F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1)).alias("raw"))
        .where((F.col("raw") != "") & ~F.col("raw").startswith("//"))
    )
    kind = (F.when(F.col("raw").startswith("!"), "exception")
            .when(F.col("raw").startswith("*."), "wildcard").otherwise("exact"))
    rule = F.regexp_replace("raw", r"^(!|\*\.)", "")
    return lines.select(
        rule.alias("rule"), kind.alias("kind"),
        F.size(F.split(rule, r"\.")).alias("labels"), "section", "line_no",
    )


def load_suffix_rules(spark: SparkSession, path: str | None = None) -> SuffixRules:
    """Rules from ``path`` or the session setting. Its version decides every registrable domain, so there is no default."""
    path = path or spark.conf.get(SUFFIX_CONF, None)
    if not path:
        raise ValueError(f"no public-suffix list: pass its path or set {SUFFIX_CONF}")
    return _rules_from(spark, path)


_RULES_CACHE: dict = {}


def _rules_from(spark: SparkSession, path: str) -> SuffixRules:
    if path not in _RULES_CACHE:
        rows = (suffix_rules_table(spark, path).select("rule", "kind", "section")
                .limit(SUFFIX_RULES_MAX + 1).collect())
        if len(rows) > SUFFIX_RULES_MAX:
            raise ValueError(f"{path}: more than {SUFFIX_RULES_MAX} suffix rules")
        _RULES_CACHE[path] = SuffixRules.from_rows([tuple(r) for r in rows])
    return _RULES_CACHE[path]


def sql_in_list(values) -> str:
    quoted = ",".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in sorted(values))
    return f"({quoted or 'NULL'})"


# a character no host may hold, an empty or overlong label, or a hyphen at the edge of a label
BAD_HOST = r"[^a-z0-9_.\\x{80}-\\x{10FFFF}-]|[.]{2}|[^.]{64}|(^|[.])-|-([.]|$)|^[.]|[.]$"
# the same for the usual ASCII host, in one pass and plain string tests
GOOD_HOST = """h RLIKE '^[a-z0-9_-]++([.][a-z0-9_-]++)*+$'
  AND NOT (contains(h, '.-') OR contains(h, '-.') OR startswith(h, '-') OR endswith(h, '-'))
  AND (length(h) < 64 OR NOT h RLIKE '[^.]{64}')"""
ADDRESS = "right(h, 1) <= '9' AND h RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}$'"


@lru_cache(maxsize=32)
def domain_parts_of(hosts: str, rules: SuffixRules) -> Column:
    """Array of domain parts, one per element of the array column ``hosts`` (lowercase hosts).

    A name with one label, a bare public suffix, an address or a malformed host has no
    registrable domain. Unknown top-level names count as a suffix of one label.
    """
    deepest = 1 + max((r.count(".") for r in rules.exact | rules.wildcard | rules.exception), default=0) + 1
    exact, wild = sql_in_list(rules.exact), sql_in_list(rules.wildcard)
    # top-level names below which wildcard rules or exceptions occur at all
    odd = sql_in_list({r.rsplit(".", 1)[-1] for r in rules.wildcard | rules.exception})
    exempt, p_exact = sql_in_list(rules.exception), sql_in_list(rules.private_exact)
    p_wild = sql_in_list(rules.private_wildcard)
    rest = "substring({0}, instr({0}, '.') + 1)".format
    dots = "(length({0}) - length(replace({0}, '.', '')))".format
    return F.expr(f"""
      transform(transform(transform(transform({hosts},
        h -> named_struct('host', h, 'n', IF(h <> '' AND length(h) < 256
            AND (({GOOD_HOST}) OR (octet_length(h) > length(h) AND NOT h RLIKE '{BAD_HOST}'))
            AND NOT ({ADDRESS}), {dots('h')} + 1, NULL))),
        s -> named_struct('host', s.host, 'n', s.n, 'odd', substring_index(s.host, '.', -1) IN {odd}, 'names',
          transform(sequence(least(s.n, {deepest}), 1, -1), k -> substring_index(s.host, '.', -k)))),
        s -> named_struct('host', s.host, 'n', s.n,
          'free', IF(s.odd, get(filter(s.names, c -> c IN {exempt}), 0), NULL),
          'hit', get(filter(s.names, c -> c IN {exact}
            OR (s.odd AND instr(c, '.') > 0 AND {rest('c')} IN {wild})), 0))),
        s -> transform(array(coalesce({rest('s.free')}, s.hit, substring_index(s.host, '.', -1))), sfx ->
          transform(array(IF(s.n > {dots('sfx')} + 1, substring_index(s.host, '.', -({dots('sfx')} + 2)), NULL)), reg ->
            named_struct('host', s.host, 'registrable_domain', reg,
              'public_suffix', IF(s.n IS NULL, NULL, sfx),
              'subdomain', IF(length(s.host) > length(reg), substring(s.host, 1, length(s.host) - length(reg) - 1), NULL),
              'subdomain_depth', IF(reg IS NULL, 0, s.n - {dots('reg')} - 1),
              'is_icann', IF(s.n IS NULL, NULL, s.free IS NOT NULL OR (s.hit IS NOT NULL AND NOT
                (s.hit IN {p_exact} OR {rest('s.hit')} IN {p_wild}))),
              'is_private', IF(s.n IS NULL, NULL, s.free IS NULL AND s.hit IS NOT NULL AND
                (s.hit IN {p_exact} OR {rest('s.hit')} IN {p_wild}))))[0])[0])
    """)


def build_domain_dim(hosts: DataFrame, rules: SuffixRules, host_col: str = "host") -> DataFrame:
    """Distinct hosts with their domain parts, as a table to join or to store."""
    distinct = hosts.select(F.lower(F.col(host_col)).alias("host")).where("host <> ''").distinct()
    return (distinct.select(F.array("host").alias("hosts"))
            .select(F.explode(domain_parts_of("hosts", rules)).alias("parts")).select("parts.*"))


def dot_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]; equi-join keys for "equal or ends with .x"."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def domain_core(parts: Column) -> Column:
    """Registrable domain without its public suffix."""
    reg, suffix = parts["registrable_domain"], parts["public_suffix"]
    core = F.substring(reg, F.lit(1), F.length(reg) - F.length(suffix) - 1)
    return F.nullif(core, F.lit(""))
