"""Rule tables of any size, joined on equal keys instead of standing in the plan.

A host is exploded to its dot suffixes, which turns "equal to x or below x" into an equi-join. Each
distinct host (and account, where the rules differ by account) is resolved once, and the outcome
goes back to the messages by host. Keys that hold most rows are dealt to ``SALTS`` tasks. Short lists
of accounts go to the messages instead, which stay in place and look through their account's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrisk.functions.domains import dot_suffixes

SALTS = 16
#: Rows, and characters of their text, up to which a joined table is broadcast.
SMALL_ROWS, SMALL_TEXT = 100_000, 8_000_000
#: Entries of one account's list up to which each of its messages looks through the list.
OWNER_LIST_MAX = 200
HITS_DDL = "array<struct<domain:string,match_type:string,score:double>>"


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: Column, how: str = "left") -> DataFrame:
    """Join on equal keys; the rows of one key on the left go to ``SALTS`` tasks, ``right`` to each of them.

    Rows without a key match nothing and go to any task.
    """
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyless = F.greatest(*[F.col(k).isNull() for k in on], F.lit(False))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.when(keyless, 2**31 - 1).otherwise(SALTS)).cast("int"))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def is_small(table: DataFrame) -> bool:
    """Whether a table is within the bound of broadcasts; counted, as an estimate takes a few keys of a large table for many."""
    n, text = table.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= SMALL_ROWS and text <= SMALL_TEXT


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: Column) -> DataFrame:
    """Left join to a table that may grow. Within a bound ``right`` goes to the rows, which stay where they are; a larger one
    is joined by salted keys, so that a key with most rows does not fall to one task."""
    if is_small(right):
        return left.join(F.broadcast(right), on, "left")  # SMALL_ROWS and SMALL_TEXT at most
    return salted_join(left, right, on, spread_by)


def short_lists(rules: DataFrame, entry: Column, key: str) -> DataFrame | None:
    """``(account_id, key)``: the entries of each account as one sorted list, where all lists together are within the bound of broadcasts and each
    within ``OWNER_LIST_MAX``; else None. Counted before any list is gathered; entries of no account match nothing."""
    owned = rules.where("account_id IS NOT NULL")
    sizes = owned.groupBy("account_id").agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("text"))
    accounts, longest, text = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("text"), F.lit(0))).first()
    if accounts > SMALL_ROWS or longest > OWNER_LIST_MAX or text > SMALL_TEXT:
        return None
    return owned.groupBy("account_id").agg(F.sort_array(F.collect_list(entry)).alias(key))


def top_n(df: DataFrame, keys: list, order: list[str], n: int, spread_by: Column, rank: str) -> DataFrame:
    """The first ``n`` rows of every key with their rank.

    A key's rows are dealt to ``SALTS`` parts that keep ``n`` rows each, whatever ``n`` is; the last
    rank sees at most ``SALTS * n`` rows of a key.
    """
    by = _sorted(order)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    heads = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by))).where(F.col(rank) <= n)
    return (heads.drop("_part").withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
            .where(F.col(rank) <= n))


def _sorted(order: list) -> list[Column]:
    """Orders such as ``at DESC`` as columns."""
    found = []
    for o in order:
        if not isinstance(o, str):
            found.append(o)
            continue
        name, *direction = o.split(" ")
        found.append(F.col(name).desc_nulls_last() if direction[:1] == ["DESC"] else F.col(name).asc())
    return found


def _owner(rules: DataFrame) -> list[str]:
    return ["account_id"] if "account_id" in rules.columns else []


def _usable(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("match_type").isin("exact", "suffix") & (F.col("domain") != ""))


def suffix_matches(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """All rules that match a host, in user order.

    ``hosts([account_id,] host)`` in lower case and ``rules([account_id,] pos, domain, match_type,
    score)``, where ``exact`` means equal and ``suffix`` equal or below. One row for each distinct
    host that any rule matches; a rule's account has to be the host's.
    """
    owner = _owner(rules)
    keys = (hosts.select(*owner, "host").where("host <> ''").distinct()
            .select("*", F.explode(dot_suffixes(F.col("host"))).alias("_key")))
    table = _usable(rules).select(
        *owner, F.lower("domain").alias("_key"), "pos", "domain", "match_type", F.col("score").cast("double").alias("score"))
    hits = (salted_join(keys, table, [*owner, "_key"], F.col("host"), "inner")
            .where((F.col("_key") == F.col("host")) | (F.col("match_type") == "suffix")))
    # as many entries as rules match one host
    found = F.sort_array(F.collect_list(F.struct("pos", "domain", "match_type", "score")))
    return hits.groupBy(*owner, "host").agg(F.transform(found, lambda r: F.struct(
        r["domain"].alias("domain"), r["match_type"].alias("match_type"), r["score"].alias("score"))).alias("sender_hits"))


def with_sender_hits(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``sender_hits``: the sender rules that match ``from_domain``."""
    owner = _owner(rules)
    short = short_lists(_usable(rules), F.struct("pos", "domain", "match_type", F.col("score").cast("double").alias("score")), "_rules") if owner else None
    if short is not None:
        host, key = F.col("from_domain"), lambda r: F.lower(r["domain"])
        hits = F.filter("_rules", lambda r: (key(r) == host) | ((r["match_type"] == "suffix") & F.endswith(host, F.concat(F.lit("."), key(r)))))
        found = F.transform(hits, lambda r: F.struct(r["domain"].alias("domain"), r["match_type"].alias("match_type"), r["score"].alias("score")))
        return (facts.join(F.broadcast(short), owner, "left")  # SMALL_ROWS and SMALL_TEXT at most
                .withColumn("sender_hits", F.coalesce(found, F.array().cast(HITS_DDL))).drop("_rules"))
    hosts = facts.select(*owner, F.col("from_domain").alias("host"))
    matches = suffix_matches(hosts, rules).withColumnRenamed("host", "from_domain")
    joined = salted_join(facts, matches, [*owner, "from_domain"], F.col("msg_id"))
    return joined.withColumn("sender_hits", F.coalesce("sender_hits", F.array().cast(HITS_DDL)))


def with_whitelist_hit(facts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Add ``whitelist_hit``: the first whitelist entry, as written, that equals the sender's address.

    ``whitelist([account_id,] pos, value, match_type)``; only ``exact`` entries count.
    """
    owner = _owner(whitelist)
    first = (whitelist.where("match_type = 'exact'")
             .groupBy(*owner, F.lower("value").alias("sender_address")).agg(F.min_by("value", "pos").alias("whitelist_hit")))
    named = first.where("sender_address IS NOT NULL")
    short = short_lists(named, F.struct("sender_address", "whitelist_hit"), "_first") if owner else None
    if short is not None:
        return (facts.join(F.broadcast(short), owner, "left")  # SMALL_ROWS and SMALL_TEXT at most
                .withColumn("whitelist_hit", F.get(F.filter("_first", lambda e: e["sender_address"] == F.col("sender_address")), F.lit(0))["whitelist_hit"]).drop("_first"))
    return salted_join(facts, first, [*owner, "sender_address"], F.col("msg_id"))


def with_trusted_ids(messages: DataFrame, trust: DataFrame) -> DataFrame:
    """Add ``trusted_ids``: the servers named in a message's result headers that an entry covers.

    ``trust([account_id,] value, match_type)``. Messages that name the same servers are resolved
    together, and the messages themselves are never exploded.
    """
    from headrisk.operators.auth import named_servers
    owner = _owner(trust)
    named = messages.withColumn("_servers", named_servers(F.col("headers")))
    rules = trust.where(F.col("match_type").isin("exact", "domain")).select(
        *owner, F.lower("value").alias("_key"), (F.col("match_type") == "domain").alias("_below")).distinct()
    short = short_lists(rules, F.struct("_key", "_below"), "_trusted") if owner else None
    if short is not None:
        covers = lambda r, s: (r["_key"] == s) | (r["_below"] & F.endswith(s, F.concat(F.lit("."), r["_key"])))
        hits = F.filter("_servers", lambda s: F.exists("_trusted", lambda r: covers(r, s)))
        return (named.join(F.broadcast(short), owner, "left")  # SMALL_ROWS and SMALL_TEXT at most
                .withColumn("trusted_ids", F.coalesce(hits, F.array().cast("array<string>"))).drop("_servers", "_trusted"))
    sets = named.select(*owner, "_servers").where(F.size("_servers") > 0).distinct()
    ids = sets.select("*", F.explode("_servers").alias("_id")).select("*", F.explode(dot_suffixes(F.col("_id"))).alias("_key"))
    covered = (salted_join(ids, rules, [*owner, "_key"], F.col("_id"), "inner")
               .where(F.col("_below") | (F.col("_key") == F.col("_id")))
               .groupBy(*owner, "_servers").agg(F.collect_set("_id").alias("trusted_ids")))  # at most the set itself
    return (salted_join(named, covered, [*owner, "_servers"], F.col("msg_id"))
            .withColumn("trusted_ids", F.coalesce("trusted_ids", F.array().cast("array<string>"))).drop("_servers"))
