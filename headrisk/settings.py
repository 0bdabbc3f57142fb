"""One settings snapshot per run: score weights, trust lists and user rules.

Weights and short lists are constants of the plan. Lists with more than ``LITERAL_MAX`` entries become
tables that are joined (``operators.lookups``), and so are the settings of many accounts in one run
(``operators.owners``). Reading, merging and migrating tables is in ``operators.settings``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.domains import dot_suffixes

SETTINGS_ROWS_MAX = 100_000
#: Entries of a list that stand in the plan; a longer list is joined as a table.
LITERAL_MAX = 200


@dataclass(frozen=True)
class Settings:
    trusted_servers: tuple = ()          # (value, match_type)
    sender_rules: tuple = ()             # (domain, match_type, score) in user order
    whitelist: tuple = ()                # (value, match_type) in user order
    formulas: tuple = ()                 # (id, name, expression, mode) in user order
    auth_scores: dict = field(default_factory=lambda: C.AUTH_SCORES)
    identity_scores: dict = field(default_factory=dict)
    heuristic_scores: dict = field(default_factory=dict)
    composite_scores: dict = field(default_factory=dict)
    whitelist_score: float = C.WHITELIST_SCORE
    address_book_score: float = C.ADDRESS_BOOK_SCORE
    address_book_enabled: bool = False
    move_to_review: bool = True
    move_high_risk_to_junk: bool = False
    alert_enabled: bool = False
    alert_max_score: float = C.ALERT_MAX_SCORE
    alert_delay_ms: int = C.ALERT_DELAY_MS
    alert_interval_ms: int = C.ALERT_INTERVAL_MS

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    # ---- weights, always merged over the defaults
    def identity(self, key: str) -> float:
        return float({**C.IDENTITY_SCORES, **self.identity_scores}[key])

    def heuristic(self, key: str) -> float:
        return float({**C.HEURISTIC_SCORES, **self.heuristic_scores}[key])

    def composite(self, key: str) -> float:
        return float({**C.COMPOSITE_SCORES, **self.composite_scores}[key])

    def composites(self) -> dict:
        return {**C.COMPOSITE_SCORES, **self.composite_scores}

    def auth_weights(self) -> Column:
        """``method.result`` -> weight, as a constant map."""
        entries = [(f"{m}.{r}", float(w)) for m, rs in self.auth_scores.items() for r, w in rs.items()]
        return F.create_map(*[F.lit(v) for pair in entries for v in pair])

    # ---- trust
    def valid_trusted(self) -> list:
        return [(v.lower(), t) for v, t in self.trusted_servers
                if isinstance(v, str) and t in ("exact", "domain")]

    def is_trusted(self, server: Column) -> Column:
        """Equal to a trusted value, or below a trusted domain."""
        exact = [v for v, _t in self.valid_trusted()]
        domains = [v for v, t in self.valid_trusted() if t == "domain"]
        server = F.lower(server)
        hit = server.isin(exact) if exact else F.lit(False)
        if domains:
            hit = hit | F.exists(dot_suffixes(server), lambda s: s.isin(domains))
        return F.coalesce(hit, F.lit(False))

    def header_trust(self, server: Column) -> Column:
        """Trust of a server named by a message; long lists need ``trusted_ids`` (``with_trusted_ids``)."""
        if is_long(self.trusted_servers):
            return F.coalesce(F.array_contains(F.col("trusted_ids"), F.lower(server)), F.lit(False))
        return self.is_trusted(server)

    # ---- user rules
    def whitelist_hit(self, sender: Column) -> Column | None:
        """First whitelist entry, as written, that equals the sender; None without entries."""
        if is_long(self.whitelist):
            return F.col("whitelist_hit")
        first: dict = {}
        for value, match_type in self.whitelist:
            if match_type == "exact":
                first.setdefault(value.lower(), value)
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), sender) if first else None

    def sender_hits(self, domain: Column) -> Column | None:
        """Sender rules that match the domain, in user order; None without rules."""
        if is_long(self.sender_rules):
            return F.col("sender_hits")
        if not self.sender_rules:
            return None
        rules = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(t).alias("match_type"), F.lit(float(score)).alias("score"))
                          for d, t, score in self.sender_rules if t in ("exact", "suffix")])
        return F.filter(rules, lambda r: F.coalesce(
            (domain == F.lower(r["domain"]))
            | ((r["match_type"] == "suffix") & domain.endswith(F.concat(F.lit("."), F.lower(r["domain"])))),
            F.lit(False)))


def is_long(entries: tuple) -> bool:
    return len(entries) > LITERAL_MAX


def bounded_rows(df: DataFrame) -> list:
    """Rows of a settings table; refuses anything that is not settings-sized."""
    rows = df.limit(SETTINGS_ROWS_MAX + 1).collect()
    if len(rows) > SETTINGS_ROWS_MAX:
        raise ValueError(f"more than {SETTINGS_ROWS_MAX} settings rows")
    return rows


def settings_from_tables(weights: DataFrame | None = None, trusted: DataFrame | None = None,
                         sender_rules: DataFrame | None = None, whitelist: DataFrame | None = None,
                         formulas: DataFrame | None = None, **options) -> Settings:
    """Snapshot of settings tables: ``weights(group, key, weight)``, ``trusted(value, match_type)``,
    ``sender_rules(pos, domain, match_type, score)``, ``whitelist(pos, value, match_type)`` and
    ``formulas(pos, id, name, expression, mode)``."""
    groups: dict = {"auth": {}, "identity": {}, "heuristic": {}, "composite": {}}
    for r in bounded_rows(weights) if weights is not None else ():
        if r["group"] == "auth":
            method, result = r["key"].split(".", 1)
            groups["auth"].setdefault(method, {})[result] = r["weight"]
        else:
            groups[r["group"]][r["key"]] = r["weight"]
    auth = {m: {**C.AUTH_SCORES.get(m, {}), **groups["auth"].get(m, {})}
            for m in {**C.AUTH_SCORES, **groups["auth"]}}

    def in_order(df, *cols):
        if df is None:
            return ()
        return tuple(tuple(r[c] for c in cols) for r in sorted(bounded_rows(df), key=lambda r: r["pos"]))
    return Settings(
        trusted_servers=tuple((r["value"], r["match_type"]) for r in bounded_rows(trusted)) if trusted is not None else (),
        sender_rules=in_order(sender_rules, "domain", "match_type", "score"),
        whitelist=in_order(whitelist, "value", "match_type"),
        formulas=in_order(formulas, "id", "name", "expression", "mode"),
        auth_scores=auth, identity_scores=groups["identity"],
        heuristic_scores=groups["heuristic"], composite_scores=groups["composite"], **options)
