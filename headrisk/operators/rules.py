"""Scoring rules: every rule is one predicate over facts that yields a reason or nothing.

All rules of a message are evaluated in one projection; the order of the reasons is the order
of evaluation, layer by layer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions import text as T
from headrisk.functions.domains import domain_core
from headrisk.functions.names import embedded_domains, normalise, words
from headrisk.operators.facts import mailbox_provider
from headrisk.settings import Settings

REASON_DDL = "struct<layer:string,key:string,label:string,delta:double,ctx:map<string,string>>"


def reason(layer: str, key, delta, label=None, ctx: dict | None = None) -> Column:
    """A reason row; context values that are null are left out."""
    text = label if label is not None else C.reason_label(key)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
                        for k, v in (ctx or {}).items()]) if ctx else None
    pairs = (F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())) if ctx
             else F.create_map().cast("map<string,string>"))
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(layer).alias("layer"), as_col(key).alias("key"), as_col(text).alias("label"),
                    as_col(delta).cast("double").alias("delta"), pairs.alias("ctx"))


def when(predicate: Column, value: Column) -> Column:
    return F.when(F.coalesce(predicate, F.lit(False)), value)


def _joined(array: Column) -> Column:
    return F.array_join(array, ", ")


def auth_reasons(settings: Settings) -> Column:
    """Layer 1: one reason per untrusted header and per known result of a trusted header."""
    weights = settings.auth_weights()
    untrusted = lambda a: F.array(reason("L1", "authserv.untrusted", 0, ctx={"authserv_id": a["authserv_id"]}))

    def scored(a: Column) -> Column:
        found = F.transform(a["results"], lambda r: F.when(
            F.map_contains_key(weights, F.concat_ws(".", r["method"], r["result"])),
            reason("L1", F.concat_ws(".", F.lit("auth"), r["method"], r["result"]),
                   F.try_element_at(weights, F.concat_ws(".", r["method"], r["result"])),
                   label=F.concat_ws(" ", F.upper(r["method"]), r["result"]),
                   ctx={"authserv_id": a["authserv_id"], "method": r["method"], "result": r["result"]})))
        return F.filter(found, lambda x: x.isNotNull())
    return F.flatten(F.transform("auth", lambda a: F.when(a["trusted"], scored(a)).otherwise(untrusted(a))))


def identity_rules(settings: Settings) -> list[Column]:
    """Layer 2: who the passing results vouch for."""
    from_reg = F.col("from_parts.registrable_domain")
    base = {"from_domain": F.col("from_domain"), "from_registrable_domain": from_reg}
    foreign, signers = F.col("foreign"), F.col("foreign.signers")
    third = F.col("third_party")
    dkim_aligned = F.col("alignment.any_dkim_aligned")
    return [
        when(from_reg.isNotNull() & ~dkim_aligned & foreign["mail_from_domain"].isNotNull(),
             reason("L2", "identity.spfMailFromMismatch", settings.identity("spfMailFromMismatch"),
                    ctx={**base, "smtp_mail_from_domain": foreign["mail_from_domain"],
                         "smtp_mail_from_registrable_domain": foreign["mail_from_registrable_domain"]})),
        when(from_reg.isNotNull() & ~dkim_aligned & (F.size(signers) > 0),
             reason("L2", "identity.dkimDomainMismatch", settings.identity("dkimDomainMismatch"),
                    ctx={**base, "dkim_domains": _joined(signers)})),
        when(from_reg.isNotNull() & third["dmarc_none_or_absent"] & third["any_pass"] & ~third["any_aligned"],
             reason("L2", "identity.dmarcNoneWithThirdPartyAuth",
                    settings.identity("dmarcNoneWithThirdPartyAuth"),
                    ctx={**base, "dmarc_result": third["dmarc_result"],
                         "third_party_domains": _joined(third["third_party_domains"])})),
    ]


def heuristic_rules(settings: Settings) -> list[Column]:
    """Layer 3: random-looking sender names; deltas are uncapped here."""
    return [
        when(F.col("random_label").isNotNull(),
             reason("L3", "heuristic.randomFromDomainLabel", settings.heuristic("randomFromDomainLabel"),
                    ctx={"domain": F.col("from_domain"), "matched_label": F.col("random_label")})),
        when(F.col("random_local"),
             reason("L3", "heuristic.randomFromLocalPart", settings.heuristic("randomFromLocalPart"))),
    ]


def lexical_penalty(settings: Settings) -> Column:
    """The capped layer adds to the score, through a reason with a positive delta."""
    label, local = (settings.heuristic(k) for k in ("randomFromDomainLabel", "randomFromLocalPart"))
    total = (F.when(F.col("random_label").isNotNull(), label).otherwise(0.0)
             + F.when(F.col("random_local"), local).otherwise(0.0))
    return ((F.least(total, F.lit(settings.heuristic("layer3Cap"))) > 0)
            & ((F.col("random_label").isNotNull() & F.lit(label > 0))
               | (F.col("random_local") & F.lit(local > 0))))


def composite_rules(settings: Settings) -> list[Column]:
    """Layer 4: combinations of facts, in evaluation order."""
    al, hf, mid = (lambda c: F.col(f"alignment.{c}")), (lambda c: F.col(f"header_facts.{c}")), F.col("message_id_facts")
    domain, local, parts = F.col("from_domain"), F.col("from_local"), F.col("from_parts")
    from_reg = parts["registrable_domain"]
    spf, dkim, aligned = al("spf_aligned"), al("any_dkim_aligned"), al("any_auth_aligned")
    passed, listed = al("any_trusted_auth_pass"), hf("has_list_headers")
    random_local = (F.length(local) >= 7) & F.col("random_local")
    mid_reg, spf_reg = mid["message_id_registrable_domain"], al("spf_mail_from_registrable_domain")
    depth, fails = parts["subdomain_depth"], _joined(al("dkim_fail_domains"))

    def fire(key: str, predicate: Column, **ctx: Column) -> Column:
        return when(predicate, reason("L4", f"composite.{key}", settings.composite(key), ctx=ctx))

    unregistrable = (mid["message_id_domain"].isNotNull() & mid_reg.isNull() & from_reg.isNotNull()
                     & al("any_trusted_spf_pass") & ~dkim & (mid["message_id_domain"] != domain))
    delegated = dkim & ~spf & (mid_reg == spf_reg) & listed
    leftmost = F.substring_index(domain, ".", 1)
    main_label = F.substring_index(from_reg, ".", 1)
    core = domain_core(parts)
    geo = F.get(F.filter(F.split(core, "-"), lambda t: t.isin(C.GEO_TOKENS)), F.lit(0))
    sub_labels = F.split(parts["subdomain"], r"\.")
    service = F.get(F.filter(F.slice(sub_labels, F.lit(2), F.greatest(F.size(sub_labels), F.lit(1))),
                             lambda x: x.isin(C.SERVICE_LABELS) | x.rlike("^mail-[0-9]+$")), F.lit(0))
    own = F.array_contains(F.col("account_domains"), from_reg)
    infrastructure = {"sender_registrable_domain": hf("sender_registrable_domain"),
                      "return_path_registrable_domain": hf("return_path_registrable_domain"),
                      "message_id_domain": mid["message_id_domain"]}
    return [
        fire("spfAlignedDkimUnalignedRandomLocal", spf & ~dkim & random_local, local_part=local),
        fire("authAlignedRandomDomain", aligned & F.col("random_label").isNotNull(),
             domain=domain, matched_label=F.col("random_label")),
        fire("thirdPartyAuthRandomLocal", passed & ~aligned & random_local, local_part=local),
        fire("messageIdMismatchWithUnalignedAuth", mid["message_id_mismatch_with_unaligned_auth"],
             message_id_domain=mid["message_id_domain"], message_id_registrable_domain=mid_reg, from_domain=domain),
        fire("messageIdUnregistrableMismatch", unregistrable,
             from_domain=domain, message_id_domain=mid["message_id_domain"]),
        fire("deepRandomFromSubdomain", aligned & (depth >= 2) & T.is_random_label(leftmost),
             from_domain=domain, subdomain_depth=depth, matched_label=leftmost, registrable_domain=from_reg),
        fire("unsecuredDeepSubdomain",
             ~aligned & al("any_trusted_dmarc_none") & ~al("any_trusted_dmarc_non_none") & (depth >= 2),
             from_domain=domain, subdomain_depth=depth, registrable_domain=from_reg),
        fire("spfPassDkimFailRandomLocal",
             al("any_trusted_spf_pass") & al("any_trusted_dkim_fail") & ~dkim & random_local,
             local_part=local, dkim_fail_domains=fails),
        fire("fromSenderMismatchWithUnalignedAuth",
             ~hf("sender_domain_matches_from_domain") & ~aligned & ~listed,
             sender_registrable_domain=hf("sender_registrable_domain"), from_domain=domain),
        fire("delegatedDkimAlignedRouteConsistent", delegated, from_domain=domain,
             message_id_registrable_domain=mid_reg, spf_mail_from_registrable_domain=spf_reg),
        fire("dkimAlignedLexicalMitigation",
             delegated & lexical_penalty(settings) & ~F.coalesce(unregistrable, F.lit(False))
             & ~T.is_random_label(main_label),
             from_domain=domain, from_registrable_domain=from_reg,
             message_id_registrable_domain=mid_reg, spf_mail_from_registrable_domain=spf_reg),
        fire("ownDomainAuthFail", own & (al("any_trusted_dmarc_fail") | al("any_trusted_spf_fail")),
             from_domain=domain, account_domain=from_reg,
             dmarc_result=F.when(al("any_trusted_dmarc_fail"), "fail"),
             spf_result=F.when(al("any_trusted_spf_fail"), "fail")),
        fire("dmarcFailDkimAlignedListMitigation", al("any_trusted_dmarc_fail") & dkim & listed),
        fire("geoTokenCompoundDomain", passed & ~dkim & core.contains("-") & geo.isNotNull(),
             from_domain=domain, registrable_domain=from_reg, registrable_domain_core=core, matched_token=geo),
        fire("deepServiceWordSubdomain", passed & ~dkim & (depth >= 2) & service.isNotNull(),
             from_domain=domain, subdomain_depth=depth, matched_label=service,
             leftmost_label=F.get(sub_labels, F.lit(0)), registrable_domain=from_reg),
        fire("dkimFailWithAlignedPass", al("any_trusted_dkim_fail") & dkim, dkim_fail_domains=fails),
        fire("unparseableFromWithInfrastructureMismatch",
             domain.isNull() & ~passed & F.coalesce(*infrastructure.values()).isNotNull(), **infrastructure),
        _brand_divergence(settings),
    ]


def _brand_divergence(settings: Settings) -> Column:
    names, parts = F.col("name_facts"), F.col("from_parts")
    brand = names["inferred_brand_domain"]
    # brand domains are fixed, so their cores are too: all but the last are "core.tld"
    brand_core = F.when(brand == "dai-ichi-life.co.jp", "dai-ichi-life").otherwise(F.substring_index(brand, ".", 1))
    suffix = parts["public_suffix"]
    regional = (~parts["is_private"] & parts["is_icann"] & (domain_core(parts) == brand_core)
                & (suffix.contains(".") | ((F.length(suffix) == 2) & ~suffix.isin(C.GENERIC_USE_CCTLDS))))
    w = words(names["display_name_raw"])
    personal = names["display_name_brand_like_shape"] == F.lit(False)
    service = (F.size(w) == 2) & F.lower(F.get(w, F.lit(1))).isin(C.BRAND_SERVICE_WORDS)
    covers = F.try_divide(F.length(normalise(brand_core)), F.length(names["display_name_normalized"])) >= 0.8
    guard = ~F.coalesce(personal, F.lit(False)) | service | F.coalesce(covers, F.lit(False))
    spaced = names["display_name_spaced_camouflage"]
    return when(
        names["brand_domain_mismatch"] & (names["inferred_brand_score"] >= C.BRAND_MIN_SCORE)
        & ~F.coalesce(regional, F.lit(False)) & guard,
        reason("L4", "composite.brandDivergencePhishing", settings.composite("brandDivergencePhishing"),
               ctx={"inferred_brand_domain": brand, "inferred_brand_score": names["inferred_brand_score"],
                    "display_name_spaced_camouflage": F.when(spaced, "true"),
                    "display_name_raw": F.when(spaced, names["display_name_raw"])}))


def consistency_rules(settings: Settings, need_trusted: bool = False) -> list[Column]:
    """Layer 4, continued: agreement of sender identifiers on equal host names.

    ``need_trusted`` makes the spoof rule wait for a trusted header.
    """
    domain, exact = F.col("from_domain"), F.col("exact")
    mid, hf = F.col("message_id_facts.message_id_domain"), (lambda c: F.col(f"header_facts.{c}"))
    psl_aligned = F.col("alignment.any_auth_aligned")
    any_trusted = F.exists("auth", lambda a: a["trusted"])
    contributors = F.array_compact(F.array(
        F.when(mid != domain, "messageId.domainMismatch"),
        F.when(hf("reply_to_domain") != domain, "replyTo.domainMismatch"),
        F.when(hf("return_path_domain") != domain, "returnPath.domainMismatch"),
        F.when(exact["mail_from_mismatch"], "smtpMailfrom.domainMismatch"),
        F.when(exact["header_from_mismatch"], "dmarc.headerFromMismatch")))
    only_mid = (F.size(contributors) == 1) & (F.get(contributors, F.lit(0)) == "messageId.domainMismatch")
    embedded = embedded_domains(F.col("display_name"))
    foreign = F.filter(embedded, lambda d: d != domain)
    family = mailbox_provider(domain)

    def other_family(host: Column) -> Column:
        return F.coalesce(mailbox_provider(host) != family, F.lit(False))
    spoof = domain.isNotNull() & ~exact["aligned"] & (F.size(contributors) > 0) & ~only_mid & ~psl_aligned
    return [
        when(spoof & (any_trusted if need_trusted else F.lit(True)),
             reason("L4", "composite.unauthenticatedFromSpoof", settings.composite("unauthenticatedFromSpoof"),
                    ctx={"from_domain": domain, "contributing_signals": _joined(contributors)})),
        when(exact["aligned"] & (F.size(foreign) > 0),
             reason("L4", "composite.authenticatedDisplayNameSpoof",
                    settings.composite("authenticatedDisplayNameSpoof"),
                    ctx={"from_domain": domain, "embedded_domains": _joined(embedded),
                         "mismatched_domains": _joined(foreign)})),
        when(exact["aligned"] & (F.size(contributors) == 0) & ~exact["any_fail"]
             & (F.coalesce(F.size(foreign), F.lit(0)) <= 0),
             reason("L4", "composite.alignedAuthenticationConfirmed", 0, ctx={"from_domain": domain})),
        when(domain.isin(list(C.MAILBOX_PROVIDERS)) & any_trusted & ~exact["aligned"] & ~psl_aligned
             & ~F.col("alignment.any_trusted_dmarc_pass")
             & (other_family(hf("return_path_domain")) | other_family(mid)),
             reason("L4", "composite.publicDomainSpoofing", settings.composite("publicDomainSpoofing"),
                    ctx={"from_domain": domain, "provider": domain})),
    ]


def user_rules(settings: Settings) -> Column:
    """Layer 5 before formulas: whitelist, address book, then every matching sender rule."""
    sender, domain = F.col("sender_address"), F.col("from_domain")
    found = []
    hit, hits = settings.whitelist_hit(sender), settings.sender_hits(domain)
    if hit is not None:
        found.append(F.array_compact(F.array(when(hit.isNotNull(), reason(
            "L5", "whitelist.manual", settings.whitelist_score,
            ctx={"matched_value": hit, "match_type": F.lit("exact")})))))
    if settings.address_book_enabled:
        found.append(F.array_compact(F.array(when(F.col("in_address_book"), reason(
            "L5", "whitelist.addressBook", settings.address_book_score)))))
    if hits is not None:
        found.append(F.transform(hits, lambda r: reason(
            "L5", "sender.rule", r["score"], ctx={"domain": r["domain"], "match_type": r["match_type"]})))
    return F.concat(*found) if found else F.array().cast(f"array<{REASON_DDL}>")


# ---------------------------------------------------------------- fixed values: keys in evaluation order
IDENTITY_KEYS = ("identity.spfMailFromMismatch", "identity.dkimDomainMismatch", "identity.dmarcNoneWithThirdPartyAuth")
HEURISTIC_KEYS = ("heuristic.randomFromDomainLabel", "heuristic.randomFromLocalPart")
COMPOSITE_KEYS = tuple(f"composite.{k}" for k in (
    "spfAlignedDkimUnalignedRandomLocal", "authAlignedRandomDomain", "thirdPartyAuthRandomLocal", "messageIdMismatchWithUnalignedAuth",
    "messageIdUnregistrableMismatch", "deepRandomFromSubdomain", "unsecuredDeepSubdomain", "spfPassDkimFailRandomLocal",
    "fromSenderMismatchWithUnalignedAuth", "delegatedDkimAlignedRouteConsistent", "dkimAlignedLexicalMitigation", "ownDomainAuthFail",
    "dmarcFailDkimAlignedListMitigation", "geoTokenCompoundDomain", "deepServiceWordSubdomain", "dkimFailWithAlignedPass",
    "unparseableFromWithInfrastructureMismatch", "brandDivergencePhishing", "unauthenticatedFromSpoof", "authenticatedDisplayNameSpoof",
    "alignedAuthenticationConfirmed", "publicDomainSpoofing"))
FIXED_KEYS = IDENTITY_KEYS + HEURISTIC_KEYS + COMPOSITE_KEYS


def fixed_rules(settings: Settings, need_trusted: bool = False) -> dict[str, Column]:
    """Key -> reason or null, for the rules of layers two to four, in evaluation order."""
    columns = [*identity_rules(settings), *heuristic_rules(settings), *composite_rules(settings),
               *consistency_rules(settings, need_trusted)]
    return dict(zip(FIXED_KEYS, columns, strict=True))


@dataclass(frozen=True)
class Rule:
    """A rule of the caller's own: a predicate over facts with its weight.

    ``predicate`` and ``context`` are called when a plan is built, and give a column and named columns.
    """

    key: str
    layer: str
    predicate: Callable[[], Column]
    delta: float
    title: str
    context: Callable[[], dict[str, Column]] = dict
    type: str = "risk"

    def __post_init__(self) -> None:
        if self.layer not in C.LAYERS:
            raise ValueError(f"{self.key}: no layer {self.layer}")

    def reason(self) -> Column:
        return when(self.predicate(), reason(self.layer, self.key, self.delta, label=self.title, ctx=self.context()))


@dataclass(frozen=True)
class RuleSet:
    """The standard rules without some of them, and rules of the caller's own after them."""

    left_out: frozenset[str] = frozenset()
    own: tuple[Rule, ...] = ()

    def without(self, *keys: str) -> RuleSet:
        unknown = set(keys) - set(FIXED_KEYS) - {r.key for r in self.own}
        if unknown:
            raise ValueError(f"no such rules: {sorted(unknown)}")
        return RuleSet(self.left_out | (set(keys) & set(FIXED_KEYS)), tuple(r for r in self.own if r.key not in keys))

    def with_rule(self, *rules: Rule) -> RuleSet:
        keys = [*FIXED_KEYS, *(r.key for r in self.own), *(r.key for r in rules)]
        repeated = {k for k in keys if keys.count(k) > 1}
        if repeated:
            raise ValueError(f"keys are taken: {sorted(repeated)}")
        return RuleSet(self.left_out, self.own + rules)

    def reasons(self, settings: Settings, need_trusted: bool = False) -> list[Column]:
        kept = [c for k, c in fixed_rules(settings, need_trusted).items() if k not in self.left_out]
        return kept + [r.reason() for r in self.own]

    def table(self, spark: SparkSession) -> DataFrame:
        """``(key, layer, title, type, standard)`` in evaluation order, with the place."""
        known = {k: (t, ty) for k, t, ty, _s in C.RULES}
        layer = lambda k: {"identity": "L2", "heuristic": "L3"}.get(k.split(".")[0], "L4")
        rows = [(k, layer(k), *known[k], True) for k in FIXED_KEYS if k not in self.left_out]
        rows += [(r.key, r.layer, r.title, r.type, False) for r in self.own]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, key string, layer string, title string, type string, standard boolean")


STANDARD = RuleSet()


def all_reasons(settings: Settings, need_trusted: bool = False, rule_set: RuleSet = STANDARD) -> Column:
    """Reasons of all layers in evaluation order, before custom formulas."""
    fixed = F.array_compact(F.array(*rule_set.reasons(settings, need_trusted)))
    return F.concat(auth_reasons(settings), fixed, user_rules(settings))
