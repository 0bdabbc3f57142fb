"""Facts of every message in one narrow pass: no join and no shuffle.

Facts come in groups; a job that names the groups it reads computes no others.

All hosts of a message are collected into one small array and resolved together, so the
suffix rules appear once in the plan however many headers a message has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrisk.constants import HEADER_TEXT_MAX, MAILBOX_PROVIDERS
from headrisk.functions import address as A
from headrisk.functions import names as N
from headrisk.functions import text as T
from headrisk.functions.binding import computed, let
from headrisk.functions.domains import SuffixRules, domain_core, domain_parts_of, dot_suffixes
from headrisk.functions.jaro import BRAND_DDL, infer_brand
from headrisk.operators import auth
from headrisk.settings import Settings

MESSAGE_COLUMNS = ["msg_id", "account_id", "folder_id", "folder_name", "folder_path", "folder_type",
                   "junk", "sent_at", "received_at", "subject", "params"]


def lower_header_names(headers: Column) -> Column:
    """Header map with lowercased names; values of names equal after folding are joined in order."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = F.transform(names, lambda n: F.flatten(F.transform(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])))
    return F.map_from_arrays(names, values)


def headers_from_pairs(pairs: Column) -> Column:
    """The same map from an array of ``{name, value}``."""
    names = F.array_distinct(F.transform(pairs, lambda p: F.lower(p["name"])))
    values = F.transform(names, lambda n: F.transform(
        F.filter(pairs, lambda p: F.lower(p["name"]) == n), lambda p: p["value"]))
    return F.map_from_arrays(names, values)


def message_identity(messages: DataFrame) -> DataFrame:
    h = F.col("headers")
    return messages.select(
        "msg_id",
        A.strip(A.header(h, "message-id")).alias("rfc_message_id"),
        F.col("account_id").alias("initial_account_id"), F.col("folder_id").alias("initial_folder_id"),
        F.col("folder_name").alias("initial_folder_name"), F.col("folder_path").alias("initial_folder_path"),
        F.col("folder_type").alias("initial_folder_type"), "subject",
        A.header(h, "from").alias("from"), A.header(h, "date").alias("date"))


def sender_columns(address: Column) -> dict[str, Column]:
    """Domain, local part and address of a parsed From address."""
    domain = A.filled(F.split_part(address, F.lit("@"), F.lit(2)))
    local = A.filled(F.split_part(address, F.lit("@"), F.lit(1)))
    return {"from_domain": domain, "from_local": local,
            "sender_address": F.when(domain.isNotNull(), F.concat_ws("@", local, domain))}


def mailbox_provider(host: Column) -> Column:
    """Provider family of a public mailbox host or of a host below one."""
    families = F.create_map(*[F.lit(v) for kv in MAILBOX_PROVIDERS.items() for v in kv])
    hits = F.transform(dot_suffixes(host), lambda s: F.try_element_at(families, s))
    return F.get(F.filter(hits, lambda p: p.isNotNull()), F.lit(0))


#: Host of a display name that is an address.
EMAIL_HOST = "substring(name_email, instr(name_email, '@') + 1)"


def _parts(host: str) -> Column:
    return F.expr(f"try_element_at(parts, {host})")


#: Groups of facts, with the groups they build on.
GROUPS = {"headers": (), "alignment": (), "message_id": ("alignment",), "lexical": (), "names": (), "brands": ("names",)}
ALL_GROUPS = tuple(GROUPS)


def with_facts(messages: DataFrame, settings: Settings, rules: SuffixRules, groups: tuple[str, ...] = ALL_GROUPS) -> DataFrame:
    """Add sender, authentication, header, Message-ID, lexical and display-name facts to messages.

    Sender and authentication results are always there; the rest only if its group is among ``groups``:
    ``headers`` (header_facts), ``alignment`` (alignment, third_party, exact, foreign), ``message_id``
    (message_id_facts), ``lexical`` (random_local, random_label), ``names`` (name_facts) and ``brands``
    (the brand fields of name_facts, else null: the only step that leaves the JVM).
    """
    unknown = set(groups) - GROUPS.keys()
    if unknown:
        raise ValueError(f"unknown groups of facts: {sorted(unknown)}")
    wanted = {*groups, *(need for g in groups for need in GROUPS[g])}
    kept = [c for c in MESSAGE_COLUMNS if c in messages.columns]
    h = F.col("headers")
    from_h = A.header(h, "from")
    hosts_of = ["from"] + ["sender", "reply_to", "return_path"] * ("headers" in wanted) + ["message_id"] * ("message_id" in wanted)
    own = messages.select(
        *kept,
        from_h.alias("from_header"),
        A.mailbox_address(from_h).alias("from_address"),
        A.strip(A.header(h, "message-id")).alias("rfc_message_id"),
        A.message_id_domain(A.header(h, "message-id")).alias("message_id_domain"),
        *([A.mailbox_address(A.header(h, "sender")).alias("sender_full"),
           A.mailbox_address(A.header(h, "reply-to")).alias("reply_to_full"),
           A.mailbox_address(A.header(h, "return-path")).alias("return_path_full"),
           F.left(A.filled(A.strip(A.header(h, "list-id"))), F.lit(HEADER_TEXT_MAX)).alias("list_id"),
           F.left(A.filled(A.strip(A.header(h, "list-unsubscribe"))), F.lit(HEADER_TEXT_MAX)).alias("list_unsubscribe")]
          if "headers" in wanted else []),
        N.display_name(from_h).alias("display_name"),
        auth.parse_auth_results(h, settings).alias("auth"),
    )
    named = own.select(
        "*",
        *[c.alias(n) for n, c in sender_columns(F.col("from_address")).items()],
        A.parse_from(F.col("from_header"), F.col("from_address")).alias("from_parse"),
        *[A.after_at(F.col(f"{n}_full")).alias(f"{n}_domain") for n in hosts_of if n not in ("from", "message_id")],
        *([F.when(N.is_email_shaped(F.col("display_name")), F.lower(A.strip(F.col("display_name")))).alias("name_email")]
          if "names" in wanted else []),
    )
    results_hosts = """flatten(transform(auth, a -> flatten(transform(a.results, r ->
            array(r.mail_from_domain, r.helo_domain, r.header_from_domain, r.signing_domain)))))"""
    single = [f"{n}_domain" for n in hosts_of] + [f"{EMAIL_HOST}"] * ("names" in wanted)
    needed = f"array({', '.join(single)})" + (f", {results_hosts}" if "alignment" in wanted else "")
    hosts = named.select("*", F.expr(f"array_distinct(array_compact(concat({needed})))").alias("hosts"))
    resolved = computed(hosts, F.map_from_arrays(F.col("hosts"), domain_parts_of("hosts", rules)).alias("parts")).drop("hosts")
    looked_up = computed(
        resolved,
        _parts("from_domain").alias("from_parts"),
        *([_parts("message_id_domain").alias("message_id_parts")] if "message_id" in wanted else []),
        *([_parts(EMAIL_HOST).alias("name_email_parts")] if "names" in wanted else []),
        *([header_facts().alias("header_facts")] if "headers" in wanted else []),
        *([F.expr("""
          flatten(transform(filter(auth, a -> a.trusted), a -> transform(a.results, r -> named_struct(
            'ar_pos', a.ar_pos, 'res_pos', r.res_pos, 'authserv_id', a.authserv_id,
            'method', r.method, 'result', r.result,
            'mail_from_domain', r.mail_from_domain,
            'mail_from_reg', try_element_at(parts, r.mail_from_domain).registrable_domain,
            'mail_from_depth', try_element_at(parts, r.mail_from_domain).subdomain_depth,
            'helo_reg', try_element_at(parts, r.helo_domain).registrable_domain,
            'header_from_domain', r.header_from_domain,
            'header_from_reg', try_element_at(parts, r.header_from_domain).registrable_domain,
            'signing_domain', r.signing_domain,
            'signing_reg', try_element_at(parts, r.signing_domain).registrable_domain,
            'signing_depth', try_element_at(parts, r.signing_domain).subdomain_depth))))
          """).alias("results")] if "alignment" in wanted else []),
    ).drop("parts")
    judgements = []
    if "alignment" in wanted:
        judgements += [auth.pass_alignment().alias("alignment"), auth.third_party_auth().alias("third_party"),
                       auth.exact_alignment().alias("exact"), auth.foreign_authentication().alias("foreign")]
    if "lexical" in wanted:
        judgements += [F.coalesce(T.is_random_local(F.col("from_local")), F.lit(False)).alias("random_local"),
                       T.first_random_label(F.col("from_domain")).alias("random_label")]
    aligned = computed(looked_up, *judgements) if judgements else looked_up
    header_scratch = [f"{n}_{x}" for n in ("sender", "reply_to", "return_path") for x in ("full", "domain")] + ["list_id", "list_unsubscribe"]
    facts = aligned.drop(*header_scratch)
    if "message_id" in wanted:
        facts = facts.withColumn("message_id_facts", message_id_facts())
    if "names" not in wanted:
        return facts
    core = N.normalise(domain_core(F.col("from_parts")))
    with_names = facts.select(
        "*",
        N.normalise(F.col("display_name")).alias("name_normalised"),
        F.when(F.col("display_name").isNotNull(), N.words(F.col("display_name"))).alias("name_words"),
        N.has_non_latin(F.col("display_name")).alias("name_non_latin"),
        let(core, lambda c: A.filled(c)).alias("domain_core"),
    )
    judged = with_names.select(
        "*",
        (F.when(F.col("display_name").isNull(), "missing_display_name")
         .when(F.col("name_non_latin"), "non_latin_display_name")
         .when(F.col("domain_core").isNull(), "missing_domain_core")
         .when((F.length("domain_core") < 3) | (F.length("name_normalised") < 3), "short_normalized"))
        .alias("name_reason"),
        N.is_spaced(F.col("name_words")).alias("name_spaced"),
        (infer_brand(F.when(~F.col("name_non_latin"), F.col("name_normalised"))) if "brands" in wanted
         else F.lit(None).cast(f"struct<{BRAND_DDL}>")).alias("brand"))
    scratch = {"name_normalised", "name_words", "name_non_latin", "domain_core", "name_reason", "name_spaced",
               "brand", "name_email", "name_email_parts"}
    return computed(judged, display_name_facts().alias("name_facts")).drop(*scratch)


def header_facts() -> Column:
    def of(name: str) -> list[Column]:
        reg = F.expr(f"try_element_at(parts, {name}_domain).registrable_domain")
        from_reg = F.expr("try_element_at(parts, from_domain).registrable_domain")
        return [
            F.left(F.col(f"{name}_full"), F.lit(HEADER_TEXT_MAX)).alias(f"{name}_header"),
            F.left(F.col(f"{name}_domain"), F.lit(HEADER_TEXT_MAX)).alias(f"{name}_domain"),
            reg.alias(f"{name}_registrable_domain"),
            F.expr(f"try_element_at(parts, {name}_domain).subdomain_depth").alias(f"{name}_subdomain_depth"),
            (reg == from_reg).alias(f"{name}_domain_matches_from_domain"),
        ]
    return F.struct(
        *of("sender"), *of("reply_to"), *of("return_path"), F.col("list_id"), F.col("list_unsubscribe"),
        (F.col("list_id").isNotNull() | F.col("list_unsubscribe").isNotNull()).alias("has_list_headers"))


def message_id_facts() -> Column:
    reg, from_reg = F.col("message_id_parts.registrable_domain"), F.col("from_parts.registrable_domain")
    differs = F.coalesce(reg != from_reg, F.lit(False))
    return F.struct(
        F.col("message_id_domain"),
        reg.alias("message_id_registrable_domain"),
        F.col("message_id_parts.is_icann").alias("message_id_is_icann"),
        F.col("message_id_parts.subdomain_depth").alias("message_id_subdomain_depth"),
        (reg == from_reg).alias("message_id_domain_matches_from_domain"),
        differs.alias("message_id_from_domain_mismatch"),
        (differs & ~F.col("alignment.any_auth_aligned")).alias("message_id_mismatch_with_unaligned_auth"))


def display_name_facts() -> Column:
    name, norm, core, reason = (F.col(c) for c in ("display_name", "name_normalised", "domain_core", "name_reason"))
    email_reg, from_reg = F.col("name_email_parts.registrable_domain"), F.col("from_parts.registrable_domain")
    return F.struct(
        name.alias("display_name_raw"),
        norm.alias("display_name_normalized"),
        F.col("name_spaced").alias("display_name_spaced_camouflage"),
        F.when(F.col("name_spaced"), F.array_join("name_words", "")).alias("display_name_compacted"),
        F.when(name.isNotNull(), core).alias("from_domain_core_normalized"),
        N.brand_like(F.col("name_words")).alias("display_name_brand_like_shape"),
        F.when(reason.isNull(), N.trigram_jaccard(norm, core)).alias("display_name_domain_similarity"),
        reason.isNull().alias("display_name_domain_metric_applicable"),
        reason.alias("display_name_domain_metric_not_applicable_reason"),
        F.col("brand.brand_domain").alias("inferred_brand_domain"),
        F.col("brand.brand_score").alias("inferred_brand_score"),
        F.when(F.col("brand.brand_domain").isNotNull(), from_reg != F.col("brand.brand_domain"))
        .alias("brand_domain_mismatch"),
        F.col("brand.brand_rank").alias("brand_inference_candidate_rank"),
        F.col("name_email").isNotNull().alias("display_name_looks_like_email"),
        F.col("name_email").alias("display_name_email_address"),
        F.expr(EMAIL_HOST).alias("display_name_email_domain"),
        (F.col("name_email") == F.col("from_parse.mailbox_address")).alias("display_name_email_matches_from_address"),
        (email_reg == from_reg).alias("display_name_email_domain_matches_from_domain"))


def heuristic_profile(facts: DataFrame, bigrams: list[float]) -> DataFrame:
    """Lexical profile of the local part and of every From domain label, in label order."""
    local = F.col("from_local")
    labels = F.filter(F.split("from_domain", r"\."), lambda x: x != "")
    return facts.select(
        "msg_id", "from_domain", F.col("from_parts").alias("domain_parts"),
        F.when(local.isNotNull(), let(T.letters_of(local), lambda letters: F.struct(
            local.alias("value"), F.length(letters).alias("length"),
            T.round3(T.entropy(letters)).alias("entropy"), T.round3(T.vowel_ratio(letters)).alias("vowel_ratio"),
            T.max_consonant_run(letters).alias("max_consonant_run"),
            T.core_lexical_metrics(local).alias("core"), T.lexical_metrics(local).alias("extra"),
            T.lexical_flags(T.lexical_metrics(local)).alias("flags")))).alias("from_local_part"),
        F.transform(labels, lambda x: F.struct(
            x.alias("label"), F.length(x).alias("length"), T.round3(T.entropy(x)).alias("entropy"),
            T.round3(T.vowel_ratio(x)).alias("vowel_ratio"), T.max_consonant_run(x).alias("max_consonant_run"),
            T.core_lexical_metrics(x).alias("core"), T.lexical_metrics(x).alias("extra"),
            T.lexical_flags(T.lexical_metrics(x))["hyphen_heavy_label"].alias("hyphen_heavy_label"),
            T.bigram_naturalness(x, bigrams).alias("bigrams"))).alias("from_domain_labels"))
