"""The derived mail and its assessment in DuckDB SQL, written as long tables and joins.

This is a second, independent formulation of what the Spark jobs compute over arrays. It knows
only the suffixes that occur in the derived data.
"""

from __future__ import annotations

from headrisk import constants as C
from headrisk.plans.derived_mail import mail_sql


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def reg(h: str) -> str:
    return (f"CASE WHEN {h} IS NULL OR {h} NOT LIKE '%.%' OR {h} = 'co.jp' THEN NULL "
            f"WHEN {h} LIKE '%.co.jp' THEN regexp_extract({h}, '([^.]+\\.co\\.jp)$', 1) "
            f"ELSE regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) END")


def suffix(h: str) -> str:
    return (f"CASE WHEN {h} IS NULL THEN NULL WHEN {h} = 'co.jp' OR {h} LIKE '%.co.jp' THEN 'co.jp' "
            f"ELSE regexp_extract({h}, '([^.]+)$', 1) END")


def dots(s: str) -> str:
    return f"(length({s}) - length(replace({s}, '.', '')))"


def depth(h: str) -> str:
    return f"CASE WHEN {h} IS NULL THEN NULL WHEN ({reg(h)}) IS NULL THEN 0 ELSE {dots(h)} - {dots('(' + reg(h) + ')')} END"


def entropy(s: str) -> str:
    p = f"((length({s}) - length(replace({s}, c, ''))) / length({s})::DOUBLE)"
    return (f"coalesce(list_sum(list_transform(list_distinct(list_filter(string_split({s}, ''), lambda c: c <> '')), "
            f"lambda c: -{p} * log2({p}))), 0.0)")


def vowel_ratio(s: str, vowels: str = "aeiou") -> str:
    return (f"coalesce(length(regexp_replace({s}, '[^{vowels}]', '', 'g')) / nullif(length({s}), 0)::DOUBLE, 0.0)")


def run(s: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({s}, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0)"


def random_label(s: str) -> str:
    return (f"(length({s}) >= 6 AND {entropy(s)} >= 2.3 AND ({vowel_ratio(s)} <= 0.20 OR {run(s)} >= 4))")


def random_local(s: str) -> str:
    x = f"lower(regexp_replace({s}, '[^a-zA-Z]', '', 'g'))"
    return (f"(length({x}) >= 5 AND {entropy(x)} >= 2.2 AND ({vowel_ratio(x)} <= 0.25 OR {run(x)} >= 4"
            f" OR regexp_matches({s}, '^[A-Z]{{5,}}$')))")


def address(h: str) -> str:
    return (f"lower(coalesce(nullif(regexp_extract({h}, '<([^@<>\\s]+@[^@<>\\s]+)>', 1), ''), "
            f"nullif(regexp_extract({h}, '[^\\s\"<>]+@[^\\s\"<>]+'), '')))")


def domain_of(a: str) -> str:
    return f"nullif(CASE WHEN {a} LIKE '%@%' THEN substring({a}, instr({a}, '@') + 1) END, '')"


def round3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


MAIL = f"""
mail AS ({mail_sql('duckdb')}),
ident AS (
  SELECT *, {domain_of('from_addr')} AS from_domain, split_part(from_addr, '@', 1) AS from_local,
    {domain_of('sender_addr')} AS sender_domain, {domain_of('reply_addr')} AS reply_domain,
    {domain_of('return_addr')} AS return_domain,
    nullif(lower(regexp_extract(mid_h, '<[^@>\\s]+@([^>\\s]+)>', 1)), '') AS mid_domain_x
  FROM (SELECT *, {address('from_h')} AS from_addr, {address('sender_h')} AS sender_addr,
          {address('reply_h')} AS reply_addr, {address('return_h')} AS return_addr,
          nullif(trim(regexp_replace(trim(regexp_extract(from_h, '^(.*?)\\s*<[^>]+>\\s*$', 1)), '^"|"$', '', 'g')), '')
            AS display_name
        FROM mail)),
ars AS (
  SELECT msg_id, 0 AS ar_pos, ar1 AS v FROM mail WHERE ar1 IS NOT NULL
  UNION ALL SELECT msg_id, CASE WHEN ar1 IS NULL THEN 0 ELSE 1 END, ar2 FROM mail WHERE ar2 IS NOT NULL),
heads AS (
  SELECT msg_id, ar_pos, v, id AS authserv_id,
    id = 'mx.example.net' OR id = 'trusted.org' OR id LIKE '%.trusted.org' AS trusted
  FROM (SELECT *, regexp_replace(trim(split_part(v, ';', 1)), '\\s+[0-9]+$', '') AS id FROM ars)),
pieces AS (
  SELECT msg_id, ar_pos, authserv_id, trusted, unnest(range(1, len(string_split(v, ';')))) - 1 AS res_pos,
    unnest(string_split(v, ';')[2:]) AS piece
  FROM heads),
allres AS (
  SELECT *, {reg('mail_from_domain')} AS mail_from_reg, {reg('signing_domain')} AS signing_reg,
    {depth('signing_domain')} AS signing_depth, {reg('header_from_domain')} AS header_from_reg
  FROM (
    SELECT msg_id, ar_pos, authserv_id, trusted, res_pos,
      regexp_extract(piece, '^\\s*([a-z]+)=([a-z]+)', 1) AS method,
      regexp_extract(piece, '^\\s*([a-z]+)=([a-z]+)', 2) AS result,
      lower(nullif(regexp_replace(regexp_extract(piece, 'smtp\\.mailfrom=(\\S+)', 1), '^.*@', ''), '')) AS mail_from_domain,
      lower(coalesce(nullif(regexp_extract(piece, 'header\\.d=(\\S+)', 1), ''),
                     nullif(regexp_extract(piece, 'header\\.i=[^@\\s]*@(\\S+)', 1), ''))) AS signing_domain,
      lower(nullif(regexp_extract(piece, 'header\\.from=(\\S+)', 1), '')) AS header_from_domain
    FROM pieces)),
res AS (SELECT r.*, i.from_domain, {reg('i.from_domain')} AS from_reg FROM allres r JOIN ident i USING (msg_id) WHERE trusted),
flags AS (
  SELECT msg_id,
    bool_or(method = 'spf' AND result = 'pass' AND mail_from_reg = from_reg) AS spf_aligned,
    bool_or(method = 'dkim' AND result = 'pass' AND signing_reg = from_reg) AS dkim_aligned,
    bool_or((method = 'spf' AND result = 'pass' AND mail_from_reg IS NOT NULL)
         OR (method = 'dkim' AND result = 'pass' AND signing_reg IS NOT NULL)) AS any_pass,
    bool_or(method = 'spf' AND result = 'pass') AND max(from_reg) IS NOT NULL AS spf_pass,
    bool_or(method = 'dkim' AND result = 'fail') AND max(from_reg) IS NOT NULL AS dkim_fail,
    bool_or(method = 'dmarc' AND result = 'fail') AND max(from_reg) IS NOT NULL AS dmarc_fail,
    bool_or(method = 'dmarc' AND result = 'pass') AND max(from_reg) IS NOT NULL AS dmarc_pass,
    bool_or(method = 'dmarc' AND result <> 'none') AND max(from_reg) IS NOT NULL AS dmarc_non_none,
    bool_or(method = 'dmarc' AND result = 'none') AND max(from_reg) IS NOT NULL AS dmarc_none,
    bool_or(method = 'spf' AND result = 'fail') AND max(from_reg) IS NOT NULL AS spf_fail,
    arg_min(mail_from_reg, ar_pos * 1000 + res_pos) FILTER (method = 'spf' AND result = 'pass' AND mail_from_reg IS NOT NULL
      AND from_reg IS NOT NULL) AS spf_reg,
    arg_min(mail_from_reg, ar_pos * 1000 + res_pos) FILTER (method = 'spf' AND result = 'fail' AND mail_from_reg IS NOT NULL
      AND from_reg IS NOT NULL) AS spf_fail_reg,
    arg_min(mail_from_domain, ar_pos * 1000 + res_pos) FILTER (method = 'spf' AND result = 'pass' AND mail_from_reg <> from_reg) AS foreign_domain,
    bool_or(method = 'dkim' AND result = 'pass' AND signing_reg <> from_reg) AS foreign_signer,
    bool_or((method = 'spf' AND result = 'pass' AND mail_from_domain = from_domain)
         OR (method = 'dkim' AND result = 'pass' AND signing_domain = from_domain)) AS exact,
    bool_or(method = 'spf' AND mail_from_domain <> from_domain) AS exact_mail_from_mismatch,
    bool_or(method = 'dmarc' AND header_from_domain <> from_domain) AS exact_header_from_mismatch,
    bool_or(result = 'fail') AS any_fail
  FROM res GROUP BY msg_id)
"""

_BRANDS = ", ".join(f"({i}, '{core}', '{dom}')" for i, (core, dom) in enumerate(C.BRANDS, 1) if len(core) >= C.BRAND_MIN_CORE)
_PROVIDERS = ", ".join(f"('{d}', '{f}')" for d, f in C.MAILBOX_PROVIDERS.items())


def provider(h: str) -> str:
    return f"(SELECT max(f) FROM (VALUES {_PROVIDERS}) AS pv(d, f) WHERE {h} = d OR {h} LIKE '%.' || d)"


FACTS = f"""
labels AS (
  SELECT label, {random_label('label')} AS is_random
  FROM (SELECT DISTINCT unnest(string_split(from_domain, '.')) AS label FROM ident)),
msg_labels AS (
  SELECT msg_id, unnest(string_split(from_domain, '.')) AS label,
    unnest(range(len(string_split(from_domain, '.')))) AS pos FROM ident WHERE from_domain IS NOT NULL),
random_hit AS (
  SELECT msg_id, arg_min(label, pos) FILTER (is_random) AS random_label,
    bool_or(is_random) FILTER (pos = 0) AS left_random
  FROM msg_labels JOIN labels USING (label) GROUP BY msg_id),
names AS (SELECT DISTINCT display_name, lower(regexp_replace(lower(display_name), '[^a-z0-9]', '', 'g')) AS norm
          FROM ident WHERE display_name IS NOT NULL),
brand_scores AS (
  SELECT display_name, rank, domain, round(jaro_winkler_similarity(norm, core), 4) AS score
  FROM names JOIN (VALUES {_BRANDS}) AS b(rank, core, domain) ON length(norm) >= {C.BRAND_MIN_NAME}
    AND (core <> 'daiichilife' OR contains(norm, core))),
brand AS (
  SELECT display_name, domain AS brand_domain, score AS brand_score, rank AS brand_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY score DESC, rank) AS rn,
      lead(score) OVER (PARTITION BY display_name ORDER BY score DESC, rank) AS second FROM brand_scores)
  WHERE rn = 1 AND score >= {C.BRAND_MIN_SCORE} AND (second IS NULL OR score - second >= {C.BRAND_MARGIN})),
facts AS (
  SELECT i.*, {reg('i.from_domain')} AS from_reg, {depth('i.from_domain')} AS from_depth,
    {suffix('i.from_domain')} AS from_suffix,
    {reg('i.mid_domain_x')} AS mid_reg, {reg('i.sender_domain')} AS sender_reg,
    {reg('i.return_domain')} AS return_reg, {reg('i.reply_domain')} AS reply_reg,
    list_id_h IS NOT NULL OR list_unsub_h IS NOT NULL AS listed,
    coalesce({random_local('i.from_local')}, false) AS random_local,
    r.random_label, coalesce(r.left_random, false) AS left_random,
    coalesce(f.spf_aligned, false) AS spf_aligned, coalesce(f.dkim_aligned, false) AS dkim_aligned,
    coalesce(f.spf_aligned, false) OR coalesce(f.dkim_aligned, false) AS aligned,
    coalesce(f.any_pass, false) AS any_pass, coalesce(f.spf_pass, false) AS spf_pass,
    coalesce(f.dkim_fail, false) AS dkim_fail, coalesce(f.dmarc_fail, false) AS dmarc_fail,
    coalesce(f.dmarc_pass, false) AS dmarc_pass, coalesce(f.dmarc_non_none, false) AS dmarc_non_none,
    coalesce(f.dmarc_none, false) AS dmarc_none, coalesce(f.spf_fail, false) AS spf_fail,
    f.spf_reg, f.spf_fail_reg, f.foreign_domain, coalesce(f.foreign_signer, false) AS foreign_signer,
    coalesce(f.exact, false) AS exact, coalesce(f.any_fail, false) AS any_fail,
    coalesce(f.exact_mail_from_mismatch, false) AS x_mf, coalesce(f.exact_header_from_mismatch, false) AS x_hf,
    f.msg_id IS NOT NULL AS any_trusted,
    b.brand_domain, b.brand_score, b.brand_rank,
    lower(regexp_replace(lower(i.display_name), '[^a-z0-9]', '', 'g')) AS name_norm
  FROM ident i LEFT JOIN flags f USING (msg_id) LEFT JOIN random_hit r USING (msg_id)
    LEFT JOIN brand b ON b.display_name = i.display_name)
"""

_W, _I, _H = C.COMPOSITE_SCORES, C.IDENTITY_SCORES, C.HEURISTIC_SCORES
_CORE = "substring(from_reg, 1, length(from_reg) - length(from_suffix) - 1)"
_BRAND_CORE = "CASE WHEN brand_domain = 'dai-ichi-life.co.jp' THEN 'dai-ichi-life' ELSE split_part(brand_domain, '.', 1) END"
_SUB = "string_split(substring(from_domain, 1, length(from_domain) - length(from_reg) - 1), '.')"
_ROUTE = "dkim_aligned AND NOT spf_aligned AND mid_reg = spf_reg AND listed"
_CONTRIB = ("(mid_domain_x <> from_domain OR coalesce(reply_domain <> from_domain, false) "
            "OR coalesce(return_domain <> from_domain, false) OR x_mf OR x_hf)")
_OTHER = ("(coalesce(reply_domain <> from_domain, false) OR coalesce(return_domain <> from_domain, false) OR x_mf OR x_hf)")
_EMBED = "list_filter(regexp_extract_all(lower(display_name), '[a-z0-9._%+-]+@([a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1), lambda d: d <> from_domain)"
_UNREG = ("mid_domain_x IS NOT NULL AND mid_reg IS NULL AND from_reg IS NOT NULL AND spf_pass AND NOT dkim_aligned "
          "AND mid_domain_x <> from_domain")

# key -> (layer, order, delta, predicate) over ``facts``
RULE_SQL = {
    "identity.spfMailFromMismatch": ("L2", 1, _I["spfMailFromMismatch"],
                                     "from_reg IS NOT NULL AND NOT dkim_aligned AND foreign_domain IS NOT NULL"),
    "identity.dkimDomainMismatch": ("L2", 2, _I["dkimDomainMismatch"],
                                    "from_reg IS NOT NULL AND NOT dkim_aligned AND foreign_signer"),
    "identity.dmarcNoneWithThirdPartyAuth": ("L2", 3, _I["dmarcNoneWithThirdPartyAuth"],
                                             "from_reg IS NOT NULL AND NOT dmarc_non_none AND any_pass AND NOT aligned"),
    "heuristic.randomFromDomainLabel": ("L3", 1, _H["randomFromDomainLabel"], "random_label IS NOT NULL"),
    "heuristic.randomFromLocalPart": ("L3", 2, _H["randomFromLocalPart"], "random_local"),
}
_COMPOSITE = [
    ("spfAlignedDkimUnalignedRandomLocal", "spf_aligned AND NOT dkim_aligned AND length(from_local) >= 7 AND random_local"),
    ("authAlignedRandomDomain", "aligned AND random_label IS NOT NULL"),
    ("thirdPartyAuthRandomLocal", "any_pass AND NOT aligned AND length(from_local) >= 7 AND random_local"),
    ("messageIdMismatchWithUnalignedAuth", "mid_reg <> from_reg AND NOT aligned"),
    ("messageIdUnregistrableMismatch", _UNREG),
    ("deepRandomFromSubdomain", "aligned AND from_depth >= 2 AND left_random"),
    ("unsecuredDeepSubdomain", "NOT aligned AND dmarc_none AND NOT dmarc_non_none AND from_depth >= 2"),
    ("spfPassDkimFailRandomLocal", "spf_pass AND dkim_fail AND NOT dkim_aligned AND length(from_local) >= 7 AND random_local"),
    ("fromSenderMismatchWithUnalignedAuth", "sender_reg <> from_reg AND NOT aligned AND NOT listed"),
    ("delegatedDkimAlignedRouteConsistent", _ROUTE),
    ("dkimAlignedLexicalMitigation",
     f"{_ROUTE} AND (random_label IS NOT NULL OR random_local) AND NOT coalesce({_UNREG}, false) "
     f"AND NOT {random_label('split_part(from_reg, chr(46), 1)')}"),
    ("ownDomainAuthFail", "from_reg = 'home-corp.com' AND (dmarc_fail OR spf_fail)"),
    ("dmarcFailDkimAlignedListMitigation", "dmarc_fail AND dkim_aligned AND listed"),
    ("geoTokenCompoundDomain", f"any_pass AND NOT dkim_aligned AND contains({_CORE}, '-') AND "
                               f"len(list_filter(string_split({_CORE}, '-'), lambda t: t IN ({_quoted(C.GEO_TOKENS)}))) > 0"),
    ("deepServiceWordSubdomain", f"any_pass AND NOT dkim_aligned AND from_depth >= 2 AND len(list_filter({_SUB}[2:], "
                                 f"lambda t: t IN ({_quoted(C.SERVICE_LABELS)}) OR regexp_matches(t, '^mail-[0-9]+$'))) > 0"),
    ("dkimFailWithAlignedPass", "dkim_fail AND dkim_aligned"),
    ("unparseableFromWithInfrastructureMismatch",
     "from_domain IS NULL AND NOT any_pass AND (sender_reg IS NOT NULL OR return_reg IS NOT NULL OR mid_domain_x IS NOT NULL)"),
    ("brandDivergencePhishing",
     f"brand_domain IS NOT NULL AND from_reg <> brand_domain AND NOT (from_suffix <> 'test' AND {_CORE} = {_BRAND_CORE} "
     f"AND (contains(from_suffix, '.') OR (length(from_suffix) = 2 AND from_suffix NOT IN ({_quoted(C.GENERIC_USE_CCTLDS)})))) "
     "AND (NOT regexp_matches(display_name, '^[A-Z][a-z''-]+ [A-Z][a-z''-]+$') "
     f"OR lower(split_part(display_name, ' ', 2)) IN ({_quoted(C.BRAND_SERVICE_WORDS)}) "
     f"OR length({_BRAND_CORE}) / length(name_norm)::DOUBLE >= 0.8)"),
    ("unauthenticatedFromSpoof", f"from_domain IS NOT NULL AND NOT exact AND NOT aligned AND {_OTHER}"),
    ("authenticatedDisplayNameSpoof", f"exact AND len({_EMBED}) > 0"),
    ("alignedAuthenticationConfirmed", f"exact AND NOT {_CONTRIB} AND NOT any_fail AND coalesce(len({_EMBED}), 0) = 0"),
    ("publicDomainSpoofing",
     f"from_domain IN ({_quoted(C.MAILBOX_PROVIDERS)}) AND any_trusted AND NOT exact AND NOT aligned AND NOT dmarc_pass "
     f"AND (coalesce({provider('return_domain')} <> {provider('from_domain')}, false) "
     f"OR coalesce({provider('mid_domain_x')} <> {provider('from_domain')}, false))"),
]
for _n, (_k, _p) in enumerate(_COMPOSITE, 1):
    RULE_SQL[f"composite.{_k}"] = ("L4", _n, _W.get(_k, 0), _p)
RULE_SQL["whitelist.manual"] = ("L5", 1, -50, "from_addr = 'friend@partner.com'")
RULE_SQL["whitelist.addressBook"] = ("L5", 2, -50, "from_addr = 'pal@contacts.net'")
RULE_SQL["sender.rule"] = ("L5", 3, 20, "from_domain = 'bulk.net' OR from_domain LIKE '%.bulk.net'")

_WEIGHTS = ", ".join(f"('{m}', '{r}', {w})" for m, rs in C.AUTH_SCORES.items() for r, w in rs.items())


def rule_select(key: str) -> str:
    layer, order, delta, predicate = RULE_SQL[key]
    return (f"SELECT msg_id, '{layer}' AS layer, {int(layer[1]) * 1000 + order} AS ord, '{key}' AS key, "
            f"CAST({delta} AS DOUBLE) AS delta FROM facts WHERE {predicate}")


REASONS = f"""
auth_reasons AS (
  SELECT msg_id, 'L1' AS layer, 1000 + ar_pos * 100 AS ord, 'authserv.untrusted' AS key, CAST(0 AS DOUBLE) AS delta
  FROM heads WHERE NOT trusted
  UNION ALL
  SELECT msg_id, 'L1', 1000 + ar_pos * 100 + res_pos, 'auth.' || method || '.' || result, CAST(w AS DOUBLE)
  FROM res JOIN (VALUES {_WEIGHTS}) AS wt(method, result, w) USING (method, result)),
reasons AS (
  SELECT * FROM auth_reasons UNION ALL {" UNION ALL ".join(rule_select(k) for k in RULE_SQL)}),
totals AS (
  SELECT msg_id, sum(CASE WHEN layer <> 'L3' THEN delta ELSE 0 END)
    + least(sum(CASE WHEN layer = 'L3' THEN delta ELSE 0 END), {_H['layer3Cap']}) AS s
  FROM reasons GROUP BY msg_id),
assessed AS (
  SELECT f.msg_id, f.account_id, f.folder_id, f.folder_name, f.folder_type, f.junk, f.sent_at, f.received_at,
    f.subject, f.from_domain, f.from_h, f.mid_h, f.dkim_aligned, coalesce(t.s, 0.0) AS score,
    CASE WHEN coalesce(t.s, 0) >= 100 THEN 'high-risk' WHEN coalesce(t.s, 0) >= 50 THEN 'review' ELSE 'normal' END AS classification
  FROM facts f LEFT JOIN totals t USING (msg_id))
"""


def over(select: str, *stages: str) -> str:
    return "WITH " + ",".join(stages or (MAIL, FACTS, REASONS)) + " " + select
