"""Scores, thresholds, word lists and texts every result depends on.

Nothing here is tuned or derived; change a value and scores change.
"""

# ---------------------------------------------------------------- fixed values: limits
REVIEW_THRESHOLD = 50
HIGH_RISK_THRESHOLD = 100
HEADER_TEXT_MAX = 200
AUTHSERV_ID_MAX = 253
LOGGED_SERVERS_MAX = 5
STATUS_SAMPLE = 20
NO_RESULTS_MIN_SAMPLE = 5
CANDIDATES_MAX = 50
SETUPS_MAX = 50
LOG_MAX = 1000
PAGE_SIZE = 100
ALERT_MAX_SCORE = 49
ALERT_DELAY_MS = 3000
ALERT_INTERVAL_MS = 4000
ALERT_QUEUE_MAX = 5
SNIPPET_MAX = 160
FORMULA_MAX_COUNT = 20
FORMULA_ID_MAX = 100
FORMULA_NAME_MAX = 200
FORMULA_TEXT_MAX = 1000
FORMULA_OUTPUT_LIMIT = 100
BRAND_MIN_SCORE = 0.82
BRAND_MARGIN = 0.04
BRAND_MIN_NAME = 5
BRAND_MIN_CORE = 4
REVIEW_FOLDER_NAME = "Auth Review"

# ---------------------------------------------------------------- fixed values: default scores
AUTH_SCORES = {
    "dmarc": {"pass": 0, "fail": 15, "none": 35, "policy": 0},
    "spf": {"pass": 0, "fail": 50, "none": 15, "softfail": 15,
            "neutral": 5, "temperror": 10, "permerror": 20},
    "dkim": {"pass": 0, "fail": 15, "none": 5, "temperror": 10, "permerror": 20},
}
IDENTITY_SCORES = {
    "spfMailFromMismatch": 0,
    "dkimDomainMismatch": 5,
    "dmarcNoneWithThirdPartyAuth": 10,
}
HEURISTIC_SCORES = {"randomFromDomainLabel": 15, "randomFromLocalPart": 5, "layer3Cap": 25}
COMPOSITE_SCORES = {
    "spfAlignedDkimUnalignedRandomLocal": 30,
    "authAlignedRandomDomain": 40,
    "thirdPartyAuthRandomLocal": 25,
    "messageIdMismatchWithUnalignedAuth": 30,
    "messageIdUnregistrableMismatch": 50,
    "fromSenderMismatchWithUnalignedAuth": 15,
    "deepRandomFromSubdomain": 25,
    "unsecuredDeepSubdomain": 25,
    "delegatedDkimAlignedRouteConsistent": -30,
    "spfPassDkimFailRandomLocal": 25,
    "dkimAlignedLexicalMitigation": -30,
    "ownDomainAuthFail": 75,
    "unparseableFromWithInfrastructureMismatch": 50,
    "dmarcFailDkimAlignedListMitigation": -15,
    "geoTokenCompoundDomain": 50,
    "deepServiceWordSubdomain": 30,
    "dkimFailWithAlignedPass": 35,
    "brandDivergencePhishing": 50,
    "unauthenticatedFromSpoof": 35,
    "authenticatedDisplayNameSpoof": 40,
    "publicDomainSpoofing": 45,
}
WHITELIST_SCORE = -50
ADDRESS_BOOK_SCORE = -50

# ---------------------------------------------------------------- fixed values: earlier default scores
SCORES_VERSION = "v3"
_SPF_60 = {"pass": 0, "fail": 60, "none": 5, "softfail": 15,
           "neutral": 5, "temperror": 10, "permerror": 20}
_SPF_50 = {"pass": 0, "fail": 50, "none": 5, "softfail": 15,
           "neutral": 5, "temperror": 10, "permerror": 20}
_DKIM_25 = {"pass": 0, "fail": 25, "none": 5, "temperror": 10, "permerror": 20}
_DKIM_15 = {"pass": 0, "fail": 15, "none": 5, "temperror": 10, "permerror": 20}
_V2_COMPOSITE = {
    "spfAlignedDkimUnalignedRandomLocal": 30, "authAlignedRandomDomain": 40, "thirdPartyAuthRandomLocal": 25,
    "messageIdMismatchWithUnalignedAuth": 30, "messageIdUnregistrableMismatch": 50,
    "fromSenderMismatchWithUnalignedAuth": 15, "deepRandomFromSubdomain": 25, "unsecuredDeepSubdomain": 25,
    "delegatedDkimAlignedRouteConsistent": -30, "spfPassDkimFailRandomLocal": 25, "dkimAlignedLexicalMitigation": -30,
    "ownDomainAuthFail": 75, "unparseableFromWithInfrastructureMismatch": 50,
    "dmarcFailDkimAlignedListMitigation": -15, "geoTokenCompoundDomain": 30, "deepServiceWordSubdomain": 30,
    "dkimFailWithAlignedPass": 35, "brandDivergencePhishing": 50, "unauthenticatedFromSpoof": 35,
    "authenticatedDisplayNameSpoof": 40, "publicDomainSpoofing": 45,
}
_V1_COMPOSITE = {
    "spfAlignedDkimUnalignedRandomLocal": 30, "authAlignedRandomDomain": 40, "thirdPartyAuthRandomLocal": 25,
    "messageIdMismatchWithUnalignedAuth": 20, "messageIdUnregistrableMismatch": 50,
    "fromSenderMismatchWithUnalignedAuth": 15, "deepRandomFromSubdomain": 25,
    "delegatedDkimAlignedRouteConsistent": -30, "spfPassDkimFailRandomLocal": 25, "dkimAlignedLexicalMitigation": -30,
    "ownDomainAuthFail": 75, "unparseableFromWithInfrastructureMismatch": 50,
    "dmarcFailDkimAlignedListMitigation": -15, "geoTokenCompoundDomain": 30, "deepServiceWordSubdomain": 30,
}

EARLIER_SCORES = [
    ("pre-v0.2.2", "auth", {"dmarc": {"pass": 0, "fail": 50, "none": 10, "policy": 0},
                            "spf": _SPF_50, "dkim": _DKIM_25}),
    ("v0", "heuristic", {"randomFromDomainLabel": 20, "randomFromLocalPart": 10, "layer3Cap": 40}),
    ("v0", "composite", {"spfAlignedDkimUnalignedRandomLocal": 30, "authAlignedRandomDomain": 25,
                         "thirdPartyAuthRandomLocal": 25, "messageIdMismatchWithUnalignedAuth": 20,
                         "fromSenderMismatchWithUnalignedAuth": 15}),
    ("v0", "auth", {"dmarc": {"pass": 0, "fail": 40, "none": 10, "policy": 0},
                    "spf": _SPF_60, "dkim": _DKIM_25}),
    ("v0-dmarc25", "auth", {"dmarc": {"pass": 0, "fail": 25, "none": 15, "policy": 0},
                            "spf": _SPF_60, "dkim": _DKIM_25}),
    ("v0.3.3", "heuristic", {"randomFromDomainLabel": 30, "randomFromLocalPart": 10, "layer3Cap": 40}),
    ("v0.3.3", "identity", {"spfMailFromMismatch": 15, "dkimDomainMismatch": 10,
                            "dmarcNoneWithThirdPartyAuth": 20}),
    ("v0.3.3", "auth", {"dmarc": {"pass": 0, "fail": 20, "none": 15, "policy": 0},
                        "spf": _SPF_60, "dkim": _DKIM_25}),
    ("v1", "identity", {"spfMailFromMismatch": 10, "dkimDomainMismatch": 5,
                        "dmarcNoneWithThirdPartyAuth": 10}),
    ("v1", "composite", _V1_COMPOSITE),
    ("v1", "auth", {"dmarc": {"pass": 0, "fail": 15, "none": 10, "policy": 0},
                    "spf": _SPF_50, "dkim": _DKIM_15}),
    ("v2", "composite", _V2_COMPOSITE),
]

# ---------------------------------------------------------------- fixed values: word lists
GEO_TOKENS = ["cn", "zh", "china", "official", "svip", "apps"]
SERVICE_LABELS = ["payment", "notice", "portal", "ship", "auth", "promo"]
GENERIC_USE_CCTLDS = ["co", "io", "me", "ai", "tv", "cc", "vc", "la", "to", "ws"]
BRAND_SERVICE_WORDS = [
    "account", "accounts", "admin", "alert", "alerts", "billing", "care", "center", "customer",
    "delivery", "help", "helpdesk", "info", "mail", "message", "messages", "noreply", "notice",
    "notices", "notification", "notifications", "official", "online", "payment", "payments",
    "security", "service", "services", "support", "team", "update", "updates", "verification",
    "verify",
]
HOST_PREFIXES = ["", "mail.", "mx.", "imap.", "pop.", "smtp."]
JUNK_FOLDER_TYPES = ["junk", "trash", "spam"]
# Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Hangul Jamo, Kana, CJK, Hangul
NON_LATIN_RANGES = ("\\u0370-\\u03FF\\u0400-\\u04FF\\u0590-\\u05FF\\u0600-\\u06FF\\u0900-\\u097F"
                    "\\u0E00-\\u0E7F\\u1100-\\u11FF\\u3040-\\u30FF\\u4E00-\\u9FFF\\uAC00-\\uD7AF")

# ---------------------------------------------------------------- fixed values: public mailbox families
MAILBOX_PROVIDERS = {
    "outlook.com": "microsoft", "hotmail.com": "microsoft", "live.com": "microsoft",
    "msn.com": "microsoft", "icloud.com": "apple", "me.com": "apple", "mac.com": "apple",
    "yahoo.com": "yahoo", "yahoo.co.jp": "yahoo", "yahoo.co.uk": "yahoo", "yahoo.fr": "yahoo",
    "yahoo.de": "yahoo", "yahoo.it": "yahoo", "yahoo.es": "yahoo", "yahoo.ca": "yahoo",
    "yahoo.com.au": "yahoo", "yahoo.com.br": "yahoo", "gmail.com": "google",
    "googlemail.com": "google", "aol.com": "aol",
}

# ---------------------------------------------------------------- fixed values: brands in rank order
# (core, domain); the last one needs its core inside the name
BRANDS = [
    ("americanexpress", "americanexpress.com"), ("paypal", "paypal.com"), ("amazon", "amazon.com"),
    ("microsoft", "microsoft.com"), ("apple", "apple.com"), ("google", "google.com"),
    ("netflix", "netflix.com"), ("ebay", "ebay.com"), ("bankofamerica", "bankofamerica.com"),
    ("wellsfargo", "wellsfargo.com"), ("chase", "chase.com"), ("citibank", "citibank.com"),
    ("discover", "discover.com"), ("capitalone", "capitalone.com"), ("usbank", "usbank.com"),
    ("dhl", "dhl.com"), ("ups", "ups.com"), ("irs", "irs.gov"), ("fedex", "fedex.com"),
    ("usps", "usps.com"), ("docusign", "docusign.com"), ("dropbox", "dropbox.com"),
    ("linkedin", "linkedin.com"), ("facebook", "facebook.com"), ("instagram", "instagram.com"),
    ("walmart", "walmart.com"), ("target", "target.com"), ("costco", "costco.com"),
    ("twitter", "twitter.com"), ("rakuten", "rakuten.com"), ("daiichilife", "dai-ichi-life.co.jp"),
]
BRANDS_CORE_REQUIRED = {"daiichilife"}

# ---------------------------------------------------------------- fixed values: rules
# (key, title, type, default score) in canonical order; titles are what reports show
RULES = [
    ("authserv.untrusted", "Untrusted authserv-id", "diagnostic", None),
    ("sender.rule", "Sender domain rule", "risk", None),
    ("whitelist.manual", "Manual whitelist", "mitigation", -50),
    ("whitelist.addressBook", "Address book contact", "mitigation", -50),
    ("identity.spfMailFromMismatch", "SPF MAIL FROM differs from From", "risk", 0),
    ("identity.dkimDomainMismatch", "DKIM signing domain differs from From", "risk", 5),
    ("identity.dmarcNoneWithThirdPartyAuth", "DMARC none with only third-party auth", "risk", 10),
    ("heuristic.randomFromDomainLabel", "Random-looking From domain label", "risk", 15),
    ("heuristic.randomFromLocalPart", "Random-looking From local part", "risk", 5),
    ("composite.spfAlignedDkimUnalignedRandomLocal",
     "SPF aligned, DKIM unaligned, random local part", "risk", 30),
    ("composite.authAlignedRandomDomain",
     "Auth-aligned sender with random-looking domain", "risk", 40),
    ("composite.thirdPartyAuthRandomLocal",
     "Third-party auth pass with random local part, no alignment", "risk", 25),
    ("composite.messageIdMismatchWithUnalignedAuth",
     "Message-ID domain mismatch with unaligned authentication", "risk", 30),
    ("composite.messageIdUnregistrableMismatch",
     "Message-ID domain is unregistrable or mismatches From", "risk", 50),
    ("composite.fromSenderMismatchWithUnalignedAuth",
     "From/Sender mismatch with unaligned authentication", "risk", 15),
    ("composite.deepRandomFromSubdomain", "Deep random-looking From subdomain", "risk", 25),
    ("composite.delegatedDkimAlignedRouteConsistent",
     "Delegated newsletter: DKIM-aligned, route-consistent", "mitigation", -30),
    ("composite.spfPassDkimFailRandomLocal", "SPF pass, DKIM fail, random local part", "risk", 25),
    ("composite.dkimAlignedLexicalMitigation",
     "DKIM-aligned lexical false-positive mitigation", "mitigation", -30),
    ("composite.ownDomainAuthFail", "Own account domain with failed authentication", "risk", 75),
    ("composite.unparseableFromWithInfrastructureMismatch",
     "Unparseable From with infrastructure mismatch", "risk", 50),
    ("composite.geoTokenCompoundDomain", "Geo/token compound registrable domain", "risk", 30),
    ("composite.deepServiceWordSubdomain", "Deep service-word subdomain", "risk", 30),
    ("composite.dmarcFailDkimAlignedListMitigation",
     "DMARC fail mitigated: DKIM aligned and list headers present", "mitigation", -15),
    ("composite.dkimFailWithAlignedPass", "DKIM fail with aligned DKIM pass", "risk", 35),
    ("composite.brandDivergencePhishing", "Display-name brand divergence phishing", "risk", 50),
    ("composite.unsecuredDeepSubdomain", "DMARC-none deep subdomain", "risk", 25),
    ("composite.unauthenticatedFromSpoof",
     "Unauthenticated From with sender inconsistency", "risk", 35),
    ("composite.authenticatedDisplayNameSpoof",
     "Authenticated sender with spoofed display-name email", "risk", 40),
    ("composite.alignedAuthenticationConfirmed", "Aligned authentication confirmed", "diagnostic", None),
    ("composite.publicDomainSpoofing",
     "Public mailbox provider domain with failed authentication", "risk", 45),
]
# labels written into reasons where they differ from the title above
REASON_LABELS = {
    "composite.messageIdUnregistrableMismatch": "Message-ID domain unregistrable, mismatch with From",
    "composite.unauthenticatedFromSpoof": "From domain unauthenticated with sender inconsistency",
    "composite.authenticatedDisplayNameSpoof":
        "Authenticated sender with mismatched display-name email",
}

# ---------------------------------------------------------------- fixed values: alert texts
ALERT_SINGLE = "%s: 1 new message"
ALERT_MANY_TITLE = "New Messages"
ALERT_MANY_BODY = "There are %s new messages."
ALERT_MORE = "+%s more messages"
ALERT_NO_SUBJECT = "(no subject)"

# ---------------------------------------------------------------- fixed values: formula starters
FORMULA_STARTERS = [
    ("boost-auth-aligned-random-domain",
     "CASE WHEN has('composite.authAlignedRandomDomain') THEN 30 ELSE 0 END"),
    ("deep-random-subdomain",
     "CASE WHEN from_.subdomain_depth >= 2 AND from_.left_label_entropy > 2.4 THEN 40 ELSE 0 END"),
    ("msgid-mismatch",
     "CASE WHEN message_id.matches_from_domain = false AND NOT alignment.any_dkim_aligned "
     "THEN 30 ELSE 0 END"),
    ("dkim-aligned-mitigate", "CASE WHEN alignment.any_dkim_aligned THEN -20 ELSE 0 END"),
]

LAYERS = ["L1", "L2", "L3", "L4", "L5"]
RULE_RANK = {key: i for i, (key, _t, _ty, _s) in enumerate(RULES)}
RULE_TITLE = {key: title for key, title, _ty, _s in RULES}


def reason_label(key: str) -> str:
    return REASON_LABELS.get(key, RULE_TITLE[key])
