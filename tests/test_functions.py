import random

import pytest
from pyspark.sql import functions as F

from headrisk.functions import address as A
from headrisk.functions import names as N
from headrisk.functions import text as T
from headrisk.functions.domains import COMMON_RULES, SuffixRules, build_domain_dim, suffix_rules_table
from headrisk.functions.jaro import best_brands, infer_brand, jaro_winkler
from headrisk.operators.facts import headers_from_pairs, lower_header_names, mailbox_provider

HOSTS = {
    "example.com": ("example.com", "com", None, 0, True, False),
    "mail1.foo.example.co.jp": ("example.co.jp", "co.jp", "mail1.foo", 2, True, False),
    "mail1.foo.bar.example.jp": ("example.jp", "jp", "mail1.foo.bar", 3, True, False),
    "foo.blogspot.com": ("foo.blogspot.com", "blogspot.com", None, 0, False, True),
    "com": (None, "com", None, 0, True, False),
    "co.jp": (None, "co.jp", None, 0, True, False),
    "not-a-domain": (None, "not-a-domain", None, 0, False, False),
    "shop.test": ("shop.test", "test", None, 0, False, False),
    "evil-example.co.jp": ("evil-example.co.jp", "co.jp", None, 0, True, False),
    "192.168.1.10": (None, None, None, 0, None, None),
    "a..b": (None, None, None, 0, None, None),
    "-x.com": (None, None, None, 0, None, None),
}


def test_domain_parts(spark, suffixes):
    df = spark.createDataFrame([(h.upper(),) for h in HOSTS], "host string")
    got = {r["host"]: tuple(r)[1:] for r in build_domain_dim(df, suffixes).collect()}
    assert got == HOSTS


def test_wildcards_and_exceptions(spark, tmp_path):
    listing = tmp_path / "list.dat"
    listing.write_text("// note\n===BEGIN ICANN DOMAINS===\ncom\nck\n*.ck\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\nhost.com\n*.cloud.com\n")
    table = suffix_rules_table(spark, str(listing))
    rules = SuffixRules.from_rows([tuple(r) for r in table.select("rule", "kind", "section").where("kind <> 'exact' OR rule NOT LIKE '===%'").collect()])
    df = spark.createDataFrame([(h,) for h in ["a.b.ck", "www.ck", "x.www.ck", "me.host.com", "z.y.cloud.com"]], "host string")
    got = {r["host"]: (r["registrable_domain"], r["is_private"]) for r in build_domain_dim(df, rules).collect()}
    assert got == {"a.b.ck": ("a.b.ck", False), "www.ck": ("www.ck", False), "x.www.ck": ("www.ck", False),
                   "me.host.com": ("me.host.com", True), "z.y.cloud.com": ("z.y.cloud.com", True)}


def test_fallback_rules_know_common_registries(spark):
    rules = SuffixRules.from_rows(COMMON_RULES)
    df = spark.createDataFrame([("a.b.co.jp",), ("x.y.com",)], "host string")
    assert {r["registrable_domain"] for r in build_domain_dim(df, rules).collect()} == {"b.co.jp", "y.com"}


def plain_jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if used[j]]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_jaro_matches_plain_definition():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    for other in words[:25]:
        got = jaro_winkler(words, other, scale=0.0)
        for w, g in zip(words, got):
            assert g == pytest.approx(plain_jaro(w, other), abs=6e-5)


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", .944), ("DWAYNE", "DUANE", .822), ("DIXON", "DICKSONX", .767)])
def test_jaro_classics(a, b, want):
    assert jaro_winkler([a], b, scale=0.0)[0] == pytest.approx(want, abs=5e-3)


def test_jaro_winkler_edges():
    assert list(jaro_winkler(["", "abc"], "")) == [1.0, 0.0]
    assert jaro_winkler(["paypal"], "paypal")[0] == 1.0
    assert jaro_winkler(["microsofft"], "microsoft")[0] > 0.9
    assert jaro_winkler(["amazon"], "americanexpress")[0] < 0.75


def test_brand_inference(spark):
    found = best_brands(["paypal", "paypa1x", "applemartin", "daiichilifecare", "zzzzzz"])
    assert found["brand_domain"].tolist()[0] == "paypal.com"
    assert found["brand_domain"].tolist()[4] is None
    df = spark.createDataFrame([("paypal",), ("bob",), (None,)], "n string").select("n", infer_brand(F.col("n")).alias("b"))
    assert {r["n"]: r["b"]["brand_domain"] for r in df.collect()} == {"paypal": "paypal.com", "bob": None, None: None}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,want", [
    ("Alice <ALICE@Example.com>", "alice@example.com"), ("bob@example.org", "bob@example.org"),
    ("x@bare.com <y@angle.com>", "y@angle.com"), ("undisclosed", None), ("", None),
    ("名前 <a@例え.jp>", "a@例え.jp"), ("nbsp a@b.com", "a@b.com")])
def test_mailbox_address(spark, value, want):
    assert one(spark, value, A.mailbox_address) == want


def test_address_parts(spark):
    assert one(spark, "<abc@Example.com>", A.message_id_domain) == "example.com"
    assert one(spark, "<broken>", A.message_id_domain) is None
    assert one(spark, "a@b@Mail.com ", A.email_domain) == "mail.com"
    assert one(spark, "A@b.com", A.email_to_domain) == "b.com"
    assert one(spark, "Host.com", A.email_to_domain) == "host.com"
    assert one(spark, " <abc@x> ", A.message_id_variants) == ["<abc@x>", "abc@x"]
    assert one(spark, "abc@x", A.message_id_variants) == ["abc@x"]


def test_lexical_vectors(spark):
    assert one(spark, "system", T.lexical_metrics)["vowel_count"] == 2
    assert one(spark, "a-1", T.lexical_metrics)["letter_digit_transition_count"] == 1
    assert one(spark, "a-1", T.core_lexical_metrics)["letter_digit_transitions"] == 0
    assert one(spark, "xfg8392a", T.max_consonant_run) == 3
    assert one(spark, "strength", T.max_consonant_run) == 4
    assert one(spark, "aaab", T.core_lexical_metrics)["max_repeated_char_run"] == 3
    assert one(spark, "aabb", T.entropy) == pytest.approx(1.0)
    assert one(spark, "", T.core_lexical_metrics)["normalized_entropy"] == 0
    assert one(spark, "abcdef", T.core_lexical_metrics)["normalized_entropy"] == pytest.approx(1.0)
    assert one(spark, "deadbeef", T.has_long_hex_run) is False
    assert one(spark, "dead8eef", T.has_long_hex_run) is True
    assert one(spark, "XKQVB", T.is_random_local) is True
    assert one(spark, "alice", T.is_random_local) is False


def test_display_names(spark):
    assert one(spark, '"Display Name" <u@x.com>', N.display_name) == "Display Name"
    assert one(spark, "u@x.com", N.display_name) is None
    assert one(spark, "Jane Doe", lambda c: N.brand_like(N.words(c))) is False
    assert one(spark, "American Express Card", lambda c: N.brand_like(N.words(c))) is True
    assert one(spark, "P a y P a l", lambda c: N.is_spaced(N.words(c))) is True
    assert one(spark, "Банк", N.has_non_latin) is True
    assert one(spark, "user@evil.com", N.is_email_shaped) is True
    assert one(spark, "ab", lambda c: N.trigram_jaccard(c, F.lit("x"))) == 1.0


def test_provider_families(spark):
    assert one(spark, "bounce.mail.icloud.com", mailbox_provider) == "apple"
    assert one(spark, "noticloud.com", mailbox_provider) is None


def test_headers_fold_case(spark):
    row = spark.sql("SELECT map('From', array('a'), 'X', array('1'), 'FROM', array('b')) AS m, "
                    "array(named_struct('name', 'To', 'value', 'p'), named_struct('name', 'TO', 'value', 'q')) AS p") \
        .select(lower_header_names(F.col("m")).alias("m"), headers_from_pairs(F.col("p")).alias("p")).first()
    assert row["m"] == {"from": ["a", "b"], "x": ["1"]}
    assert row["p"] == {"to": ["p", "q"]}
