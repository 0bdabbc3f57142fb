"""A mail table derived from the driver's ``orders`` table.

The given tables hold no mail headers. Every order becomes one message: its key picks one of
24 scenarios and one of six variants, so 144 kinds of messages occur. The statement runs
unchanged on Spark and on DuckDB but for the few tokens in ``DIALECTS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headrisk.settings import Settings

T = "mx.example.net"
# p, name, address, message-id domain, sender, reply-to, return-path, list-id, list-unsubscribe, result header, 2nd
SCENARIOS = [
    (0, "Alice", "alice@example.com", "example.com", None, None, None, None, None,
     f"{T}; spf=fail smtp.mailfrom=alice@example.com; dkim=none; dmarc=fail header.from=example.com", None),
    (1, "Bob", "bob@example.org", "example.org", None, None, None, None, None,
     "evil-mx.test; spf=pass smtp.mailfrom=bob@example.org", "mx.b.test; dkim=pass header.d=example.org"),
    (2, "Carl", "carl@shop.com", "shop.com", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=b@esp.net", None),
    (3, "Dana", "dana@shop.com", "shop.com", None, None, None, None, None,
     "gw.trusted.org; dkim=pass header.d=esp.net; dmarc=none", None),
    (4, "x", "info@xkqvbtzm.com", "xkqvbtzm.com", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@xkqvbtzm.com", None),
    (5, "x", "xkqvbtzm@shop.com", "shop.com", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@shop.com", None),
    (6, "x", "xkqvbtzm@shop.com", "esp.net", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@esp.net; dkim=fail header.d=shop.com", None),
    (7, "x", "sales@disposable-spam.xyz", "internalserver", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@disposable-spam.xyz", None),
    (8, "x", "a@ppbwwcyr.customer.233biz.com", "233biz.com", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@233biz.com", None),
    (9, "x", "a@sivakeso.support.sn5799.com", "sn5799.com", None, None, None, None, None,
     f"{T}; dmarc=none", None),
    (10, "x", "a@shop.com", "shop.com", "b@other.net", None, None, None, None,
     f"{T}; spf=fail smtp.mailfrom=a@shop.com", None),
    (11, "News", "news@xkqvbtzm.brandmail.com", "mx.esp.net", None, None, None, "<news.brandmail.com>", None,
     f"{T}; dkim=pass header.d=brandmail.com; spf=pass smtp.mailfrom=b@esp.net", None),
    (12, "Boss", "ceo@home-corp.com", "home-corp.com", None, None, None, None, None,
     f"{T}; spf=fail smtp.mailfrom=ceo@home-corp.com", None),
    (13, "List", "l@brandmail.com", "brandmail.com", None, None, None, None, "<mailto:off@brandmail.com>",
     f"{T}; dkim=pass header.i=@brandmail.com; dmarc=fail", None),
    (14, "x", "a@svip-china.com", "svip-china.com", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@svip-china.com", None),
    (15, "x", "a@abc.payment.shop-site.co.jp", "shop-site.co.jp", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=a@shop-site.co.jp", None),
    (16, "x", "a@brandmail.com", "brandmail.com", None, None, None, None, None,
     f"{T}; dkim=pass header.d=brandmail.com; dkim=fail header.d=old.net", None),
    (17, "undisclosed", None, "esp.net", None, None, "<b@esp.net>", None, None, f"{T}; spf=none", None),
    (18, "PayPal", "x@secure-login.net", "secure-login.net", None, None, None, None, None,
     f"{T}; spf=pass smtp.mailfrom=x@secure-login.net", None),
    (19, "x", "a@shop.com", "shop.com", None, "c@other.net", None, None, None,
     f"{T}; spf=fail smtp.mailfrom=a@other.net", None),
    (20, '"user@evil.com"', "legit@example.com", "example.com", None, None, None, None, None,
     f"{T} 1; dkim=pass header.d=example.com", None),
    (21, "x", "user@outlook.com", "outlook.com", None, None, "<bounce@mail.icloud.com>", None, None,
     f"{T}; dmarc=fail; spf=fail smtp.mailfrom=bounce@icloud.com", None),
    (22, "Friend", "friend@partner.com", "partner.com", None, None, None, None, None,
     f"{T}; dkim=pass header.d=partner.com; dmarc=pass header.from=partner.com", None),
    (23, "Pal", "pal@contacts.net", "contacts.net", None, None, None, None, None, None, None),
]
COLUMNS = ("p", "s_name", "s_addr", "mid_domain", "sender_h", "reply_h", "return_h", "list_id_h", "list_unsub_h",
           "ar1", "ar2")
DIALECTS = {"spark": {"div": "div", "text": "STRING", "seconds": "make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 3600)"},
            "duckdb": {"div": "//", "text": "VARCHAR", "seconds": "to_seconds(o_orderkey % 3600)"}}


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def mail_sql(dialect: str) -> str:
    """One row per message with its headers as plain columns."""
    d = DIALECTS[dialect]
    values = ",\n".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in SCENARIOS)
    return f"""
    SELECT o_orderkey AS msg_id,
      'account' || CAST(o_custkey % 20 AS {d['text']}) AS account_id,
      CASE WHEN o_orderkey % 10 < 7 THEN 'inbox' WHEN o_orderkey % 10 < 9 THEN 'review' ELSE 'junk' END AS folder_id,
      CASE WHEN o_orderkey % 10 < 7 THEN 'Inbox' WHEN o_orderkey % 10 < 9 THEN 'Auth Review' ELSE 'Junk' END
        AS folder_name,
      CASE WHEN o_orderkey % 10 < 7 THEN 'inbox' WHEN o_orderkey % 10 < 9 THEN 'folder' ELSE 'junk' END
        AS folder_type,
      o_orderkey % 10 = 9 AS junk,
      o_orderdate AS sent_at,
      o_orderdate + {d['seconds']} AS received_at,
      'Order ' || o_orderpriority AS subject,
      CASE WHEN addr IS NULL THEN nm ELSE nm || ' <' || addr || '>' END AS from_h,
      '<' || CAST(o_orderkey AS {d['text']}) || '@' || mid_domain || '>' AS mid_h,
      CASE WHEN v = 3 THEN coalesce(sender_h, 'relay@esp.net') ELSE sender_h END AS sender_h,
      CASE WHEN v = 3 THEN coalesce(reply_h, 'Help <help@other.net>') ELSE reply_h END AS reply_h,
      return_h, list_id_h,
      CASE WHEN v = 1 THEN coalesce(list_unsub_h, '<mailto:u@lists.example.org>') ELSE list_unsub_h END AS list_unsub_h,
      CASE WHEN v = 5 THEN replace(ar1, '{T}', 'mx2.unknown.test') ELSE ar1 END AS ar1,
      CASE WHEN v = 2 THEN coalesce(ar2, 'gw.trusted.org; dmarc=none; dkim=pass header.d=shop.com') ELSE ar2 END AS ar2
    FROM (
      SELECT o.*, s.*, (o_orderkey {d['div']} 24) % 6 AS v,
        CASE WHEN (o_orderkey {d['div']} 24) % 6 = 4 THEN 'Amazon Support'
             WHEN s.p = 23 AND (o_orderkey {d['div']} 24) % 2 = 1 THEN 'Deal' ELSE s.s_name END AS nm,
        CASE WHEN s.p = 23 AND (o_orderkey {d['div']} 24) % 2 = 1 THEN 'd@a.bulk.net' ELSE s.s_addr END AS addr
      FROM orders o JOIN (VALUES {values}) AS s({", ".join(COLUMNS)}) ON o.o_orderkey % 24 = s.p) m
    """


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the input has fewer splits; a large input stays as it is split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their headers as a map, from ``orders``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    spread(orders).createOrReplaceTempView("orders")
    flat = spark.sql(mail_sql("spark"))
    names = {"from": "from_h", "message-id": "mid_h", "sender": "sender_h", "reply-to": "reply_h",
             "return-path": "return_h", "list-id": "list_id_h", "list-unsubscribe": "list_unsub_h"}
    # a map for each header that is there: these compile, where filters over a full map are interpreted row by row
    none = "CAST(map() AS MAP<STRING, ARRAY<STRING>>)"
    entries = ", ".join(f"IF({c} IS NULL, {none}, map('{h}', array({c})))" for h, c in names.items())
    results = "CASE WHEN ar1 IS NULL THEN array(ar2) WHEN ar2 IS NULL THEN array(ar1) ELSE array(ar1, ar2) END"
    return flat.selectExpr(
        "msg_id", "account_id", "folder_id", "folder_name", "folder_id AS folder_path", "folder_type", "junk",
        "sent_at", "received_at", "subject",
        f"map_concat({entries}, IF(ar1 IS NULL AND ar2 IS NULL, {none}, map('authentication-results', {results}))) AS headers")


def derived_settings() -> Settings:
    """Trust list and user rules that go with the derived messages."""
    return Settings(
        trusted_servers=((T, "exact"), ("trusted.org", "domain")),
        sender_rules=(("bulk.net", "suffix", 20.0),),
        whitelist=(("Friend@Partner.com", "exact"),),
        address_book_enabled=True)


def contacts(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('Pal@contacts.net') AS t(address)")


def account_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account that receives mail owns ``home-corp.com``."""
    return (spark.read.parquet(f"{sf_dir}/orders.parquet")
            .selectExpr("'account' || CAST(o_custkey % 20 AS STRING) AS account_id").distinct()
            .selectExpr("account_id", "array('home-corp.com') AS account_domains"))
