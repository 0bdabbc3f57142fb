import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def suffixes(spark):
    from headrisk.functions.domains import load_suffix_rules
    return load_suffix_rules(spark, "/usr/share/publicsuffix/public_suffix_list.dat")


def mail(spark, *messages):
    """Messages from dicts of header name -> value or list of values."""
    rows = [(i, "account1", "Hello", {k: v if isinstance(v, list) else [v] for k, v in m.items()})
            for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "msg_id bigint, account_id string, subject string, headers map<string,array<string>>")
