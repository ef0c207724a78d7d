from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[4]")
        .appName("monthpick-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from monthpick.session import checkpoint_dir

    checkpoint_dir(s)  # the session's own, or a local one when it has none
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


SIM_SCHEMA = (
    "SCENARIOID int, EID string, DATETIME timestamp_ntz, PEAKID int, ACTIVATIONLEVEL double, "
    "WINDIMPACT double, SOLARIMPACT double, HYDROIMPACT double, NONRENEWBALIMPACT double, "
    "EXTERNALIMPACT double, LOADIMPACT double, TRANSMISSIONOUTAGEIMPACT double, {p} double"
)


def sim_rows(rows, price_col="PSM"):
    """(scenario, eid, datetime-str, peak, activation, price) -> full sim rows."""
    out = []
    for sc, eid, when, peak, act, price in rows:
        out.append((sc, eid, ts(when), peak, act, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, price))
    return out


@pytest.fixture
def make(spark):
    """Builders for domain-schema micro tables."""
    from monthpick.sources.loaders import load_costs, load_prices, load_sim_daily, load_sim_monthly

    class M:
        def prices(self, rows):
            df = spark.createDataFrame(
                [(e, ts(d), p, v) for e, d, p, v in rows],
                "EID string, DATETIME timestamp_ntz, PEAKID int, PRICEREALIZED double",
            )
            return load_prices(df)

        def costs(self, rows):
            df = spark.createDataFrame(rows, "EID string, MONTH string, PEAKID int, C double")
            return load_costs(df)

        def sim_monthly(self, rows):
            df = spark.createDataFrame(sim_rows(rows, "PSM"), SIM_SCHEMA.format(p="PSM"))
            return load_sim_monthly(df)

        def sim_daily(self, rows):
            df = spark.createDataFrame(sim_rows(rows, "PSD"), SIM_SCHEMA.format(p="PSD"))
            return load_sim_daily(df)

    return M()
