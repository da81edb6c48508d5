import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidekeep.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tidekeep-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def profiles(spark):
    from tidekeep.schemas import PROFILE
    base = dict(nationality_region="MENA", tenure_months=60, segment="Mass", products_held=2,
                avg_balance_aed=1000.0, balance_trend_3m=0.0, salary_credit_active=True,
                remittance_count_3m=1, intl_transfer_spike=False, complaints_6m=0,
                branch_visits_trend=0.0, clv_estimate_aed=10000, churned=False)
    rows = [
        {**base, "customer_id": "A"},
        {**base, "customer_id": "B", "segment": "Premium", "balance_trend_3m": -0.3,
         "salary_credit_active": False, "intl_transfer_spike": True, "complaints_6m": 3,
         "branch_visits_trend": -0.5, "tenure_months": 12, "remittance_count_3m": 8,
         "clv_estimate_aed": 200000, "churned": True},
        {**base, "customer_id": "C", "segment": "Private", "balance_trend_3m": -0.15,
         "complaints_6m": 2, "branch_visits_trend": -0.4, "tenure_months": 13,
         "remittance_count_3m": 7, "clv_estimate_aed": 9999},
    ]
    names = [f.name for f in PROFILE.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PROFILE)


def by(df, key, value=None):
    rows = df.collect()
    return {r[key]: (r[value] if value else r) for r in rows}
