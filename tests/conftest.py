import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelframe.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


SEED_SCHEMA = ("mailitm_fid string, depot_region string, depot_office string, last_event string, "
               "is_delivered boolean, shipment_type string, is_crbt boolean, crbt_amount decimal(18,3), "
               "revenue_ca decimal(18,3), weight_kg double, interval_days int, deposit_year int, deposit_month int, "
               "next_region string, deposit_date date, last_event_region string, last_event_office string, "
               "last_event_date date, source string")


@pytest.fixture(scope="session")
def seed(spark):
    """The three national seed rows of the source system's tests."""
    d = dt.date(2026, 2, 10)
    rows = [
        ("A1", "SFAX", "Agence Sfax", "Envoi Livré", True, "Ordinaire", False, None, Decimal(7), 5.0, 2, 2026, 1,
         None, d, "SFAX", "Bureau Sfax", d, "national"),
        ("A2", "SFAX", "Agence Sfax", "Recevoir envoi", False, "CRBT", True, Decimal(50), Decimal(5), 12.0, 9, 2026,
         2, None, d, "SFAX", "Bureau Sfax", d, "national"),
        ("A3", "TUNIS", "Bureau Tunis", "Envoi Livré", True, "Ordinaire", False, None, Decimal(6), 1.0, 1, 2026, 2,
         None, d, "TUNIS", "Bureau Tunis", d, "national"),
    ]
    return spark.createDataFrame(rows, SEED_SCHEMA)
