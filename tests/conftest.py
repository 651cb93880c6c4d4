from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from orderlens.session import build_session  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return str(DATA)


@pytest.fixture
def order_frame(spark):
    """Seven order lines with known calendar values."""
    product = {
        288563: ("Cereal Toasty Os (Cheerios)", "Cereals", "US FoodsBuffalo (HPSI)"),
        288564: ("Milk Whole", "Dairy", "Dairy Co"),
    }
    rows = [
        (1045, 6420, 9149870, 288563, "07/08/2024", 1.0, 23.17),
        (1045, 6417, 9148894, 288563, "07/08/2024", 1.0, 23.17),
        (1045, 6417, 9635115, 288563, "10/21/2024", 1.0, 23.17),
        (1045, 6359, 9626004, 288563, "10/15/2024", 1.0, 23.17),
        (1045, 4745, 9854860, 288563, "12/04/2024", 1.0, 23.17),
        (1046, 6420, 9149871, 288564, "07/09/2024", 2.0, 4.50),
        (1046, 6417, 9148895, 288564, "07/10/2024", 3.0, 4.50),
    ]
    return spark.createDataFrame(
        [(c, f, o, p, *product[p], d, u, pr) for c, f, o, p, d, u, pr in rows],
        "CustomerID int, FacilityID int, OrderID int, ProductID int, ProductName string, "
        "CategoryName string, VendorName string, CreateDate string, OrderUnits double, Price double",
    )
