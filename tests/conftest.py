import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from shopflow.session import build_session

    wh = tempfile.mkdtemp(prefix="shopflow-warehouse-")
    s = build_session("local[4]", shuffle_partitions=4, extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


# An invented menu: (name, category, price, quantity); ids count from 1.
MENU = [
    ("Garlic Bread", "Appetizer", "120.00", 50), ("Corn Soup", "Appetizer", "180.00", 30),
    ("Olive Plate", "Appetizer", "95.00", 25), ("Bean Dip", "Appetizer", "145.00", 20),
    ("Lentil Stew", "Main Course", "280.00", 20), ("Veggie Pie", "Main Course", "250.00", 25),
    ("Rice Bowl", "Main Course", "220.00", 30), ("Noodle Box", "Main Course", "195.00", 25),
    ("Mint Tea", "Drinks", "90.00", 100), ("Apple Juice", "Drinks", "110.00", 100),
    ("Ginger Ale", "Drinks", "120.00", 80), ("Plum Soda", "Drinks", "75.00", 100),
    ("Warm Milk", "Drinks", "95.00", 60), ("Pear Tart", "Dessert", "150.00", 20),
    ("Oat Cookie", "Dessert", "130.00", 15), ("Rice Pudding", "Dessert", "160.00", 15),
    ("House Mix", "Specialty", "160.00", 50), ("Maple Roast", "Specialty", "140.00", 50),
    ("Spice Brew", "Specialty", "130.00", 40), ("Rose Cordial", "Specialty", "145.00", 8),
]


@pytest.fixture(scope="session")
def seed(spark):
    import datetime as dt
    from decimal import Decimal

    from shopflow.schema import EMPLOYEES, ORDER_ITEMS, ORDERS, PRODUCTS, Tables

    ts = dt.datetime(2024, 1, 1)
    products = [(i, n, c, Decimal(p), q, None, 1, ts) for i, (n, c, p, q) in enumerate(MENU, start=1)]
    staff = [(1, "Ada Boss", "ada", "x", "admin", ts), (2, "Cal Till", "cal", "y", "cashier", ts)]
    return Tables(spark.createDataFrame(staff, EMPLOYEES), spark.createDataFrame(products, PRODUCTS),
                  spark.createDataFrame([], ORDERS), spark.createDataFrame([], ORDER_ITEMS))
