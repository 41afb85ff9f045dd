import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("sequential_pricing", "document_status", "confirmation_links", "export_positions", "extract_rieder", "totals_upsert", "edited_items")


def test_names_and_oracles():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 100 and len({n for n in names - sql if not re.match(r"op[0-9]+_|pipeline$", n)}) <= 5


def test_smoke_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    ok, message, rows, _ = compare(duck(FOLDER), spark, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok and rows, message
