"""Queries over images and files use every supplier, on a table with more than ten."""

import duckdb
import pytest

from skein.plans.oracles import ORACLES
from skein.plans.queries import QUERIES

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{BIG}/{t}.parquet')")
    return con


def both(spark, duck, name):
    df = QUERIES[name](spark, BIG)
    found = duck.execute(ORACLES[name])
    got = sorted(map(tuple, df.select(*[c[0] for c in found.description]).collect()))
    assert got == sorted(found.fetchall())
    return got


@pytest.mark.parametrize("name", ["g_binary_gaps", "g_mapped_spans"])
def test_every_image_has_rows(spark, duck, name):
    assert {r[0] for r in both(spark, duck, name)} == {r[0] for r in duck.execute("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()}


def test_gaps_reach_the_highest_addresses(spark, duck):
    assert max(r[2] for r in both(spark, duck, "g_binary_gaps")) == duck.execute("SELECT max(l_orderkey) * 40 FROM lineitem").fetchone()[0]


def test_calls_lie_in_all_images(spark, duck):
    got = both(spark, duck, "g_binary_calls_whole")
    assert len({r[0] for r in got}) > 50 and max(r[0] for r in got) > 90


@pytest.mark.parametrize("name", ["g_interval_overlap_whole", "g_tightest_owner"])
def test_events_meet_units_of_all_files(spark, duck, name):
    met = ",".join(str(r[0]) for r in both(spark, duck, name))
    files = "SELECT count(DISTINCT user_id % (SELECT count(*) FROM supplier)) FROM events"
    assert duck.execute(f"{files} WHERE event_id IN ({met})").fetchone() == duck.execute(files).fetchone() == (100,)
