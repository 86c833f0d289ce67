"""Every query of the catalogue against its SQL on the small tables."""

import os
from collections import defaultdict

import duckdb
import pytest

from twinleaf.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert name in ("diff_ranges", "html_subtrees", "html_clone_groups")
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    want = sorted(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)
    assert got == want


def test_html_clone_groups_by_a_walk(spark):
    """From the largest group down: a group goes if ranges of larger groups that stay hold all its instances."""
    groups = defaultdict(list)
    for r in catalogue.html_subtrees(spark, SF).where(f"node_count >= {catalogue.THRESHOLD}").collect():
        groups[r["hash"]].append(r)
    groups = {h: g for h, g in groups.items() if len(g) > 1}
    assert all(len({r.node_count for r in g}) == 1 for g in groups.values())
    kept, held = set(), defaultdict(list)
    for h in sorted(groups, key=lambda h: -groups[h][0].node_count):
        size = groups[h][0].node_count
        if all(any(n > size and lo <= r.start_line and hi >= r.end_line for n, lo, hi in held[r.file]) for r in groups[h]):
            continue
        kept.add((h, size, len(groups[h])))
        for r in groups[h]:
            held[r.file].append((size, r.start_line, r.end_line))
    got = [(r["hash"], r.node_count, r.instance_count) for r in catalogue.html_clone_groups(spark, SF).collect()]
    assert len(got) == len(set(got)) > 0 and set(got) == kept
