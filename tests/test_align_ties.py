"""Alignment where patches have no gradient: the SQL may take any of the tied offsets, so each row must be one of those."""

import duckdb
import pytest

from cloudgrid.plans import harness


@pytest.mark.parametrize("quantity, tied", [(50.0, [9025, 1, 1, 1]), (0.0, [9025, 5985, 5985, 3969])])
def test_offsets_are_among_the_tied(spark, tmp_path, quantity, tied):
    """A flat map (its first patch sees no border) and an empty one (no patch sees any; those at the far border are cut)."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({quantity}::double AS l_quantity) FROM '/root/testdata/sf0.01/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    sums = harness.oracle_sql()["align_images"].split(", best AS (")[0]
    best = con.execute(f"{sums} SELECT qy, qx, dx, dy, round(c, 6) FROM corr QUALIFY c = max(c) OVER (PARTITION BY qy, qx)").fetchall()
    patches = [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [sum(b[:2] == p for b in best) for p in patches] == tied
    got = sorted(map(tuple, harness.queries()["align_images"](spark, str(tmp_path)).collect()))
    assert [g[:2] for g in got] == patches and set(got) <= set(best)
