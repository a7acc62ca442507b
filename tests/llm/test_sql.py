"""Corpus queries that SQL can express, against their SQL."""

import duckdb
import numpy as np
import pytest

pytest.importorskip("codequarry.llm")

from codequarry import llm  # noqa: E402
from codequarry.llm import near_dedup  # noqa: E402
from codequarry.llm._common import TABLES, bucketed, materialise, release  # noqa: E402
from codequarry.plans.lineage import WRITTEN  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = db.execute(llm.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    made = llm.queries()[name](spark, SF).select(*names).collect()
    plain = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(made) == plain(expected.fetchall())


def test_release_deletes_what_was_written(spark):
    df, table = materialise(spark.range(3), "gone"), bucketed(spark.range(5), "gone_too", "id", 2)
    assert df.count() == 3 and table.count() == 5 and WRITTEN and TABLES
    name = TABLES[-1]
    release(spark)
    assert not WRITTEN and not TABLES and not spark.catalog.tableExists(name)


@pytest.mark.parametrize("repeats", ["none", "a third of one text", "one text", "both texts"])
def test_weights_keep_similar_sets(repeats):
    """Of 300 pairs of sets of 200 shingles with a similarity of 0.8, some repeated up to 30 times, banding and sketches keep 0.97 or more."""
    r, kept = np.random.default_rng(7), 0
    for _ in range(300):
        ids = r.integers(1, 1 << 63, 400).astype(np.uint64)
        first, second = np.ones(200), np.ones(200)
        if repeats == "a third of one text":
            first[r.random(200) < 1 / 3] = r.integers(2, 31)
        elif repeats != "none":
            first = r.integers(1, 31, 200)
            second = r.integers(1, 31, 200) if repeats == "both texts" else second
        made = near_dedup.prob_min_hash(np.repeat([0, 1], 200), np.concatenate([ids[:200], ids[22:222]]), near_dedup.weights(np.concatenate([first, second])), 2, near_dedup.BANDS * near_dedup.ROWS)
        keys = near_dedup.band_keys(made)
        kept += (made[0] == made[1]).sum() >= near_dedup.AGREEING and (keys[0] == keys[1]).any()
    assert kept >= 0.97 * 300
