"""Every query against its SQL on the smallest tables; queries without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import compare

from auctionlake.plans import catalog

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        compare(df, catalog.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0
