import pytest

import __spark_entry__ as entry
import bench


@pytest.mark.parametrize("name", ["mc_block_bootstrap", "mc_trades"])
def test_registered_with_all_simulations(spark, name):
    assert {r.n_sims for r in entry.queries()[name](spark, "/root/testdata/sf0.01").collect()} == {10_000}


def test_benchmark_has_the_costly_operators():
    assert {"mc_block_bootstrap", "op3_linededup", "op10_bpe"} <= set(bench.NAMES)
