import pytest

from codeweft.llm import queries

from ..conftest import check_dirty

#: p8_ids gives a row for a null document as well, and p10's statistics change when all texts come twice.
STABLE = {"p1_found", "p1_rates", "p4_found", "p7_found", "p10_found"}


@pytest.mark.parametrize("kind", ["empty", "nulls", "twice", "wide"])
def test_dirty_tables(spark, smallest, tmp_path, kind):
    names = STABLE - ({"p10_found"} if kind == "twice" else set()) | ({"p8_ids", "p9_mix", "p9_shares"} if kind in ("empty", "wide") else set())
    check_dirty(spark, smallest, tmp_path, kind, {n: queries.QUERIES[n] for n in sorted(names)})
