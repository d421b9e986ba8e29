import pytest

from codeweft.plans import integrity

from .conftest import check_dirty

FOUND = {k: f for k, f in integrity.QUERIES.items() if k in ("p2_found", "p3_found", "p5_found", "p5_paths", "p6_found")}


@pytest.mark.parametrize("kind", ["empty", "nulls", "twice", "wide"])
def test_dirty_tables(spark, smallest, tmp_path, kind):
    check_dirty(spark, smallest, tmp_path, kind, FOUND)
