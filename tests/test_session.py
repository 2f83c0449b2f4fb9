import pytest

from reviewmill.session import new_path, scratch, settle, settle_at, shared_dir
from reviewmill.streaming.ingest import names_below


def test_settled_tables_go_with_their_block(spark):
    folder = f"{shared_dir(spark)}/reviewmill"
    kept = new_path(spark, "kept")
    with scratch(spark):
        inner = settle(spark.range(10), "inner")
        with scratch(spark):
            settle(spark.range(3), "innermost")
        result = settle_at(inner.filter("id > 4"), kept)
    assert result.count() == 5
    assert not any(name.startswith("scratch-") for name in names_below(spark, folder))
    with pytest.raises(ValueError):
        with scratch(spark):
            settle(spark.range(3), "lost")
            raise ValueError
    assert not any(name.startswith("scratch-") for name in names_below(spark, folder))
    assert "/scratch-" not in new_path(spark, "after")
