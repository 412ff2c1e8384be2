"""Every core query against its SQL, on whole tables."""

import pytest

from talkgrain.plans import catalogue
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name])


def test_queries_without_sql(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"random_message"}
    (row,) = catalogue.random_message(spark, SF).collect()
    assert row["msg_id"] is not None and row["url"].startswith("https://chat.example/c/")


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 10 and all("<b>" in r["highlighted"] for r in rows)
    times = [r["post_time"] for r in rows]
    assert times == sorted(times, reverse=True)
