"""The registered queries that SQL can express, against it."""

import pytest

from lucidreq.llm import registry

from ..conftest import DATA, duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(registry.queries()[name](spark, f"{DATA}/sf0.001")) == duck_rows(duck, registry.oracle_sql()[name])
