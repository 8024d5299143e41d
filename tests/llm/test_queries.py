import __spark_entry__ as contract
from ripple.llm import queries


def test_registered_with_the_library():
    """One query for each operator, its SQL where there is some, and the pipeline."""
    names = contract.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.SQL) <= set(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.SQL) <= set(contract.oracle_sql())
