"""Every operator of the folder is registered while the folder exists."""

import __spark_entry__ as entry
from veritext.llm import queries


def test_all_operators_are_registered():
    found = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1, n
    assert "pipeline" in found
    assert {"op2_mixing", "op4_exact_dedup", "op11_line_dedup"} <= set(entry.oracle_sql())
    assert set(queries.all_sql()) <= set(queries.all_queries())
