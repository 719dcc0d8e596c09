import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from pagewright import registry

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_name_and_most_have_sql():
    runs, sql = registry.queries(), registry.oracle_sql()
    assert sql.keys() <= runs.keys() and len(sql) > 0.9 * len(runs) and len(runs) > 120


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="sample tables aren't here")
def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["doc_id", "page", "r", "rel_path"]
    got.collect()


def test_the_engine_does_not_need_the_training_data_operators():
    code = "import sys; sys.modules['pagewright.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__)).stdout.split()
    assert int(out[-2]) == len(registry.queries()) and out[-1] == "False"
