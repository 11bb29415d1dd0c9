import io
import re
from contextlib import redirect_stdout

import pytest

from tetraflow.llm import queries


@pytest.mark.parametrize("name", ["op4_linededup", "op7_url_filter"])
def test_native_plans_have_no_python(spark, name):
    said = io.StringIO()
    with redirect_stdout(said):
        queries.queries()[name](spark, "/root/testdata/sf0.001").explain("extended")
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", said.getvalue())


def test_every_oracle_has_its_query():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 10
