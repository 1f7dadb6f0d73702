"""Every registered query of the page-analysis operators against its SQL."""

import pytest
from conftest import same_rows

from leafcut.plans.oracle import ORACLE_SQL
from leafcut.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        same_rows(got, duck.execute(ORACLE_SQL[name]).fetch_df())
    else:
        assert len(got)


def test_entry_reads_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["bundle_id", "segment_idx", "start_page", "end_page", "page_count", "confidence"]
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["q03_header_footer_change", "q04_blank_separator", "q10_segments"])
def test_segments_shuffle_no_text(spark, sf, name):
    """What goes into an exchange: measures of texts, not texts."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan
    lines = plan.splitlines()
    below = [lines[k + 1] for k, line in enumerate(lines) if "Exchange hashpartitioning(bundle_id" in line]
    assert below
    for line in below:  # the columns that come out of what is exchanged
        outs = [x.split(" AS ")[-1] for x in line.split("[", 1)[-1].rstrip("]").split(", ")]
        assert not any(x.startswith("text#") for x in outs), line
