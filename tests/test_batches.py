"""Python workers hold few pages at a time, whatever a partition holds."""

import pytest

from tidemark import registry


@pytest.mark.parametrize("name", ["c2_html_to_text", "c3_strip_containers", "c4_extract_article", "c10_sanitize_html", "c11_structured_html"])
def test_pages_reach_python_in_small_batches(spark, sf_dir, name):
    """Arrow batches are bounded by 10,000 rows, so a worker's memory grew with its partition; rows are pickled by the hundred."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
