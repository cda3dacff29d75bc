import pytest

import __spark_entry__ as entry
from pagesieve.llm.queries import registry

FOUND = {
    "p2_found": "table_name string, url string, node_id int", "p3_found": "url string", "p4_found": "url string, node_id int", "p5_found": "url string, line_no int",
    "p6_found": "url string", "p7_found": "feature_id bigint", "p8_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
}


def test_registered():
    assert set(registry.queries) <= set(entry.queries()) and set(FOUND) <= set(registry.queries)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, name):
    df = registry.queries[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(set(registry.queries) - set(FOUND)))
def test_other(spark, name):
    assert registry.queries[name](spark, "/root/testdata/sf0.001").columns
