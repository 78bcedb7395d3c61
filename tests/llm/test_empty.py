"""Every corpus query over empty tables."""

import pytest
from conftest import DATA

from tidemark.llm import catalog

TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


#: This query adds a conversation of its own to the table's.
ADDS = "op12_prefix_chats"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {ADDS}))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).collect() == []


def test_only_the_added_conversation_is_left(spark, empty):
    assert [(r.conv_id, r.n_turns) for r in catalog.QUERIES[ADDS](spark, empty).collect()] == [(-1, 2)]
