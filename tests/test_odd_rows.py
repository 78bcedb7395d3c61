"""Every query against its SQL over odd rows, and over empty tables."""

from concurrent.futures import ThreadPoolExecutor

import odd
import pytest
from compare import database, same
from conftest import DATA

from tidemark.plans import catalog


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Tables this small take longer to compile for than to read."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write(spark, DATA, path)
    return path


@pytest.fixture(scope="module")
def con(odd_dir):
    return database(odd_dir)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    odd.empty(spark, DATA, path)
    return path


class Done:
    """A query's columns and rows, or what it raised."""

    def __init__(self, query, spark, path):
        try:
            df = query(spark, path)
            self.columns, self.rows, self.error = df.columns, df.collect(), None
        except Exception as e:  # raised again in the test of that query
            self.error = e

    def collect(self):
        if self.error:
            raise self.error
        return self.rows


def at_once(spark, path):
    """All queries over a folder, several at a time."""
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(catalog.QUERIES, pool.map(lambda q: Done(q, spark, path), catalog.QUERIES.values()), strict=True))


@pytest.fixture(scope="module")
def odd_results(spark, odd_dir):
    return at_once(spark, odd_dir)


@pytest.fixture(scope="module")
def empty_results(spark, empty_dir):
    return at_once(spark, empty_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_odd_rows(odd_results, con, name):
    done = odd_results[name]
    done.collect()
    if name in catalog.ORACLE_SQL:
        same(done, con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(empty_results, name):
    empty_results[name].collect()
