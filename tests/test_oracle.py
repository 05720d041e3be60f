"""Every registered query against its SQL on the smallest data folder."""

import pathlib
import subprocess
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_oracle import canonical  # noqa: E402
from workload.tables import BASE  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


#: Queries of the detachable text-collection folder are tested in ``tests/llm``.
NAMES = sorted(name for group in entry.CORE for name in group.QUERIES)


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["lexloom.llm", "corpus_pipeline", "xxhash"])
def test_other_queries_stand_without_the_detachable_folder(missing):
    hide = f"""
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
core = {{n for g in entry.CORE for n in g.QUERIES}}
assert core <= set(entry.queries()) and core <= set(entry.oracle_sql())
assert "pipeline" not in entry.queries()
"""
    subprocess.run([sys.executable, "-c", hide], cwd=ROOT, check=True, timeout=300)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got = canonical(df.collect(), df.columns)
    assert got == canonical(cursor.fetchall(), columns)
    assert got
