"""Every registered query of the maps against its SQL, by DuckDB on the same files."""

import duckdb
import pytest

from arealmap import border_queries, layout_queries  # noqa: F401 - they register their queries
from arealmap import queries as maps

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if type(v).__name__ in ("Decimal", "float") else v
    return sorted((tuple(plain(x[i]) for i in order) for x in found), key=lambda row: [(v is not None, v) for v in row])  # nulls first


@pytest.mark.parametrize("name", sorted(maps.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = maps.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    told = duck.execute(maps.ORACLES[name])
    assert got == rows([c[0] for c in told.description], told.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


def test_entry_without_the_training_data_operators():
    """The library stands without the subpackage and the pipeline."""
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('arealmap.llm', 'corpus_pipeline')): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 50 and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
