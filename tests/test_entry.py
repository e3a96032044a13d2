import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in entry.oracle_sql():
        found = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert plain(rows) == plain([[r[i] for i in order] for r in found.fetchall()])
    else:
        assert rows


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_rest_imports_without_the_subpackage():
    code = "import sys; sys.modules['quirelake.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not any(n.startswith('op') for n in e.queries()), e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)
