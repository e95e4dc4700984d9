"""Every query that SQL can express against DuckDB on the same tables, also with other numbers of partitions."""

import duckdb
import pytest

from graindeck import queries

queries.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(name, spark, duck, data):
    r = duck.sql(queries.SQL[name])
    cols = sorted(r.columns)
    want = sorted((tuple(plain(v) for v in x) for x in r.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert rows(queries.QUERIES[name](spark, data)) == (cols, want)


@pytest.mark.parametrize(
    "name", ["retrieval_ranks", "cap_per_group_topk", "chunked_epoch", "representative_first", "length_percentiles", "pareto_frontier", "queue_collisions"]
)
def test_partitions_do_not_matter(name, spark, data):
    found = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(queries.QUERIES[name](spark, data)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_run(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0
