"""Rows of a Spark query and of its SQL in one comparable form."""

import contextlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def assert_same(spark, con, folder, build, oracle):
    df = build(spark, folder)
    ran = con.execute(oracle)
    kinds = {d[0]: str(d[1]) for d in ran.description}
    assert sorted(df.columns) == sorted(kinds)
    spark_kind = {"bigint": ("BIGINT", "NUMBER"), "double": ("DOUBLE", "NUMBER"),
                  "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "bool"),
                  "timestamp_ntz": ("TIMESTAMP", "DATETIME"), "int": ("INTEGER", "NUMBER")}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of([d[0] for d in ran.description], ran.fetchall())
    for name, kind in df.dtypes:
        assert any(k in kinds[name] for k in spark_kind[kind]), (name, kind, kinds[name])
    assert len(got) == len(want)
    assert got == want
    return len(got)


NO_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@contextlib.contextmanager
def settings(spark, changed):
    """Settings of the session for a while; afterwards they are what they were, which ``unset`` would not bring back."""
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
