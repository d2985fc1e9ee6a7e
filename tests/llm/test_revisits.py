"""Revisits against a plain loop; canonical urls; edge rows."""

import random

from pyspark.sql import functions as F

from playtrail.llm import revisits

SCHEMA = ("record_id bigint, url string, ts bigint, status int, etag string, last_modified string, "
          "headers map<string,string>, canonical string, outcome string, part int")


def record(i, url, ts, status, etag=None, modified=None, headers=None):
    return (i, url, ts, status, etag, modified, headers, "c", "o", 1)


def slow(records):
    out = {}
    for r in records:
        if r[3] != 304:
            continue
        before = [o for o in records if o[3] == 200 and o[1] is not None and o[1] == r[1] and o[2] is not None and r[2] is not None
                  and o[0] is not None and r[0] is not None and (o[2], o[0]) < (r[2], r[0])]
        found = max(before, key=lambda o: (o[2], o[0]), default=None)
        if found is None:
            out[r[0]] = ("missing", None, None)
            continue
        if r[4] and found[4]:
            verdict = "resolved" if r[4].removeprefix("W/") == found[4].removeprefix("W/") else "mismatch"
        elif r[5] and found[5]:
            verdict = "resolved" if r[5] == found[5] else "mismatch"
        else:
            verdict = "unverified"
        merged = dict(found[6] or {}) | {k: v for k, v in (r[6] or {}).items() if k in revisits.PERMITTED and v is not None}
        out[r[0]] = (verdict, found[0], None if verdict == "mismatch" else merged)
    return out


def test_equals_a_plain_loop_with_a_hot_url(spark):
    rng = random.Random(6)
    records = []
    for i in range(600):
        url = "http://hot/" if rng.random() < 0.5 else f"http://u{rng.randrange(60)}/"
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = rng.choice([None, {}, {"etag": "x", "content-length": str(i), "date": str(i)}, {"set-cookie": "s", "vary": None}])
        records.append(record(i, url, rng.choice([None, *range(40)]), rng.choice([200, 304, 304, 404]), tag, rng.choice([None, "m", "n"]), headers))
    records += [record(9000, None, 5, 304), record(None, "http://hot/", 5, 304), record(None, "http://hot/", 1, 200)]
    df = spark.createDataFrame(records, SCHEMA).repartition(7)
    got = {r["record_id"]: (r["outcome"], r["full_id"], r["headers"]) for r in revisits.resolve(df).collect()}
    assert got == slow(records)


def test_canonical_urls(spark):
    urls = {
        "HTTP://www.Example.COM:80/a/?b=2&utm_source=x&a=1#f": "example.com/a?a=1&b=2", "https://e.com": "e.com/",
        "https://e.com/?utm_campaign=x": "e.com/", "https://e.com/x//": "e.com/x", "e.com/x?": "e.com/x", None: None, "": "/",
        "http://e.com:8080/#": "e.com:8080/"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", revisits.canonical_url(F.col("url"))).collect()} == urls


def test_repeated_and_missing_rows(spark):
    rows = [record(1, "http://e/", 1, 200, headers={"a": "b"}), record(2, "http://e/", 2, 304), record(2, "http://e/", 2, 304)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["outcome"], r["full_id"], r["headers"]) for r in revisits.resolve(df).collect()] == [("unverified", 1, {"a": "b"})] * 2
    assert revisits.resolve(df.where("false")).count() == 0
