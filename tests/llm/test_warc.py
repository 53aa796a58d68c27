from __future__ import annotations

import os
import random

import duckdb
import pytest
from helpers import rows

from tesserae.llm import queries, warc

SCHEMA = "record_id long, url string, date long, kind string, status int, etag string, last_modified long, payload_digest string, headers map<string,string>"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80/a/?utm_source=x&b=1#top", "example.com/a?b=1"),
        ("https://example.com/a/index.html", "example.com/a"),
        ("https://example.com", "example.com"),
        ("https://example.com/a?ref=x", "example.com/a"),
        ("https://example.com/A?b=1&fbclid=2&c=3", "example.com/A?b=1&c=3"),
        ("", None),
        (None, None),
        ("#x", None),
    ],
)
def test_canonical_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(df.u)).first()[0] == want


def slow(records):
    canon = lambda u: u
    out = []
    for r in records:
        if r[3] != "revisit":
            continue
        date = lambda x: -(1 << 62) if x[2] is None else x[2]
        earlier = [x for x in records if x[3] == "response" and x[4] == 200 and x[1] and x[1] == r[1] and date(x) < date(r)]
        hit = max(earlier, key=lambda x: (date(x), x[0]), default=None)
        own = {k.lower(): v for k, v in sorted((r[8] or {}).items())}
        if not r[1]:
            out.append((r[0], None, None, "no_url", None, own))
        elif hit is None:
            out.append((r[0], canon(r[1]), None, "no_earlier_response", None, own))
        else:
            weak = lambda t: t.removeprefix("W/")
            same = next((a for a in ([weak(r[5]) == weak(hit[5])] if r[5] is not None and hit[5] is not None else [r[i] == hit[i]] if r[i] is not None and hit[i] is not None else [] for i in (5, 6, 7)) if a), [None])[0]
            outcome = "unverified" if same is None else "resolved" if same else "validator_mismatch"
            new = {k: v for k, v in own.items() if k in warc.PERMITTED}
            merged = {k.lower(): v for k, v in sorted((hit[8] or {}).items())} | new if same is not False else own
            out.append((r[0], canon(r[1]), hit[0], outcome, hit[7] if same is not False else None, merged))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(11)
    records = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        # One URL has a third of all records.
        url = rng.choice(["hot", "hot", "a", "b", "c", None, ""])
        records.append(
            (
                i,
                f"h.org/{url}" if url else url,
                rng.choice([None, *range(0, 600_000, 10_000)]),
                kind,
                rng.choice([200, 200, 404, 206]) if kind == "response" else 304,
                rng.choice([None, '"x"', 'W/"x"', '"y"']),
                rng.choice([None, 5, 6]),
                rng.choice([None, "p", "q"]),
                rng.choice([None, {}, {"ETag": f"t{i}", "Content-Length": "3", "date": str(i)}, {"Cache-Control": "c", "Date": "d", "DATE": "e"}]),
            )
        )
    records += records[-5:]
    df = spark.createDataFrame(records, SCHEMA).selectExpr("*", "'z' as key", "1 as span", "2 as own", "3 as hit")
    got = sorted((tuple(r[:5]) + (dict(r.headers),) for r in warc.resolve(df).collect()), key=repr)
    canon = lambda rs: sorted(((a, b, c, d, e, dict(sorted(f.items()))) for a, b, c, d, e, f in rs), key=repr)
    assert canon(got) == canon(slow(records))


def test_no_records(spark):
    assert rows(warc.resolve(spark.createDataFrame([], SCHEMA))) == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    got = queries.op2_warc(spark, folder)
    want = con.sql(queries.ORACLES["op2_warc"]).df()[got.columns].astype(object)
    clean = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) else x
    assert sorted(map(repr, rows(got))) == sorted(repr(tuple(clean(x) for x in r)) for r in want.itertuples(index=False))


def test_queries_of_urls_keep_their_slashes(spark):
    df = spark.createDataFrame([("http://A.com/x/?next=/b/",), ("http://a.com/x?next=/b",), ("http://a.com/?u=/x/index.html",), ("http://a.com/p/index.html?q=1/",)], "u string")
    got = [r[0] for r in df.select(warc.canonical_url(df.u)).collect()]
    assert got == ["a.com/x?next=/b/", "a.com/x?next=/b", "a.com?u=/x/index.html", "a.com/p?q=1/"]
