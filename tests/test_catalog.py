"""Every query that has SQL equals DuckDB on the smallest tables; the rest give rows."""
import math
from pathlib import Path

import duckdb
import pytest

from lanewise.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    rows, columns = df.collect(), sorted(df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()], key=repr)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_similarity_meets_every_pair(spark, tmp_path):
    """Vehicles far apart in number meet as well: 40 vehicles in the same six hours are 20 x 20 pairs."""
    con = duckdb.connect()
    hours = "SELECT h * 40 + v AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (h) HOUR AS ts, v::BIGINT AS user_id, 'view' AS event_type, h + v * 1.5::DOUBLE AS value, '{\"k\": ' || (h + v) || '}' AS props FROM range(40) AS a(v), range(6) AS b(h)"
    con.execute(f"COPY ({hours}) TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalog.queries()["similarity"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)} and len(got) == 400
    want = con.execute(catalog.oracle_sql()["similarity"]).fetchall()
    assert sorted(tuple(plain(v) for v in (r.a, r.b, r.dist)) for r in got) == sorted(tuple(plain(v) for v in r) for r in want)


def test_overlaps_at_the_limit_count_as_in_sql(spark, tmp_path):
    """Three frames of sf0.1 in which an overlap is a fifth but for the last bit, on either side of the limit."""
    frames = {
        38247: [(1, 17804, 44, 42), (2, 14853, 662, 40), (4, 1080, 584, 34), (4, 2926, 9, 36), (4, 18172, 787, 36), (5, 3293, 940, 43), (7, 5864, 688, 36)],
        40939: [(2, 13739, 872, 17), (2, 16837, 749, 36), (6, 4736, 783, 38), (6, 12394, 323, 36), (7, 306, 227, 36), (7, 11377, 709, 36)],
        127745: [(2, 8630, 616, 46), (3, 16081, 286, 35), (5, 2103, 344, 32), (6, 14002, 863, 12)],
    }
    values = ", ".join(f"({f}, {', '.join(map(str, r))})" for f, rows in frames.items() for r in rows)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT o::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, q::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, TIMESTAMP '2000-01-01' AS l_shipdate FROM (VALUES {values}) AS v(o, n, p, s, q)) TO '{tmp_path}/lineitem.parquet' (FORMAT PARQUET)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = catalog.queries()["oriented_totals"](spark, str(tmp_path)).collect()
    want = con.execute(catalog.oracle_sql()["oriented_totals"]).fetchall()
    assert {r.frame_index: (r.pairs, plain(r.total)) for r in got} == {f: (n, plain(t)) for f, n, t in want} and len(got) == 3
