import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sondage.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    """A value that compares alike whichever engine it comes from."""
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def agree(spark, duck, small):
    """Asserts that a query and its statement give the same rows under the same names."""

    def check(query, sql):
        df = query(spark, small)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        found = duck.execute(sql)
        given = [d[0] for d in found.description]
        assert sorted(given) == names
        at = [given.index(c) for c in names]
        assert mine == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)

    return check
