import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spoor.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("spoor-tests", "local[8]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """Lines of one file, in order, optionally cut into splits."""
    def build(lines, file="a.log", split=10**9):
        rows = [(file, i // split, i, text) for i, text in enumerate(lines)]
        return spark.createDataFrame(rows, "src_file string, block_start long, seq long, line string")
    return build


@pytest.fixture(scope="session")
def events_of(spark):
    """Events from short dicts; absent columns get plain values."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            full.append((base + dt.timedelta(seconds=r.get("s", 0)), r.get("ip", "9.9.9.9"),
                         r.get("method", "GET"), r.get("referrer", "-"), r.get("status", 200),
                         r.get("bytes", 0), r.get("url", "/"), r.get("domain", ""), r.get("ua", "UA"),
                         "raw", "a.log", 0, i))
        return spark.createDataFrame(full, (
            "ts timestamp, ip string, method string, referrer string, status int, bytes long, "
            "url string, domain string, ua string, raw string, src_file string, block_start long, "
            "seq long"))
    return build
