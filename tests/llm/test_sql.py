"""Queries that have SQL against DuckDB over the whole small tables, and the SQL for urls on pages with links."""

import duckdb
import pytest
from diff import DATA, compare, duck

from cubeloom.llm.queries import ORACLES, QUERIES, RULES
from cubeloom.llm.sql import redirect_rules


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    _, _, problem = compare(spark, duck(DATA), QUERIES[name], ORACLES[name], DATA)
    assert problem is None


def test_url_sql_follows_links():
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    rows = [
        (1, "http://a.org/1", '<link rel="canonical" href="https://shop.net/es/9">'),
        (2, "http://b.org/2", "<meta http-equiv=refresh content='0; url=http://a.org/1#part'>"),
        (3, "http://c.com/3", "<meta http-equiv=refresh content='0; url=http://b.org/2'>"),
        (4, "http://g.org/", '<link rel="canonical" href="http://c.com/3">'), (5, "http://h.org/", None), (6, None, None),
    ]
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = con.sql(redirect_rules(RULES)).fetchall()
    assert {r[0] for r in got if r[4] == "block"} == {1, 2, 4} and len(got) == 6
