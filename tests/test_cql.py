"""The log language: its parser, its predicates, its aggregates."""

import pytest

from memquarry.operators import cql

ROWS = [
    (0, "Session alpha opened at 192.0.2.5", "Session <*> opened at <*>", ["alpha", "192.0.2.5"]),
    (1, "Session beta opened at 192.0.2.6", "Session <*> opened at <*>", ["beta", "192.0.2.6"]),
    (2, "ERROR lost link to node-7", "ERROR lost link to <*>", ["node-7"]),
    (3, "load=95.2 on web", "load=<*> on <*>", ["95.2", "web"]),
    (4, "load=72.5 on db", "load=<*> on <*>", ["72.5", "db"]),
    (5, "error: first\nsecond line", "error: <*>", ["first\nsecond line"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "line_no long, text string, template string, slots array<string>")


def value(rows, q):
    return cql.execute(rows, q).first()["value"]


def found(rows, q):
    return [r["line_no"] for r in cql.execute(rows, q).orderBy("line_no").collect()]


def test_like(rows):
    assert found(rows, "SELECT lines WHERE text LIKE '%error%'") == [2]  # wildcards don't match line feeds
    assert found(rows, "SELECT lines WHERE NOT text LIKE '%error%'") == [0, 1, 3, 4, 5]
    assert found(rows, "select LINES where slot[0] like '_eta'") == [1]


def test_aggregates(rows):
    assert value(rows, "SELECT count()") == 6
    assert value(rows, "SELECT avg(slot[0]) WHERE template LIKE 'load%'") == pytest.approx(83.85)
    assert value(rows, "SELECT min(slot[0])") == 72.5 and value(rows, "SELECT max(slot[0])") == 95.2
    assert value(rows, "SELECT avg(slot[0]) WHERE template LIKE 'Session%'") is None
    assert value(rows.where("false"), "SELECT count()") == 0
    assert value(rows, "SELECT count() LIMIT 4") == 4


def test_comparisons(rows):
    assert found(rows, "SELECT lines WHERE slot[0] >= 80") == [3]
    assert found(rows, "SELECT lines WHERE slot[0] <= 72.5") == [4]
    assert found(rows, "SELECT lines WHERE NOT slot[0] = 95.2") == [0, 1, 2, 4, 5]
    assert found(rows, "SELECT lines WHERE slot[1] >= 'web'") == [3]
    assert found(rows, "SELECT lines WHERE slot[7] = ''") == [0, 1, 2, 3, 4, 5]
    assert found(rows, "SELECT lines WHERE slot[1] = 'web' OR slot[1] = 'db' AND slot[0] > 90") == [3]
    assert found(rows, "SELECT lines WHERE (slot[1] = 'web' OR slot[1] = 'db') AND slot[0] < 90") == [4]


@pytest.mark.parametrize("q", ["", "SELECT", "SELECT nothing", "SELECT lines WHERE", "SELECT lines WHERE text LIKE 5", "SELECT lines LIMIT x", "SELECT lines extra", "SELECT lines WHERE slot[a] = 1", "SELECT lines WHERE text ~ 'a'"])
def test_errors(q):
    with pytest.raises(cql.CqlError):
        cql.parse(q)


def test_quotes():
    assert cql.parse("SELECT lines WHERE text = 'it''s'").where == ("=", "text", "it's")
