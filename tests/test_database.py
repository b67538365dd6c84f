"""Scans of a database file: what reaches the database, and that rows are those that Spark's filters leave."""

import sqlite3
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle

from sijill.sources import database as D

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors don't import this module

ROWS = [(i if i % 10 else None, i % 3, ["active", "Active", "repealed", None][i % 4], f"المادة {i}%_x" if i % 5 else None, i / 4) for i in range(1, 101)]
SCHEMA = "id long, regulation_id int, status string, article_ref string, weight double"


class Noted:
    """A connection whose statements are kept in a folder."""

    def __init__(self, path, log):
        self.inner, self.log = sqlite3.connect(path), log

    def cursor(self):
        cursor, log = self.inner.cursor(), self.log

        class Cursor:
            def execute(self, sql, values):
                (Path(log) / f"{time.time_ns()}").write_text(f"{sql} {values}")
                cursor.execute(sql, values)

            def fetchmany(self, n):
                return cursor.fetchmany(n)

        return Cursor()

    def close(self):
        self.inner.close()


@pytest.fixture
def table(tmp_path):
    path, log = str(tmp_path / "db"), str(tmp_path / "log")
    Path(log).mkdir()
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE chunks (id, regulation_id, status, article_ref, weight)")
    c.executemany("INSERT INTO chunks VALUES (?, ?, ?, ?, ?)", ROWS)
    c.commit()
    c.close()
    return D.Table(lambda: Noted(path, log), "chunks", SCHEMA, key="id", parts=4), lambda: [p.read_text() for p in sorted(Path(log).iterdir())]


def test_all_rows_in_ranges(spark, table):
    rows = D.scan(spark, "db_all", table[0])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(ROWS, key=str)
    assert rows.rdd.getNumPartitions() == 4 and sum("IS NULL" in s for s in table[1]()) >= 1


# as SQL, since columns need a session that isn't there yet
FILTERS = [
    ("status = 'active'", '"status" = ?'),
    ("regulation_id in (1, 2)", '"regulation_id" IN (?, ?)'),
    ("id > 20 and id <= 60 and weight < 12.0D", '"id" > ?'),
    ("startswith(article_ref, 'المادة 1')", '"article_ref" LIKE ?'),
    ("contains(article_ref, '%_')", '"article_ref" LIKE ?'),
    ("id is null and status is not null", '"id" IS NULL'),
    ("status <=> null", '"status" IS NULL'),
    ("id > 95 or status = 'repealed'", None),
    ("lower(status) = 'active'", None),
]


@pytest.mark.parametrize("keep,said", FILTERS)
def test_filters_reach_the_database(spark, table, keep, said):
    name = f"db_{FILTERS.index((keep, said))}"
    plain = spark.createDataFrame(ROWS, SCHEMA).where(keep)
    found = D.scan(spark, name, table[0]).where(keep)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    reads = [s for s in table[1]() if "min(" not in s]
    assert reads and all((said in s) if said else ("LIKE" not in s and '"status" =' not in s) for s in reads)


def test_the_plan_keeps_what_spark_must_look_at_again(spark, table):
    plan = D.scan(spark, "db_plan", table[0], ["id", "status"]).where("status = 'active' and id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "(status#" in plan and "> 3" not in plan and "BatchScan db_plan" in plan  # numbers are the database's, texts are compared again


def test_columns_and_patterns(spark, table):
    found = D.scan(spark, "db_like", table[0], ["article_ref"], {"status": "ACT%", "article_ref": "%مادة 1%"})
    assert found.columns == ["article_ref"]
    expected = sorted(a for _, _, s, a, _ in ROWS if a and s and s.lower().startswith("act") and "مادة 1" in a)
    assert sorted(r[0] for r in found.collect()) == expected
    assert all('SELECT "article_ref" FROM' in s for s in table[1]() if "min(" not in s)
    assert D.scan(spark, "db_none", table[0], ["id"], {"status": "nothing"}).collect() == []
