"""The scrape of a made site on disk: it stops, resumes, is blocked and fails, and misses or repeats no id."""

import json
import re
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle

from sijill.streaming import scrape as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors don't import this module


class Made:
    """A site of ``pages`` pages; a folder keeps what was asked, as each task has a session of its own."""

    def __init__(self, folder, pages, broken=(), blocked=()):
        self.folder, self.pages, self.broken, self.blocked = Path(folder), pages, broken, blocked
        self.name = f"{time.time_ns()}"
        (self.folder / f"session-{self.name}").touch()

    def note(self, what):
        (self.folder / f"{what}-{time.time_ns()}").touch()

    def list(self, page, size):
        if page in self.broken:
            raise ConnectionError(f"page {page}")
        ids = [f"{page}-{i}" for i in range(size)] + [f"{page - 1}-0", "", None]  # pages overlap, and some entries have no id
        return json.dumps({"model": {"totalPages": self.pages, "judgementsCollection": [{"id": i, "caseNumber": f"c{i}", "city": None} for i in ids]}})

    def details(self, key):
        self.note(f"asked-{key}")
        if key in self.broken:
            raise ConnectionError(key)
        if key in self.blocked and not list(self.folder.glob("cooled-*")):
            return "<html>Request Rejected</html>"
        return json.dumps({"model": {"title": f"t{key}", "judgmentNumber": "other", S.TEXT: f"<p>one {key}<br>two</p><script>x</script>"}})


def site(folder, pages, limit=2, broken=(), blocked=(), cool_down=60.0):
    def pause(seconds):
        if seconds == cool_down:
            (Path(folder) / f"cooled-{time.time_ns()}").touch()

    return S.Site(connect=lambda: Made(folder, pages, broken, blocked), size=3, limit=limit, list_attempts=2, detail_attempts=2, delay=0.0, cool_down=cool_down, pause=pause)


def run(spark, made, tmp_path, name, until):
    query = S.scrape(spark, name, made, str(tmp_path / "out"), str(tmp_path / "errors"), str(tmp_path / "checkpoint"), sessions=2)
    try:
        deadline = time.time() + 120
        while time.time() < deadline and query.isActive:
            offsets = [p["sources"][0]["endOffset"] for p in query.recentProgress if p["sources"]]
            if any(int(re.search(r"\d+", str(o))[0]) >= until for o in offsets if o):
                break
            time.sleep(0.2)
        assert query.exception() is None
    finally:
        query.stop()
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def ids(pages):
    return sorted([f"{p}-{i}" for p in range(1, pages + 1) for i in range(3)] + ["0-0"])


def test_stops_and_resumes(spark, tmp_path):
    folder = tmp_path / "site"
    folder.mkdir()
    sizes = run(spark, site(folder, 5), tmp_path, "made_a", 6)
    assert sizes[0] == 2 * 4 and len(sizes) == 3  # two pages a batch, with their entries that have an id
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.collect()) == ids(5)
    # the site has grown; the same checkpoint, a new query
    sizes = run(spark, site(folder, 8), tmp_path, "made_b", 9)
    assert sizes == [8, 4]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.collect()) == ids(8)
    asked = [p.name.rsplit("-", 1)[0].removeprefix("asked-") for p in folder.glob("asked-*")]
    assert sorted(asked) == ids(8)  # each once
    row = out.where("id = '3-1'").first()
    assert (row["page"], row["title"], row["case_number"], row["city"], row["judgment_date"], row["plain_text"]) == (3, "t3-1", "c3-1", None, "", "one 3-1\ntwo")


def test_a_repeated_batch_and_failures(spark, tmp_path):
    folder = tmp_path / "site"
    folder.mkdir()
    made = site(folder, 3, broken=(2, "1-1"))
    rows = [r for n in (1, 2, 3) for r in S.listed(made, n)]
    batch = spark.createDataFrame(rows, S.LISTED)
    for _ in range(2):
        S.absorb(batch, 7, made, str(tmp_path / "out"), str(tmp_path / "errors"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in found.collect()) == ["0-0", "1-0", "1-2", "2-0", "3-0", "3-1", "3-2"]
    failed = {(r["id"], r["page"], r["error"]) for r in spark.read.schema("id string, page int, error string").json(str(tmp_path / "errors")).collect()}
    assert failed == {(None, 2, "ConnectionError: page 2"), ("1-1", 1, "ConnectionError: 1-1")}
    S.absorb(S.retried_errors(spark, str(tmp_path / "errors"), site(folder, 3)), 8, site(folder, 3), str(tmp_path / "out"), str(tmp_path / "errors"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ids(3)


def test_one_cool_down_and_a_new_session(tmp_path):
    made = site(tmp_path, 1, blocked=("1-1",))
    session = S.Session(made)
    first = session.now
    assert session.details("1-1")["title"] == "t1-1" and session.now is not first
    assert len(list(tmp_path.glob("cooled-*"))) == 1 and len(list(tmp_path.glob("asked-1-1-*"))) == 3
    off = site(tmp_path / "none", 1, blocked=("x",), cool_down=0.0)
    (tmp_path / "none").mkdir()
    with pytest.raises(S.Blocked):
        S.Session(off).details("x")


def test_bodies_and_pauses():
    for body in (None, "", " ", "<html>", "sorry, Request Rejected"):
        with pytest.raises(S.Blocked):
            S.answer(body)
    with pytest.raises(ValueError):
        S.answer("{oops")
    with pytest.raises(ValueError):
        S.answer("[1]")
    waits = []
    with pytest.raises(ValueError):
        S.attempted(lambda: "{oops", 8, 120.0, waits.append)
    assert waits == [4.0, 8.0, 16.0, 32.0, 64.0, 120.0, 120.0]
