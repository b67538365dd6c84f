"""Scraping a paged list and the details of its entries: a partitioned stream of pages, then the details of unseen ids, each once.

The stream's offset is the next page. A batch takes ``limit`` pages at most, each a partition that lists its page on an executor.
Per batch the ids that the output doesn't hold yet are dealt over ``sessions`` tasks, which fetch their details; records are
appended to the output, failures to a side output, a folder a batch. A batch that is repeated after a crash finds what it wrote:
its ids are seen, and its folder of failures is written anew. So a stopped run goes on without missing or repeating an id.

Requests are repeated with growing pauses. A site that blocks details (no JSON but a page or nothing) is left alone once for the
time of ``cool_down``, then asked again by a new session. A page that can't be listed, an entry without details and one whose answer
is no object are failures with their error; they aren't asked for again unless ``retried_errors`` lists them anew.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from sijill.session import ship
from sijill.sources.extract import html_lines
from sijill.sources.tables import write_errors

# A record's columns with their keys in the details and in the list's entry, the one that counts first.
FIELDS = {
    "title": (("details", "title"), ("entry", "judgementNumber")),
    "case_number": (("entry", "caseNumber"), ("details", "judgmentNumber")),
    "court_type": (("entry", "courtType"), ("details", "courtType")),
    "court_name": (("entry", "courtName"), ("details", "courtName")),
    "city": (("entry", "city"), ("details", "city")),
    "hijri_year": (("entry", "hijriYear"), ("details", "hjriiYear")),
    "judgment_date": (("details", "judgmentDate"),),
    "judgment_hijri_date": (("details", "judgmentHijriiDate"), ("entry", "judgementDate")),
}
TEXT = "judgmentTextofRulling"
LISTED = "page int, pos int, id string, entry string, error string"
RECORD = "id string, page int, " + ", ".join(f"{n} string" for n in FIELDS) + ", plain_text string, error string"


class Blocked(RuntimeError):
    """The site answered with something else than JSON, as it does when it limits requests."""


@dataclass(frozen=True)
class Site:
    """A source of pages. ``connect`` makes a session with ``list(page, size)`` and ``details(id)``, both of which give a body or raise."""

    connect: Callable
    first: int = 1
    size: int = 12
    limit: int = 50
    list_attempts: int = 8
    detail_attempts: int = 7
    delay: float = 0.75
    cool_down: float = 600.0
    pause: Callable[[float], None] = time.sleep


def wait(attempt: int, cap: float) -> float:
    return min(cap, 4.0 * 2**attempt)


def answer(body: str | None) -> dict:
    """The JSON object of a body."""
    text = (body or "").strip()
    if not text or text.startswith("<") or "request rejected" in text[:500].lower():
        raise Blocked(f"no JSON but {text[:160]!r}")
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"no object but {text[:160]!r}")
    return found


def attempted(call: Callable[[], str], attempts: int, cap: float, pause: Callable[[float], None]) -> dict:
    """What ``call`` answers; after a failure again, ``attempts`` times in all."""
    for attempt in range(attempts - 1):
        try:
            return answer(call())
        except Exception:  # noqa: BLE001  connection, status or body: all are tried again
            pause(wait(attempt, cap))
    return answer(call())


class Session:
    """One task's connection, made anew after a block."""

    def __init__(self, site: Site):
        self.site, self.now = site, site.connect()

    def page(self, number: int) -> dict:
        s = self.site
        return _model(attempted(lambda: self.now.list(number, s.size), s.list_attempts, 120.0, s.pause))

    def details(self, key: str) -> dict:
        s = self.site
        ask = lambda: attempted(lambda: self.now.details(key), s.detail_attempts, 90.0, s.pause)
        try:
            return _model(ask())
        except Blocked:
            if s.cool_down <= 0:
                raise
        s.pause(s.cool_down)
        self.now = s.connect()
        return _model(ask())


def _model(found: dict) -> dict:
    model = found.get("model")
    return model if isinstance(model, dict) else {}


# ------------------------------------------------------------------ pages


def listed(site: Site, number: int) -> Iterator[tuple]:
    """A row an entry with an id (page, pos, id, entry, error), or one with the error of the page."""
    try:
        found = Session(site).page(number).get("judgementsCollection") or []
    except Exception as e:  # noqa: BLE001  the page becomes a row of the side output
        yield number, 0, None, None, _said(e)
        return
    for i, x in enumerate(found):
        if isinstance(x, dict) and x.get("id"):
            yield number, i, str(x["id"]), json.dumps(x, ensure_ascii=False), None


def _said(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def page_source(name: str, site: Site) -> type[DataSource]:
    """A streaming data source over the site's list; register it with ``spark.dataSource.register``."""

    class Pages(DataSourceStreamReader):
        def __init__(self):
            self.next = site.first

        def initialOffset(self) -> dict:
            return {"page": site.first}

        def latestOffset(self) -> dict:
            last = int(Session(site).page(site.first).get("totalPages") or 0)
            return {"page": max(self.next, min(self.next + site.limit, last + 1))}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.next = end["page"]  # after a restart the engine first names the offset it goes on from, as an empty range
            return [InputPartition(p) for p in range(start["page"], end["page"])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from listed(site, partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LISTED

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Pages()

    return Source


# ------------------------------------------------------------------ details


def record(key: str, page: int, entry: dict, details: dict) -> tuple:
    """The row of an entry; a column takes the first of its keys that is there, and its text is the HTML's lines."""
    both = {"entry": entry, "details": details}
    values = [next((both[w][k] for w, k in keys if k in both[w]), "") for keys in FIELDS.values()]
    return key, page, *[None if v is None else str(v) for v in values], html_lines(details.get(TEXT) or ""), None


def detailed(entries: DataFrame, site: Site, sessions: int) -> DataFrame:
    """RECORD rows of ``entries`` (page, id, entry) from as many tasks as ``sessions``; failures have an error and no other column."""
    ship(entries.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = None
        for p in parts:
            out = []
            for key, page, entry in zip(p["id"], p["page"], p["entry"], strict=True):
                try:
                    session = session or Session(site)
                    out.append(record(key, page, json.loads(entry), session.details(key)))
                    site.pause(site.delay)
                except Exception as e:  # noqa: BLE001  the entry becomes a row of the side output
                    out.append((key, page, *[None] * len(FIELDS), None, _said(e)))
                    site.pause(max(site.delay, 8.0))
            yield pd.DataFrame(out, columns=["id", "page", *FIELDS, "plain_text", "error"])

    return entries.select("page", "id", "entry").repartition(sessions, "id").mapInPandas(run, RECORD)


def _known(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path).select("id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id string")


def absorb(batch: DataFrame, number: int, site: Site, out: str, errors: str, sessions: int = 4) -> None:
    """One batch: details of the ids that ``out`` doesn't hold, each once; records to ``out``, failures to ``errors``/batch=number."""
    spark, batch = batch.sparkSession, batch.persist()  # pages are listed once
    first = batch.where("id is not null").groupBy("id").agg(F.min(F.struct("page", "pos", "entry")).alias("x")).select("x.page", "id", "x.entry")
    found = detailed(first.join(_known(spark, out), "id", "left_anti"), site, sessions).persist()  # both outputs see the same answers
    try:
        failed = batch.where("error is not null").select("id", "page", "error").unionByName(found.where("error is not null").select("id", "page", "error"))
        write_errors(failed, f"{errors}/batch={number}", again=True)
        found.where("error is null").drop("error").write.mode("append").parquet(out)
    finally:
        found.unpersist()
        batch.unpersist()


def scrape(spark: SparkSession, name: str, site: Site, out: str, errors: str, checkpoint: str, sessions: int = 4) -> StreamingQuery:
    """Starts the scrape of all pages that the site has now, from where ``checkpoint`` stands."""
    ship(spark)
    spark.dataSource.register(page_source(name, site))
    pages = spark.readStream.format(name).load()
    step = functools.partial(absorb, site=site, out=out, errors=errors, sessions=sessions)
    return pages.writeStream.foreachBatch(lambda batch, number: step(batch, number)).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def retried_errors(spark: SparkSession, errors: str, site: Site) -> DataFrame:
    """What failed so far as rows of LISTED: pages listed again, entries as they are without their list's columns; for ``absorb``."""
    failed = spark.read.schema("id string, page int, error string").json(errors)
    lost = failed.where("id is null").select("page").distinct()
    again = lost.mapInPandas(lambda parts: (pd.DataFrame(list(r for n in p["page"] for r in listed(site, n)), columns=["page", "pos", "id", "entry", "error"]) for p in parts), LISTED)
    return again.unionByName(failed.where("id is not null").groupBy("id").agg(F.min("page").alias("page")).select("page", F.lit(0).alias("pos"), "id", F.lit("{}").alias("entry"), F.lit(None).cast("string").alias("error")))
