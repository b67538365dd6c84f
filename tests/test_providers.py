import struct

import pytest
from pyspark.sql import functions as F

from sijill.functions import providers, vectors
from sijill.operators import fragments
from sijill.session import ship
from sijill.sources import fetch


def test_dense_and_sparse_agree(spark):
    rows = spark.createDataFrame([(1, "a labor contract a"), (2, "another case"), (3, None)], "id long, t string")
    dense = {r["id"]: r["embedding"] for r in providers.embed(rows, "t").collect()}
    assert dense[3] is None
    for r in vectors.hash_embed(rows, "id", "t").collect():
        assert dense[r["id"]][r["dim"]] * 100 == pytest.approx(r["v"])
    unit = providers.embed(rows, "t", normalize=True).where("id = 1").first()["embedding"]
    assert sum(x * x for x in unit) == pytest.approx(1)


def test_chain_falls_back():
    def down(_):
        raise ConnectionError

    assert providers.chain([down, lambda b: [[1.0]] * (len(b) - 1), lambda b: [[2.0]] * len(b)], pause=0)(["a", "b"]) == [[2.0], [2.0]]
    with pytest.raises(ConnectionError):
        providers.chain([down], pause=0)(["a"])


def test_binary_vectors(spark):
    ship(spark)
    rows = spark.createDataFrame([(struct.pack("<HH2f", 2, 0, 1.5, -2.0),), (b"x",), (None,)], "b binary")
    assert [r[0] for r in rows.select(providers.binary_vector("b")).collect()] == [[1.5, -2.0], None, None]
    text = spark.createDataFrame([("[1, 2.5]",)], "t string")
    assert text.select(vectors.parse_vector("t")).first()[0] == [1.0, 2.5]


def test_fragments(spark):
    cases = spark.createDataFrame([(1, "Short text."), (2, "unused")], "case_id long, text string")
    given = spark.createDataFrame([(2, "a", 0, "case", "x. " * 400), (2, "b", 1, "case", " "), (2, "c", 2, "case", "fine")], "case_id long, fragment_id string, pos long, source string, text string")
    rows = fragments.case_fragments(cases, given).orderBy("case_id", "frag_pos").collect()
    assert rows[0]["fragment_id"] == "case_seg_00" and rows[1]["fragment_id"] == "a:s00" and rows[-1]["fragment_id"] == "c"
    assert fragments.case_fragments(cases).where(F.col("case_id") == 2).count() == 1


def test_units(spark):
    regs = spark.createDataFrame([(1, "T", "c", None), (2, "U", None, "body"), (3, None, None, None)], "reg_id long, title string, category string, content_text string")
    chunks = spark.createDataFrame([(1, 7, 0, "chunk"), (2, 8, 0, " ")], "reg_id long, chunk_id long, chunk_index int, text string")
    assert {(r["reg_id"], r["text"], r["fallback"]) for r in fragments.regulation_units(regs, chunks).collect()} == {(1, "chunk", False), (2, "U body", True)}


def test_fetch(spark):
    urls = spark.createDataFrame([("https://a.org/x", "e", None), ("https://a.org/y", None, None), ("http://a.org", None, None)], "url string, etag string, modified string")
    assert {r["status"] for r in fetch.fetch(urls, ("a.org",)).collect()} == {"disabled", "blocked"}
    get = lambda u, e, m: (304, None, None, e) if e else (200, "text/plain", b"t", "n")
    assert {(r["url"][-1], r["status"], r["content"]) for r in fetch.fetch(urls, ("a.org",), get).collect()} == {("x", "not_modified", None), ("y", "ok", b"t"), ("g", "blocked", None)}
