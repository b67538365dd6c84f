"""Every path of the recognition chain, and that a provider is asked only for what the one before it failed."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

from sijill.sources import ocr

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors don't import this module

SCHEMA = "id long, method string, content_type string, name string, content binary, raw string, warnings array<string>"


def provider(folder, name, fails, says=None):
    def read(data, kind, file):
        (Path(folder) / f"{name}-{file}").touch(exist_ok=False)
        if file in fails:
            raise OSError(f"{name} can't read {file}")
        return "" if file.startswith("blank") else f"{name}:{data.decode()}:{kind}"

    return ocr.Provider(name, read)


ROWS = [
    (1, "text", "text/plain", "plain", b"x", "short", None),
    (2, "pdf", "application/pdf", "long", b"x", "y" * 500, ["before"]),
    (3, "pdf", "application/pdf", "short", b"abc", "  few   words \0", ["before"]),
    (4, "pdf", None, "rtl", b"abc", "نص " * 300, None),
    (5, "image", "image/png", "second", b"abc", None, None),
    (6, "image", "image/png", "blank both", None, "", []),
    (7, "pdf", "application/pdf", None, b"abc", "kept", None),
    (8, None, None, None, None, None, None),
]


def test_paths(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    one, two = provider(tmp_path, "one", ("second", "document")), provider(tmp_path, "two", ("document",))
    found = {r["id"]: (r["text"], r["extraction_method"], r["ocr_provider_used"], r["fallback_stage"], r["warnings"]) for r in ocr.recognized(rows, one, two).collect()}
    assert found == {
        1: ("short", "parser_text", "none", "none", None),
        2: ("y" * 500, "parser_pdf", "none", "none", ["before"]),
        3: ("one:abc:application/pdf", "ocr_primary", "one", "none", ["before"]),
        4: ("one:abc:application/octet-stream", "ocr_primary", "one", "none", []),
        5: ("two:abc:image/png", "ocr_secondary", "two", "secondary", ["one can't read second"]),
        6: ("", "parser_image_fallback", "none", "parser_only", ["Primary OCR provider failed.", "Secondary OCR provider failed."]),
        7: ("kept", "parser_pdf_fallback", "none", "parser_only", ["one can't read document", "two can't read document"]),
        8: ("", None, "none", "none", None),
    }
    # each file once at most, the second provider only for what the first failed
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["one-short", "one-rtl", "one-second", "one-blank both", "one-document", "two-second", "two-blank both", "two-document"])


@pytest.mark.parametrize("primary,secondary", [(False, False), (False, True)])
def test_without_providers(spark, tmp_path, primary, secondary):
    rows = spark.createDataFrame(ROWS[4:5], SCHEMA)
    row = ocr.recognized(rows, None, provider(tmp_path, "two", ()) if secondary else None).first()
    assert row["ocr_provider_used"] == ("two" if secondary else "none") and row["warnings"][0] == "Primary OCR provider isn't configured."
    assert ocr.recognized(rows.where("false")).collect() == []
