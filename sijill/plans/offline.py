"""The offline run from judgments to triplets: stages wired by fingerprints, outputs as tables, a manifest with artifacts and aliases.

A table's fingerprint is of its content, whatever its order, partitions and files; a stage's is of its name, its parameters and its
inputs' fingerprints. A stage writes to a folder of its fingerprint, so a run takes up every output whose inputs are unchanged, and
an unfinished one, which the manifest doesn't list, is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions import blocks
from sijill.functions import vectors as V
from sijill.operators import citations, training
from sijill.plans.pipeline import Manifest


@dataclass(frozen=True)
class Stage:
    """``make`` gives the stage's table and counters from the tables of ``inputs``, in their order, and ``parameters``."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., tuple[DataFrame, dict]]
    parameters: dict = field(default_factory=dict)


def fingerprint(table: DataFrame) -> str:
    """Of a table's columns, types and rows, in any order; repeated rows count."""
    columns = sorted(table.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    found = table.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"s{i}") for i in range(4)]).first()
    kinds = [(c, table.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(json.dumps([kinds, *map(str, found)]).encode()).hexdigest()


def run(spark: SparkSession, tables: dict[str, DataFrame], stages: list[Stage], out: str, manifest: Manifest) -> dict[str, DataFrame]:
    """The tables of all stages, read from where they were written now or by an earlier run.

    The manifest gets for each stage its status (done, or reused for an output that was there), its fingerprint and counters; under
    artifacts every output ever written, and under latest where the last one of each stage lies. A failure is noted and raised again.
    """
    prints = {name: fingerprint(t) for name, t in tables.items()}
    known, doc = dict(tables), manifest.doc
    doc.setdefault("artifacts", [])
    doc.setdefault("latest", {})
    doc["status"] = "running"
    for stage in stages:
        said = json.dumps([stage.name, stage.parameters, [prints[i] for i in stage.inputs]], sort_keys=True)
        prints[stage.name] = mark = hashlib.sha256(said.encode()).hexdigest()
        written, status = next((a for a in doc["artifacts"] if a["fingerprint"] == mark), None), "reused"
        if written is None:
            manifest.stage(stage.name, "running", fingerprint=mark)
            try:
                table, counters = stage.make(*[known[i] for i in stage.inputs], **stage.parameters)
                path = f"{out}/{stage.name}/{mark[:16]}"
                table.write.mode("overwrite").parquet(path)
            except Exception as e:
                manifest.stage(stage.name, "failed", error=str(e))
                doc["status"] = "failed"
                manifest.save()
                raise
            status, written = "done", {"stage": stage.name, "fingerprint": mark, "path": path, "counters": counters}
            doc["artifacts"].append(written)
        doc["latest"][stage.name] = written["path"]
        manifest.stage(stage.name, status, fingerprint=mark, counters=written["counters"])
        known[stage.name] = spark.read.parquet(written["path"])
    doc["status"] = "done"
    manifest.save()
    return {s.name: known[s.name] for s in stages}


# ------------------------------------------------------------------ the stages


def _ingest(judgments: DataFrame, least: int) -> tuple[DataFrame, dict]:
    """Judgments (id, text, category) whose text has ``least`` characters, the first of an id by text."""
    kept = judgments.where((F.length("text") >= least) & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("text", "category")).alias("x"))
    return kept.select("id", "x.text", "x.category"), {}


def _cited(cases: DataFrame, titles: DataFrame, least: float) -> tuple[DataFrame, dict]:
    found = citations.extract(cases)
    return citations.with_confidence(found, citations.resolve(found.where("name <> ''"), titles, least)), {}


def _sampled(cited: DataFrame, n: int, seed: int) -> tuple[DataFrame, dict]:
    """For checks by people: the citations of ``n`` cases."""
    return cited.join(training.sample(cited.select("id").distinct(), "id", n, seed), "id", "left_semi"), {}


def _paired(cases: DataFrame, cited: DataFrame, chunks: DataFrame, near: int, seed: int) -> tuple[DataFrame, dict]:
    """Triplets; hard negatives come from the ``near`` best chunks by hash embedding."""
    found = blocks.scored(cases.select("id", F.col("text").alias("what")), chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("what")), near)
    scores = V.top_k(found, ["query_id"], [F.desc("score"), F.col("id")], near, "_r").select(F.col("query_id").alias("id"), F.col("id").alias("chunk_id"), "score")
    first = chunks.groupBy("reg_id").agg(F.min_by("content", F.struct("chunk_index", "chunk_id")).alias("content"))
    given = cited.select("id", F.col("title_id").alias("reg_id"), "article_number")
    return training.counted_triplets(cases, given, chunks, scores, first, seed=seed)


def stages(least: int = 50, match: float = 0.5, checked: int = 50, near: int = 200, seed: int = 42) -> list[Stage]:
    """From the tables judgments (id, text, category), titles (title_id, title) and chunks (chunk_id, reg_id, chunk_index, article_ref, category, content)."""
    return [
        Stage("ingest", ("judgments",), _ingest, {"least": least}),
        Stage("citations", ("ingest", "titles"), _cited, {"least": match}),
        Stage("qa", ("citations",), _sampled, {"n": checked, "seed": seed}),
        Stage("triplets", ("ingest", "citations", "chunks"), _paired, {"near": near, "seed": seed}),
    ]
