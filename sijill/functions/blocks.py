"""Query sets against a whole corpus as products of block matrices.

The query side goes to the executors a block of bounded size at a time (``BLOCK_BYTES`` of vectors), each with a pass over the
corpus; the corpus is neither shuffled nor joined, and of ``k`` wanted neighbours a task passes on ``k`` a query. Scores of the hash
embedding are quotients of whole numbers, so they are the same in any order of summing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.functions.vectors import DIMS, FIRST, FLAGS
from sijill.session import ship

#: Bytes of query vectors that a pass broadcasts, and rows of the corpus that are multiplied at a time.
BLOCK_BYTES = 64 << 20
ROWS = 1024
#: Tokens whose dimension a worker remembers, bytes of products and pairs of vectors that it holds at a time.
KNOWN, PRODUCT_BYTES, PAIRS = 1 << 17, 16 << 20, 1 << 20

_dims: dict[str, int] = {}


def _dim(token: str) -> int:
    found = _dims.get(token)
    if found is None:
        if len(_dims) >= KNOWN:
            _dims.clear()
        found = _dims[token] = FIRST + int.from_bytes(hashlib.sha1(token.encode()).digest()[:4], "little") % (DIMS - FIRST)
    return found


def hash_matrix(texts: list[str]) -> np.ndarray:
    """The hash embedding of each text times 100, in whole numbers; a null text's is zero."""
    at: list[int] = []
    sizes = []
    for t in texts:
        tokens = t.lower().split() if t else []
        sizes.append(len(tokens))
        at += map(_dim, tokens)
    row = np.repeat(np.arange(len(texts)), sizes)
    out = np.bincount(row * DIMS + np.array(at, np.int64), minlength=len(texts) * DIMS).reshape(-1, DIMS) * 100.0
    for i, t in enumerate(texts):
        if t:
            low = t.lower()
            out[i, : len(FLAGS)] += [100.0 * (w in low) for w in FLAGS]
            out[i, len(FLAGS)] = min(len(t), 1000)
    return out


def entries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dim, value) of the values of ``hash_matrix`` that aren't zero, by row and dimension, without the matrix."""
    at: list[int] = []
    sizes, keys, values = [], [], []
    for i, t in enumerate(texts):
        low = t.lower() if t else ""
        tokens = low.split()
        sizes.append(len(tokens))
        at += map(_dim, tokens)
        if t:
            for k, w in enumerate(FLAGS):
                if w in low:
                    keys.append(i * DIMS + k)
                    values.append(100.0)
            keys.append(i * DIMS + len(FLAGS))
            values.append(float(min(len(t), 1000)))
    hashed, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * DIMS + np.array(at, np.int64), return_counts=True)
    key, value = np.concatenate([hashed, np.array(keys, np.int64)]), np.concatenate([n * 100.0, np.array(values)])
    order = np.argsort(key, kind="stable")
    return key[order] // DIMS, key[order] % DIMS, value[order]


def text_scores(texts: list[str], vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, columns) of cosines with the columns of ``vectors`` (dimensions, columns) of norms ``sizes``.

    A text has some ten values of the thousand: their rows of ``vectors`` are summed, which is the same whole number as the dense
    product's, costs as much as the text has values, and starts no threads beside the task's own.
    """
    row, dim, value = entries(texts)
    out = np.zeros((len(texts), vectors.shape[1]))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    if not len(starts):
        return out
    ends = np.r_[starts[1:], len(row)]
    most = max(1, PRODUCT_BYTES // (8 * vectors.shape[1]))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        part = slice(starts[i], ends[j - 1])
        out[row[starts[i:j]]] = np.add.reduceat(vectors[dim[part]] * value[part, None], starts[i:j] - starts[i])
        i = j
    n = np.sqrt(np.bincount(row, value * value, len(texts)))
    return out / (np.where(n == 0, 1.0, n)[:, None] * sizes)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors of one length; a null vector is zero."""
    rows = [np.zeros(0) if v is None else np.asarray(v, float) for v in column.to_numpy(zero_copy_only=False)]
    size = max((len(v) for v in rows), default=0)
    return np.stack([v if len(v) == size else np.zeros(size) for v in rows]) if rows else np.zeros((0, 0))


def norms(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1))
    return np.where(n == 0, 1.0, n)


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half away from zero, as the database's ROUND has it."""
    return np.copysign(np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits, x)


class Queries:
    """A block of the query side: ids, vectors and their norms, and for each group the places of the queries that don't meet it."""

    def __init__(self, ids: list, vectors: np.ndarray, without: list | None = None):
        self.ids, self.vectors, self.norms = ids, vectors, norms(vectors)
        self.without: dict[str, list[int]] = {}
        for i, groups in enumerate(without or ()):
            for g in groups or ():
                self.without.setdefault(g, []).append(i)

    def scores(self, m: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """(rows of ``m``, queries) of cosines."""
        n = norms(m) if n is None else n
        return (m @ self.vectors.T) / (n[:, None] * self.norms)

    @functools.cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.vectors.T)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """The same of the texts' hash embeddings."""
        return text_scores(texts, self.columns, self.norms)


def query_blocks(queries: DataFrame, embed: bool) -> Iterator:
    """Broadcast blocks of ``queries`` (id, and text or vector as ``what``), read a partition at a time."""
    rows, size = [], 0

    def block():
        what = pa.array([r["what"] for r in rows])
        return queries.sparkSession.sparkContext.broadcast(Queries([r["id"] for r in rows], hash_matrix(what.to_pylist()) if embed else matrix(what), [r["without"] for r in rows] if "without" in queries.columns else None))

    for r in queries.where("what is not null").orderBy("id").toLocalIterator():
        rows.append(r)
        size += 8 * (DIMS if embed else len(r["what"]))
        if size >= BLOCK_BYTES:
            yield block()
            rows, size = [], 0
    if rows:
        yield block()


class _Kept:
    """The ``k`` best of each of ``n`` queries so far, by key and then id: only pairs that reach a query's k-th are put in order."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.id, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``key`` and ``score``: (rows, queries); a key of minus infinity doesn't count."""
        row, query = np.nonzero((key >= self.least) & (key > -np.inf))
        if not len(row):
            return
        query, id_ = np.concatenate([self.query, query]), np.concatenate([self.id, ids[row]])
        key, score = np.concatenate([self.key, key[row, query[len(self.query) :]]]), np.concatenate([self.score, score[row, query[len(self.query) :]]])
        order = np.lexsort((id_, -key, query))
        at = query[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        full = order[place == self.k - 1]
        self.least[query[full]] = key[full]
        order = order[place < self.k]
        self.query, self.id, self.key, self.score = query[order], id_[order], key[order], score[order]


def by_score(group: str | None, scores: np.ndarray) -> list[tuple[str | None, np.ndarray]]:
    """The default order: by the score in six digits, all rows of a group together."""
    return [(group, rounded(scores))]


def _scored(batches, shared, embed: bool, k: int | None, named: bool, keys: Callable):
    q = shared.value
    kept: dict = {}  # by group
    rows = min(ROWS, max(64, PAIRS // len(q.ids)))

    def out(group, x: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.array(q.ids)[x]), pa.array(ids), pa.array([group] * len(x), pa.string()), pa.array(scores)], ["query_id", "id", "grp", "score"])

    for b in batches:
        for begin in range(0, b.num_rows, rows):
            part = b.slice(begin, rows).filter(b.slice(begin, rows).column("what").is_valid())
            if not part.num_rows:
                continue
            s = q.of_texts(part.column("what").to_pylist()) if embed else q.scores(matrix(part.column("what")))
            ids = part.column("id").to_numpy()
            if k is None:
                for i in range(0, len(q.ids), 256):
                    some = np.arange(i, min(len(q.ids), i + 256))
                    yield out(None, np.tile(some, len(ids)), np.repeat(ids, len(some)), s[:, some].ravel())
                continue
            groups = np.array(part.column("grp").to_pylist(), object) if named or q.without else None
            for g in q.without.keys() & set(groups.tolist()) if q.without else ():
                s[np.ix_(groups == g, q.without[g])] = -np.inf
            for g in dict.fromkeys(groups.tolist()) if named else (None,):
                mine = np.flatnonzero(groups == g) if named else slice(None)
                for name, key in keys(g, s[mine]):
                    if name not in kept:
                        kept[name] = g, _Kept(len(q.ids), k)
                    kept[name][1].add(key, s[mine], ids[mine])
    for g, x in kept.values():
        for i in range(0, len(x.query), 100_000):
            part = slice(i, i + 100_000)
            yield out(g, x.query[part], x.id[part], x.score[part])


def scored(queries: DataFrame, corpus: DataFrame, k: int | None = None, without: DataFrame | None = None, keys: Callable = by_score) -> DataFrame:
    """(query_id, id, grp, score): cosines of ``queries`` (id, what) and ``corpus`` (id, what, and possibly grp), ids being long.

    ``what`` is a text, embedded by the hash embedding, or a vector. Without ``k`` all pairs; else at least each query's best ``k`` by
    the score in six digits and the id, of each group if there are any, from which the caller takes the first ones. Null texts and
    vectors score with nothing; a zero vector's norm counts as one; of vectors of other lengths than the longest all scores are 0.

    With ``without`` (id, grp) a query's best ``k`` are those outside its groups there, of all others together (grp comes out null).
    ``keys`` makes other orders: of a group and its scores (rows, queries) it returns named arrays of keys, and each name keeps its
    own ``k`` of the greatest keys (of equal ones the least ids).
    """
    spark = corpus.sparkSession
    ship(spark)
    embed = dict(corpus.dtypes)["what"] == "string"
    grouped = "grp" in corpus.columns
    own = corpus.select(F.col("id").cast("long").alias("id"), "what", *([F.col("grp").cast("string").alias("grp")] if grouped else []))
    queries = queries.select(F.col("id").cast("long").alias("id"), "what")
    if without is not None:
        not_met = without.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("string").alias("grp")).groupBy("id").agg(F.collect_set("grp").alias("without"))
        queries = queries.join(not_met, "id", "left")
    schema = "query_id long, id long, grp string, score double"
    found = [own.mapInArrow(functools.partial(_scored, shared=x, embed=embed, k=k, named=grouped and without is None, keys=keys), schema) for x in query_blocks(queries, embed)]
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _sparse(batches):
    for b in batches:
        for begin in range(0, b.num_rows, ROWS):
            part = b.slice(begin, ROWS)
            m = hash_matrix(part.column("what").to_pylist())
            row, dim = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(dim.astype(np.int32)), pa.array(m[row, dim].astype(np.int64))], ["id", "dim", "v"])


def sparse(corpus: DataFrame) -> DataFrame:
    """(id, dim, v): the hash embedding's values that aren't zero, times 100, of ``corpus`` (id, what); no shuffle."""
    ship(corpus.sparkSession)
    kind = dict(corpus.dtypes)["id"]
    return corpus.select("id", "what").mapInArrow(_sparse, f"id {kind}, dim int, v long")
