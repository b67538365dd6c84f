"""The manifest against a tree that is built whole, and on the edge cases its docstring defines."""

import hashlib
import zlib

from pyspark.sql import functions as F

from sijill.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, pos long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], n_chars, row["text"])])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, i):
    return [(i >> h & 1, level[(i >> h) ^ 1] if (i >> h) ^ 1 < len(level) else "") for h, level in enumerate(levels[:-1])]


def brute(rows):
    """As the query's rows, sorted by leaf."""
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((-1 if r["doc_id"] is None else r["doc_id"], leaf(r, r["n_chars"]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for v in by.values():
        v.sort(key=lambda x: x[:2])
    trees = {k: levels_of([x[1] for x in by[k]]) for k in langs}
    top = levels_of([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, (_, h, r) in enumerate(by[k]):
            path = way(trees[k], i) + way(top, j)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf(r, r["n_chars"] + 1) if tampered else h
            for left, s in path:
                node = digest(s, node) if left else digest(node, s)
            root = top[-1][0]
            out.append((r["doc_id"], h, trees[k][-1][0], root, digest(*[s for _, s in path]), node, node == root))
    return sorted(out, key=str)


def rows_of(spark, n):
    rows = [(i * 3, f"text ü {i}" * (i % 5), ["en", "de", None, "zz", "é"][(i * i) % 5 if i > 20 else 0], f"s{i % 3}", i % 11 or None, "t", "n", 1) for i in range(n)]
    rows += [(None, "no id", "en", None, 3, "t", "n", 1), (6, None, None, None, None, "t", "n", 1), (9, "", "", "", 0, "t", "n", 1), (9, "again", "en", "s", 2, "t", "n", 1)]
    return spark.createDataFrame(rows + rows[:3], DOCS)


def found(docs, bits):
    return sorted((tuple(r) for r in merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bits).collect()), key=str)


def test_manifest_matches_brute_force(spark):
    docs = rows_of(spark, 150)
    expected = brute(docs.collect())
    assert found(docs, 2) == expected  # several tiers
    assert found(docs.repartition(7), merkle.BITS) == expected
    assert not all(r[6] for r in expected) and any(r[6] for r in expected)


def test_one_row_and_none(spark):
    docs = rows_of(spark, 0)
    one = docs.where("lang = ''").limit(1)
    (row,) = found(one, 3)
    assert row[1] == row[2] == row[3] == leaf(one.first(), 0) and row[4] == digest("")
    assert found(docs.where("false"), 3) == []


def test_traversal_matches_whole_trees():
    for n in [*range(1, 35), 64, 100]:
        nodes = [digest(str(i)).encode() for i in range(n)]
        for levels in (merkle.height(n), merkle.height(n) + 2):
            rows = [nodes]
            for _ in range(levels):
                rows.append([digest(*[x.decode() for x in rows[-1][i : i + 2]]).encode() for i in range(0, len(rows[-1]), 2)])
            paths = [[rows[h][(i >> h) ^ 1] if (i >> h) ^ 1 < len(rows[h]) else None for h in range(levels)] for i in range(n)]
            assert [list(p) for p in merkle.traverse(nodes, levels)] == paths and merkle.root(nodes, levels) == rows[-1][0]


def test_traversal_holds_few_nodes(monkeypatch):
    """Nodes in stacks, paths and results grow with the logarithm of the leaves."""
    made = []
    monkeypatch.setattr(merkle, "Treehash", type("Counted", (merkle.Treehash,), {"__init__": lambda self, level: (made.append(self), super(type(self), self).__init__(level))[1]}))
    most = {}
    for levels in (6, 10):
        made.clear()
        nodes = [digest(str(i)).encode() for i in range(1 << levels)]
        most[levels] = max(sum(len(t.stack) + (t.node is not None) for t in made) for _ in merkle.traverse(nodes, levels))
    assert most[10] <= 3 * 10 and most[10] - most[6] <= 3 * 4
