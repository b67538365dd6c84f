"""The subpackage's registered queries: each applies one operator to its whole table. ``ORACLES`` has SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sijill.llm import decontaminate, embdedup, html, langid, lmscore, merkle, mixing, neardup, pii, quality, search, secrets, toxicity
from sijill.llm.common import fold, read


def op1_decontamination(spark, sf_dir):
    """The documents' places that a benchmark item stands in; clean documents have no row."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_secrets(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op3_main_text(spark, sf_dir):
    return html.main_text(read(spark, sf_dir, "pages"))


def op4_personal_data(spark, sf_dir):
    return pii.find(read(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark, sf_dir):
    return neardup.classes(read(spark, sf_dir, "documents"))


def op7_quality_resampling(spark, sf_dir):
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_suffix_tree_scores(spark, sf_dir):
    return lmscore.score(read(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark, sf_dir):
    return embdedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    """Leaf, roots and proof of each document; those whose id's crc32 is divisible by 7 are tampered with before their path is folded."""
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=fold("doc_id", 7) == 0)


def op12_toxicity(spark, sf_dir):
    """A score for each document, learned from the labelled ones that aren't held out."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_ranked_search(spark, sf_dir):
    """The 20 best documents of each benchmark item."""
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def personal_data_base(spark, sf_dir):
    """What the fixed rules say of op4's result; its other spans are the model's."""
    return op4_personal_data(spark, sf_dir).drop("spans")


def language_folds(spark, sf_dir):
    """What of op5's result doesn't depend on the model: the fold, and which texts have no letter."""
    rows = op5_language_id(spark, sf_dir)
    return rows.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("no_letter"), F.col("score").between(0, 1).alias("in_range"))


def toxicity_folds(spark, sf_dir):
    """What of op12's result doesn't depend on the model: the fold, and what a score and a prediction may be."""
    rows = op12_toxicity(spark, sf_dir)
    return rows.select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"), (F.col("predicted") == (F.col("score") >= 0.5).cast("int")).alias("agrees"))


def lm_base_scores(spark, sf_dir):
    """op8's counts and word baseline; its score is the model's."""
    return op8_suffix_tree_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


def mix_targets(spark, sf_dir):
    """What of op10's result isn't drawn: sizes and targets, whether a document keeps its limit, and whether each source is as near its target as its greatest document."""
    rows = op10_mix_sources(spark, sf_dir)
    by = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("all"), F.max("size").alias("most"), F.count("*").alias("n"))
    near = by.select("source_size", "target", (F.abs(F.col("all") - F.col("target")) <= F.col("most")).alias("near"))
    return rows.join(near, ["source_size", "target"]).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"), "near")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secrets, op3_main_text, op4_personal_data, op5_language_id, op6_minhash_dedup, op7_quality_resampling, op8_suffix_tree_scores, op9_embedding_dedup, op10_mix_sources, op11_merkle_manifest, op12_toxicity, op13_ranked_search, personal_data_base, language_folds, toxicity_folds, lm_base_scores, mix_targets)}



def _crc(x: str) -> str:
    """CRC-32 of a number's digits: a bit at a time, a byte's value before its eight shifts (-1)."""
    steps = f"flatten(list_transform(range(1, length({x}::VARCHAR) + 1), lambda i: [CAST(ascii(substr({x}::VARCHAR, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295, list_reduce({steps}, lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, CAST(4294967295 AS BIGINT)))"


def _spans(kind: int, pattern: str, test: str) -> str:
    """(doc_id, s, kind, e) of a rule: matches and what lies between them give the places."""
    return f"""SELECT doc_id, s, {kind} AS kind, e FROM (SELECT doc_id, m, CAST(coalesce(sum(length(g) + length(m)) OVER w, 0) + length(g) AS BIGINT) AS s, CAST(coalesce(sum(length(g) + length(m)) OVER w, 0) + length(g) + length(m) AS BIGINT) AS e
  FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN (CAST(substr({_DIGITS}, i, 1) AS INT) * 2) // 10 + (CAST(substr({_DIGITS}, i, 1) AS INT) * 2) % 10 ELSE CAST(substr({_DIGITS}, i, 1) AS INT) END)) % 10 = 0"
_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_LOW = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"



def _leaf(n_chars: str) -> str:
    """A document's digest; a value is its length in bytes and itself."""
    said = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"
    return f"sha256({' || '.join(said(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _tree(name: str, leaves: str, key: str) -> str:
    """``name`` (lvl, key, i, h, n): all nodes over ``leaves`` (key, i, h, n), level by level."""
    return f"""{name} AS (SELECT 0 AS lvl, {key}, i, h, n FROM {leaves}
  UNION ALL SELECT lvl + 1, {key}, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lvl, {key}, i // 2, n)"""


def _way(tree: str, leaves: str, key: str) -> str:
    """(key, i, way): for each leaf its siblings with their side, N where it has none."""
    return f"""SELECT o.{key}, o.i, list(CASE WHEN t.h IS NULL THEN 'N' WHEN (o.i >> o.lvl) & 1 = 1 THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY o.lvl) AS way
  FROM (SELECT {key}, i, unnest(range(0, m)) AS lvl FROM {leaves} JOIN (SELECT {key} AS k, max(lvl) AS m FROM {tree} GROUP BY 1) ON k IS NOT DISTINCT FROM {key}) o
  LEFT JOIN {tree} t ON t.{key} IS NOT DISTINCT FROM o.{key} AND t.lvl = o.lvl AND t.i = xor(o.i >> o.lvl, 1) GROUP BY o.{key}, o.i"""


ORACLES = {
    "op11_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS h, CASE WHEN {_crc('doc_id')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_tree('t', 'l', 'lang')},
s AS (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree('u', 's', 'one')},
low AS ({_way('t', 'l', 'lang')}),
high AS ({_way('u', 's', 'one')}),
a AS (SELECT l.doc_id, l.h AS leaf, l.changed, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(low.way, []), coalesce(high.way, [])) AS way
  FROM l LEFT JOIN low ON low.lang IS NOT DISTINCT FROM l.lang AND low.i = l.i JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN high ON high.i = s.i),
p AS (SELECT *, list_reduce(way, lambda acc, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || acc) WHEN 'R' THEN sha256(acc || x[2:]) ELSE sha256(acc) END, changed) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM p""",
    "personal_data_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (
{_spans(0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')} UNION ALL
{_spans(1, '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(x AS BIGINT) > 255)) = 0")} UNION ALL
{_spans(2, '[0-9](?:[ -]?[0-9])+', f'length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}')} UNION ALL
{_spans(3, '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 10 AND 15')}),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  string_agg((['email', 'ip', 'card', 'phone'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS x FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "language_folds": f"""SELECT doc_id, {_crc('doc_id')} % 5 = 0 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS no_letter, true AS in_range FROM documents""",
    "toxicity_folds": f"""SELECT doc_id, {_crc('doc_id')} % 5 = 0 AS held_out, true AS in_range, true AS agrees FROM documents""",
    "lm_base_scores": f"""WITH d AS (SELECT doc_id, {_crc('doc_id')} % 5 = 1 AS held_out, list_append(coalesce({_LOW}, []), chr(10)) AS l FROM documents), t AS (SELECT doc_id, held_out, unnest(l) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)))), 6) AS base_score
FROM t LEFT JOIN c USING (x) CROSS JOIN n GROUP BY doc_id""",
    "mix_targets": f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(coalesce({_WORDS}, [])) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT 0 AS step, source, source_size, w, false AS capped, 0.0::DOUBLE AS unit FROM s
  UNION ALL SELECT step + 1, source, source_size, w, capped OR w * u > 3 * source_size, u FROM (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER () AS u FROM r) WHERE step < 12 AND u IS NOT NULL),
e AS (SELECT * FROM r WHERE step = (SELECT max(step) FROM r))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE w * unit END, 6) AS target, true AS within, true AS near FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source""",
    "op13_ranked_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS l FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(l) AS x, len(l)::BIGINT AS n FROM d),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(l))::BIGINT AS ll FROM d WHERE len(l) > 0),
p AS (SELECT doc_id, x, count(*)::BIGINT AS tf, 75 + (25 * any_value(n) * any_value(nn)) // any_value(ll) AS m FROM t, g GROUP BY doc_id, x),
w AS (SELECT x, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY x),
i AS (SELECT item_id, x, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS x FROM benchmark) GROUP BY item_id, x),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM i JOIN w USING (x) JOIN p USING (x) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "op9_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.x LEFT JOIN degree d ON e.vec_id = d.x
""",
    "op6_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) = 1 THEN w
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM items a JOIN items b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON s.doc_id = l.x
""",
}
