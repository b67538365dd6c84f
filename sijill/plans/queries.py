"""Registered queries over the engine's own operators, each with the SQL that DuckDB answers on the same tables.

Roles of the tables: benchmark items are cases, documents regulations, embeddings precomputed vectors with their label as
regulation, labels verdicts, conversations chats. Arabic texts, citations and dates are made in the query from TPC-H columns.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions import answers, blocks
from sijill.functions import text as T
from sijill.functions import vectors as V
from sijill.functions.segment import max_sim, segment
from sijill.operators import agentic, chat, citations, fragments, insights, layout, ranking, training
from sijill.session import settled, ship
from sijill.sources import extract, guarded, ocr

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """One file of one row group is one task; texts and vectors that are worked on go to all cores first."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# ------------------------------------------------------------------ SQL shared by the oracles

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]{{2,}}')"
_TOKEN_SET = "list_distinct(" + _TOKENS + ")"


def _embed(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``name`` (id, dim, v) and ``name``_n (id, norm2) of the hash embedding times 100."""
    return f"""
{name}_tok AS (SELECT id, tok, count(*) * 100 AS v FROM (SELECT {key} AS id, unnest(string_split_regex(lower({text}), '\\s+')) AS tok FROM {source}) WHERE tok <> '' GROUP BY id, tok),
{name}_all AS (
  SELECT id, CAST(4 + (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT % 1020) AS BIGINT) AS dim, v FROM (SELECT id, v, sha1(tok) AS h FROM {name}_tok)
  UNION ALL SELECT {key}, 0, 100 FROM {source} WHERE contains(lower({text}), 'contract')
  UNION ALL SELECT {key}, 1, 100 FROM {source} WHERE contains(lower({text}), 'labor')
  UNION ALL SELECT {key}, 2, 100 FROM {source} WHERE contains(lower({text}), 'case')
  UNION ALL SELECT {key}, 3, least(length({text}), 1000) FROM {source}),
{name} AS (SELECT id, dim, CAST(sum(v) AS BIGINT) AS v FROM {name}_all GROUP BY id, dim),
{name}_n AS (SELECT id, CAST(sum(v * v) AS BIGINT) AS n2 FROM {name} GROUP BY id)"""


def _pairs(a: str, b: str) -> str:
    return f"""SELECT x.id AS l, y.id AS r, CAST(sum(x.v * y.v) AS BIGINT) / (sqrt(any_value(xn.n2)) * sqrt(any_value(yn.n2))) AS score
  FROM {a} x JOIN {b} y ON x.dim = y.dim JOIN {a}_n xn ON xn.id = x.id JOIN {b}_n yn ON yn.id = y.id GROUP BY x.id, y.id"""


_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?؟؛;\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_OBL = r"(?i)(^|[^\p{L}\p{N}_])(must|shall|required|obligation|يلتزم|يجب|يتعين|يلزم)([^\p{L}\p{N}_]|$)"
_RISK = r"(?i)(^|[^\p{L}\p{N}_])(penalty|fine|imprison[\p{L}\p{N}_]*|sanction[\p{L}\p{N}_]*|prohibited|forbidden|يعاقب|غرامة|السجن|الحبس|يحظر|ممنوع)([^\p{L}\p{N}_]|$)"


def _windows(name: str, source: str) -> str:
    """CTEs up to ``name`` (id, pos, w): the windows of ``source`` (id, text), each rule a step of its own."""
    n, flat = name, r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
    ends = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
{n}_p AS (SELECT id, CAST(generate_subscripts(l, 1) AS BIGINT) AS pi, trim(unnest(l), {ends}) AS p FROM (SELECT id, string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n+') AS l FROM {source})),
{n}_s AS (SELECT id, pi, p, CASE WHEN length(p) <= 600 THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(regexp_replace(p, '([.!?؟؛])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, {ends})), lambda x: x <> '') END AS l FROM {n}_p WHERE p <> ''),
{n}_i AS (SELECT id, pi, CAST(generate_subscripts(l, 1) AS BIGINT) AS si, unnest(l) AS s, len(l) AS n FROM (SELECT id, pi, CASE WHEN len(l) < 2 THEN [p] ELSE l END AS l FROM {n}_s)),
{n}_h AS (SELECT id, pi, si, CAST(0 AS BIGINT) AS k, '' AS piece, s AS rest FROM {n}_i WHERE length(s) > 600
  UNION ALL SELECT id, pi, si, k + 1, left(rest, c), CASE WHEN length(rest) > 600 THEN ltrim(substr(rest, c + 1)) ELSE '' END FROM (
    SELECT *, CASE WHEN length(rest) <= 600 THEN length(rest) WHEN b = 0 THEN 600 ELSE 601 - b END AS c FROM (SELECT *, strpos(reverse(substr(rest, 281, 320)), ' ') AS b FROM {n}_h WHERE rest <> ''))),
{n}_f AS (SELECT id, pi, si, CASE WHEN length(s) > 600 THEN '' ELSE s END AS held, CAST(NULL AS VARCHAR) AS out, n FROM {n}_i WHERE si = 1
  UNION ALL SELECT f.id, f.pi, i.si, CASE WHEN length(i.s) > 600 THEN '' WHEN f.held = '' OR length(f.held) + 1 + length(i.s) > 600 OR length(f.held) >= 280 THEN i.s ELSE f.held || ' ' || i.s END,
    CASE WHEN f.held <> '' AND (length(i.s) > 600 OR length(f.held) + 1 + length(i.s) > 600 OR length(f.held) >= 280) THEN f.held END, f.n
  FROM {n}_f f JOIN {n}_i i ON i.id = f.id AND i.pi = f.pi AND i.si = f.si + 1),
{n}_c AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pi, si, k) AS c, w FROM (SELECT id, pi, si, k, {flat.format('w')} AS w FROM (
  SELECT id, pi, si, CAST(0 AS BIGINT) AS k, out AS w FROM {n}_f WHERE out IS NOT NULL UNION ALL SELECT id, pi, si, k, piece FROM {n}_h WHERE k > 0
  UNION ALL SELECT id, pi, si + 1, 0, held FROM {n}_f WHERE si = n)) WHERE w <> ''),
{n}_e AS (SELECT id, c, CAST(1 AS BIGINT) AS k, w FROM {n}_c WHERE c = 1
  UNION ALL SELECT e.id, x.c, CASE WHEN e.k >= 40 OR (length(x.w) < 40 AND length(e.w) + 1 + length(x.w) <= 600) THEN e.k ELSE e.k + 1 END,
    CASE WHEN e.k >= 40 THEN e.w WHEN length(x.w) < 40 AND length(e.w) + 1 + length(x.w) <= 600 THEN e.w || ' ' || x.w ELSE x.w END
  FROM {n}_e e JOIN {n}_c x ON x.id = e.id AND x.c = e.c + 1),
{n} AS (SELECT id, k - 1 AS pos, arg_max(w, c) AS w FROM {n}_e GROUP BY id, k)"""


def _r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ similarity


@query(f"""WITH {_embed('q', 'benchmark', 'item_id', 'text')}, {_embed('d', 'documents', 'doc_id', 'text')},
s AS ({_pairs('q', 'd')}),
k AS (SELECT l AS item_id, r AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY l ORDER BY round(score, 6) DESC, r) AS rank FROM s)
SELECT * FROM k WHERE rank <= 5""")
def sim_rank(spark, d):
    """The documents most like each benchmark item, by hash embeddings."""
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("what"))
    docs = _spread(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("what")))
    s = blocks.scored(q, docs, 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), _r6("score").alias("score"))
    return V.top_k(s, ["item_id"], [F.desc("score"), F.col("doc_id")], 5)


@query(f"""WITH {_embed('d', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, dim, v FROM d WHERE v > 0""")
def hash_embedding(spark, d):
    docs = _spread(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("what")))
    return blocks.sparse(docs).select(F.col("id").alias("doc_id"), F.col("dim").cast("long").alias("dim"), "v")


_COS = "(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))"
_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _dense(spark, d, k: int | None = None, group: bool = False, rounded: bool = True):
    """Query vectors (ids divisible by 50) against all, or each one's best ``k``, of each label if ``group``."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("what"), F.col("label").alias("grp"))
    s = blocks.scored(v.where(F.col("id") % 50 == 0), _spread(v if group else v.drop("grp")), k)
    return s.select("query_id", F.col("id").alias("vec_id"), F.col("grp").cast("int").alias("label"), (_r6("score") if rounded else F.col("score")).alias("score"))


@query(f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 10""")
def vector_top_k(spark, d):
    return V.top_k(_dense(spark, d, 10).drop("label"), ["query_id"], [F.desc("score"), F.col("vec_id")], 10)


@query(f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.label, b.vec_id, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM s) SELECT query_id, label, vec_id, score FROM k WHERE r = 1""")
def vector_best_of_label(spark, d):
    return V.top_k(_dense(spark, d, 1, True), ["query_id", "label"], [F.desc("score"), F.col("vec_id")], 1, "r").drop("r")


@query(f"""WITH {_VEC} SELECT a.vec_id AS query_id, count(*) AS n, round(min(round({_COS}, 6)), 6) AS least, round(max(round({_COS}, 6)), 6) AS most, CAST(count(*) FILTER (round({_COS}, 6) >= 0.3) AS BIGINT) AS near
FROM v a, v b WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id""")
def similarity_matrix_stats(spark, d):
    """Of the full matrix of queries and vectors, its rows' extremes and how many pass a threshold."""
    return _dense(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), _r6(F.min("score")).alias("least"), _r6(F.max("score")).alias("most"), F.count_if(F.col("score") >= 0.3).alias("near"))


# ------------------------------------------------------------------ text rules


@query(rf"""SELECT doc_id, {_TOKEN_SET.format('text')} AS t, CAST(len({_TOKEN_SET.format('text')}) AS BIGINT) AS n FROM documents""".replace("SELECT doc_id, ", "SELECT doc_id, md5(array_to_string(list_sort(", 1).replace(" AS t,", "), ' ')) AS tokens,", 1))
def token_sets(spark, d):
    t = T.token_set("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(t), " ")).alias("tokens"), F.size(t).cast("long").alias("n"))


@query(rf"""SELECT doc_id, {_NORM.format('text')} AS normalized,
CASE WHEN length({_NORM.format('text')}) > 320 THEN rtrim(left({_NORM.format('text')}, 320)) || '...' ELSE {_NORM.format('text')} END AS clipped,
CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) <= 320 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE regexp_replace(left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 320), ' [^ ]*$', '') || '…' END AS clipped_at_word,
sha256(text) AS sha256 FROM documents""")
def text_clips(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.normalize_space("text").alias("normalized"), T.clip("text").alias("clipped"), T.clip_at_word("text").alias("clipped_at_word"), F.sha2("text", 256).alias("sha256"))


@query(rf"""WITH t AS (SELECT item_id, lower({_NORM.format('text')}) AS t FROM benchmark),
g AS (SELECT item_id, generate_subscripts(l, 1) AS pos, unnest(l) AS gram FROM (SELECT item_id, [substr(t, i, 4) FOR i IN range(1, length(t) - 2)] AS l FROM t))
SELECT item_id, CAST(pos AS BIGINT) AS pos, gram FROM g""")
def char_ngrams(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.posexplode(T.char_ngrams("text")).alias("pos", "gram")).select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), "gram")


@query(rf"""WITH s AS (SELECT doc_id, {_SENT.format(_NORM.format('text'))} AS l FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS index, unnest(l) AS text FROM s),
o AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e)
SELECT doc_id, index, text, start, start + length(text) AS "end" FROM o""")
def sentence_chunks(spark, d):
    return insights.sentence_chunks(_t(spark, d, "documents")).select("doc_id", F.col("index").cast("long").alias("index"), "text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), {_windows('w', 'src')}
SELECT id AS doc_id, 'case_seg_' || lpad(pos::VARCHAR, 2, '0') AS fragment_id, w AS "window" FROM w""")
def segment_windows(spark, d):
    rows = _spread(_t(spark, d, "documents")).select("doc_id", F.posexplode(segment(F.col("text"))).alias("pos", "window"))
    return rows.select("doc_id", F.format_string("case_seg_%02d", F.col("pos")).alias("fragment_id"), "window")


@query(r"""WITH t AS (SELECT doc_id, list_slice(list_distinct_ordered, 1, 8) AS e FROM (
  SELECT doc_id, list_transform(list_sort(list_transform(map_entries(m), lambda x: {'k': x.value, 'v': x.key})), lambda x: x.v) AS list_distinct_ordered FROM (
    SELECT doc_id, map_from_entries(list_transform(list_distinct(l), lambda x: {'k': x, 'v': list_position(l, x)})) AS m FROM (
      SELECT doc_id, regexp_extract_all(text, '[A-Za-z\x{0600}-\x{06FF}][A-Za-z0-9\x{0600}-\x{06FF}_-]{2,}') AS l FROM documents))))
SELECT t.doc_id, array_to_string(e, ' ') AS entities, CASE WHEN w = '' THEN 'No content provided.' WHEN length(w) > 400 THEN rtrim(left(w, 400)) || '...' ELSE w END AS summary
FROM t JOIN (SELECT doc_id, """ + _NORM.format("text") + """ AS w FROM documents) x USING (doc_id)""")
def entity_tokens(spark, d):
    return insights.brief(_t(spark, d, "documents")).select("doc_id", F.array_join("entities", " ").alias("entities"), "summary")


@query(r"""SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967295.0::DOUBLE < 0.2::DOUBLE THEN 'val' ELSE 'train' END AS split FROM documents""")
def hash_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", V.hash_split("doc_id").alias("split"))


# ------------------------------------------------------------------ composite ranking


_CASE_TYPES = ("labor", "commercial", "civil", "family")
_CATEGORIES = ("labor_law", "commercial_law", "civil_law")


def _cases(spark, d):
    """The query set's benchmark items, each with the seven behind it: blank lines before even ones make paragraphs."""
    b = _t(spark, d, "benchmark")
    q = b.where("item_id % 50 = 0").select(F.col("item_id").alias("case_id"))
    parts = q.join(b, F.col("item_id").between(F.col("case_id"), F.col("case_id") + 7)).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.concat(F.when(x["item_id"] % 2 == 0, "\n\n").otherwise(" "), x["text"])), "")
    return parts.select("case_id", text.alias("text"), F.element_at(F.array(*[F.lit(x) for x in _CASE_TYPES]), (F.col("case_id") % 4 + 1).cast("int")).alias("case_type"))


def _case_tables(spark, d):
    """Cases in windows and with a hypothesis (the ninth item), and documents as regulations: their sentences are the chunks, each
    fifth has none and so one unit of title, category and content."""
    cases = _cases(spark, d)
    frags = fragments.case_fragments(cases)
    said = _t(spark, d, "benchmark").select((F.col("item_id") - 8).alias("case_id"), "text").where("case_id % 50 = 0")
    frags = fragments.with_hypotheses(frags, said)
    docs = _spread(_t(spark, d, "documents"))
    category = F.element_at(F.array(*[F.lit(x) for x in _CATEGORIES]), (F.col("doc_id") % 3 + 1).cast("int"))
    regs = docs.select(F.col("doc_id").alias("reg_id"), F.concat(F.lit("Regulation "), F.col("doc_id")).alias("title"), category.alias("category"), F.col("text").alias("content_text"), (F.col("doc_id") % 5 == 0).alias("fallback"))
    return cases, frags, regs


def _units(spark, d, regs):
    docs = _spread(_t(spark, d, "documents")).where("doc_id % 5 <> 0")
    chunks = docs.select(F.col("doc_id").alias("reg_id"), F.posexplode(T.sentences(T.normalize_space("text"))).alias("chunk_index", "text")).withColumn("chunk_id", F.col("reg_id") * 100000 + F.col("chunk_index"))
    return ranking.grouped_units(fragments.regulation_units(regs, chunks))


_COMPOSITE = rf"""
c AS (SELECT item_id AS case_id, (['labor', 'commercial', 'civil', 'family'])[item_id % 4 + 1] AS case_type FROM benchmark WHERE item_id % 50 = 0),
src AS (SELECT case_id AS id, string_agg(CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) ELSE ' ' END || text, '' ORDER BY item_id) AS text FROM c JOIN benchmark ON item_id BETWEEN case_id AND case_id + 7 GROUP BY case_id),
{_windows('w', 'src')},
fr AS (SELECT id AS case_id, pos AS frag_pos, w AS text, id * 100000 + pos AS id, 'case_seg_' || lpad(pos::VARCHAR, 2, '0') AS fragment_id, 'case' AS source FROM w
  UNION ALL SELECT c.case_id, n.n, trim(left(b.text, 4000)), c.case_id * 100000 + n.n, 'hyde_hypothetical', 'hyde' FROM c JOIN benchmark b ON b.item_id = c.case_id + 8 JOIN (SELECT id, max(pos) + 1 AS n FROM w GROUP BY id) n ON n.id = c.case_id WHERE length(trim(b.text)) >= 20),
us AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ['Regulation ' || doc_id || ' (' || (['labor_law', 'commercial_law', 'civil_law'])[doc_id % 3 + 1] || ')' || CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN ' ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END] ELSE {_SENT.format(_NORM.format('text'))} END AS l FROM documents),
un AS (SELECT reg_id, unit_pos, text, reg_id * 100000 + unit_pos AS id FROM (SELECT doc_id AS reg_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS unit_pos, unnest(l) AS text FROM us)),
{_embed('q', 'fr', 'id', 'text')}, {_embed('u', 'un', 'id', 'text')},
sc AS ({_pairs('q', 'u')}),
p AS (SELECT fr.case_id, fr.fragment_id, fr.frag_pos, fr.source, un.reg_id, un.unit_pos, round(sc.score, 6) AS score, {_TOKEN_SET.format('fr.text')} AS ft, {_TOKEN_SET.format('un.text')} AS ut
  FROM sc JOIN fr ON fr.id = sc.l JOIN un ON un.id = sc.r),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, reg_id ORDER BY score DESC, frag_pos, unit_pos) AS rn FROM p),
fe AS (SELECT case_id, reg_id, max(score) AS semantic_max, avg(score) FILTER (rn <= 3) AS semantic_avg_top3,
  count(DISTINCT fragment_id) FILTER (score >= 0.3::DOUBLE AND source <> 'hyde') AS supported,
  max(CASE WHEN len(ft) = 0 OR len(ut) = 0 THEN 0 ELSE len(list_intersect(ft, ut))::DOUBLE / (len(ft) + len(ut) - len(list_intersect(ft, ut))) END) FILTER (rn <= 4) AS lexical_overlap,
  bool_or(score >= 0.3::DOUBLE AND source = 'case') AS has_case_support, count(*) FILTER (score >= 0.4::DOUBLE) AS strong_support_count FROM rk GROUP BY case_id, reg_id),
nf AS (SELECT case_id, count(*) AS n FROM fr WHERE source <> 'hyde' GROUP BY case_id),
cs AS (SELECT fe.*, least(1.0::DOUBLE, supported / greatest(1, least(n, 3))::DOUBLE) AS support_coverage, reg_id % 5 = 0 AS fallback,
  CASE WHEN (['labor_law', 'commercial_law', 'civil_law'])[reg_id % 3 + 1] = CASE case_type WHEN 'labor' THEN 'labor_law' WHEN 'commercial' THEN 'commercial_law' ELSE 'civil_law' END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category_prior
  FROM fe JOIN nf USING (case_id) JOIN c USING (case_id)),
fi AS (SELECT *, CASE WHEN fallback THEN greatest(0::DOUBLE, raw - 0.18::DOUBLE) ELSE raw END AS final_score FROM (
  SELECT *, 0.55::DOUBLE * semantic_avg_top3 + 0.2::DOUBLE * support_coverage + 0.15::DOUBLE * lexical_overlap + 0.1::DOUBLE * category_prior AS raw FROM cs))"""


def _scored(spark, d, profile, lines=False):
    cases, frags, regs = _case_tables(spark, d)
    pairs = ranking.compared(frags, _units(spark, d, regs), profile, lines)
    return pairs, ranking.composite(ranking.features(pairs, frags, profile), regs.select("reg_id", "category", "fallback"), cases, profile)


@query(f"""WITH RECURSIVE {_COMPOSITE}, k AS (SELECT case_id, reg_id, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY case_id ORDER BY round(final_score, 6) DESC, reg_id) AS rank FROM fi
  WHERE round(final_score, 6) >= 0.45::DOUBLE AND strong_support_count >= 1 AND has_case_support) SELECT * FROM k WHERE rank <= 10""")
def composite_strict(spark, d):
    p = ranking.Profile()
    rows = _scored(spark, d, p)[1].withColumn("final_score", _r6("final_score"))
    return ranking.ranked(ranking.gate(rows, p), p).select("case_id", "reg_id", "final_score", "rank")


@query(f"""WITH RECURSIVE {_COMPOSITE}, k AS (SELECT case_id, reg_id, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY case_id ORDER BY round(final_score, 6) DESC, reg_id) AS rank FROM fi
  WHERE round(final_score, 6) >= 0.3::DOUBLE) SELECT * FROM k WHERE rank <= 10""")
def composite_lenient(spark, d):
    p = ranking.Profile(strict=False)
    rows = _scored(spark, d, p)[1].withColumn("final_score", _r6("final_score"))
    return ranking.ranked(ranking.gate(rows, p), p).select("case_id", "reg_id", "final_score", "rank")


@query(f"""WITH RECURSIVE {_COMPOSITE} SELECT case_id, reg_id, semantic_max, round(semantic_avg_top3, 6) AS semantic_avg_top3, round(support_coverage, 6) AS support_coverage, round(lexical_overlap, 6) AS lexical_overlap,
category_prior, has_case_support, CAST(strong_support_count AS BIGINT) AS strong_support_count FROM fi""")
def score_breakdown(spark, d):
    return _scored(spark, d, ranking.Profile())[1].select("case_id", "reg_id", "semantic_max", *[_r6(c).alias(c) for c in ("semantic_avg_top3", "support_coverage", "lexical_overlap")], "category_prior", "has_case_support", F.col("strong_support_count").cast("long").alias("strong_support_count"))


@query(f"""WITH RECURSIVE {_COMPOSITE}, k AS (SELECT round(final_score, 6) AS s FROM fi) SELECT round(min(s), 4) AS min_score, round(max(s), 4) AS max_score, round(avg(s), 4) AS avg_score, round(stddev_pop(s), 4) AS stddev_score FROM k""")
def score_stats(spark, d):
    return ranking.score_stats(_scored(spark, d, ranking.Profile())[1].withColumn("final_score", _r6("final_score")))


@query(f"""WITH RECURSIVE {_COMPOSITE}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id, reg_id, fragment_id ORDER BY score DESC, frag_pos, unit_pos) AS r1 FROM p),
k AS (SELECT case_id, reg_id, fragment_id, unit_pos, score, row_number() OVER (PARTITION BY case_id, reg_id ORDER BY score DESC, frag_pos, unit_pos) AS rank FROM o WHERE r1 = 1) SELECT * FROM k WHERE rank <= 2""")
def evidence_top2(spark, d):
    return ranking.evidence(_scored(spark, d, ranking.Profile())[0]).select("case_id", "reg_id", "fragment_id", "unit_pos", "score", "rank")


@query(f"""WITH RECURSIVE {_COMPOSITE},
a AS (SELECT case_id, reg_id, fragment_id, frag_pos, unit_pos, score, max(score) OVER (PARTITION BY case_id, reg_id) AS top FROM p),
p0 AS (SELECT case_id, reg_id, 0 AS line, CAST([] AS VARCHAR[]) AS fs, CAST([] AS BIGINT[]) AS us, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS fragment_id, CAST(NULL AS BIGINT) AS unit_pos, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS contribution FROM (SELECT DISTINCT case_id, reg_id FROM a)
  UNION ALL SELECT q.case_id, q.reg_id, q.line + 1, list_append(q.fs, n.fragment_id), list_append(q.us, n.unit_pos), list_append(q.taken, n.fragment_id || '/' || n.unit_pos), n.fragment_id, n.unit_pos, n.score, n.contribution
  FROM p0 q JOIN LATERAL (SELECT a.fragment_id, a.unit_pos, a.score, CASE WHEN a.top > 0 THEN greatest(0, least(1, a.score / a.top)) ELSE 0 END AS contribution FROM a
    WHERE a.case_id = q.case_id AND a.reg_id = q.reg_id AND NOT list_contains(q.taken, a.fragment_id || '/' || a.unit_pos)
    ORDER BY CASE WHEN NOT list_contains(q.fs, a.fragment_id) AND NOT list_contains(q.us, a.unit_pos) THEN 0 WHEN NOT list_contains(q.fs, a.fragment_id) THEN 1 ELSE 2 END, a.score DESC, a.frag_pos, a.unit_pos LIMIT 1) n ON true WHERE q.line < 3)
SELECT case_id, reg_id, CAST(line AS BIGINT) AS line, fragment_id, unit_pos, score, round(contribution, 6) AS contribution FROM p0 WHERE line > 0""")
def line_matches(spark, d):
    return ranking.line_matches(_scored(spark, d, ranking.Profile(), True)[0]).withColumn("contribution", _r6("contribution"))


# ------------------------------------------------------------------ several sources


_TYPES = ("regulation", "judgment", "circular", "guide")
_SOURCES = f"""
s AS (SELECT vec_id AS source_id, (['regulation', 'judgment', 'circular', 'guide'])[vec_id % 4 + 1] AS source_type, (['official', 'trusted', 'discovered', 'unverified'])[(vec_id // 4) % 4 + 1] AS trust_tier, vec_id % 3 = 0 AS citable, vec_id AS pos FROM embeddings),
{_VEC}, b AS (SELECT a.vec_id AS case_id, b.vec_id AS source_id, {_COS} AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
w1 AS (SELECT b.case_id, s.*, round(greatest(0, score), 4) AS relevance, round(greatest(0, score) * CASE trust_tier WHEN 'official' THEN 1.0::DOUBLE WHEN 'trusted' THEN 0.9::DOUBLE WHEN 'discovered' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END, 4) AS weighted FROM s JOIN b USING (source_id) WHERE score >= 0.1::DOUBLE),
w2 AS (SELECT *, row_number() OVER (PARTITION BY case_id, source_type ORDER BY weighted DESC, pos) AS rn FROM w1),
w3 AS (SELECT * REPLACE (CASE WHEN source_type = 'regulation' AND rn > 4 AND relevance < 0.6::DOUBLE THEN floor(round(weighted * 10000) / 2 + 0.5::DOUBLE) / 10000.0::DOUBLE ELSE weighted END AS weighted) FROM w2),
w4 AS (SELECT *, row_number() OVER (PARTITION BY case_id, source_type ORDER BY weighted DESC, CASE WHEN source_type = 'regulation' THEN rn ELSE pos END) AS rank FROM w3)"""


def _multi(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % 4 + 1).cast("int"))
    v = _t(spark, d, "embeddings")
    held = v.select(F.col("vec_id").alias("source_id"), pick(_TYPES, F.col("vec_id")).alias("source_type"), pick(V.TRUST, F.floor(F.col("vec_id") / 4)).alias("trust_tier"), (F.col("vec_id") % 3 == 0).alias("citable"), F.col("vec_id").alias("pos"), F.col("embedding").alias("what"))
    cases = held.where("source_id % 50 = 0").select(F.col("source_id").alias("case_id"), "what")
    best = ranking.source_scores(cases, _spread(held), 5, 0.1)
    return cases, ranking.multi_source(best, held.drop("what"), 5, 0.1)


@query(f"WITH {_SOURCES} SELECT case_id, source_id, source_type, trust_tier, relevance, weighted, rank FROM w4 WHERE rank <= 5")
def multi_source_ranked(spark, d):
    return _multi(spark, d)[1].select("case_id", "source_id", "source_type", "trust_tier", "relevance", "weighted", "rank")


@query(f"""WITH {_SOURCES}, t AS (SELECT DISTINCT case_id, unnest(['regulation', 'judgment', 'circular', 'guide']) AS source_type FROM b)
SELECT t.case_id, t.source_type, count(w.source_id) AS n, coalesce(bool_or(w.citable), false) AS any_citable FROM t LEFT JOIN (SELECT * FROM w4 WHERE rank <= 5) w ON t.case_id = w.case_id AND t.source_type = w.source_type GROUP BY ALL""")
def multi_source_groups(spark, d):
    cases, kept = _multi(spark, d)
    types = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(x) for x in _TYPES])).alias("source_type"))
    return ranking.group_summary(kept, types)


# ------------------------------------------------------------------ reranking, blending, expansion


_RANKED = f"WITH RECURSIVE {_COMPOSITE}, k AS (SELECT case_id, reg_id, round(final_score, 6) AS final_score FROM fi WHERE round(final_score, 6) >= 0.3::DOUBLE)"


def _lenient(spark, d):
    p = ranking.Profile(strict=False)
    return ranking.gate(_scored(spark, d, p)[1].withColumn("final_score", _r6("final_score")), p).select("case_id", "reg_id", "final_score")


_EXCERPT = """
xu AS (SELECT reg_id, unit_pos, text, coalesce(sum(length(text)) OVER (PARTITION BY reg_id ORDER BY unit_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM un),
xc AS (SELECT *, min(CASE WHEN used + length(text) > 2000 THEN unit_pos END) OVER (PARTITION BY reg_id) AS over FROM xu),
xe AS (SELECT reg_id, string_agg(CASE WHEN unit_pos = over THEN left(text, CAST(2000 - used AS BIGINT)) ELSE text END, chr(10) ORDER BY unit_pos) AS excerpt FROM xc WHERE over IS NULL OR unit_pos < over OR (unit_pos = over AND 2000 - used > 50) GROUP BY reg_id)"""


def _excerpts(spark, d):
    units = _units(spark, d, _case_tables(spark, d)[2])
    return units.select("reg_id", T.best_excerpt(F.transform("units", lambda u: u["text"])).alias("excerpt"))


@query(f"""{_RANKED}, {_EXCERPT}, j AS (SELECT k.*, {_TOKEN_SET.format('src.text')} AS a, {_TOKEN_SET.format('xe.excerpt')} AS b FROM k JOIN src ON src.id = k.case_id JOIN xe USING (reg_id)),
r AS (SELECT case_id, reg_id, final_score, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS rerank_score FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rerank_score DESC, reg_id) AS rerank_rank FROM r) SELECT * FROM o WHERE rerank_rank <= 15""")
def rerank_jaccard(spark, d):
    rows = _lenient(spark, d).join(_cases(spark, d).select("case_id", F.col("text").alias("case_text")), "case_id").join(_excerpts(spark, d), "reg_id")
    return ranking.rerank(rows, _r6(T.jaccard(T.token_set("case_text"), T.token_set("excerpt")))).drop("case_text", "excerpt")


@query(rf"""{_RANKED}, {_EXCERPT}, t0 AS (SELECT case_id, reg_id, row_number() OVER (PARTITION BY case_id ORDER BY final_score DESC, reg_id) AS r FROM k), t1 AS (SELECT * FROM t0 WHERE r <= 30),
tx AS (SELECT 'q' || case_id AS id, lower({_NORM.format('src.text')}) AS t FROM (SELECT DISTINCT case_id FROM t1) JOIN src ON src.id = case_id UNION ALL SELECT 'd' || reg_id, lower({_NORM.format('excerpt')}) FROM xe WHERE reg_id IN (SELECT reg_id FROM t1)),
g0 AS (SELECT id, CASE WHEN length(t) >= 4 THEN [substr(t, i, 4) FOR i IN range(1, length(t) - 2)] ELSE [t] END AS l FROM tx WHERE t <> ''),
g1 AS (SELECT id, pos, gram FROM (SELECT id, generate_subscripts(l, 1) AS pos, unnest(l) AS gram FROM g0) QUALIFY pos = 1 OR gram <> lag(gram) OVER (PARTITION BY id ORDER BY pos)),
gv AS (SELECT gram, list_transform(range(16), lambda i: ('0x' || substr(md5(gram), CAST(2 * i + 1 AS BIGINT), 2))::INT::DOUBLE) AS v FROM (SELECT DISTINCT gram FROM g1)),
gu AS (SELECT gram, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM gv),
qg AS (SELECT id, gram, count(*) AS n FROM g1 WHERE id LIKE 'q%' GROUP BY id, gram), dg AS (SELECT DISTINCT id, gram FROM g1 WHERE id LIKE 'd%'),
dots AS (SELECT a.gram AS x, b.gram AS y, list_dot_product(ua.v, ub.v) AS s FROM (SELECT DISTINCT gram FROM qg) a JOIN gu ua USING (gram) CROSS JOIN (SELECT DISTINCT gram FROM dg) b JOIN gu ub ON ub.gram = b.gram),
best AS (SELECT qg.id AS q, dg.id AS dd, qg.gram, qg.n, max(s) AS s FROM t1 JOIN qg ON qg.id = 'q' || t1.case_id JOIN dg ON dg.id = 'd' || t1.reg_id JOIN dots ON dots.x = qg.gram AND dots.y = dg.gram GROUP BY qg.id, dg.id, qg.gram, qg.n),
ms AS (SELECT q, dd, round(sum(s * n) / sum(n), 6) AS rerank_score FROM best GROUP BY q, dd),
o AS (SELECT t1.case_id, t1.reg_id, coalesce(rerank_score, 0.0) AS rerank_score, row_number() OVER (PARTITION BY t1.case_id ORDER BY coalesce(rerank_score, 0.0) DESC, t1.reg_id) AS rerank_rank FROM t1 LEFT JOIN ms ON q = 'q' || case_id AND dd = 'd' || reg_id) SELECT * FROM o WHERE rerank_rank <= 15""")
def maxsim_rerank(spark, d):
    """Late interaction over pseudo-embedded n-grams: the first 30 of each case's ranking, by their excerpts."""
    top = V.top_k(_lenient(spark, d), ["case_id"], [F.desc("final_score"), F.col("reg_id")], 30, "_r").select("case_id", "reg_id")
    rows = top.join(_cases(spark, d).select("case_id", F.col("text").alias("q")), "case_id").join(_excerpts(spark, d).withColumnRenamed("excerpt", "t"), "reg_id")
    return ranking.rerank(rows, _r6(max_sim("q", "t"))).drop("q", "t")


@query(f"""{_RANKED}, t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY final_score DESC, reg_id) AS r FROM k),
v AS (SELECT t.*, l.quality, l.toxic, bool_or(l.quality IS NOT NULL) OVER (PARTITION BY case_id) AS any_said FROM t LEFT JOIN labels l ON l.doc_id = t.reg_id AND r <= 15)
SELECT case_id, reg_id, final_score, CASE WHEN any_said AND r <= 15 THEN CASE WHEN quality IS NULL THEN 'skipped' ELSE 'approved' END END AS status, CASE WHEN NOT any_said THEN 'gemini_fallback_used' END AS warning,
round(CASE WHEN quality IS NULL THEN final_score ELSE 0.85::DOUBLE * final_score + 0.15::DOUBLE * CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END END, 6) AS blended FROM v WHERE quality IS NULL OR quality = 1""")
def verdict_blend(spark, d):
    rows = _lenient(spark, d)
    verdicts = _t(spark, d, "labels").select(F.col("doc_id").alias("reg_id"), (F.col("quality") == 1).alias("applicable"), F.when(F.col("toxic") == 0, "high").otherwise("low").alias("confidence")).join(rows.select("case_id", "reg_id"), "reg_id")
    return ranking.blend(rows, verdicts).withColumn("blended", _r6("blended"))


@query(f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS reg_id, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
p AS (SELECT query_id AS case_id, reg_id FROM s WHERE query_id % 100 = 0 AND score >= 0.25::DOUBLE),
n AS (SELECT query_id - 50 AS case_id, 1 AS round, reg_id, score, CASE WHEN reg_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prior FROM s WHERE query_id % 100 = 50),
f AS (SELECT n.*, 0.55::DOUBLE * score + 0.1::DOUBLE * prior AS final_score FROM n ANTI JOIN p ON n.case_id = p.case_id AND n.reg_id = p.reg_id WHERE score > 0)
SELECT case_id, reg_id, round(final_score, 6) AS final_score FROM f WHERE score >= 0.8::DOUBLE * 0.3::DOUBLE AND final_score >= 0.7::DOUBLE * 0.3::DOUBLE""")
def agentic_expand(spark, d):
    s = _dense(spark, d).withColumnRenamed("vec_id", "reg_id")
    passed = s.where("query_id % 100 = 0 and score >= 0.25").select(F.col("query_id").alias("case_id"), "reg_id")
    later = s.where("query_id % 100 = 50").select((F.col("query_id") - 50).alias("case_id"), F.lit(1).alias("round"), "reg_id", "score", F.when(F.col("reg_id") % 2 == 0, 1.0).otherwise(0.0).alias("category_prior"))
    return ranking.expand(passed, later, ranking.Profile()).select("case_id", "reg_id", _r6("final_score").alias("final_score"))


#: Strict enough that cases have gaps; the model's answers are made from the two benchmark items behind the hypothesis.
_SPARSE = ranking.Profile(min_final=0.62)


@query(f"""WITH RECURSIVE {_COMPOSITE}, pa AS (SELECT case_id, reg_id, round(final_score, 6) AS final_score FROM fi WHERE round(final_score, 6) >= 0.62::DOUBLE AND strong_support_count >= 1 AND has_case_support),
gq AS (SELECT c.case_id * 10 + b.item_id - c.case_id - 8 AS id, c.case_id, b.item_id - c.case_id - 8 AS round, b.text FROM c JOIN benchmark b ON b.item_id IN (c.case_id + 9, c.case_id + 10)
  JOIN (SELECT case_id, count(*) AS n FROM pa GROUP BY case_id) USING (case_id) WHERE n < 15 AND length(trim(b.text)) >= 5),
{_embed('g', 'gq', 'id', 'text')}, sg AS ({_pairs('g', 'u')}),
bu AS (SELECT gq.case_id, gq.round, un.reg_id, un.unit_pos, round(score, 6) AS score, row_number() OVER (PARTITION BY gq.case_id, gq.round, un.reg_id ORDER BY round(score, 6) DESC, un.unit_pos) AS r FROM sg JOIN gq ON gq.id = sg.l JOIN un ON un.id = sg.r),
ca AS (SELECT * FROM (SELECT bu.case_id, round, bu.reg_id, unit_pos, score, 0.55::DOUBLE * score + 0.1::DOUBLE * cs.category_prior AS final_score FROM bu JOIN cs ON cs.case_id = bu.case_id AND cs.reg_id = bu.reg_id WHERE r = 1)
  WHERE score > 0 AND score >= 0.8::DOUBLE * 0.3::DOUBLE AND final_score >= 0.7::DOUBLE * 0.3::DOUBLE),
st AS (SELECT case_id, 0 AS round, list(reg_id) AS seen, CAST([] AS BIGINT[]) AS new FROM pa GROUP BY case_id
  UNION ALL SELECT case_id, round + 1, list_concat(any_value(seen), coalesce(list(reg_id) FILTER (fresh), [])), coalesce(list(reg_id) FILTER (fresh), [])
  FROM (SELECT st.case_id, st.round, st.seen, ca.reg_id, ca.reg_id IS NOT NULL AND NOT list_contains(st.seen, ca.reg_id) AS fresh FROM st LEFT JOIN ca ON ca.case_id = st.case_id AND ca.round = st.round + 1) WHERE round < 2 GROUP BY case_id, round)
SELECT case_id, reg_id, 0 AS round, final_score, CAST(NULL AS BIGINT) AS unit_pos FROM pa
UNION ALL SELECT a.case_id, a.reg_id, CAST(a.round AS INTEGER), round(ca.final_score, 6), ca.unit_pos FROM (SELECT case_id, round, unnest(new) AS reg_id FROM st) a JOIN ca ON ca.case_id = a.case_id AND ca.round = a.round AND ca.reg_id = a.reg_id""")
def agentic_rounds(spark, d):
    """Two rounds after the strict ranking: prompts from what passed, answers, their queries against all units, anti-joined round by round."""
    cases, frags, regs = _case_tables(spark, d)
    units = _units(spark, d, regs)
    scored = ranking.composite(ranking.features(ranking.compared(frags, units, _SPARSE), frags, _SPARSE), regs.select("reg_id", "category", "fallback"), cases, _SPARSE)
    passed = settled(ranking.gate(scored.withColumn("final_score", _r6("final_score")), _SPARSE).select("case_id", "reg_id", "category", "final_score"))
    asked = agentic.prompts(cases, passed.join(regs.select("reg_id", "title"), "reg_id").withColumnRenamed("final_score", "score"))
    items = _t(spark, d, "benchmark").select((F.col("item_id") - F.col("item_id") % 50).alias("case_id"), (F.col("item_id") % 50).alias("i"), "text").where("i in (9, 10)")
    said = items.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("refined_queries"))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit(True).alias("has_gaps"), "refined_queries")), F.lit("\n```"))
    queries = agentic.gap_queries(asked.join(said, "case_id", "left").withColumn("raw", raw))
    return agentic.expanded(passed, queries, units, regs, cases, _SPARSE).withColumn("final_score", _r6("final_score"))


# ------------------------------------------------------------------ insights


@query(rf"""WITH s AS (SELECT doc_id, {_SENT.format(_NORM.format('text'))} AS l FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS index, unnest(l) AS text FROM s),
o AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e),
k AS (SELECT doc_id, index, CASE WHEN used + length(text) > 15000 THEN trim(left(text, CAST(15000 - used AS BIGINT))) ELSE text END AS text, doc_id * 100000 + index AS id FROM o WHERE used < 15000),
c AS (SELECT item_id, text FROM benchmark WHERE item_id % 50 = 0), kk AS (SELECT * FROM k WHERE text <> ''),
{_embed('q', 'c', 'item_id', 'text')}, {_embed('u', 'kk', 'id', 'text')}, sc AS ({_pairs('q', 'u')}),
r AS (SELECT sc.l AS case_id, kk.doc_id, kk.index, kk.text, round(score, 6) AS score FROM sc JOIN kk ON kk.id = sc.r),
w AS (SELECT *, row_number() OVER (PARTITION BY case_id, doc_id ORDER BY score DESC, index) AS rank FROM r) SELECT * FROM w WHERE rank <= 5""")
def case_insights(spark, d):
    cases = _t(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("case_id"), "text")
    return insights.case_insights(cases, _spread(_t(spark, d, "documents")))


_SPOKEN = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'An employee of the ' WHEN 1 THEN 'Each customer and ' WHEN 2 THEN 'تلتزم هيئة ' ELSE 'The ' END || 'supplier ' || CASE o_orderkey % 3 WHEN 0 THEN 'must deliver' WHEN 1 THEN 'may deliver' ELSE 'shall pay a penalty' END || ' by ' || strftime(o_orderdate, '%Y-%m-%d') || '. ' || CASE o_orderkey % 2 WHEN 0 THEN 'يجب على صاحب العمل الدفع.' ELSE 'Clerk ' || o_orderpriority || ' on ' || strftime(o_orderdate, '%d/%m/%Y') || '.' END || ' Status ' || o_orderstatus || ' on ' || strftime(o_orderdate, '%d-%m-%Y') || ' and ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS text FROM orders"


def _spoken(spark, d):
    """Sentences with obligations, risks and dates, made from orders."""
    k = F.col("o_orderkey") % 3
    who = F.col("o_orderkey") % 7
    first = F.concat(F.when(who == 0, "An employee of the ").when(who == 1, "Each customer and ").when(who == 2, "تلتزم هيئة ").otherwise("The "), F.lit("supplier "), F.when(k == 0, "must deliver").when(k == 1, "may deliver").otherwise("shall pay a penalty"), F.lit(" by "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(". "))
    second = F.when(F.col("o_orderkey") % 2 == 0, "يجب على صاحب العمل الدفع.").otherwise(F.concat(F.lit("Clerk "), F.col("o_orderpriority"), F.lit(" on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(".")))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(first, second, F.lit(" Status "), F.col("o_orderstatus"), F.lit(" on "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" and "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".")).alias("text"))


_RANKED_SENT = rf"""t AS ({_SPOKEN}), s AS (SELECT doc_id, {_SENT.format('text')} AS l FROM t), e AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS sentence FROM s),
f AS (SELECT *, regexp_matches(sentence, '{_OBL}') AS o, regexp_matches(sentence, '{_RISK}') AS k FROM e)"""


@query(f"""WITH {_RANKED_SENT} SELECT doc_id, pos, sentence, CASE WHEN k THEN 'high' WHEN o THEN 'medium' ELSE 'low' END AS severity,
round(least(0.99::DOUBLE, 0.25::DOUBLE + (CASE WHEN o THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN k THEN 0.35::DOUBLE ELSE 0 END) + least(0.05::DOUBLE, length(sentence) / 20000.0::DOUBLE)), 3) AS relevance FROM f""")
def sentence_severity(spark, d):
    rows = insights.ranked_sentences(_spoken(spark, d))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "severity", "relevance")


_PARTY = {
    "أصحاب العمل والمنشآت": "employer|company|منشأة|صاحب العمل",
    "العاملون والموظفون": "employee|worker|عامل|موظف",
    "الجهات التنظيمية والرقابية": "authority|regulator|جهة|وزارة|هيئة",
    "العملاء والمستفيدون": "customer|consumer|عميل|مستفيد",
}
_PARTIES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{0}}, '(?i)(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])({w})([^\\p{{{{L}}}}\\p{{{{N}}}}_]|$)') THEN '{k}' END" for k, w in _PARTY.items()) + "], lambda x: x IS NOT NULL)"


@query(rf"""WITH {_RANKED_SENT}, d0 AS (SELECT doc_id, {_PARTIES.format('text')} AS parties, list_concat(list_concat(regexp_extract_all(text, '\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b'), regexp_extract_all(text, '\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}\b')), regexp_extract_all(text, '\b[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}\b')) AS l FROM t),
d AS (SELECT doc_id, array_to_string(parties, '; ') AS parties, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 8), ' ') AS dates FROM d0)
SELECT doc_id, any_value(dates) AS dates, any_value(parties) AS parties, count(*) FILTER (o) AS n_obligations, count(*) FILTER (k) AS n_risks, count(*) AS n_sentences FROM f JOIN d USING (doc_id) GROUP BY doc_id""")
def regulation_summary(spark, d):
    return insights.summary(_spoken(spark, d)).select("doc_id", F.array_join("dates", " ").alias("dates"), F.array_join("parties", "; ").alias("parties"), *[F.col(c).cast("long").alias(c) for c in ("n_obligations", "n_risks", "n_sentences")])


@query(rf"""WITH p AS (SELECT a.doc_id, {_SENT.format(_NORM.format('a.text'))} AS o, {_SENT.format(_NORM.format('b.text'))} AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
c AS (SELECT doc_id, 'added' AS change, unnest(list_distinct(list_filter(n, lambda s: NOT list_contains(o, s)))) AS sentence FROM p UNION ALL
SELECT doc_id, 'removed', unnest(list_distinct(list_filter(o, lambda s: NOT list_contains(n, s)))) FROM p) SELECT * FROM c""")
def amendment_diff(spark, d):
    docs = _t(spark, d, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("old_text")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new_text")), "doc_id")
    return insights.amendment(pairs).select("doc_id", "change", "sentence")


# ------------------------------------------------------------------ analyses


def _title(x: str, fallback: str) -> str:
    """A bullet's title in SQL; ``x``: a trimmed sentence."""
    prefix = rf"regexp_replace(regexp_extract({x}, '^([٠-٩0-9]+\s*[-:–—]|[\x{{0600}}-\x{{06FF}}]{{2,10}}\s*[:-])\s*', 1), '[-:–— ]+$', '')"
    heads = " ".join(f"WHEN strpos({x}, '{m}') BETWEEN 2 AND 46 AND trim(left({x}, strpos({x}, '{m}') - 1)) <> '' THEN trim(left({x}, strpos({x}, '{m}') - 1))" for m in (":", "：", "،"))
    words = rf"regexp_extract_all({x}, '[\x{{0600}}-\x{{06FF}}]+')"
    return f"CASE WHEN length(trim({prefix})) BETWEEN 2 AND 30 THEN trim({prefix}) {heads} WHEN len({words}) > 0 THEN array_to_string(list_slice({words}, 1, 5), ' ') ELSE '{fallback}' END"


def _distinct(items: str, n: int) -> str:
    return f"list_slice(list_filter({items}, lambda v, i: list_position(list_transform({items}, lambda y: lower(y)), lower(v)) = i), 1, {n})"


def _shown(items: str, fallback: str) -> str:
    level = f"CASE WHEN regexp_matches(left(x, 450), '{_RISK}') THEN 'high' WHEN regexp_matches(left(x, 450), '{_OBL}') THEN 'medium' ELSE 'low' END"
    return f"array_to_string(list_transform({items}, lambda x: {_title('x', fallback)} || ' | ' || left(x, 450) || ' | ' || {level}), chr(10))"


def _lines(c):
    return F.array_join(F.transform(c, lambda b: F.concat_ws(" | ", b["title"], b["description"], b["severity"])), "\n")


def _cited_lines(c):
    return F.array_join(F.transform(c, lambda b: F.concat_ws(" | ", b["snippet"], F.format_string("%.3f", b["relevance"]))), "\n")


@query(rf"""WITH t AS ({_SPOKEN}), w AS (SELECT doc_id, left({_NORM.format('text')}, 40000) AS t FROM t), s0 AS (SELECT doc_id, {_SENT.format('t')} AS s FROM w),
s AS (SELECT *, list_filter(s, lambda x: regexp_matches(x, '{_OBL}')) AS must, list_filter(s, lambda x: regexp_matches(x, '{_RISK}')) AS risk FROM s0),
b AS (SELECT *, CASE WHEN len(must) > 0 THEN {_distinct('list_slice(must, 1, 8)', 8)} ELSE {_distinct('list_slice(s, 1, 4)', 4)} END AS o,
  CASE WHEN len(risk) > 0 THEN {_distinct('list_slice(risk, 1, 8)', 8)} ELSE {_distinct('list_slice(s, 1, 2)', 4)} END AS r FROM s),
e AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s0), k0 AS (SELECT doc_id, i, left(x, 400) AS x, least(0.99::DOUBLE, 0.25::DOUBLE + (CASE WHEN regexp_matches(x, '{_OBL}') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(x, '{_RISK}') THEN 0.35::DOUBLE ELSE 0 END) + least(0.05::DOUBLE, length(x) / 20000.0::DOUBLE)) AS w FROM e),
k1 AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY doc_id, x ORDER BY w DESC, i) = 1), k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, i) <= 8),
k AS (SELECT doc_id, string_agg(x || ' | ' || printf('%.3f', w), chr(10) ORDER BY w DESC, i) AS citations FROM k2 GROUP BY doc_id)
SELECT doc_id, 'ok' AS status, 'ملخص تنظيمي: ' || left(array_to_string(list_slice(s, 1, 4), ' '), 900) AS summary, {_shown('o', 'التزام تنظيمي')} AS obligations, {_shown('r', 'مؤشر مخاطر')} AS risk_flags, citations FROM b JOIN k USING (doc_id)""")
def summary_analysis(spark, d):
    rows = insights.analysis(_spoken(spark, d))
    return rows.select("doc_id", "status", "summary", _lines("obligations").alias("obligations"), _lines("risk_flags").alias("risk_flags"), _cited_lines("citations").alias("citations"))


def _change(items: str, title: str, said: str, fallback: str, most: int) -> str:
    level = f"CASE WHEN regexp_matches(left(x, {most}), '{_RISK}') THEN 'high' WHEN regexp_matches(left(x, {most}), '{_OBL}') THEN 'medium' ELSE 'low' END"
    return f"list_transform({items}, lambda x: '{title}' || {_title('x', fallback)} || ' | ' || left('{said}' || left(x, {most}), 450) || ' | ' || {level})"


@query(rf"""WITH t AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents), x AS (SELECT a.doc_id, a.t AS o, b.t AS n, {_SENT.format('a.t')} AS os, {_SENT.format('b.t')} AS ns FROM t a JOIN t b ON b.doc_id = a.doc_id + 1),
y AS (SELECT *, list_filter(list_filter(ns, lambda v: NOT list_contains(os, v)), lambda v: true) AS a0, list_filter(os, lambda v: NOT list_contains(ns, v)) AS r0 FROM x),
z AS (SELECT *, {_distinct('a0', 10)} AS a, {_distinct('r0', 10)} AS r FROM y),
v AS (SELECT *, CASE WHEN len(a) + len(r) > 0 THEN list_concat(list_slice(a, 1, 5), list_slice(r, 1, 3)) ELSE list_slice(ns, 1, 3) END AS pool, {_PARTIES.format("(o || chr(10) || n)")} AS parties FROM z)
SELECT doc_id, CASE WHEN o = '' OR n = '' THEN 'error' ELSE 'ok' END AS status,
array_to_string(list_concat({_change('list_slice(a, 1, 6)', 'إضافة: ', 'تمت إضافة نص: ', 'نص مضاف', 380)}, {_change('list_slice(r, 1, 4)', 'حذف: ', 'تم حذف/تعديل نص: ', 'نص محذوف أو معدل', 380)}), chr(10)) AS what_changed,
array_to_string({_change('list_slice(pool, 1, 6)', 'أثر على: ', 'قد يؤثر هذا التغيير على التطبيق النظامي: ', 'التطبيق النظامي', 360)}, chr(10)) AS legal_impact,
CASE WHEN len(parties) > 0 THEN array_to_string(parties, '; ') ELSE 'الأطراف الخاضعة للنظام' END AS affected_parties FROM v""")
def amendment_impact(spark, d):
    rows = insights.impact_of_next(_spread(_t(spark, d, "documents")))
    return rows.select("doc_id", "status", _lines("what_changed").alias("what_changed"), _lines("legal_impact").alias("legal_impact"), F.array_join("affected_parties", "; ").alias("affected_parties"))


_ANSWERS = (
    '{"has_gaps": true, "gap_description": "x", "refined_queries": ["overtime pay rules", "abc", "end of service award", "a third query"], "missing_domains": ["labor_law"]}',
    '```json\n{"has_gaps": true, "refined_queries": ["notice period"]}\n```',
    '{"has_gaps": false, "refined_queries": ["never asked"]}',
    '{"has_gaps": true, "refined_queries": ["no"]}',
    "not json",
    "",
)


#: Answers to a summary, made from orders: in fences, among other text, with entries of the wrong kind, broken, or a list.
_ANSWERED = """a AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s, o_orderdate::VARCHAR AS d, o_totalprice AS t, o_orderkey % 6 AS k FROM orders)"""


@query(f"""WITH {_ANSWERED}
SELECT a.id, CASE WHEN a.k = 0 THEN 'Status ' || s || '|' || p || '|high;untitled|' || s || '|low' WHEN a.k = 1 THEN 'untitled|must ' || p || '|medium' WHEN a.k = 2 THEN '7|True|low' ELSE '' END AS bullets,
CASE WHEN a.k = 0 THEN 'تاريخ نظامي مهم|' || d || '|' || p WHEN a.k = 1 THEN 'due|' || d || '|' ELSE '' END AS dates,
CASE WHEN a.k = 0 THEN s || '|' || p || '|' WHEN a.k = 1 THEN p || '||0.5' WHEN a.k = 3 THEN d || '||1.0' ELSE '' END AS citations FROM a""")
def answer_parts(spark, d):
    """What answers of a model keep: bullets, dates and citations, each as title|text|rest."""
    k, q = F.col("o_orderkey") % 6, lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    p, s, date = q("o_orderpriority"), q("o_orderstatus"), q("o_orderdate")
    full = F.concat(F.lit('```json\n{"bullets": [{"title": "Status '), F.col("o_orderstatus"), F.lit('", "description": '), p, F.lit(', "severity": "high"}, {"title": " ", "description": '), s, F.lit('}, "text", {"title": "empty", "description": ""}], "key_dates": [{"value": '), date, F.lit(', "source": '), p, F.lit('}, {"label": "no value"}], "citations": [{"snippet": '), s, F.lit(', "section_ref": '), p, F.lit(', "relevance": "0.9"}]}\n```'))
    some = F.concat(F.lit('Here: {"bullets": [null, {"description": "must '), F.col("o_orderpriority"), F.lit('"}], "key_dates": [[], {"label": "due", "value": '), date, F.lit(', "source": ""}], "citations": [{"snippet": '), p, F.lit(', "section_ref": 0, "relevance": 0.5}, 5]} done'))
    odd = F.lit('{"bullets": [{"title": 7, "description": true}], "key_dates": {"value": "no list"}, "citations": "none"}')
    late = F.concat(F.lit('{"citations": [{"snippet": "  "}, {"snippet": '), date, F.lit(', "relevance": true}]}'))
    raw = F.when(k == 0, full).when(k == 1, some).when(k == 2, odd).when(k == 3, late).when(k == 4, '{"bullets": [').otherwise('[1, 2]')
    v = answers.answer("raw")
    line = lambda x: F.concat_ws("|", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in x_fields])
    out = []
    for name, column, x_fields in (("bullets", answers.bullets(v, "bullets", "untitled", 8), ("title", "description", "severity")), ("dates", answers.key_dates(v), ("label", "value", "source")), ("citations", answers.citations(v), ("snippet", "section_ref", "relevance"))):
        out.append(F.array_join(F.transform(column, line), ";").alias(name))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).select("id", *out)


def _first_reader(data: bytes, kind: str, name: str) -> str:
    if len(data.decode()) % 3 == 0:
        raise ValueError(f"{name} is blurred")
    return "" if len(data.decode()) % 3 == 1 else f"{kind}: {data.decode()}"


def _second_reader(data: bytes, kind: str, name: str) -> str:
    if len(data.decode()) % 2:
        raise ValueError("no lines")
    return f"again: {data.decode()}"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, (['pdf', 'image', 'text'])[doc_id % 3 + 1] AS method, CASE WHEN doc_id % 3 = 1 THEN '' ELSE coalesce(text, '') END AS raw FROM documents),
n AS (SELECT *, method <> 'text' AND length({_NORM.format('raw')}) < 400 AS needs FROM d),
r AS (SELECT *, CASE WHEN NOT needs THEN 'parser' WHEN length(t) % 3 = 2 THEN 'first' WHEN length(t) % 2 = 0 THEN 'second' ELSE 'none' END AS way FROM n)
SELECT doc_id, CASE way WHEN 'first' THEN 'ocr_primary' WHEN 'second' THEN 'ocr_secondary' WHEN 'none' THEN 'parser_' || method || '_fallback' ELSE 'parser_' || method END AS extraction_method,
CASE way WHEN 'first' THEN 'one' WHEN 'second' THEN 'two' ELSE 'none' END AS ocr_provider_used, CASE way WHEN 'second' THEN 'secondary' WHEN 'none' THEN 'parser_only' ELSE 'none' END AS fallback_stage,
md5(CASE way WHEN 'first' THEN method || '/x: ' || t WHEN 'second' THEN 'again: ' || t ELSE raw END) AS text_md5,
CASE WHEN way IN ('second', 'none') THEN CASE length(t) % 3 WHEN 0 THEN 'file-' || doc_id || ' is blurred' ELSE 'Primary OCR provider failed.' END || CASE way WHEN 'none' THEN '|no lines' ELSE '' END ELSE '' END AS warnings FROM r""")
def ocr_chain(spark, d):
    """Documents as PDF files, images and texts, through two readers that fail by a text's length."""
    k = (F.col("doc_id") % 3 + 1).cast("int")
    text = F.coalesce("text", F.lit(""))
    rows = _spread(_t(spark, d, "documents")).select("doc_id", F.element_at(F.array(F.lit("pdf"), F.lit("image"), F.lit("text")), k).alias("method"), F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("name"), F.encode(text, "utf-8").alias("content"), F.when(k == 2, "").otherwise(text).alias("raw"))
    found = ocr.recognized(rows.withColumn("content_type", F.concat("method", F.lit("/x"))), ocr.Provider("one", _first_reader), ocr.Provider("two", _second_reader))
    return found.select("doc_id", "extraction_method", "ocr_provider_used", "fallback_stage", F.md5(F.encode("text", "utf-8")).alias("text_md5"), F.array_join("warnings", "|").alias("warnings"))


def _blocks_sql() -> str:
    """(kind, base, bits) of the closed address blocks: all 32 bits of the old kind, the first 32 of the new one."""
    nets = [ipaddress.ip_network(b) for b in guarded.CLOSED]
    return ", ".join(f"({n.version}, {int(n[0]) >> (n.max_prefixlen - 32)}, {n.prefixlen})" for n in nets)


@query(f"""WITH c AS (SELECT c_custkey AS id, c_custkey * 2654435761 % 4294967296 AS n, c_custkey * 40503 % 65536 AS g, c_custkey * 30011 % 65536 AS h, c_custkey % 4 AS k FROM customer),
s AS (SELECT *, (n >> 24) || '.' || (n >> 16 & 255) || '.' || (n >> 8 & 255) || '.' || (n & 255) AS d, CASE WHEN k = 2 THEN 6 ELSE 4 END AS kind, CASE WHEN k = 2 THEN g * 65536 + h ELSE n END AS b FROM c),
x(kind, base, bits) AS (VALUES {_blocks_sql()}),
m AS (SELECT s.id, count(x.base) > 0 AS met FROM s LEFT JOIN x ON x.kind = s.kind AND (s.b >> (32 - x.bits)) = (x.base >> (32 - x.bits)) GROUP BY s.id),
f AS (SELECT s.*, met AND NOT (kind = 4 AND n IN (3221225481, 3221225482)) AND NOT (kind = 6 AND (b = 536936451 OR b >> 4 IN (33558530, 33558531))) AS closed FROM s JOIN m USING (id))
SELECT id, CASE k WHEN 0 THEN d WHEN 1 THEN '::ffff:' || d WHEN 2 THEN printf('%x:%x::%x', g, h, id % 65536) ELSE d || '.1' END AS address, CASE WHEN k < 3 THEN closed END AS closed FROM f""")
def address_ranges(spark, d):
    """Addresses of both kinds, of the old kind within the new one, and what is none, made from customers: which are closed to fetching."""
    key = F.col("c_custkey")
    rows = _spread(_t(spark, d, "customer")).select(key.alias("id"), (key * 2654435761 % 4294967296).alias("n"), (key * 40503 % 65536).alias("g"), (key * 30011 % 65536).alias("h"))
    dotted = F.concat_ws(".", *[F.shiftright("n", k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    k = F.col("id") % 4
    said = F.when(k == 0, dotted).when(k == 1, F.concat(F.lit("::ffff:"), dotted)).when(k == 2, F.format_string("%x:%x::%x", "g", "h", F.col("id") % 65536)).otherwise(F.concat(dotted, F.lit(".1")))
    return guarded.closed(rows.select("id", said.alias("address")), "address")


@query(f"""WITH a AS (SELECT item_id AS case_id, item_id % 17 AS n_found, item_id % 6 AS k FROM benchmark), j(k, gaps, qs, bad) AS (VALUES (0, true, ['overtime pay rules', 'end of service award'], NULL), (1, true, ['notice period'], NULL), (2, false, CAST([] AS VARCHAR[]), NULL), (3, true, CAST([] AS VARCHAR[]), NULL), (4, false, CAST([] AS VARCHAR[]), 'agentic_parse_failed'), (5, false, CAST([] AS VARCHAR[]), 'agentic_empty_response')),
w AS (SELECT case_id, CASE WHEN n_found >= 15 THEN 'agentic_sufficient_candidates' WHEN bad IS NOT NULL THEN bad WHEN gaps AND len(qs) = 0 THEN 'agentic_no_queries_generated' END AS warning, qs FROM a JOIN j USING (k))
SELECT case_id, warning, CAST(i AS INTEGER) AS round, CASE WHEN i IS NOT NULL THEN qs[i] END AS query FROM w LEFT JOIN (SELECT unnest([1, 2]) AS i) r ON warning IS NULL AND i <= len(qs)""")
def gap_queries(spark, d):
    k = (F.col("item_id") % len(_ANSWERS) + 1).cast("int")
    answers = _t(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 17).alias("n_found"), F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), k).alias("raw"))
    return agentic.gap_queries(answers)


# ------------------------------------------------------------------ Arabic, citations


_JUDGED = "SELECT p_partkey AS id, 'وَفْقًا لِمَا جَاءَ فِي المَادَّة ' || p_size || ' من نظام العمل السعودي، وكذلك المادة ' || (p_size + 1) || ' من لائحة التنفيذ. والمادة ٧٥/١ ' || p_brand AS text FROM part"


def _judged(spark, d):
    return _spread(_t(spark, d, "part")).select(F.col("p_partkey").alias("id"), F.concat(F.lit("وَفْقًا لِمَا جَاءَ فِي المَادَّة "), F.col("p_size"), F.lit(" من نظام العمل السعودي، وكذلك المادة "), F.col("p_size") + 1, F.lit(" من لائحة التنفيذ. والمادة ٧٥/١ "), F.col("p_brand")).alias("text"))


#: Words of a part's name, twice, and of a judgment on a made page: three rows of six on a page, each a little off its line.
_LAID = f"""w AS (SELECT p_partkey AS doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS w FROM (SELECT p_partkey, string_split(p_name || ' ' || p_name || ' ' || t.text, ' ') AS l FROM part JOIN ({_JUDGED}) t ON t.id = p_partkey)),
d AS (SELECT doc_id, i // 18 AS page, i AS pos, 500 - (i % 6) * 80 + (doc_id + i) % 7 AS x0, 40 + (i % 18) // 6 * 14 + ((i * 7 + doc_id) % 5) * 0.5::DOUBLE - 1 AS top, w FROM w WHERE w <> ''),
g AS (SELECT *, round_even(top / 5, 0) AS band, regexp_matches(w, '[\\x{{0600}}-\\x{{06FF}}]') AS rtl FROM d),
f AS (SELECT *, bool_or(rtl) OVER (PARTITION BY doc_id, page, band) AS turn, CASE WHEN rtl THEN array_to_string([substr(nfc_normalize(w), k, 1) FOR k IN range(length(nfc_normalize(w)), 0, -1)], '') ELSE w END AS said FROM g),
n AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY band) AS line, string_agg(said, ' ' ORDER BY CASE WHEN turn THEN -x0 ELSE x0 END, pos) AS text FROM f GROUP BY doc_id, page, band)"""


def _laid(spark, d):
    judged = _judged(spark, d).withColumnRenamed("id", "p_partkey")
    words = F.split(F.concat_ws(" ", "p_name", "p_name", "text"), " ")
    rows = _t(spark, d, "part").join(judged, "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.posexplode(words).alias("i", "text")).where("text <> ''")
    i, key = F.col("i"), F.col("doc_id")
    top = 40 + F.floor(i % 18 / 6) * 14 + (i * 7 + key) % 5 * 0.5 - 1
    return rows.select("doc_id", F.floor(i / 18).alias("page"), i.cast("long").alias("pos"), (500 - i % 6 * 80 + (key + i) % 7).cast("double").alias("x0"), top.cast("double").alias("top"), "text")


@query(f"WITH {_LAID} SELECT doc_id, page, line, text FROM n")
def page_lines(spark, d):
    return layout.page_lines(_laid(spark, d))


@query(f"WITH {_LAID}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM n GROUP BY doc_id, page) SELECT doc_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS text FROM p GROUP BY doc_id")
def page_texts(spark, d):
    return layout.page_texts(layout.page_lines(_laid(spark, d)))


_AR = r"trim(regexp_replace(regexp_replace(translate({0}, 'آأإ', 'ااا'), '[\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH t AS ({_JUDGED}) SELECT id, {_AR.format('text')} AS normalized, length({_AR.format('text')}) AS n FROM t")
def arabic_normalize(spark, d):
    return _judged(spark, d).select("id", T.normalize_arabic("text").alias("normalized")).withColumn("n", F.length("normalized").cast("long"))


_SAID = ("الأولى", "الثانية عشرة", "الخامسة والعشرون", "٧٥/١", "العاشرة", "التاسعة والثلاثين", "المادة 12", "كلمة", "السادس عشر", "المائة", "الثامنة والتسعون", "")


@query(rf"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 12 THEN p_size::VARCHAR ELSE ([{', '.join(f"'{x}'" for x in _SAID)}])[p_partkey % 13 + 1] END AS said FROM part),
n AS (SELECT id, {_AR.format('said')} AS x FROM t), g AS (SELECT id, x, regexp_replace(translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[^0-9]', '', 'g') AS digits FROM n),
w(word, value) AS (VALUES ('الاولى', 1), ('الثانية', 2), ('الخامسة', 5), ('السادسة', 6), ('الثامنة', 8), ('التاسعة', 9), ('العاشرة', 10), ('الثانية عشرة', 12), ('السادس عشر', 16), ('العشرون', 20), ('الثلاثين', 30), ('التسعون', 90), ('المائة', 100)),
p AS (SELECT id, unnest(string_split_regex(x, '\s+و')) AS part FROM g WHERE digits = '' AND x <> ''), v AS (SELECT id, CASE WHEN count(*) = count(value) THEN sum(value) END AS total FROM p LEFT JOIN w ON trim(part) = word GROUP BY id)
SELECT g.id, CASE WHEN digits <> '' THEN digits::BIGINT ELSE total::BIGINT END AS number FROM g LEFT JOIN v USING (id)""")
def arabic_numbers(spark, d):
    k = (F.col("p_partkey") % 13 + 1).cast("int")
    said = F.when(k == 13, F.col("p_size").cast("string")).otherwise(F.element_at(F.array(*[F.lit(x) for x in _SAID], F.lit("")), k))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.arabic_number(said).alias("number"))


_END = r"(?:[،.؛:\s)(]|$)"
_NAMED = r"\s+([\x{0600}-\x{06FF}\s]{3,60}?)" + _END
_DIGIT = r"[0-9٠-٩]+(?:\s*/\s*[0-9٠-٩]+)?"
_CITED = (
    r"المادة\s+(ال[\x{0600}-\x{06FF}]+(?:\s+و(?:ال)?[\x{0600}-\x{06FF}]+)*|" + _DIGIT + r")\s+من\s+(?:نظام|لائحة|قانون|مرسوم)" + _NAMED,
    r"المادة\s+(" + _DIGIT + r")\s+من\s+(?:نظام|لائحة|قانون)" + _NAMED,
    r"المادة\s+(" + _DIGIT + ")" + _END,
)
_CITATIONS = f"""n AS (SELECT id, {_AR.format('text')} AS t FROM ({_JUDGED}) WHERE length(text) >= 50),
m AS ({' UNION ALL '.join(f"SELECT id, {k} AS pattern, generate_subscripts(a, 1) AS pos, unnest(a) AS a, unnest(b) AS b FROM (SELECT id, regexp_extract_all(t, '{p}', 1) AS a, {'regexp_extract_all(t, ' + chr(39) + p + chr(39) + ', 2)' if k < 2 else 'list_transform(regexp_extract_all(t, ' + chr(39) + p + chr(39) + ', 1), lambda x: ' + chr(39) * 2 + ')'} AS b FROM n)" for k, p in enumerate(_CITED))}),
c AS (SELECT id, pattern, pos, trim(a) AS article_ref, regexp_replace(regexp_replace(trim(b), '[\\s،.؛:]+$', ''), '\\s+(?:و|أو|في|على|من|إلى)$', '') AS name FROM m),
cited AS (SELECT id, pattern, article_ref, name FROM (SELECT *, row_number() OVER (PARTITION BY id, article_ref, name ORDER BY pattern, pos) AS k, row_number() OVER (PARTITION BY id, article_ref ORDER BY pattern, pos) AS r FROM c) WHERE k = 1 AND (pattern < 2 OR r = 1))"""


@query(f"WITH {_CITATIONS} SELECT id, pattern, article_ref, name FROM cited")
def citations_found(spark, d):
    return citations.extract(_judged(spark, d)).select("id", F.col("pattern"), "article_ref", "name")


_TITLES = ((1, "نظام العمل"), (2, "لائحة التنفيذ القضائي"), (3, "نظام الشركات"), (4, "العمل التطوعي"))
_BARE = r"regexp_replace({0}, '^(?:نظام|لائحة|قانون|مرسوم|قرار)\s+', '')"
#: The ratio of matching blocks by recursion: the longest common run, then what is left and right of it.
_RESOLVED = rf"""{_CITATIONS}, titles(title_id, title) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in _TITLES)}),
pr AS (SELECT name, title_id, title, {_BARE.format(_AR.format('name'))} AS a, {_BARE.format(_AR.format('title'))} AS b FROM (SELECT DISTINCT name FROM cited WHERE name <> ''), titles),
sm AS (SELECT name, title_id, a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi, 0 AS k, 0 AS i, 0 AS j, 0 AS depth FROM pr
  UNION ALL SELECT s.name, s.title_id, s.a, s.b, s.alo, s.ahi, s.blo, s.bhi, m.k, m.i, m.j, s.depth + 1 FROM (
    SELECT *, x.al AS alo, x.ah AS ahi, x.bl AS blo, x.bh AS bhi FROM (SELECT name, title_id, a, b, depth, unnest(CASE WHEN k = 0 THEN [{{'al': alo, 'ah': ahi, 'bl': blo, 'bh': bhi}}] ELSE [{{'al': alo, 'ah': i, 'bl': blo, 'bh': j}}, {{'al': i + k, 'ah': ahi, 'bl': j + k, 'bh': bhi}}] END) AS x FROM sm)) s
  JOIN LATERAL (SELECT i, j, max(k) AS k FROM (SELECT unnest(range(s.alo, s.ahi)) AS i) x, (SELECT unnest(range(s.blo, s.bhi)) AS j) y, (SELECT unnest(range(1, length(s.a) + 1)) AS k) z
    WHERE i + k <= s.ahi AND j + k <= s.bhi AND substr(s.a, CAST(i + 1 AS BIGINT), CAST(k AS BIGINT)) = substr(s.b, CAST(j + 1 AS BIGINT), CAST(k AS BIGINT)) GROUP BY i, j ORDER BY max(k) DESC, i, j LIMIT 1) m ON true WHERE s.ahi > s.alo AND s.bhi > s.blo),
rt AS (SELECT name, title_id, 2.0::DOUBLE * sum(k) / any_value(length(a) + length(b)) AS ratio FROM sm GROUP BY name, title_id),
jc AS (SELECT pr.*, ratio, list_distinct(list_filter(string_split_regex(a, '\s+'), lambda x: length(x) > 1)) AS x, list_distinct(list_filter(string_split_regex(b, '\s+'), lambda x: length(x) > 1)) AS y FROM pr JOIN rt USING (name, title_id)),
ss AS (SELECT name, title_id, 0.4::DOUBLE * CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END + 0.6::DOUBLE * ratio AS score FROM jc),
rs AS (SELECT name, title_id, round(score, 3) AS match_score FROM ss WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, title_id) = 1),
found AS (SELECT cited.id, cited.pattern, article_ref, cited.name, title_id, match_score, CASE WHEN cited.pattern = 0 THEN CASE WHEN match_score >= 0.7 THEN 'high' ELSE 'medium' END WHEN cited.pattern = 1 AND match_score IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM cited LEFT JOIN rs USING (name))"""


def _resolved(spark, d):
    titles = spark.createDataFrame(list(_TITLES), "title_id long, title string")
    found = citations.extract(_judged(spark, d))
    return citations.with_confidence(found, citations.resolve(found.where("name <> ''"), titles))


@query(f"WITH RECURSIVE {_RESOLVED} SELECT id, article_ref, name, title_id::BIGINT AS title_id, match_score, confidence, regexp_replace(translate(article_ref, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[^0-9]', '', 'g')::BIGINT AS article_number FROM found")
def citations_resolved(spark, d):
    return _resolved(spark, d).select("id", "article_ref", "article_number", "name", "title_id", "match_score", "confidence")


@query(f"""WITH RECURSIVE {_RESOLVED}, per AS (SELECT id, count(*) AS n, count(*) FILTER (confidence = 'high') AS h, count(*) FILTER (confidence = 'medium') AS m, count(*) FILTER (confidence = 'low') AS l FROM found GROUP BY id),
a AS (SELECT count(*) AS total_cases, count(per.id) AS cases_with_citations, coalesce(sum(n), 0)::BIGINT AS total_citations, coalesce(sum(h), 0)::BIGINT AS high, coalesce(sum(m), 0)::BIGINT AS medium, coalesce(sum(l), 0)::BIGINT AS low FROM part LEFT JOIN per ON per.id = p_partkey)
SELECT *, round(cases_with_citations / greatest(1, total_cases)::DOUBLE, 3) AS citation_rate, round(total_citations / greatest(1, total_cases)::DOUBLE, 2) AS mean_citations FROM a""")
def citation_stats(spark, d):
    return citations.stats(_judged(spark, d), _resolved(spark, d))


# ------------------------------------------------------------------ training data


@query("""WITH u AS (SELECT text AS id, 0 AS s, doc_id AS pos FROM documents UNION ALL SELECT text, 1, item_id FROM benchmark UNION ALL SELECT CASE WHEN turn = 0 THEN '' ELSE text END, 2, conv_id * 1000 + turn FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, pos) AS r FROM u WHERE id IS NOT NULL AND id <> '') SELECT md5(id) AS id, pos FROM k WHERE r = 1""")
def merge_dedupe(spark, d):
    return training.merge(_three(spark, d)).select(F.md5("id").alias("id"), "pos")


def _three(spark, d):
    return [
        _t(spark, d, "documents").select(F.col("text").alias("id"), F.col("doc_id").alias("pos")),
        _t(spark, d, "benchmark").select(F.col("text").alias("id"), F.col("item_id").alias("pos")),
        _t(spark, d, "conversations").select(F.when(F.col("turn") == 0, "").otherwise(F.col("text")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos")),
    ]


@query("""WITH u AS (SELECT text AS id FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT CASE WHEN turn = 0 THEN '' ELSE text END FROM conversations)
SELECT count(DISTINCT id) FILTER (id IS NOT NULL AND id <> '') AS kept, count(*) FILTER (id IS NOT NULL AND id <> '') - count(DISTINCT id) FILTER (id IS NOT NULL AND id <> '') AS duplicates, count(*) FILTER (id IS NULL OR id = '') AS invalid FROM u""")
def merge_stats(spark, d):
    return training.merge_stats(_three(spark, d))


@query("""SELECT doc_id, left(text, 500) AS snippet FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50""")
def qa_sample(spark, d):
    return training.sample(_t(spark, d, "documents"), "doc_id", 50).select("doc_id", F.left("text", F.lit(500)).alias("snippet"))


_CHUNKS = "SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_suppkey AS reg_id, l_orderkey AS version_id, CAST(l_linenumber AS BIGINT) AS chunk_index, 'المادة ' || l_partkey AS article_ref, 'chunk ' || l_orderkey || ' ' || l_linenumber || ' of the regulation' AS content FROM lineitem"


def _chunks(spark, d):
    n = F.col("l_linenumber")
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("chunk_id"), F.col("l_suppkey").alias("reg_id"), F.col("l_orderkey").alias("version_id"), n.cast("long").alias("chunk_index"), F.concat(F.lit("المادة "), F.col("l_partkey")).alias("article_ref"), F.concat(F.lit("chunk "), F.col("l_orderkey"), F.lit(" "), n, F.lit(" of the regulation")).alias("content"))


@query(f"""WITH c AS ({_CHUNKS}), k AS (SELECT *, row_number() OVER (PARTITION BY reg_id ORDER BY version_id DESC, chunk_index, chunk_id) AS r FROM c) SELECT reg_id, content FROM k WHERE r = 1""")
def latest_first_chunk(spark, d):
    versions = _t(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("version_number"))
    return training.latest_first_chunk(_chunks(spark, d), versions)


@query(f"""WITH c AS ({_CHUNKS}), ci AS (SELECT p_partkey AS id, s_suppkey AS reg_id, CAST(p_size AS BIGINT) AS article_number FROM part JOIN supplier ON s_suppkey = p_partkey % 50 + 1),
f AS (SELECT reg_id, content FROM (SELECT *, row_number() OVER (PARTITION BY reg_id ORDER BY version_id DESC, chunk_index, chunk_id) AS r FROM c) WHERE r = 1),
h AS (SELECT ci.*, c.content, row_number() OVER (PARTITION BY ci.id ORDER BY c.chunk_index, c.chunk_id) AS r FROM ci JOIN c ON c.reg_id = ci.reg_id AND contains(c.article_ref, ci.article_number::VARCHAR))
SELECT ci.id, ci.reg_id, ci.article_number, coalesce(h.content, f.content) AS positive FROM ci LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.id = ci.id LEFT JOIN f ON f.reg_id = ci.reg_id""")
def positive_chunks(spark, d):
    """Chunks by article number, else the first of the latest version."""
    ci = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50 + 1).alias("reg_id"), F.col("p_size").cast("long").alias("article_number")).join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("reg_id")), "reg_id").select("id", "reg_id", "article_number")
    versions = _t(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("version_number"))
    return training.chunk_by_article(ci, _chunks(spark, d), training.latest_first_chunk(_chunks(spark, d), versions))


@query(f"""WITH {_VEC}, s AS (SELECT a.vec_id AS id, b.vec_id AS chunk_id, b.label AS reg_id, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
n AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, chunk_id) AS k FROM s JOIN v q ON q.vec_id = s.id WHERE s.reg_id <> q.label),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rank FROM n WHERE k <= 10 AND chunk_id % 2 = 0) SELECT id, chunk_id, reg_id, score, rank FROM m WHERE rank <= 3""")
def hard_negatives(spark, d):
    v = _t(spark, d, "embeddings")
    chunks = v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("reg_id"), F.when(F.col("vec_id") % 2 == 0, "a long enough content of a chunk").otherwise("short").alias("content"))
    own = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("reg_id"))
    scores = _outside(v, F.col("label"), own)
    return training.hard_negatives(scores, own, chunks).select("id", "chunk_id", "reg_id", "score", "rank")


def _outside(v, reg, own):
    """(id, chunk_id, score): each query vector's best ten outside the regulations of ``own`` (id, reg_id); ``reg``: a vector's regulation."""
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("what"), reg.alias("grp"))
    best = blocks.scored(rows.where("id % 50 = 0").drop("grp"), _spread(rows), 10, own.select("id", F.col("reg_id").alias("grp")))
    return best.select(F.col("query_id").alias("id"), F.col("id").alias("chunk_id"), _r6("score").alias("score"))


def _hash_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::UBIGINT"


def _drawn(name: str, who: str, n: int) -> str:
    """CTEs up to ``name`` (id, chunk_id, reg_id, content, rank): draws of ``who`` (id, pool) from ``pools``, ``shares`` and ``own``."""
    base = f"SELECT w.id, p.chunk_id, p.reg_id, p.content, md5('42:' || w.id || ':' || p.chunk_id) AS o"
    free = "NOT EXISTS (SELECT 1 FROM own WHERE own.id = w.id AND own.reg_id = p.reg_id)"
    return f"""
{name}_1 AS ({base} FROM {who} w JOIN shares s USING (pool) JOIN pools p ON p.pool = w.pool AND {_hash_sql("'42'", "'share'", 'p.chunk_id')} % s.n = {_hash_sql("'42'", "'case'", 'w.id')} % s.n WHERE {free}),
{name}_2 AS (SELECT id FROM {name}_1 GROUP BY id HAVING count(*) >= {n}),
{name}_3 AS ({base} FROM {who} w JOIN shares s USING (pool) JOIN pools p ON p.pool = w.pool WHERE s.n > 1 AND w.id NOT IN (SELECT id FROM {name}_2) AND {free}),
{name}_4 AS (SELECT * FROM {name}_1 WHERE id NOT IN (SELECT w.id FROM {who} w JOIN shares s USING (pool) WHERE s.n > 1 AND w.id NOT IN (SELECT id FROM {name}_2)) UNION ALL SELECT * FROM {name}_3),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, chunk_id) AS rank FROM {name}_4) WHERE rank <= {n})"""


_POOLS = """pools AS (SELECT chunk_id, reg_id, content, category AS pool FROM chunks UNION ALL SELECT chunk_id, reg_id, content, '*' FROM chunks), shares AS (SELECT pool, CAST(ceil(count(*) / 64.0) AS UBIGINT) AS n FROM pools GROUP BY pool)"""


@query(f"""WITH chunks AS (SELECT vec_id AS chunk_id, vec_id AS reg_id, label::VARCHAR AS category, 'x' AS content FROM embeddings), who AS (SELECT vec_id AS id, label::VARCHAR AS pool FROM embeddings WHERE vec_id % 50 = 0), own AS (SELECT id, id AS reg_id FROM who), {_POOLS}, {_drawn('n', 'who', 2)}
SELECT id, chunk_id, rank FROM n""")
def random_negatives(spark, d):
    v = _t(spark, d, "embeddings")
    cases = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("category"))
    chunks = v.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("reg_id"), F.col("label").alias("category"), F.lit("a long enough content of a chunk").alias("content"))
    return training.random_negatives(cases, cases.select("id", F.col("id").alias("reg_id")), chunks).select("id", "chunk_id", "rank")


_TRIPLET = rf"""{_VEC}, cases AS (SELECT v.vec_id AS id, d.text, CASE WHEN v.vec_id % 100 = 0 THEN 'c' || v.label WHEN v.vec_id % 150 = 50 THEN 'nowhere' END AS category FROM v JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id % 50 = 0),
cited AS (SELECT id, CASE WHEN k = 2 AND id % 100 = 0 THEN NULL ELSE (id * 7 + k * 31) % 97 END AS reg_id, k * 5 AS article_number FROM cases, (SELECT unnest([0, 1, 2]) AS k)),
chunks AS (SELECT vec_id AS chunk_id, vec_id % 97 AS reg_id, vec_id // 97 AS chunk_index, 'المادة ' || (vec_id % 20) AS article_ref, 'c' || label AS category, CASE WHEN vec_id % 9 = 0 THEN 'short ' || vec_id ELSE 'the content of chunk number ' || vec_id END AS content FROM embeddings),
facts AS (SELECT id, category, trim(left(text, 1500), ' ' || chr(9) || chr(10) || chr(13)) AS query FROM cases WHERE length(text) >= 50), q AS (SELECT * FROM facts WHERE length(query) >= 30),
ok AS (SELECT DISTINCT cited.* FROM cited JOIN q USING (id) WHERE reg_id IS NOT NULL), own AS (SELECT DISTINCT id, reg_id FROM ok),
hit AS (SELECT ok.*, c.content, row_number() OVER (PARTITION BY ok.id, ok.reg_id, ok.article_number ORDER BY chunk_index, chunk_id) AS r FROM ok JOIN chunks c ON c.reg_id = ok.reg_id AND ok.article_number <> 0 AND contains(c.article_ref, ok.article_number::VARCHAR)),
f AS (SELECT reg_id, content FROM chunks QUALIFY row_number() OVER (PARTITION BY reg_id ORDER BY chunk_index, chunk_id) = 1),
pos AS (SELECT ok.id, ok.reg_id, ok.article_number, coalesce(h.content, f.content) AS positive FROM ok LEFT JOIN (SELECT * FROM hit WHERE r = 1) h ON h.id = ok.id AND h.reg_id = ok.reg_id AND h.article_number = ok.article_number LEFT JOIN f ON f.reg_id = ok.reg_id),
people AS (SELECT DISTINCT q.id, q.category FROM q JOIN own USING (id)),
sc AS (SELECT p.id, b.vec_id AS chunk_id, round({_COS}, 6) AS score FROM people p JOIN v a ON a.vec_id = p.id, v b),
hd0 AS (SELECT sc.id, c.content, row_number() OVER (PARTITION BY sc.id ORDER BY score DESC, sc.chunk_id) AS k FROM sc JOIN chunks c USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.id = sc.id AND own.reg_id = c.reg_id)),
hd AS (SELECT id, content, 'hard' AS origin FROM hd0 WHERE k <= 10 AND length(content) >= 20 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) <= 3),
{_POOLS}, who1 AS (SELECT id, category AS pool FROM people WHERE category IS NOT NULL), {_drawn('n1', 'who1', 2)}, who2 AS (SELECT id, '*' AS pool FROM people WHERE id NOT IN (SELECT id FROM n1)), {_drawn('n2', 'who2', 2)},
neg AS (SELECT * FROM hd UNION ALL SELECT id, content, 'random' FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) WHERE length(content) >= 20),
made AS (SELECT pos.id, pos.reg_id, pos.article_number, md5(q.query) AS query, positive, content AS negative, origin, CASE WHEN ('0x' || substr(md5(pos.id::VARCHAR), 1, 8))::UBIGINT / 4294967295.0::DOUBLE < 0.2::DOUBLE THEN 'val' ELSE 'train' END AS split FROM pos JOIN q USING (id) JOIN neg USING (id) WHERE length(positive) >= 20)"""


def _triplet_tables(spark, d):
    """Cases are the query set's vectors with the documents of their ids, chunks all vectors, cut into 97 regulations."""
    v, docs = _t(spark, d, "embeddings"), _t(spark, d, "documents")
    label = F.concat(F.lit("c"), F.col("label"))
    category = F.when(F.col("vec_id") % 100 == 0, label).when(F.col("vec_id") % 150 == 50, "nowhere")
    cases = v.where("vec_id % 50 = 0").join(docs, F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("id"), "text", category.alias("category"))
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    cited = cases.select("id", k.alias("k")).select("id", F.when((F.col("k") == 2) & (F.col("id") % 100 == 0), None).otherwise((F.col("id") * 7 + F.col("k") * 31) % 97).alias("reg_id"), (F.col("k") * 5).cast("long").alias("article_number"))
    content = F.when(F.col("vec_id") % 9 == 0, F.concat(F.lit("short "), F.col("vec_id"))).otherwise(F.concat(F.lit("the content of chunk number "), F.col("vec_id")))
    chunks = v.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 97).alias("reg_id"), F.floor(F.col("vec_id") / 97).alias("chunk_index"), F.concat(F.lit("المادة "), F.col("vec_id") % 20).alias("article_ref"), label.alias("category"), content.alias("content"))
    scores = _outside(v, F.col("vec_id") % 97, cited.where("reg_id is not null"))
    first = training.latest_first_chunk(chunks.withColumn("version_id", F.lit(1)), spark.createDataFrame([(1, 1)], "version_id int, version_number int"))
    return cases, cited, chunks, scores, first


@query(f"WITH {_TRIPLET} SELECT * FROM made")
def triplet_build(spark, d):
    return training.triplets(*_triplet_tables(spark, d)).withColumn("query", F.md5("query"))


@query(f"""WITH {_TRIPLET}, g AS (SELECT id, count(*) AS n, count(reg_id) AS resolved FROM cited GROUP BY id), e AS (SELECT length(positive) >= 20 AS good FROM cited JOIN q USING (id) JOIN pos USING (id, reg_id, article_number))
SELECT (SELECT count(*) FROM cases) AS total_cases, (SELECT count(*) FROM cases LEFT JOIN g USING (id) WHERE coalesce(length(text), 0) < 50 OR (resolved > 0 AND id NOT IN (SELECT id FROM q))) AS skipped_no_text, (SELECT count(*) FROM cases JOIN g USING (id) WHERE length(text) >= 50 AND n > 0) AS cases_with_citations,
(SELECT count(*) FROM cases JOIN g USING (id) WHERE length(text) >= 50 AND resolved > 0) AS cases_with_resolved_citations, (SELECT count(*) FROM e WHERE coalesce(good, false)) AS total_positives_found, (SELECT count(*) FROM e WHERE NOT coalesce(good, false)) AS skipped_no_positive,
(SELECT count(*) FROM made WHERE split = 'train') AS total_triplets_train, (SELECT count(*) FROM made WHERE split = 'val') AS total_triplets_val""")
def triplet_stats(spark, d):
    """The counters that are observed while triplets are stored."""
    counts = training.counted_triplets(*_triplet_tables(spark, d))[1]
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query("""SELECT c_mktsegment AS category, count(*) AS n_chunks, count(DISTINCT c_nationkey) AS n_regulations FROM customer GROUP BY c_mktsegment""")
def chunk_indexes(spark, d):
    return training.chunk_indexes(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("reg_id")))


@query(f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS hit, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1) SELECT count(*) AS evaluated, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM k""")
def top1_accuracy(spark, d):
    v = _t(spark, d, "embeddings")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    s = _dense(spark, d, 2, True).where("query_id <> vec_id").join(own, "query_id")
    return training.top1_accuracy(s.select("query_id", F.col("vec_id").alias("item_id"), "score", (F.col("l") == F.col("label")).alias("relevant")))


@query("""WITH f AS (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 2000), l AS (SELECT conv_id AS case_pos, turn * 2 + CASE WHEN role = 'user' THEN 0 ELSE 1 END AS pos, text FROM conversations JOIN f USING (conv_id) WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY case_pos, pos) AS r FROM l) SELECT text, case_pos, pos::BIGINT AS pos FROM r WHERE r = 1""")
def law_pool(spark, d):
    """Messages as the laws of a conversation, their case."""
    laws = _t(spark, d, "conversations").select(F.col("conv_id").alias("case_pos"), (F.col("turn") * 2 + F.when(F.col("role") == "user", 0).otherwise(1)).cast("long").alias("pos"), "text")
    return training.pool(laws, laws)


@query("""WITH p AS (SELECT DISTINCT left(a.text, 200) AS k, a.text AS t, 1 AS rel FROM conversations a WHERE role = 'user' UNION SELECT left(a.text, 200), b.text, 0 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.role = 'user' AND b.role = 'assistant'),
c AS (SELECT k, t, max(rel) AS rel FROM p GROUP BY k, t) SELECT count(DISTINCT k) AS queries, count(*) AS corpus, count(*) FILTER (rel = 1) AS relevant FROM c""")
def evaluation_set(spark, d):
    rows = _t(spark, d, "conversations")
    users, others = rows.where("role = 'user'").select("conv_id", F.col("text").alias("query")), rows.where("role = 'assistant'").select("conv_id", F.col("text").alias("negative"))
    queries, corpus, relevant = training.evaluation_set(users.join(others, "conv_id", "left").select("query", F.col("query").alias("positive"), "negative"))
    return queries.agg(F.count("*").alias("queries")).crossJoin(corpus.agg(F.count("*").alias("corpus"))).crossJoin(relevant.agg(F.count("*").alias("relevant")))


# ------------------------------------------------------------------ retrieval measures


_IR = f"""{_VEC}, s AS (SELECT a.vec_id AS query_id, a.label AS l, b.vec_id, b.label, round({_COS}, 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM k WHERE rank <= 100 AND l = label),
n AS (SELECT query_id, count(*) FILTER (l = label) AS n FROM s GROUP BY query_id),
q AS (SELECT n.query_id, n.n, count(h.rank) FILTER (h.rank <= 1) AS h1, count(h.rank) FILTER (h.rank <= 3) AS h3, count(h.rank) FILTER (h.rank <= 5) AS h5, count(h.rank) FILTER (h.rank <= 10) AS h10, min(h.rank) AS first,
  coalesce(sum(1 / log2(h.rank + 1)) FILTER (h.rank <= 10), 0) AS dcg, coalesce(sum(nth::DOUBLE / h.rank), 0) AS ap FROM n LEFT JOIN h USING (query_id) GROUP BY n.query_id, n.n)"""


def _retrieved(spark, d):
    v = _t(spark, d, "embeddings")
    rows = _dense(spark, d, 101).where("query_id <> vec_id").withColumnRenamed("vec_id", "item_id")
    ranked = V.top_k(rows, ["query_id"], [F.desc("score"), F.col("item_id")], 100)
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    relevant = queries.join(v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("l")), "l").where("query_id <> item_id").select("query_id", "item_id")
    return ranked.select("query_id", "item_id", "rank"), relevant, queries.select("query_id")


@query(f"WITH {_IR} SELECT " + ", ".join(f"round(avg(CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy_{k}, round(avg(h{k} / {k}::DOUBLE), 4) AS precision_{k}, round(avg(h{k} / greatest(n, 1)::DOUBLE), 4) AS recall_{k}" for k in (1, 3, 5, 10)) + """,
round(avg(CASE WHEN first <= 10 THEN 1 / first::DOUBLE ELSE 0 END), 4) AS mrr_10, round(avg(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, greatest(1, least(n, 10)) + 1)])), 4) AS ndcg_10, round(avg(ap / least(greatest(n, 1), 100)), 4) AS map_100 FROM q""")
def ir_metrics(spark, d):
    return training.ir_metrics(*_retrieved(spark, d))


@query(f"WITH {_IR} SELECT count(*) AS evaluated, round(avg(CASE WHEN h3 > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate FROM q")
def hit_rate(spark, d):
    ranked, relevant, _ = _retrieved(spark, d)
    return training.hit_rate(ranked, relevant)


# ------------------------------------------------------------------ extraction, chat


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|template)\b.*?</(script|style|template)\s*>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g') AS h FROM pages),
q AS (SELECT page_id, string_split_regex(h, '<[/!a-zA-Z][^>]*>') AS l FROM p),
u AS (SELECT page_id, list_transform(l, lambda x: trim(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))) AS l FROM q),
t AS (SELECT page_id, trim(regexp_replace(array_to_string(list_filter(l, lambda x: x <> ''), ' '), '\s+', ' ', 'g')) AS t FROM u)
SELECT page_id, 'html' AS method, 'ok' AS status, CASE WHEN t <> '' THEN left(t, 120000) END AS text, CASE WHEN t <> '' THEN sha256(left(t, 120000)) END AS sha256 FROM t""")
def html_text(spark, d):
    pages = _spread(_t(spark, d, "pages")).select("page_id", F.lit("text/html").alias("content_type"), F.lit("page.html").alias("name"), F.encode("html", "utf-8").alias("content"))
    return extract.extract(pages).select("page_id", "method", "status", "sha256", "text")


@query(rf"""WITH t AS (SELECT doc_id, {_NORM.format('text')} AS w, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 15000000 THEN NULL ELSE left(w, 120000) END AS text, CASE WHEN n > 15000000 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n > 15000000 THEN 'payload_too_large' END AS error_code,
CASE WHEN n <= 15000000 THEN sha256(left(w, 120000)) END AS sha256, CASE WHEN n <= 15000000 AND length(w) > 120000 THEN 'text_truncated' ELSE '' END AS warnings FROM t""")
def extraction_envelope(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"), F.lit("text").alias("method"), F.when(F.octet_length("text") <= extract.MOST_BYTES, F.col("text")).alias("raw"))
    found = extract.envelope(rows.withColumn("read", F.col("raw").isNotNull()))
    blank = lambda c, x: F.coalesce(c, F.when(F.col("read"), x)).alias(c)  # noqa: E731  # a blank text is no missing one
    return found.select("doc_id", blank("text", F.lit("")), "status", "error_code", blank("sha256", F.sha2(F.lit(""), 256)), F.array_join("warnings", ",").alias("warnings"))


_FILES = (("", "a.HTML"), ("", "a.pdf"), ("application/pdf", "scan"), ("", "b.docx"), ("text/csv; charset=utf-8", "c"), ("", "d.tsv"), ("application/vnd.ms-excel", ""), ("", "e.rtf"), ("", "old.doc"), ("image/png", ""), ("", "f.JPEG"), ("text/plain", "g"), ("", ""), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ""))


@query(rf"""WITH k(i, kind, name) AS (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_FILES))}),
t AS (SELECT page_id, kind, lower(name) AS name, CASE WHEN page_id % 3 = 0 THEN chr(10) || ' %PDF-1.7 ' || html WHEN page_id % 3 = 1 THEN 'no markup' ELSE html END AS body FROM pages JOIN k ON i = page_id % {len(_FILES)}),
e AS (SELECT *, regexp_extract(name, '\.([a-z]+)$', 1) AS ext, lower(left(body, 2048)) AS head FROM t)
SELECT page_id, CASE WHEN contains(kind, 'html') OR ext IN ('html', 'htm') THEN 'html'
WHEN contains(kind, 'pdf') OR ext = 'pdf' THEN CASE WHEN regexp_matches(head, '^\s*%pdf-') THEN 'pdf' WHEN contains(head, '<html') OR contains(head, '<!doctype html') THEN 'html' ELSE 'invalid_pdf' END
WHEN contains(kind, 'wordprocessingml') OR ext = 'docx' THEN 'docx' WHEN contains(kind, 'csv') OR ext IN ('csv', 'tsv') THEN 'csv'
WHEN contains(kind, 'spreadsheetml') OR contains(kind, 'ms-excel') OR ext IN ('xlsx', 'xls') THEN 'xlsx' WHEN contains(kind, 'rtf') OR ext = 'rtf' THEN 'rtf' WHEN ext = 'doc' THEN 'unsupported_file_type'
WHEN starts_with(kind, 'text/') OR ext IN ('txt', 'md') THEN 'text' WHEN starts_with(kind, 'image/') OR ext IN ('png', 'jpg', 'jpeg', 'tif', 'tiff') THEN 'image' ELSE 'text' END AS method FROM e""")
def format_dispatch(spark, d):
    k = (F.col("page_id") % len(_FILES) + 1).cast("int")
    kind, name = (F.element_at(F.array(*[F.lit(f[i]) for f in _FILES]), k) for i in (0, 1))
    third = F.col("page_id") % 3
    body = F.when(third == 0, F.concat(F.lit("\n %PDF-1.7 "), "html")).when(third == 1, "no markup").otherwise(F.col("html"))
    rows = _t(spark, d, "pages").select("page_id", kind.alias("content_type"), name.alias("name"), F.encode(body, "utf-8").alias("content"))
    return rows.select("page_id", extract.method("content_type", "name", "content").alias("method"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, CASE WHEN length(text) > 5000 THEN left(text, 5000) || '…(truncated)' ELSE text END AS text FROM r WHERE k <= 20 AND role IN ('user', 'assistant', 'model')""")
def history_trim(spark, d):
    return chat.history(_t(spark, d, "conversations"))


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), h AS (SELECT conv_id, string_agg(role || ': ' || n, chr(10) ORDER BY role, n) AS head FROM c GROUP BY conv_id),
b AS (SELECT conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id), j AS (SELECT conv_id, head || chr(10) || body AS c FROM h JOIN b USING (conv_id))
SELECT conv_id, CASE WHEN length(c) > 12000 THEN left(c, 12000) || chr(10) || '...(truncated)' ELSE c END AS context FROM j""")
def context_block(spark, d):
    rows = _t(spark, d, "conversations")
    return chat.context(rows.select("conv_id", F.col("role").alias("case_type")), rows.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("title"), "text"))


@query(r"""WITH i AS (SELECT item_id AS chunk_id, item_id // 3 AS reg_id, CASE WHEN item_id % 7 = 0 THEN '' ELSE regexp_extract(text, '^\S+') END AS title, CASE WHEN item_id % 5 = 0 THEN '' ELSE regexp_extract(text, '^\S+\s+(\S+)', 1) END AS article,
  list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5)) AS l FROM benchmark),
w AS (SELECT DISTINCT conv_id, unnest(string_split_regex(lower(text), '\s+')) AS x FROM conversations WHERE role = 'user'),
g AS (SELECT DISTINCT conv_id, chunk_id, reg_id, title, article FROM w JOIN (SELECT *, unnest(l) AS x FROM i) USING (x)),
m AS (SELECT c.conv_id, c.turn, reg_id, chunk_id, title, article, row_number() OVER (PARTITION BY c.conv_id, c.turn, reg_id ORDER BY chunk_id) AS r FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') c JOIN g USING (conv_id)
  WHERE (title <> '' AND contains(c.text, title)) OR (article <> '' AND contains(c.text, article)))
SELECT conv_id, turn, reg_id, title, nullif(article, '') AS article, chunk_id FROM m WHERE r = 1""")
def answer_references(spark, d):
    """Which references an answer uses: items are chunks, three a regulation, given to conversations that ask with one of their long words."""
    said = _t(spark, d, "conversations")
    items = _t(spark, d, "benchmark").select(
        F.col("item_id").alias("chunk_id"),
        F.floor(F.col("item_id") / 3).alias("reg_id"),
        F.when(F.col("item_id") % 7 == 0, "").otherwise(F.regexp_extract("text", r"^\S+", 0)).alias("title"),
        F.when(F.col("item_id") % 5 == 0, "").otherwise(F.regexp_extract("text", r"^\S+\s+(\S+)", 1)).alias("article"),
        F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 5))).alias("x"),
    )
    asked = said.where("role = 'user'").select("conv_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("x")).distinct()
    given = asked.join(items, "x").drop("x").distinct().withColumn("pos", F.col("chunk_id"))
    return chat.used_references(said.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), given)
