"""Training data for retrieval: merged sources, quality samples, triplets with hard negatives, and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sijill.functions import text as T
from sijill.functions import vectors as V
from sijill.session import settled


def merge(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of the sources; of rows with one key the first of the first source stays. Rows need ``pos``, their order there."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_source", "pos")
    valid = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    return rows.where(valid).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_source")


def merge_stats(sources: list[DataFrame], key: str = "id") -> DataFrame:
    rows = None
    for s in sources:
        rows = s.select(key) if rows is None else rows.unionByName(s.select(key))
    valid = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    return rows.agg(F.count_distinct(F.when(valid, F.col(key))).alias("kept"), (F.count_if(valid) - F.count_distinct(F.when(valid, F.col(key)))).alias("duplicates"), F.count_if(~valid).alias("invalid"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash of the key: the same in every run and on every partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def chunk_by_article(citations: DataFrame, chunks: DataFrame, first: DataFrame) -> DataFrame:
    """The chunk of a citation: the first whose reference contains the article's number, else the regulation's first chunk.

    ``citations``: id, reg_id, article_number; ``chunks``: reg_id, chunk_id, chunk_index, article_ref, content; ``first``: reg_id, content. The first is that of the least index, of
    equal ones that of the least chunk_id; a null or zero number and a null reference match nothing.
    """
    number = F.col("article_number")
    wanted = citations.where(number.isNotNull() & (number != 0)).select("reg_id", "article_number").distinct()  # an article is looked up once, however many cite it
    hit = wanted.join(chunks.where("article_ref is not null"), "reg_id").where(F.contains(F.lower("article_ref"), F.lower(number.cast("string"))))
    hit = hit.groupBy("reg_id", "article_number").agg(F.min_by("content", F.struct("chunk_index", "chunk_id")).alias("by_article"))
    return citations.alias("c").join(hit.alias("h"), (F.col("c.reg_id") == F.col("h.reg_id")) & (F.col("c.article_number") == F.col("h.article_number")), "left").select("c.*", "by_article").join(first.withColumnRenamed("content", "by_default"), "reg_id", "left").select("id", "reg_id", "article_number", F.coalesce("by_article", "by_default").alias("positive"))


def latest_first_chunk(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("reg_id").orderBy(F.desc("version_number"), "chunk_index", "chunk_id")
    return chunks.join(versions, "version_id").withColumn("r", F.row_number().over(w)).where("r = 1").select("reg_id", "content")


def hard_negatives(scores: DataFrame, positives: DataFrame, chunks: DataFrame, k: int = 10, keep: int = 3, least: int = 20) -> DataFrame:
    """Per case, not per citation: the best ``k`` chunks outside its regulations, then the first ``keep`` long enough ones.

    ``scores`` (id, chunk_id, score) may be all pairs or each case's best ``k`` outside its regulations (``blocks.scored``).
    """
    rows = scores.join(chunks.select("chunk_id", "reg_id", "content"), "chunk_id").join(positives.select("id", "reg_id").distinct(), ["id", "reg_id"], "left_anti")
    top = V.top_k(rows, ["id"], [F.desc("score"), F.col("chunk_id")], k, "_k").where(F.length("content") >= least)
    return V.top_k(top, ["id"], [F.col("_k")], keep).drop("_k")


#: Chunks that a case draws its random negatives from, on average.
DRAWN = 64


def hash_number(*parts) -> Column:
    """A number from a seeded hash of the parts, the same on every partitioning: the first eight digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[x if isinstance(x, Column) else F.lit(x) for x in parts])), 1, 8), 16, 10).cast("long")


def drawn(cases: DataFrame, positives: DataFrame, chunks: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """(id, chunk_id, reg_id, content, rank): ``n`` chunks by a seeded hash for each case (id, category), outside its regulations.

    They are of the case's category if that has any such, else of any category. Each category (and all together) is cut into shares
    of about DRAWN chunks by a hash. A case meets one share only; where that has fewer than ``n`` left for it, it meets all.
    A null category draws from all, chunks without a category are never drawn; ties go by chunk_id.
    """
    own = positives.select("id", "reg_id").distinct()
    every = chunks.withColumn("pool", F.col("category").cast("string")).where("pool is not null and pool <> ''").select("chunk_id", "reg_id", "content", "pool")
    size = every.groupBy("pool", "reg_id").agg(F.count("*").alias("n"))
    total = size.groupBy("pool").agg(F.sum("n").alias("n"))
    who = cases.select("id", F.col("category").cast("string").alias("pool"))
    taken = who.join(own, "id").join(size, ["pool", "reg_id"]).groupBy("id").agg(F.sum("n").alias("taken"))
    left = F.coalesce("n", F.lit(0)) - F.coalesce("taken", F.lit(0))
    who = who.join(total, "pool", "left").join(taken, "id", "left").select("id", F.when(left > 0, F.col("pool")).otherwise("*").alias("pool"))
    shares = total.unionByName(total.agg(F.sum("n").alias("n")).select(F.lit("*").alias("pool"), "n")).select("pool", F.ceil(F.col("n") / DRAWN).alias("shares"))
    who = who.join(F.broadcast(shares), "pool").withColumn("share", hash_number(str(seed), "case", F.col("id").cast("string")) % F.col("shares"))
    rows = every.unionByName(every.withColumn("pool", F.lit("*"))).join(F.broadcast(shares), "pool")
    rows = rows.select("pool", "chunk_id", "reg_id", "content", (hash_number(str(seed), "share", F.col("chunk_id").cast("string")) % F.col("shares")).alias("share"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("chunk_id").cast("string")))

    def met(few: DataFrame, on: list[str]) -> DataFrame:
        found = few.join(rows, on).join(own, ["id", "reg_id"], "left_anti")
        return V.top_k(found.select("id", "chunk_id", "reg_id", "content"), ["id"], [order, F.col("chunk_id")], n)

    first = met(who.select("id", "pool", "share"), ["pool", "share"]).persist()  # n rows a case
    full = first.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") >= n)
    rest = who.where("shares > 1").join(full, "id", "left_anti").select("id", "pool")
    if rest.isEmpty():
        return first
    return first.join(rest.select("id"), "id", "left_anti").unionByName(met(rest, ["pool"]))


def random_negatives(cases: DataFrame, positives: DataFrame, chunks: DataFrame, n: int = 2, least: int = 20, seed: int = 42) -> DataFrame:
    """Those of ``drawn`` that have ``least`` characters or more."""
    return drawn(cases, positives, chunks, n, seed).where(F.length("content") >= least)


def triplets(cases: DataFrame, citations: DataFrame, chunks: DataFrame, scores: DataFrame, first: DataFrame, query: int = 30, least: int = 20, seed: int = 42, positives: DataFrame | None = None) -> DataFrame:
    """(id, reg_id, article_number, query, positive, negative, origin, split): every positive of a case with every negative.

    ``cases``: id, text, category; ``citations``: id, reg_id (null: not resolved, left out), article_number; ``chunks``: chunk_id,
    reg_id, chunk_index, article_ref, category, content; ``scores``: id, chunk_id, score; ``first``: reg_id, content. Texts under 50
    characters, queries under ``query`` and positives under ``least`` drop out. Negatives are hard ones, then random ones; a case
    without any gets its first random one, however short. ``positives`` (id, reg_id, article_number, positive) stands in for the chunks
    of the citations, if they are known.
    """
    q = cases.where(F.length("text") >= 50).select("id", "category", T.facts_section("text").alias("query")).where(F.length("query") >= query)
    cited = citations.where("reg_id is not null").join(q.select("id"), "id").select("id", "reg_id", "article_number")
    positives = (chunk_by_article(cited.distinct(), chunks, first) if positives is None else positives).where(F.length("positive") >= least)
    own = cited.select("id", "reg_id").distinct().persist()
    who = q.select("id", "category").join(own.select("id").distinct(), "id").persist()
    hard = hard_negatives(scores.join(who.select("id"), "id"), own, chunks).select("id", F.col("content").alias("negative"), F.lit("hard").alias("origin"), F.lit(None).cast("long").alias("rank"))
    some = drawn(who, own, chunks, 2, seed).select("id", F.col("content").alias("negative"), F.lit("random").alias("origin"), "rank")
    whole = Window.partitionBy("id")
    found = hard.unionByName(some).withColumn("long", (F.col("origin") == "hard") | (F.length("negative") >= least)).withColumn("any", F.bool_or("long").over(whole))
    found = found.where("long or (not any and rank = 1)").select("id", "negative", F.when(F.col("long"), F.col("origin")).otherwise("any").alias("origin"))
    rows = q.select("id", "query").join(positives, "id").join(found, "id")
    return rows.withColumn("split", V.hash_split("id"))


def counted_triplets(cases: DataFrame, citations: DataFrame, chunks: DataFrame, scores: DataFrame, first: DataFrame, query: int = 30, least: int = 20, seed: int = 42) -> tuple[DataFrame, dict]:
    """``triplets``, stored, and eight counters that are observed while the positives and the triplets are stored, without a pass of their own.

    skipped_no_text counts cases under 50 characters, and those with a resolved citation whose query is too short;
    total_positives_found and skipped_no_positive count resolved citations (repeated ones too) of the other cases, by whether a
    positive was found that is long enough, negatives or not.
    """
    cited = citations.where("reg_id is not null").select("id", "reg_id", "article_number")
    found = chunk_by_article(cited.distinct(), chunks, first)
    given = citations.groupBy("id").agg(F.count("*").alias("n"), F.count("reg_id").alias("resolved"))
    per = cited.groupBy("id", "reg_id", "article_number").agg(F.count("*").alias("times")).alias("c").join(found.alias("f"), (F.col("c.id") == F.col("f.id")) & (F.col("c.reg_id") == F.col("f.reg_id")) & F.col("c.article_number").eqNullSafe(F.col("f.article_number")))
    per = per.groupBy("c.id").agg(F.collect_list(F.struct("c.reg_id", "c.article_number", "times", "positive")).alias("cited"))  # a case's own citations
    rows = cases.select("id", F.coalesce(F.length("text") >= 50, F.lit(False)).alias("long"), (F.length(T.facts_section("text")) >= query).alias("asks")).join(given, "id", "left").join(per, "id", "left")
    usable, good = F.col("long") & (F.col("resolved") > 0) & F.col("asks"), lambda x: F.coalesce(F.length(x["positive"]) >= least, F.lit(False))
    times = lambda keep: F.sum(F.when(usable, F.aggregate(F.filter("cited", keep), F.lit(0).cast("long"), lambda a, x: a + x["times"])).otherwise(0))
    seen, made_ = Observation(), Observation()
    rows = rows.observe(
        seen,
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("long") & (F.col("n") > 0)).alias("cases_with_citations"),
        F.count_if(F.col("long") & (F.col("resolved") > 0)).alias("cases_with_resolved_citations"),
        times(good).alias("total_positives_found"),
        times(lambda x: ~good(x)).alias("skipped_no_positive"),
        F.count_if(~F.col("long") | (F.col("resolved") > 0) & ~F.col("asks")).alias("skipped_no_text"),
    )
    positives = settled(rows).select("id", F.explode("cited").alias("c")).select("id", "c.reg_id", "c.article_number", "c.positive")
    made = triplets(cases, citations, chunks, scores, first, query, least, seed, positives)
    made = settled(made.observe(made_, F.count_if(F.col("split") == "train").alias("total_triplets_train"), F.count_if(F.col("split") == "val").alias("total_triplets_val")))
    return made, {k: v or 0 for k, v in (seen.get | made_.get).items()}


def chunk_indexes(chunks: DataFrame) -> DataFrame:
    """The pools that negatives are drawn from: (category, n_chunks, n_regulations), null and empty categories left out."""
    return chunks.where("category is not null and category <> ''").groupBy("category").agg(F.count("*").alias("n_chunks"), F.count_distinct("reg_id").alias("n_regulations"))


def top1_accuracy(scores: DataFrame) -> DataFrame:
    """(evaluated, accuracy): how often a query's best item is a relevant one. ``scores``: query_id, item_id, score, relevant; ties go by item_id."""
    best = V.top_k(scores, ["query_id"], [F.desc("score"), F.col("item_id")], 1, "_r")
    return best.agg(F.count("*").alias("evaluated"), F.round(F.avg(F.col("relevant").cast("double")), 4).alias("accuracy"))


def pool(cases: DataFrame, laws: DataFrame, most: int = 2000) -> DataFrame:
    """(text, case_pos, pos): the distinct laws (case_pos, pos, text) of the first ``most`` cases (case_pos), each where it is seen first.

    The order of the pool is that of case_pos and pos. Cases without a law count too; texts are compared as they are; null ones drop out.
    """
    first = cases.select("case_pos").where("case_pos is not null").distinct().orderBy("case_pos").limit(most)
    seen = laws.where("text is not null").join(first, "case_pos").groupBy("text").agg(F.min(F.struct("case_pos", "pos")).alias("x"))
    return seen.select("text", "x.case_pos", "x.pos")


# ------------------------------------------------------------------ retrieval measures


def evaluation_set(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, relevant): queries by their first 200 characters; every (query, text) pair is a text of its own."""
    keyed = rows.select(F.left("query", F.lit(200)).alias("query_key"), "query", "positive", "negative")
    pairs = keyed.select("query_key", F.explode(F.array(F.struct(F.col("positive").alias("text"), F.lit(1).alias("rel")), F.struct(F.col("negative").alias("text"), F.lit(0).alias("rel")))).alias("e")).where("e.text is not null").groupBy("query_key", "e.text").agg(F.max("e.rel").alias("rel"))
    corpus = pairs.withColumn("corpus_id", F.sha2(F.concat_ws("\x1f", "query_key", "text"), 256))
    return keyed.groupBy("query_key").agg(F.min("query").alias("query")), corpus.select("corpus_id", "text"), corpus.where("rel = 1").select("query_key", "corpus_id")


def ir_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """accuracy, precision and recall at 1, 3, 5 and 10, MRR and nDCG at 10, MAP at 100, over all queries.

    ``ranked``: query_id, item_id, rank; ``relevant``: query_id, item_id; ``queries``: query_id.
    """
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(relevant, ["query_id", "item_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gain = 1 / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5, 10)], F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg"), F.sum(F.when(F.col("rank") <= 100, F.col("nth") / F.col("rank"))).alias("ap"))
    rows = queries.join(total, "query_id", "left").join(per, "query_id", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_rel"), F.lit(10)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    some = F.greatest(F.col("n_rel"), F.lit(1))
    out = []
    for k in (1, 3, 5, 10):
        h = F.col(f"h{k}")
        out += [F.avg(F.when(h > 0, 1.0).otherwise(0.0)).alias(f"accuracy_{k}"), F.avg(h / k).alias(f"precision_{k}"), F.avg(h / some).alias(f"recall_{k}")]
    out += [F.avg(F.when(F.col("first").between(1, 10), 1 / F.col("first")).otherwise(0.0)).alias("mrr_10"), F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_10"), F.avg(F.coalesce("ap", F.lit(0.0)) / F.least(some, F.lit(100))).alias("map_100")]
    means = rows.agg(*out)
    return means.select(*[F.round(c, 4).alias(c) for c in means.columns])


def hit_rate(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    any_ = ranked.join(relevant.withColumn("hit", F.lit(True)), ["query_id", "item_id"], "left").where(F.col("rank") <= k).groupBy("query_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    return any_.agg(F.count("*").alias("evaluated"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))


def improvement(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """(metric, baseline, tuned, change) of two tables (metric, value)."""
    return baseline.select("metric", F.col("value").alias("baseline")).join(tuned.select("metric", F.col("value").alias("tuned")), "metric").withColumn("change", F.round(F.col("tuned") - F.col("baseline"), 4))


def best_checkpoint(rows: DataFrame, metric: str = "cosine_accuracy_10") -> DataFrame:
    return rows.agg(F.max_by("checkpoint", F.struct(F.col(metric), F.col("checkpoint"))).alias("checkpoint"), F.max(metric).alias(metric))
