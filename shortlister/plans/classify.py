"""Classifier metrics on logits derived from documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..operators import classify as cl
from ..tables import stash

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_L = """WITH d AS (SELECT doc_id, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id)),
l AS (SELECT doc_id, 'quality' AS category, CAST(quality AS DOUBLE) AS y, (n_chars%97-48)/16.0::DOUBLE AS logit FROM d UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE), (n_chars%89-60)/16.0::DOUBLE FROM d
 UNION ALL SELECT doc_id, 'absent', 0.0, (n_chars%31-30)/16.0::DOUBLE FROM d), p AS (SELECT *, 1/(1+exp(-logit)) AS p FROM l)"""


def _rows(spark, sf_dir):
    d = fx.table(spark, sf_dir, "labels").join(fx.table(spark, sf_dir, "documents"), "doc_id")
    n = F.col("n_chars")
    kinds = (("quality", F.col("quality"), (n % 97 - 48) / 16.0), ("toxic", F.col("toxic"), (n % 89 - 60) / 16.0), ("absent", F.lit(0), (n % 31 - 30) / 16.0))
    cells = F.array(*[F.struct(F.lit(c).alias("category"), y.cast("double").alias("y"), z.cast("double").alias("logit")) for c, y, z in kinds])
    rows = d.select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.*")
    return rows.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))


@query("""WITH f AS (SELECT lang AS category, count(*) AS n FROM documents WHERE lang<>'es' GROUP BY lang), t AS (SELECT DISTINCT lang AS category FROM documents), v AS (SELECT category FROM f UNION SELECT category FROM t UNION SELECT p_brand FROM part),
k AS (SELECT v.category, coalesce(n, 0) AS n, t.category IS NOT NULL AS t FROM v LEFT JOIN f USING (category) LEFT JOIN t USING (category))
SELECT count(*) AS vocab_size, count(*) FILTER (t) AS test_categories, count(*) FILTER (t AND n>0) AS covered, coalesce(string_agg(category, ',' ORDER BY category) FILTER (t AND n=0), '') AS missing, max(n) FILTER (n>0) AS train_max_freq, min(n) FILTER (n>0) AS train_min_nonzero_freq, round(max(n) FILTER (n>0)/min(n) FILTER (n>0), 1) AS imbalance_ratio FROM k""")
def coverage_report(spark, sf_dir):
    """E10, H2, E9."""
    d = fx.table(spark, sf_dir, "documents")
    freq = d.where("lang <> 'es'").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    test = d.select(F.col("lang").alias("category")).distinct()
    vocab = test.union(freq.select("category")).union(fx.table(spark, sf_dir, "part").select("p_brand")).distinct()
    return cl.coverage(freq, test, vocab)


@query(f"{_L} SELECT category, round(CASE WHEN sum(y)>0 THEN (count(*)-sum(y))/sum(y) ELSE 1.0 END, 6) AS weight FROM l GROUP BY category")
def pos_weights(spark, sf_dir):
    """E11."""
    return _rows(spark, sf_dir).groupBy("category").agg(F.round(cl.positive_weight(F.col("y")), 6).alias("weight"))


@query(f"{_L}, b AS (SELECT len(list_filter([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]::DOUBLE[], lambda e: p>e)) AS b, p, y FROM p), g AS (SELECT b, count(*) AS n, abs(avg(p)-avg(y)) AS gap FROM b GROUP BY b) SELECT round(sum(n*gap)/sum(n), 6) AS ece FROM g")
def ece(spark, sf_dir):
    """E12."""
    return cl.calibration_error(_rows(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


_BCE = "avg(-(y*ln(least(greatest(1/(1+exp(-logit/t)), 1e-6), 1-1e-6)) + (1-y)*ln(1-least(greatest(1/(1+exp(-logit/t)), 1e-6), 1-1e-6))))"


@query(f"""{_L}, c AS (SELECT i, 0.5+i*4.5/45 AS t FROM range(46) r(i)), b AS (SELECT t FROM (SELECT i, t, {_BCE} AS loss FROM l, c GROUP BY ALL) ORDER BY round(loss, 12), i LIMIT 1),
f AS (SELECT i, greatest(0.3, t-0.2)+i*((t+0.2)-greatest(0.3, t-0.2))/40 AS t FROM b, range(41) r(i)) SELECT round(t, 6) AS temperature FROM (SELECT i, t, {_BCE} AS loss FROM l, f GROUP BY ALL) ORDER BY round(loss, 12), i LIMIT 1""")
def temperature_fit(spark, sf_dir):
    """E13, B18."""
    return cl.fit_temperature(_rows(spark, sf_dir)).select(F.round("temperature", 6).alias("temperature"))


@query(f"""{_L}, t AS (SELECT category, logit, sum(y) AS tp, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, sum(tp) OVER w/sum(n) OVER w AS pr FROM t WINDOW w AS (PARTITION BY category ORDER BY logit DESC ROWS UNBOUNDED PRECEDING))
SELECT category, round(sum(pr*tp)/sum(tp), 4) AS ap FROM r GROUP BY category HAVING sum(tp)>0""")
def average_precision(spark, sf_dir):
    """E14."""
    rows = _rows(spark, sf_dir).withColumn("score", F.col("logit"))
    return cl.average_precision(rows, "category").select("category", F.round("ap", 4).alias("ap"))


@query(f"""{_L}, c AS (SELECT category, sum(y*CAST(p>=0.5 AS INT)) AS tp, sum((1-y)*CAST(p>=0.5 AS INT)) AS fp, sum(y*CAST(p<0.5 AS INT)) AS fn FROM p GROUP BY category)
SELECT round(CASE WHEN 2*sum(tp)+sum(fp)+sum(fn)>0 THEN 2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)) ELSE 0 END, 4) AS micro_f1, round(sum(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END)/3, 4) AS macro_f1 FROM c""")
def f1_scores(spark, sf_dir):
    """E15."""
    rows = _rows(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("double"))
    return cl.f1(rows, 3).select(F.round("micro_f1", 4).alias("micro_f1"), F.round("macro_f1", 4).alias("macro_f1"))


@query(f"{_L} SELECT doc_id, category, CAST(y AS INTEGER) AS y FROM l")
def multihot(spark, sf_dir):
    """K4: long form, a row for each id and category of the vocabulary."""
    return _rows(spark, sf_dir).select("doc_id", "category", F.col("y").cast("int").alias("y"))


@query(f"""{_L}, s AS (SELECT doc_id, coalesce(list(category) FILTER (p>=0.5), []) AS pk, coalesce(list(category) FILTER (y=1), []) AS gd FROM p GROUP BY doc_id), b AS (SELECT *, len(list_intersect(pk, gd)) AS nb FROM s)
SELECT round(avg(CASE WHEN len(pk)>0 THEN nb/len(pk) END), 4) AS precision, round(avg(nb/greatest(1, len(gd))), 4) AS recall, count(*) FILTER (len(pk)=0) AS empty, round(avg(len(pk)), 4) AS mean_picked FROM b""")
def set_pr(spark, sf_dir):
    """E26."""
    sets = _rows(spark, sf_dir).groupBy("doc_id").agg(F.collect_set(F.when(F.col("p") >= 0.5, F.col("category"))).alias("picked"), F.collect_set(F.when(F.col("y") == 1, F.col("category"))).alias("gold"))
    return cl.set_precision_recall(sets)


@query("""WITH v AS (SELECT DISTINCT lang AS category, lower(lang) AS k FROM documents), g AS (SELECT doc_id, 'EN., "fr", xx, en' || CASE WHEN doc_id%3=0 THEN ', de' ELSE '' END || chr(10) || 'es' AS gen FROM documents),
p AS (SELECT doc_id, generate_subscripts(string_split(split_part(gen, chr(10), 1), ','), 1) AS pos, unnest(string_split(split_part(gen, chr(10), 1), ',')) AS w FROM g),
n AS (SELECT doc_id, pos, lower(trim(w, ' ."''')) AS k FROM p), m AS (SELECT n.*, category FROM n LEFT JOIN v USING (k) WHERE n.k<>''),
f AS (SELECT doc_id, category, min(pos) AS pos FROM m WHERE category IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f)
SELECT doc_id, string_agg(category, ',' ORDER BY n) FILTER (n<=2) AS picked, (SELECT count(*) FROM m WHERE m.doc_id=r.doc_id AND category IS NULL) AS unknown FROM r GROUP BY doc_id""")
def category_choice(spark, sf_dir):
    """A first line of categories read against the vocabulary; two at most, unknown ones counted."""
    d = fx.table(spark, sf_dir, "documents")
    vocab = d.select(F.col("lang").alias("category")).distinct().withColumn("k", F.lower("category"))
    gen = F.concat(F.lit('EN., "fr", xx, en'), F.when(F.col("doc_id") % 3 == 0, ", de").otherwise(""), F.lit("\nes"))
    words = d.select("doc_id", F.posexplode(F.split(F.split_part(gen, F.lit("\n"), F.lit(1)), ",")).alias("pos", "w")).withColumn("k", F.lower(F.regexp_replace("w", """^[ ."']+|[ ."']+$""", ""))).where("k <> ''")
    m = words.join(vocab, "k", "left")
    first = m.groupBy("doc_id", "category").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    picked = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("pos", "category")))), 1, 2), lambda x: x["category"])
    return first.groupBy("doc_id").agg(F.array_join(picked, ",").alias("picked"), F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))


@query()
def category_prior_model(spark, sf_dir):
    """One logistic model for each category over hashed words; a model, so there is no SQL."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = _rows(spark, sf_dir).where("category <> 'absent'").select("doc_id", "category", "y")
    words = fx.table(spark, sf_dir, "documents").select("doc_id", F.split(tx.norm_text(F.coalesce("text", F.lit(""))), " ").alias("words"))
    vectors = HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12, binary=True).transform(words).select("doc_id", "features")
    vectors = stash(vectors)
    weights = {r.category: r.w for r in rows.groupBy("category").agg(cl.positive_weight(F.col("y")).alias("w")).collect()}  # a row for each category
    out = None
    for category in ("quality", "toxic"):
        train = rows.where(F.col("category") == category).join(vectors, "doc_id")
        train = train.withColumn("w", F.when(F.col("y") == 1, float(weights[category])).otherwise(1.0))
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=0.1, maxIter=10).fit(train)
        from pyspark.ml.functions import vector_to_array

        p = model.transform(vectors).select("doc_id", F.lit(category).alias("category"), F.round(vector_to_array("probability")[1], 6).alias("p"))
        out = p if out is None else out.unionByName(p)
    return out
