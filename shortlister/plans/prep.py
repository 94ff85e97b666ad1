"""Catalogue text, raw instances, pools, samples, training rows, segments and batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import calls as fc
from ..functions import text as tx
from ..operators import prep as op
from ..tables import once

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: FX5: tools from parts.
_FX5 = """WITH t AS (SELECT p_partkey, p_brand || '__' || p_type || '__' || p_name AS id, CASE WHEN p_partkey%13=0 THEN 'test ' ELSE '' END || p_name AS name,
CASE WHEN p_partkey%11=0 THEN '' ELSE p_name || ' ' || p_type END AS d0, p_type, p_brand AS category, ['size','retail'] AS params FROM part),
m AS (SELECT *, CASE WHEN d0='' THEN p_type ELSE d0 END AS description, d0='' AS desc_fallback FROM t)"""


def _tools(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    empty = F.col("p_partkey") % 11 == 0
    name = F.concat(F.when(F.col("p_partkey") % 13 == 0, "test ").otherwise(""), F.col("p_name"))
    desc = F.when(empty, F.col("p_type")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return p.select("p_partkey", tx.make_id(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("id"), name.alias("name"), desc.alias("description"), empty.alias("desc_fallback"), F.col("p_brand").alias("category"), F.array(F.lit("size"), F.lit("retail")).alias("params"))


@query(f"{_FX5} SELECT p_partkey, name || '. ' || description || '. Parameters: size, retail' AS text, desc_fallback FROM m")
def desc_text(spark, sf_dir):
    """B3-B5."""
    return _tools(spark, sf_dir).select("p_partkey", tx.description_text(F.col("name"), F.col("description"), F.col("params")).alias("text"), "desc_fallback")


@query(f"{_FX5} SELECT p_partkey, regexp_replace(id, '[^A-Za-z0-9_-]', '_', 'g') AS sanitized FROM m")
def sanitize_names(spark, sf_dir):
    """B7."""
    return _tools(spark, sf_dir).select("p_partkey", fc.sanitize(F.col("id")).alias("sanitized"))


@query("SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS norm, trim(regexp_replace(lower(url), '\\s+', ' ', 'g')) AS norm_text, 'query: ' || url AS embed_query, 'passage: ' || url AS embed_passage FROM pages")
def norm_names(spark, sf_dir):
    """B1, B6, B10."""
    u = F.col("url")
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.norm_name(u).alias("norm"), tx.norm_text(u).alias("norm_text"), F.concat(F.lit("query: "), u).alias("embed_query"), F.concat(F.lit("passage: "), u).alias("embed_passage"))


@query(f"{_FX5} SELECT p_partkey, split_part(id, '__', 1) || '__' || split_part(id, '__', 2) AS service, split_part(id, '__', 2) AS tool_segment, CAST(('0x' || substr(md5(id || '::' || name), 1, 8)) AS BIGINT) AS seed FROM m")
def service_keys(spark, sf_dir):
    """B2, B8, B26."""
    seed = F.conv(F.substring(F.md5(F.concat_ws("::", "id", "name")), 1, 8), 16, 10).cast("long")
    return _tools(spark, sf_dir).select("p_partkey", tx.service_key(F.col("id")).alias("service"), tx.tool_segment(F.col("id")).alias("tool_segment"), seed.alias("seed"))


_JUNK_RE2 = tx.JUNK_NAME.replace("'", "''")


@query(f"""{_FX5}, f AS (SELECT p_partkey, regexp_matches(split_part(id, '__', 2) || ' ' || name, '{_JUNK_RE2}') AS j1, regexp_matches(replace(split_part(id, '__', 2), ' ', ''), '^[0-9a-f]{{20,}}$') AS j2,
regexp_matches(trim(description), '^[a-zA-Z]{{3,8}}$') AND NOT regexp_matches(trim(description), '(?i)[aeiou].*[aeiou]') AS j3, desc_fallback AS m1, length(trim(description))<12 AS m2 FROM m)
SELECT p_partkey, j1 OR j2 OR j3 AS clearly_junk, NOT (j1 OR j2 OR j3) AND (m1 OR m2) AS missing_meta, concat_ws(',', CASE WHEN j1 THEN 'name_pattern' END, CASE WHEN j2 THEN 'hex_tool' END, CASE WHEN j3 THEN 'gibberish_desc' END, CASE WHEN m1 THEN 'desc_fallback' END, CASE WHEN m2 THEN 'short_desc' END) AS reasons FROM f""")
def junk_flags(spark, sf_dir):
    """B11, I22."""
    junk, missing, reasons = tx.junk_reasons(F.col("id"), F.col("name"), F.col("description"), F.col("desc_fallback"))
    return _tools(spark, sf_dir).select("p_partkey", junk.alias("clearly_junk"), missing.alias("missing_meta"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""{_FX5} SELECT p_partkey, regexp_replace(id, '[^A-Za-z0-9_-]', '_', 'g') AS name, description, 'limit:integer,price:number,q:string' AS properties, 'q' AS required FROM m""")
def openai_schema(spark, sf_dir):
    """Parameters of a tool by the fixed aliases of types; nameless ones are skipped."""
    params = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required")) for n, t, r in (("q", "weird", True), ("limit", "INT", False), ("price", "double", False), ("", "string", True))])
    t = _tools(spark, sf_dir).withColumn("p", F.filter(params, lambda x: x["name"] != ""))
    props = F.array_join(F.array_sort(F.transform("p", lambda x: F.concat(x["name"], F.lit(":"), fc.json_type(x["type"])))), ",")
    need = F.array_join(F.transform(F.filter("p", lambda x: x["required"]), lambda x: x["name"]), ",")
    return t.select("p_partkey", fc.sanitize(F.col("id")).alias("name"), "description", props.alias("properties"), need.alias("required"))


#: FX6: raw instances from orders and their lines.
_FX6 = """WITH ln AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos, p_brand AS category, p_type AS tool, p_name AS api, l_returnflag, l_linenumber FROM lineitem JOIN part ON l_partkey=p_partkey),
api AS (SELECT query_id, pos, category, tool, api, category || '__' || tool || '__' || api AS id FROM ln),
rel AS (SELECT query_id, pos, CASE WHEN l_linenumber%2=0 THEN upper(tool) ELSE tool END AS tool, CASE WHEN l_linenumber=7 THEN 'bogus' ELSE api END AS api FROM ln WHERE l_returnflag='R'),
ex AS (SELECT query_id, tool, api, arg_max(id, pos) AS exact FROM api GROUP BY ALL),
lo AS (SELECT query_id, regexp_replace(lower(tool), '[^a-z0-9]', '', 'g') AS nt, regexp_replace(lower(api), '[^a-z0-9]', '', 'g') AS na, arg_max(id, pos) AS loose FROM api GROUP BY ALL),
rr AS (SELECT rel.*, coalesce(exact, loose) AS id FROM rel LEFT JOIN ex USING (query_id, tool, api) LEFT JOIN lo ON lo.query_id=rel.query_id AND nt=regexp_replace(lower(rel.tool), '[^a-z0-9]', '', 'g') AND na=regexp_replace(lower(rel.api), '[^a-z0-9]', '', 'g')),
g0 AS (SELECT query_id, id, min(pos) AS p FROM rr GROUP BY ALL), gg AS (SELECT query_id, bool_and(id IS NOT NULL) AS ok, list(id ORDER BY p) FILTER (id IS NOT NULL) AS gold FROM g0 GROUP BY query_id),
inst AS (SELECT o_orderkey AS query_id, ['I1','I2','I3'][CAST(o_orderkey%3 AS INTEGER)+1] AS split, CASE WHEN o_orderpriority<>'1-URGENT' THEN o_orderpriority END AS query, gg.query_id IS NOT NULL AS has_rel, CASE WHEN ok THEN gold ELSE [] END AS gold FROM orders LEFT JOIN gg ON gg.query_id=o_orderkey),
dr AS (SELECT *, CASE WHEN query IS NULL THEN 'no_query_or_id' WHEN NOT has_rel THEN 'no_relevant_apis' WHEN len(gold)=0 THEN 'gold_unresolved' END AS reason FROM inst)"""


def _made_instances(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("category"), F.col("p_type").alias("tool"), F.col("p_name").alias("api"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = fx.table(spark, sf_dir, "lineitem").join(p, "l_partkey").withColumn("pos", F.row_number().over(order)).withColumnRenamed("l_orderkey", "query_id")
    apis = lines.select("query_id", "pos", "category", "tool", "api")
    rel = lines.where("l_returnflag = 'R'").select("query_id", "pos", F.when(F.col("l_linenumber") % 2 == 0, F.upper("tool")).otherwise(F.col("tool")).alias("tool"), F.when(F.col("l_linenumber") == 7, "bogus").otherwise(F.col("api")).alias("api"))
    gold = op.resolve_gold(apis, rel)
    o = fx.table(spark, sf_dir, "orders")
    split = F.element_at(F.array(*map(F.lit, fx.SPLITS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    inst = o.select(F.col("o_orderkey").alias("query_id"), split.alias("split"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("query"))
    has = rel.select("query_id", F.array(F.lit(1)).alias("rel")).distinct()
    inst = inst.join(gold, "query_id", "left").join(has, "query_id", "left")
    return apis, inst.withColumn("reason", op.drop_reason(F.col("query"), F.col("query_id"), F.col("rel"), F.col("gold")))


def _instances(spark, sf_dir):
    """Apis and instances, each written once."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")]
    return tuple(once(spark, name, inputs, lambda i=i: _made_instances(spark, sf_dir)[i]) for i, name in enumerate(("apis", "instances")))


def _kept(spark, sf_dir):
    return _instances(spark, sf_dir)[1].where("reason IS NULL").select("split", "query_id", "gold")


@query(f"{_FX6} SELECT split, query_id, array_to_string(gold, ',') AS gold_tools FROM dr WHERE reason IS NULL")
def gold_resolution(spark, sf_dir):
    """D-1, F8."""
    return _kept(spark, sf_dir).select("split", "query_id", F.array_join("gold", ",").alias("gold_tools"))


@query(f"{_FX6} SELECT split, coalesce(reason, 'kept') AS reason, count(*) AS n FROM dr GROUP BY ALL")
def drop_reasons(spark, sf_dir):
    """B12."""
    return _instances(spark, sf_dir)[1].groupBy("split", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_META = "me AS (SELECT id, category, query_id*100+pos AS seq FROM api), up AS (SELECT id, arg_max(category, seq) AS category, min(seq) AS first_pos, max(seq) AS last_pos FROM me GROUP BY id)"


def _made_meta(spark, sf_dir):
    apis, _ = _instances(spark, sf_dir)
    rows = apis.select(tx.make_id(F.col("category"), F.col("tool"), F.col("api")).alias("id"), "category", (F.col("query_id") * 100 + F.col("pos")).alias("seq"))
    return op.upsert(rows, "id", "seq")


def _meta(spark, sf_dir):
    return once(spark, "meta", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")], lambda: _made_meta(spark, sf_dir))


@query(f"{_FX6}, {_META} SELECT id, category, first_pos, last_pos FROM up")
def meta_upsert(spark, sf_dir):
    """D-2."""
    return _meta(spark, sf_dir).select("id", "category", "first_pos", F.col("seq").alias("last_pos"))


_SAMPLE = "sm AS (SELECT * FROM (SELECT split, query_id, gold, row_number() OVER (PARTITION BY split ORDER BY md5('42::' || query_id), query_id) AS n FROM dr WHERE reason IS NULL AND (split='I1' OR len(gold)>=2)) WHERE n<=20)"


@query(f"{_FX6}, {_SAMPLE} SELECT split, query_id FROM sm")
def split_sample(spark, sf_dir):
    """G1, B13."""
    return op.sample_split(_kept(spark, sf_dir), 20).select("split", "query_id")


_FILL = """pg AS (SELECT DISTINCT unnest(gold) AS id FROM sm), tot AS (SELECT count(*) AS total, greatest(200-count(*), 0) AS target FROM pg),
qu AS (SELECT category, CAST(least(round_even(target*count(*)/total, 0), greatest(1.0, ceil(target*0.2))) AS INTEGER) AS quota FROM pg JOIN up USING (id), tot GROUP BY category, target, total),
fr AS (SELECT id, up.category, quota, row_number() OVER (PARTITION BY up.category ORDER BY md5('42::' || id)) AS r FROM up LEFT JOIN qu USING (category) WHERE id NOT IN (SELECT id FROM pg)),
al AS (SELECT id, 0 AS phase, '' AS sort FROM pg UNION ALL SELECT id, CASE WHEN r<=coalesce(quota, 0) THEN 1 ELSE 2 END, CASE WHEN r<=coalesce(quota, 0) THEN category || chr(1) || lpad(CAST(r AS VARCHAR), 10, '0') ELSE md5('43::' || id) END FROM fr),
pl AS (SELECT *, row_number() OVER (ORDER BY phase, sort, id)-1 AS place FROM al)"""


def _pool(spark, sf_dir, size=200):
    gold = op.sample_split(_kept(spark, sf_dir), 20).select(F.explode("gold").alias("id")).distinct()
    return op.fill(_meta(spark, sf_dir).select("id", "category"), gold, size), gold


@query(f"{_FX6}, {_META}, {_SAMPLE}, {_FILL} SELECT id, CAST(phase AS INTEGER) AS phase, CAST(place AS INTEGER) AS place FROM pl WHERE phase=0 OR place<200")
def pool_build(spark, sf_dir):
    """G5, G6, H1, H3."""
    return _pool(spark, sf_dir)[0]


@query(f"{_FX6}, {_META}, {_SAMPLE}, {_FILL} SELECT category, count(*) AS n, count(*) FILTER (phase=0) AS gold FROM pl JOIN up USING (id) WHERE phase=0 OR place<200 GROUP BY category")
def distractor_quota(spark, sf_dir):
    """What the pool took of each category."""
    pool, _ = _pool(spark, sf_dir)
    return pool.join(_meta(spark, sf_dir).select("id", "category"), "id").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("phase") == 0).alias("gold"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42::' || doc_id), doc_id)<=greatest(1, round_even(count(*) OVER ()*0.2, 0)) THEN 'val' ELSE 'train' END AS part FROM labels")
def train_val_split(spark, sf_dir):
    """G7."""
    return op.train_val(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.2)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id%5=0)")
def train_antijoin_id(spark, sf_dir):
    """D-11, D-20: training rows that are no test rows."""
    test = fx.table(spark, sf_dir, "labels").where("doc_id % 5 = 0").select("doc_id")
    return fx.table(spark, sf_dir, "documents").join(test, "doc_id", "left_anti").select("doc_id", "lang")


_NT = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(f"""WITH r AS (SELECT 'doc::' || doc_id AS query_id, text, lang AS category FROM documents UNION ALL SELECT 'bench::' || item_id, '  ' || replace(text, ' ', '  '), 'en' FROM benchmark UNION ALL SELECT 'nocat::' || item_id, text, NULL FROM benchmark),
s AS (SELECT query_id, CASE WHEN category IS NULL THEN 'no_category' WHEN {_NT.format('text')} IN (SELECT {_NT.format('text')} FROM benchmark) THEN 'duplicate' ELSE 'kept' END AS outcome FROM r) SELECT outcome, count(*) AS n FROM s GROUP BY outcome""")
def train_antijoin_text(spark, sf_dir):
    """A6, B9, D-12: external rows without category, or with a benchmark text under normalisation, go."""
    d, b = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "benchmark")
    rows = d.select(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("query_id"), "text", F.col("lang").alias("category"))
    rows = rows.union(b.select(F.concat(F.lit("bench::"), F.col("item_id").cast("string")), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  "))), F.lit("en"))).union(b.select(F.concat(F.lit("nocat::"), F.col("item_id").cast("string")), "text", F.lit(None).cast("string")))
    keys = b.select(tx.norm_text(F.col("text")).alias("k")).distinct()
    known = rows.withColumn("k", tx.norm_text(F.col("text"))).join(keys.withColumn("dup", F.lit(True)), "k", "left")
    outcome = F.when(F.col("category").isNull(), "no_category").when(F.col("dup"), "duplicate").otherwise("kept")
    return known.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT 'augex_' || p_partkey || '_' || j AS query_id, p_brand AS category FROM part, range(0, 2) t(j)), r AS (SELECT a.* FROM a, range(0, 4)) SELECT category, count(*) AS n, count(DISTINCT query_id) AS unique_rows FROM r GROUP BY category""")
def train_augmented(spark, sf_dir):
    """D-13, G8, H6, C9: examples of tools as rows of their category, four times."""
    examples = _tools(spark, sf_dir).select("p_partkey", "category", F.posexplode(F.array("name", "description")).alias("j", "query"))
    rows = examples.select(F.concat_ws("_", F.lit("augex"), F.col("p_partkey").cast("string"), F.col("j").cast("string")).alias("query_id"), "category", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("copy"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("unique_rows"))


_SEG = """WITH t AS (SELECT conv_id, turn, trim(text) AS x FROM conversations),
m AS (SELECT conv_id, turn, x, regexp_replace(regexp_replace(x, '([。！？])\\s*', '\\1' || chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g') AS y FROM t),
p AS (SELECT conv_id, turn, x, list_filter(list_transform(string_split(y, chr(1)), lambda s: regexp_replace(s, '^[ ,;、，]+|[ ,;、，]+$', '', 'g')), lambda s: s<>'') AS ps FROM m),
e AS (SELECT conv_id, turn, generate_subscripts(ps, 1) AS pos, unnest(ps) AS s FROM p)"""


def _turns(spark, sf_dir):
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query(f"{_SEG} SELECT conv_id, turn, CAST(pos-1 AS INTEGER) AS pos, s AS segment FROM e")
def segment_queries(spark, sf_dir):
    """C6."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(tx.segments(F.col("text"))).alias("pos", "segment"))


@query(f"""{_SEG}, g AS (SELECT *, sum(CASE WHEN pos=1 OR length(s)>=12 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS grp FROM e)
SELECT conv_id, turn, CAST(grp-1 AS INTEGER) AS pos, string_agg(s, ' ' ORDER BY pos) AS segment FROM g GROUP BY conv_id, turn, grp UNION ALL SELECT conv_id, turn, 0, x FROM p WHERE len(ps)=0""")
def segment_merge(spark, sf_dir):
    """C7."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(tx.merged_segments(F.col("text"))).alias("pos", "segment"))


@query("""WITH RECURSIVE i AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS o, len(string_split(trim(text), ' ')) AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT lang, o, 0 AS batch, 1 AS n, CAST(t AS BIGINT) AS sum FROM i WHERE o=1 UNION ALL
 SELECT i.lang, i.o, CASE WHEN n>=8 OR sum+t>2000 THEN batch+1 ELSE batch END, CASE WHEN n>=8 OR sum+t>2000 THEN 1 ELSE n+1 END, CASE WHEN n>=8 OR sum+t>2000 THEN t ELSE sum+t END FROM r JOIN i ON i.lang=r.lang AND i.o=r.o+1)
SELECT lang, batch, count(*) AS n, CAST(max(sum) AS BIGINT) AS tokens FROM r GROUP BY ALL""")
def token_batches(spark, sf_dir):
    """by language, 8 items or 2,000 tokens."""
    d = fx.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", "doc_id", F.size(F.split(F.trim("text"), " ")).alias("t"))
    b = op.token_batches(d, "lang", "doc_id", "t", 8, 2000).join(d, ["lang", "doc_id"])
    return b.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"))
