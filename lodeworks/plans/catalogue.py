"""Catalogue of registered queries: name -> (spark, sf_dir) -> DataFrame, and the equivalent DuckDB SQL.

Each query is one operator or a small composition of them over the given tables. Plans are declarative: pairwise and
for-all conditions are written as equi-joins on elements with counts, so that they shuffle by key instead of looping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import scoring as S
from lodeworks.operators import relational as R
from lodeworks.operators import scorers as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Register the function as query ``name`` with its SQL."""

    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


GRADE_SQL = "CASE WHEN s >= 90 THEN 'A+' WHEN s >= 80 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 50 THEN 'D' ELSE 'F' END"


@query("q01_grade_bands", f"SELECT {GRADE_SQL} AS grade, count(*) AS n FROM (SELECT trunc((c_acctbal + 1000) / 110) AS s FROM customer) GROUP BY 1")
def grade_bands(spark, d):
    score = ((F.col("c_acctbal") + 1000) / 110).cast("int")
    return table(spark, d, "customer").groupBy(S.grade(score).alias("grade")).agg(F.count("*").alias("n"))


@query(
    "q02_decay_score",
    """SELECT l_returnflag, count(*) AS n, round(round(avg(CASE WHEN l_quantity <= 30 THEN 1::DOUBLE
       ELSE greatest(0::DOUBLE, 1::DOUBLE - (l_quantity - 30::DOUBLE) / 120::DOUBLE) END), 9) * 20)::BIGINT AS points FROM lineitem GROUP BY 1""",
)
def decay_score(spark, d):
    credit = S.decay_credit(F.col("l_quantity"), 30)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.round(F.avg(credit), 9) * 20).cast("long").alias("points"))


@query(
    "q03_threshold_issues",
    """SELECT o_orderkey, CASE WHEN o_totalprice / 100000::DOUBLE >= 3 THEN 'error' WHEN o_totalprice / 100000::DOUBLE >= 1.5 THEN 'warning' ELSE 'info' END AS severity,
       'order_value' AS sub_metric FROM orders WHERE o_totalprice > 100000""",
)
def threshold_issues(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice") > 100000).select(
        "o_orderkey", S.issue_severity(F.col("o_totalprice"), F.lit(100000.0)).alias("severity"), F.lit("order_value").alias("sub_metric")
    )


@query(
    "q04_debt_penalty",
    """WITH i AS (SELECT o_orderpriority AS p, CASE WHEN o_totalprice <= 100000 THEN NULL WHEN o_totalprice / 100000::DOUBLE >= 3 THEN 'error'
         WHEN o_totalprice / 100000::DOUBLE >= 1.5 THEN 'warning' ELSE 'info' END AS s FROM orders),
       a AS (SELECT p, count(*) AS n, count_if(s = 'error') AS errors, count_if(s = 'warning') AS warnings, count_if(s = 'info') AS infos FROM i GROUP BY 1)
       SELECT p AS o_orderpriority, n, errors, warnings, infos, CASE WHEN errors + warnings + infos = 0 THEN 0
         WHEN errors > 0 THEN greatest(1, round((errors * 3.0::DOUBLE + warnings + infos * 0.2::DOUBLE) / n * 120)::BIGINT)
         ELSE round((errors * 3.0::DOUBLE + warnings + infos * 0.2::DOUBLE) / n * 120)::BIGINT END AS penalty FROM a""",
)
def debt_penalty(spark, d):
    issue = F.when(F.col("o_totalprice") > 100000, S.issue_severity(F.col("o_totalprice"), F.lit(100000.0)))
    a = table(spark, d, "orders").withColumn("s", issue).groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col("s") == k, F.lit(False))).alias(f"{k}s") for k in ("error", "warning", "info")]
    )
    weight = F.col("errors") * F.lit(3.0) + F.col("warnings") + F.col("infos") * F.lit(0.2)
    return a.withColumn("penalty", S.debt_penalty(weight, F.col("n"), F.col("errors")))


_WEIGHTS = (("AUTOMOBILE", 0.25), ("BUILDING", 0.2), ("FURNITURE", 0.2), ("HOUSEHOLD", 0.2), ("MACHINERY", 0.15))


@query(
    "q05_weighted_overall",
    f"""WITH w(seg, w) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE)" for a, b in _WEIGHTS)}),
       s AS (SELECT c_mktsegment AS seg, round(avg(c_acctbal) / 100, 6) AS s FROM customer GROUP BY 1)
       SELECT CASE WHEN sum(w) = 0 THEN 0 ELSE round(round(sum(s * w) / sum(w), 6))::BIGINT END AS overall, count(*) AS n FROM s JOIN w USING (seg)""",
)
def weighted_overall(spark, d):
    weights = spark.createDataFrame(list(_WEIGHTS), "seg string, w double")
    scores = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.round(F.avg("c_acctbal") / 100, 6).alias("s"))
    mean = F.round(F.round(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum("w")), 6)).cast("long")
    return scores.join(F.broadcast(weights), "seg").agg(F.coalesce(mean, F.lit(0)).alias("overall"), F.count("*").alias("n"))


@query(
    "q06_p90_lower_rank",
    """SELECT l_suppkey, v AS p90 FROM (SELECT l_suppkey, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS k,
       trunc((count(*) OVER (PARTITION BY l_suppkey) - 1) * 0.9::DOUBLE) AS place FROM lineitem) WHERE k = place""",
)
def p90_lower_rank(spark, d):
    return R.lower_rank(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "p90")


@query(
    "q07_median_outliers",
    """WITH c AS (SELECT o_custkey, count(*) AS ce FROM orders GROUP BY 1), m AS (SELECT median(ce) AS m FROM c)
       SELECT o_custkey, ce, m AS median FROM c, m WHERE m >= 1 AND ce > 2 * m""",
)
def median_outliers(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("ce"))
    return R.outliers(counts, "ce", 2.0)


@query(
    "q08_entropy",
    """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n FROM c)
       SELECT user_id, CASE WHEN max(n) <= 1 THEN 0 ELSE round(least(1.0::DOUBLE, sum(-(c / n::DOUBLE) * log2(c / n::DOUBLE)) / log2(max(n)::DOUBLE)), 6) END AS entropy FROM p GROUP BY 1""",
)
def entropy(spark, d):
    return R.entropy(table(spark, d, "events"), ["user_id"], "event_type")


@query(
    "q09_name_collisions",
    """WITH n AS (SELECT p_name, count(DISTINCT p_brand) AS k FROM part GROUP BY 1)
       SELECT count(*) AS names, count_if(k >= 2) AS colliding, round(count_if(k >= 2) / count(*)::DOUBLE, 6) AS rate FROM n""",
)
def name_collisions(spark, d):
    n = table(spark, d, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("k"))
    hit = F.count_if(F.col("k") >= 2)
    return n.agg(F.count("*").alias("names"), hit.alias("colliding"), F.round(hit / F.count("*"), 6).alias("rate"))


@query(
    "q10_documented_ratio",
    """SELECT source, count(DISTINCT d.doc_id) AS docs, count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id END) AS good,
       round(count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id END) / count(DISTINCT d.doc_id)::DOUBLE, 6) AS ratio
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def documented_ratio(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    good = F.count_distinct(F.when(F.col("quality") == 1, F.col("doc_id")))
    return j.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), good.alias("good"), F.round(good / F.count_distinct("doc_id"), 6).alias("ratio"))


_BRANDS = "SELECT DISTINCT l_suppkey AS k, p_brand || '/' || p_size AS e FROM lineitem JOIN part ON l_partkey = p_partkey"


def brand_sets(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("e"))
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("k"), "e").distinct()


@query(
    "q11_jaccard_pairs",
    f"""WITH s AS ({_BRANDS}), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
       p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.k < b.k GROUP BY 1, 2)
       SELECT a, b, c AS shared, round(c / (x.n + y.n - c)::DOUBLE, 6) AS jaccard, round(least(x.n, y.n) / greatest(x.n, y.n)::DOUBLE, 6) AS size_similarity
       FROM p JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 4 * c >= x.n + y.n - c""",
)
def jaccard_pairs(spark, d):
    return R.jaccard_pairs(brand_sets(spark, d), "k", "e", 0.25)


@query(
    "q12_division_all",
    "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
)
def division_all(spark, d):
    o = table(spark, d, "orders")
    return R.divide(o.select("o_custkey", "o_orderpriority"), o.select("o_orderpriority"), ["o_custkey"], "o_orderpriority")


@query(
    "q13_division_pairs",
    f"""WITH s AS ({_BRANDS}), t AS (SELECT DISTINCT p_partkey AS t, p_brand || '/' || p_size AS e FROM part),
       n AS (SELECT t, count(*) AS n FROM t GROUP BY 1)
       SELECT s.k, t.t FROM s JOIN t USING (e) JOIN n ON n.t = t.t GROUP BY s.k, t.t, n.n HAVING count(*) = n.n""",
)
def division_pairs(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("t"), F.concat_ws("/", "p_brand", "p_size").alias("e")).distinct()
    return R.covers(brand_sets(spark, d), wanted, "k", "t", "e")


@query(
    "q14_new_issues_anti",
    """WITH m AS (SELECT user_id, event_type, floor(value)::BIGINT AS level, ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS late FROM events)
       SELECT DISTINCT user_id, event_type, level FROM m a WHERE late AND NOT EXISTS
       (SELECT 1 FROM m b WHERE NOT b.late AND a.user_id = b.user_id AND a.event_type = b.event_type AND a.level = b.level)""",
)
def new_issues_anti(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.floor("value").alias("level"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    lo, hi = e.agg(F.min("t"), F.max("t")).first()  # two numbers
    late = F.col("t") >= lo + (hi - lo) / 2
    return R.new_rows(e.where(late), e.where(~late), ["user_id", "event_type", "level"])


@query("q15_membership_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def membership_semi(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


@query("q16_left_default", "SELECT d.doc_id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def left_default(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query(
    "q17_peer_missing",
    f"""WITH s AS ({_BRANDS}), n AS (SELECT count(DISTINCT k) AS n FROM s), peer AS (SELECT e FROM s GROUP BY 1 HAVING count(*) > (SELECT n // 2 FROM n))
       SELECT k.k, peer.e AS missing FROM (SELECT DISTINCT k FROM s) k, peer WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = k.k AND s.e = peer.e)""",
)
def peer_missing(spark, d):
    return R.missing_peers(brand_sets(spark, d), "k", "e")


@query(
    "q18_suffix_reuse",
    """WITH c AS (SELECT p_brand, regexp_extract(p_name, '[^ ]*$') AS suffix, count(*) AS c FROM part GROUP BY 1, 2)
       SELECT p_brand, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)::DOUBLE, 6) AS reuse FROM c GROUP BY 1""",
)
def suffix_reuse(spark, d):
    return R.reuse_ratio(table(spark, d, "part").withColumn("suffix", F.regexp_extract("p_name", "[^ ]*$", 0)), ["p_brand"], "suffix")


@query(
    "q19_group_max_ratio",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, n / max(n) OVER (PARTITION BY c_nationkey)::DOUBLE AS r,
       count(*) OVER (PARTITION BY c_nationkey) AS g FROM c) SELECT c_nationkey, round(avg(r), 6) AS mean_ratio, count(*) AS groups FROM r WHERE g >= 2 GROUP BY 1""",
)
def group_max_ratio(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_nationkey")
    c = c.withColumn("r", F.col("n") / F.max("n").over(w)).withColumn("g", F.count("*").over(w)).where("g >= 2")
    return c.groupBy("c_nationkey").agg(F.round(F.avg("r"), 6).alias("mean_ratio"), F.count("*").alias("groups"))


@query(
    "q20_two_level_avg",
    """SELECT l_returnflag, round(avg(r), 6) AS mean_ratio FROM (SELECT l_returnflag, l_suppkey, count_if(l_quantity >= 25) / count(*)::DOUBLE AS r
       FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def two_level_avg(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg((F.count_if(F.col("l_quantity") >= 25) / F.count("*")).alias("r"))
    return one.groupBy("l_returnflag").agg(F.round(F.avg("r"), 6).alias("mean_ratio"))


@query(
    "q21_consistency",
    """WITH g AS (SELECT user_id, count(*) AS n, avg(CASE WHEN value >= 20 THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS b
       FROM events GROUP BY 1 HAVING count(*) >= 2)
       SELECT count(*) AS groups, count_if((a >= 0.8 OR a <= 0.2) AND (b >= 0.8 OR b <= 0.2)) AS consistent FROM g""",
)
def consistency(spark, d):
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), flag(F.col("value") >= 20).alias("a"), flag(F.col("event_type") == "error").alias("b")).where("n >= 2")
    same = lambda c: (F.col(c) >= 0.8) | (F.col(c) <= 0.2)
    return g.agg(F.count("*").alias("groups"), F.count_if(same("a") & same("b")).alias("consistent"))


@query(
    "q22_vote_fusion",
    """WITH v AS (SELECT source, CASE WHEN lang = 'en' THEN 'core' ELSE 'adapter' END AS role, 0.7::DOUBLE AS conf FROM documents
       UNION ALL SELECT source, CASE WHEN n_chars > 2000 THEN 'adapter' ELSE 'ports' END, 0.8::DOUBLE FROM documents
       UNION ALL SELECT source, CASE WHEN quality = 1 THEN 'core' ELSE 'ports' END, 0.6::DOUBLE FROM documents JOIN labels USING (doc_id)),
       g AS (SELECT source, role, count(*) AS n, max(conf) AS c FROM v GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, c DESC, CASE role WHEN 'adapter' THEN 1 WHEN 'ports' THEN 3 ELSE 4 END) AS k FROM g)
       SELECT source, role, n AS votes, least(0.95::DOUBLE, CASE WHEN n >= 2 THEN c + 0.10::DOUBLE ELSE c END) AS confidence FROM r WHERE k = 1""",
)
def vote_fusion(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    vote = lambda df, role, c: df.select("source", role.alias("role"), F.lit(c).alias("conf"))
    votes = vote(docs, F.when(F.col("lang") == "en", "core").otherwise("adapter"), 0.7).union(
        vote(docs, F.when(F.col("n_chars") > 2000, "adapter").otherwise("ports"), 0.8)
    ).union(vote(docs.join(labels, "doc_id"), F.when(F.col("quality") == 1, "core").otherwise("ports"), 0.6))
    return R.fuse_votes(votes, ["source"])


@query(
    "q23_camel_words",
    """WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS name FROM part),
       w AS (SELECT p_partkey, name, regexp_extract_all(name, '[A-Z][a-z]*|[0-9]+') AS ws FROM n)
       SELECT p_partkey, name, array_to_string(ws, '|') AS words, CASE WHEN len(ws) BETWEEN 2 AND 4 THEN 1.0::DOUBLE WHEN len(ws) = 1 THEN 0.5::DOUBLE
       WHEN len(ws) = 5 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score, len(ws) >= 2 AS verb_noun FROM w""",
)
def camel_words(spark, d):
    name = F.array_join(F.transform(F.split("p_name", " "), S.title_case), "")
    p = table(spark, d, "part").select("p_partkey", name.alias("name"))
    words = S.camel_words(F.col("name"))
    return p.select("p_partkey", "name", F.array_join(words, "|").alias("words"), S.word_count_score(words).alias("score"), S.verb_noun(F.col("name")).alias("verb_noun"))


@query(
    "q24_case_convert",
    """WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), '') AS pascal FROM part)
       SELECT p_partkey, pascal, lower(pascal[1:1] || regexp_replace(pascal[2:], '([A-Z])', '_\\1', 'g')) AS snake FROM n""",
)
def case_convert(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), S.pascal_case), "").alias("pascal"))
    return p.select("p_partkey", "pascal", S.snake_case(F.col("pascal")).alias("snake"))


_LAYERS = (("en", "domain"), ("de", "application"), ("fr", "adapters"), ("es", "adapters"))


@query(
    "q25_path_layers",
    f"""WITH l(seg, layer) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _LAYERS)}),
       s AS (SELECT page_id, string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')[2] AS seg FROM pages)
       SELECT coalesce(layer, 'unknown') AS layer, count(*) AS n FROM s LEFT JOIN l USING (seg) GROUP BY 1""",
)
def path_layers(spark, d):
    layers = F.broadcast(spark.createDataFrame(list(_LAYERS), "seg string, layer string"))  # four rows
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    s = table(spark, d, "pages").select(F.get(F.split(path, "/"), 1).alias("seg"))
    return s.join(layers, "seg", "left").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"))


@query(
    "q26_layout_ratio",
    """WITH s AS (SELECT DISTINCT string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')[2] AS seg FROM pages WHERE contains(url, '://'))
       SELECT count(*) AS segments, count_if(seg IN ('en', 'fr')) AS layers, CASE WHEN count_if(seg IN ('en', 'fr')) / count(*)::DOUBLE >= 0.5 THEN 'cross-cutting' ELSE 'per-feature' END AS layout FROM s""",
)
def layout_ratio(spark, d):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    s = table(spark, d, "pages").where(F.col("url").contains("://")).select(F.get(F.split(path, "/"), 1).alias("seg")).distinct()
    hit = F.count_if(F.coalesce(F.col("seg").isin("en", "fr"), F.lit(False)))
    return s.agg(F.count("*").alias("segments"), hit.alias("layers"), F.when(hit / F.count("*") >= 0.5, "cross-cutting").otherwise("per-feature").alias("layout"))


@query(
    "q27_idiom_sets",
    """WITH s AS (SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY 1)
       SELECT roles, roles IN ('assistant,user', 'assistant,system,user') AS idiomatic, count(*) AS n FROM s GROUP BY 1, 2""",
)
def idiom_sets(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return s.groupBy("roles", F.col("roles").isin("assistant,user", "assistant,system,user").alias("idiomatic")).agg(F.count("*").alias("n"))


@query(
    "q28_ngram_clones",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), g AS (SELECT doc_id, i, array_to_string(ws[i:i + 9], ' ') AS g FROM
       (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM w WHERE len(ws) >= 10)),
       h AS (SELECT g FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
       p AS (SELECT DISTINCT doc_id, i FROM g JOIN h USING (g)), c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM p)
       SELECT doc_id, sum(least(10, coalesce(i - prev, 10)))::BIGINT AS duplicated FROM c GROUP BY 1""",
)
def ngram_clones(spark, d):
    return R.cloned_words(table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("ws")), [], "doc_id", "ws", 10)


@query(
    "q29_interval_cover",
    """WITH e AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY s) AS prev FROM e)
       SELECT user_id, sum(least(3600, coalesce(s - prev, 3600)))::BIGINT AS covered FROM l GROUP BY 1""",
)
def interval_cover(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).distinct()
    return R.covered_length(e, ["user_id"], "s", 3600, "covered")


@query(
    "q30_history_delta",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
       SELECT month, n, n - lag(n) OVER (ORDER BY month) AS delta FROM m""",
)
def history_delta(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return m.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("month")))  # one row a month


@query(
    "q31_first_argmax",
    """SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""",
)
def first_argmax(spark, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", F.round("b.o_totalprice", 2).alias("price"))


@query(
    "q32_topk_multikey",
    "SELECT s_suppkey, s_acctbal > 5000 AS rich, s_nationkey FROM supplier ORDER BY rich DESC, s_nationkey DESC, s_suppkey LIMIT 15",
)
def topk_multikey(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") > 5000).alias("rich"), "s_nationkey")
    return s.orderBy(F.desc("rich"), F.desc("s_nationkey"), "s_suppkey").limit(15)


_FLOW = """SELECT s_nationkey AS a, c_nationkey AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2"""
_EDGES = f"SELECT f.a AS src, f.b AS dst FROM ({_FLOW}) f LEFT JOIN ({_FLOW}) g ON f.a = g.b AND f.b = g.a WHERE f.q > coalesce(g.q, 0)"


def trade_edges(spark, d, *keys: str) -> DataFrame:
    """Edges from each nation to those it sells more to than it buys from, for each value of keys; all line items count."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o, c, s = table(spark, d, "orders").select("o_orderkey", "o_custkey", *keys), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey).where("s_nationkey <> c_nationkey")
    x, y = F.least("s_nationkey", "c_nationkey").alias("x"), F.greatest("s_nationkey", "c_nationkey").alias("y")
    net = j.groupBy(*keys, x, y).agg(F.sum(F.when(F.col("s_nationkey") < F.col("c_nationkey"), F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("q")).where("q <> 0")
    return net.select(*keys, F.when(F.col("q") > 0, F.col("x")).otherwise(F.col("y")).alias("src"), F.when(F.col("q") > 0, F.col("y")).otherwise(F.col("x")).alias("dst"))


_DEGREES = f"""WITH e AS ({_EDGES}), o AS (SELECT src AS node, count(*) AS ce FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS ca FROM e GROUP BY 1),
  g AS (SELECT coalesce(o.node, i.node) AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM o FULL JOIN i ON o.node = i.node)"""


@query("q33_graph_degrees", f"{_DEGREES} SELECT node, ca, ce FROM g")
def graph_degrees(spark, d):
    return R.degrees(trade_edges(spark, d))


@query(
    "q34_main_sequence",
    f"""{_DEGREES}, t AS (SELECT n_nationkey AS node, n_regionkey + 1 AS ifaces, n_nationkey % 7 AS structs FROM nation)
       SELECT node, round(ce / (ca + ce)::DOUBLE, 6) AS instability, round(ifaces / (ifaces + structs)::DOUBLE, 6) AS abstractness,
       round(abs(ifaces / (ifaces + structs)::DOUBLE + ce / (ca + ce)::DOUBLE - 1), 6) AS distance FROM g JOIN t USING (node)""",
)
def main_sequence(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") + 1).alias("ifaces"), (F.col("n_nationkey") % 7).alias("structs"))
    i, a = S.instability(F.col("ca"), F.col("ce")), S.abstractness(F.col("ifaces"), F.col("structs"))
    return R.degrees(trade_edges(spark, d)).join(t, "node").select(
        "node", F.round(i, 6).alias("instability"), F.round(a, 6).alias("abstractness"), F.round(S.main_sequence_distance(a, i), 6).alias("distance")
    )


@query(
    "q35_cycle_members",
    f"""WITH RECURSIVE t AS ({_EDGES}),
       r AS (SELECT src, dst FROM t UNION SELECT r.src, t.dst FROM r JOIN t ON r.dst = t.src) SELECT DISTINCT src AS node FROM r WHERE src = dst""",
)
def cycle_members(spark, d):
    return R.cycle_members(trade_edges(spark, d))


@query(
    "q36_edge_violations",
    f"""WITH e AS ({_EDGES}), n AS (SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 'core' WHEN 1 THEN 'ports' WHEN 2 THEN 'orchestrator' ELSE 'adapter' END AS role FROM nation)
       SELECT src, dst, a.role AS src_role, b.role AS dst_role FROM e JOIN n a ON src = a.k JOIN n b ON dst = b.k
       WHERE (a.role IN ('core', 'ports') AND b.role IN ('adapter', 'orchestrator')) OR (a.role = 'orchestrator' AND b.role = 'adapter') OR (a.role = 'adapter' AND b.role = 'adapter')""",
)
def edge_violations(spark, d):
    k = F.col("n_regionkey")
    role = F.when(k == 0, "core").when(k == 1, "ports").when(k == 2, "orchestrator").otherwise("adapter")
    roles = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), role.alias("role"))
    return R.edge_violations(trade_edges(spark, d), roles)


@query(
    "q37_missing_template",
    """SELECT c_custkey, o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders)
       EXCEPT SELECT o_custkey, o_orderpriority FROM orders""",
)
def missing_template(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    # every customer should have every priority: the template is exploded from one row, the few values of a priority
    wanted = o.agg(F.collect_set("o_orderpriority").alias("all"))
    template = table(spark, d, "customer").select("c_custkey").join(F.broadcast(wanted)).select("c_custkey", F.explode("all").alias("o_orderpriority"))
    return template.join(o, ["c_custkey", "o_orderpriority"], "left_anti")


@query(
    "q38_golden_score",
    """WITH p AS (SELECT l_suppkey AS k, count(*) AS n, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_discount = 0) AS has_free FROM lineitem GROUP BY 1),
       s AS (SELECT k, round(0.6::DOUBLE * n / max(n) OVER () + 0.2::DOUBLE * has_r::INT + 0.2::DOUBLE * has_free::INT, 6) AS score FROM p)
       SELECT k AS l_suppkey, score FROM s""",
)
def golden_score(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_discount") == 0).alias("f"))
    top = p.agg(F.max("n").alias("top"))
    score = F.lit(0.6) * F.col("n") / F.col("top") + F.lit(0.2) * F.col("r").cast("int") + F.lit(0.2) * F.col("f").cast("int")
    return p.join(F.broadcast(top)).select("l_suppkey", F.round(score, 6).alias("score"))


@query(
    "q39_rescore_skipped",
    """WITH m AS (SELECT l_returnflag AS cat, l_linestatus AS sub, count(*) AS points, count_if(l_quantity >= 25) AS score FROM lineitem GROUP BY 1, 2)
       SELECT cat, round(100 * sum(score) / sum(points)::DOUBLE, 6) AS rescored FROM m WHERE NOT (cat = 'A' AND sub = 'O') GROUP BY 1""",
)
def rescore_skipped(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cat"), F.col("l_linestatus").alias("sub")).agg(F.count("*").alias("points"), F.count_if(F.col("l_quantity") >= 25).alias("score"))
    return R.rescored(m, spark.createDataFrame([("A", "O")], "cat string, sub string"))


@query(
    "q40_literal_flags",
    """SELECT doc_id, contains(text, '%%') AS has_percent, regexp_matches(text, '[#*$&]') AS has_mark, text LIKE '%| %' AS has_bar FROM documents""",
)
def literal_flags(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.contains("%%").alias("has_percent"), t.rlike("[#*$&]").alias("has_mark"), t.contains("| ").alias("has_bar"))


@query(
    "q41_token_classes",
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS words, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers,
       len(regexp_extract_all(text, '[.,;:!?]'))::BIGINT AS marks FROM documents""",
)
def token_classes(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n("[A-Za-z]+").alias("words"), n("[0-9]+").alias("numbers"), n("[.,;:!?]").alias("marks"))


@query("q42_content_hash", "SELECT item_id, sha256(text) AS sha, least(strlen(text), 16384)::BIGINT AS size FROM benchmark")
def content_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.sha2(t.cast("binary"), 256).alias("sha"), F.least(F.octet_length(t), F.lit(16384)).cast("long").alias("size"))


@query(
    "q43_norms",
    """SELECT lang, v AS p90 FROM (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k,
       trunc((count(*) OVER (PARTITION BY lang) - 1) * 0.9::DOUBLE) AS place FROM documents) WHERE k = place""",
)
def norms(spark, d):
    return R.lower_rank(table(spark, d, "documents"), ["lang"], "n_chars", "p90")


@query(
    "q44_file_naming",
    """SELECT source, count_if(n_chars >= 1000) AS suffixed, count_if(n_chars < 1000) AS bare, CASE WHEN count_if(n_chars >= 1000) > count_if(n_chars < 1000) THEN 'suffixed' ELSE 'bare' END AS naming,
       round(greatest(count_if(n_chars >= 1000), count_if(n_chars < 1000)) / count(*)::DOUBLE, 6) AS ratio FROM documents GROUP BY 1""",
)
def file_naming(spark, d):
    a, b = F.count_if(F.col("n_chars") >= 1000), F.count_if(F.col("n_chars") < 1000)
    return table(spark, d, "documents").groupBy("source").agg(
        a.alias("suffixed"), b.alias("bare"), F.when(a > b, "suffixed").otherwise("bare").alias("naming"), F.round(F.greatest(a, b) / F.count("*"), 6).alias("ratio")
    )


def order_files(spark, d: str) -> DataFrame:
    """Orders as source files (a repository a priority), their line items as functions: the scorers' facts from tables."""
    fn = F.struct(
        F.when(F.col("l_returnflag") == "R", "Return").otherwise(F.concat(F.lit("Ship"), F.initcap("l_linestatus"), F.lit("ine"))).alias("name"), F.lit("").alias("receiver"), (F.col("l_linenumber") % 2 == 0).alias("exported"), F.lit(1).alias("line_start"),
        (F.col("l_quantity") * 4).cast("int").alias("line_end"), F.expr("transform(sequence(1, l_linenumber), i -> struct(concat('p', i) AS name, 'string' AS type))").alias("params"),
        F.array(F.lit("error")).alias("returns"), F.lit(3).alias("max_nesting"), F.lit(2).alias("max_cond_ops"), (F.col("l_linenumber") * 12).cast("int").alias("cognitive_complexity"),
        F.lit(0.0).alias("string_literal_ratio"), F.lit(0).alias("max_case_arms"), F.lit(0.0).alias("avg_case_lines"),
    )
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(fn).alias("functions"))  # an order has a few line items
    o, no = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")), lambda t: F.array().cast(f"array<{t}>")
    path = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "_test.go").otherwise(".go"))
    return o.select(
        F.col("o_orderpriority").alias("repo_id"), path.alias("path"), F.lower("o_orderstatus").alias("package"), (F.col("o_totalprice") > 200000).alias("package_doc"), (F.col("o_totalprice") > 499500).cast("int").alias("init_functions"),
        (F.size("functions") * 100).alias("total_lines"), (F.col("o_orderkey") % 7 == 0).alias("is_generated"), F.lit(False).alias("has_cgo"), no("string").alias("structs"), no("string").alias("interfaces"),
        no("struct<name:string,methods:array<string>>").alias("interface_defs"), no("string").alias("imports"), F.when(F.col("o_totalprice") > 499000, F.array(F.lit("Total"), F.lit("ErrTotal"), F.lit("part"))).otherwise(no("string")).alias("global_vars"),
        no("struct<has_wrap:boolean,has_context:boolean>").alias("error_calls"), no("struct<safe:boolean>").alias("type_assertions"), "functions",
    )


_FN_SQL = """SELECT o_orderpriority AS repo_id, o_orderkey, o_orderkey % 5 = 0 AS test, trunc(l_quantity * 4) AS lines, l_linenumber * 12 AS cc, l_linenumber AS params
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> 0"""


def _credit_sql(v: str, t: str) -> str:
    return f"CASE WHEN {v} <= {t} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ({v} - {t})::DOUBLE / (4.0::DOUBLE * {t})) END"


@query(
    "q45_code_health",
    f"""WITH f AS ({_FN_SQL}), s AS (SELECT repo_id, round(avg({_credit_sql('lines', 'CASE WHEN test THEN 100 ELSE 50 END')}) * 20) AS function_size,
       round(avg({_credit_sql('cc', 'CASE WHEN test THEN 30 ELSE 25 END')}) * 20) AS cognitive_complexity, round(avg({_credit_sql('params', 'CASE WHEN test THEN 6 ELSE 4 END')}) * 20) AS parameter_count FROM f GROUP BY 1),
       z AS (SELECT repo_id, round(avg({_credit_sql('n', 'CASE WHEN test THEN 600 ELSE 300 END')}) * 20) AS file_size FROM (SELECT repo_id, o_orderkey, test, count(*) * 100 AS n FROM f GROUP BY 1, 2, 3) GROUP BY 1)
       SELECT repo_id, 'code_health' AS category, name, score::BIGINT AS score, 20::BIGINT AS points FROM (SELECT * FROM s JOIN z USING (repo_id)) UNPIVOT (score FOR name IN (function_size, file_size, cognitive_complexity, parameter_count))""",
)
def code_health(spark, d):
    return C.code_health(order_files(spark, d))


@query(
    "q46_issue_counts",
    f"""WITH f AS ({_FN_SQL}), i AS (
         SELECT repo_id, 'function_size' AS sub_metric, lines AS v, CASE WHEN test THEN 100 ELSE 50 END AS t FROM f UNION ALL SELECT repo_id, 'cognitive_complexity', cc, CASE WHEN test THEN 30 ELSE 25 END FROM f
         UNION ALL SELECT repo_id, 'parameter_count', params, CASE WHEN test THEN 6 ELSE 4 END FROM f
         UNION ALL SELECT repo_id, 'file_size', count(*) * 100, any_value(CASE WHEN test THEN 600 ELSE 300 END) FROM f GROUP BY repo_id, o_orderkey)
       SELECT repo_id, sub_metric, CASE WHEN v >= 3 * t THEN 'error' WHEN v >= 1.5 * t THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM i WHERE v > t GROUP BY ALL""",
)
def issue_counts(spark, d):
    return C.issues(order_files(spark, d)).where("category = 'code_health'").groupBy("repo_id", "sub_metric", "severity").agg(F.count("*").alias("n"))


@query(
    "q47_explicit_dependencies",
    """SELECT o_orderpriority AS repo_id, CASE WHEN count_if(o_orderkey % 5 <> 0) = 0 THEN 0 ELSE greatest(0, 25 - 3 * (count_if(o_orderkey % 5 <> 0 AND o_totalprice > 499000)
       + count_if(o_orderkey % 5 <> 0 AND o_totalprice > 499500))) END::BIGINT AS score FROM orders
       WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""",
)
def explicit_dependencies(spark, d):
    """Explicit dependencies: orders of a high price have package state."""
    return C.predictability(order_files(spark, d)).where("name = 'explicit_dependencies'").select("repo_id", "score")


@query(
    "q48_self_describing_names",
    """SELECT o_orderpriority AS repo_id, floor(count_if(l_returnflag <> 'R')::DOUBLE / count(*) * 25)::BIGINT AS score
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 0 GROUP BY 1""",
)
def self_describing_names(spark, d):
    return C.predictability(order_files(spark, d)).where("name = 'self_describing_names'").select("repo_id", "score")
