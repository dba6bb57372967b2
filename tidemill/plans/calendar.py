"""Releases and their sources: numbers, names, merging, duplicates, quality, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import consolidation
from tidemill.plans.registry import CLAIMS, RELEASES, query, rounded
from tidemill.sources import tables

# Ordered rules, the first that is found wins.
CONCEPT_RULES = [
    ("anodised", r"anodized|plated"),
    ("metal", r"\bsteel\b|\bbrass\b|copper|nickel|\btin\b"),
    ("large", r"^large|^economy"),
    ("small", r"^small|^medium"),
]


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice::DECIMAL(18,2)::DECIMAL(18,1)::VARCHAR || 'K' WHEN 1 THEN '$' || printf('%d', o_totalprice::DECIMAL(18,2)::DECIMAL(18,0)::BIGINT)
  WHEN 2 THEN '<' || (o_totalprice::DECIMAL(18,2) * 0.001)::DECIMAL(18,2)::VARCHAR || '%' WHEN 3 THEN 'n/a' WHEN 4 THEN printf('%d', o_totalprice::DECIMAL(18,2)::DECIMAL(18,0)::BIGINT // 1000) || ',' || lpad((o_totalprice::DECIMAL(18,2)::DECIMAL(18,0)::BIGINT % 1000)::VARCHAR, 3, '0')
  ELSE '-' || o_totalprice::DECIMAL(18,2)::DECIMAL(18,1)::VARCHAR || 'm' END AS txt FROM orders),
p AS (SELECT o_orderkey, regexp_extract(replace(txt, '$', ''), '^\\s*[<>~]?\\s*(-?[0-9][0-9,]*\\.?[0-9]*)\\s*([KMBTkmbt]?)\\s*%?\\s*$', 1) AS num,
  upper(regexp_extract(replace(txt, '$', ''), '^\\s*[<>~]?\\s*(-?[0-9][0-9,]*\\.?[0-9]*)\\s*([KMBTkmbt]?)\\s*%?\\s*$', 2)) AS u FROM t)
SELECT o_orderkey, round((nullif(replace(num, ',', ''), '')::DECIMAL(18,2) * (CASE u WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'B' THEN 1000000000 WHEN 'T' THEN 1000000000000 ELSE 1 END)::DECIMAL(14,0))::DOUBLE, 4) AS value FROM p""")
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures written in six ways and read again."""
    o = tables.table(spark, sf_dir, "orders")
    whole, kind = F.col("o_totalprice").cast("decimal(20,0)").cast("long"), F.col("o_orderkey") % 6
    txt = (
        F.when(kind == 0, F.concat(F.format_string("%.1f", "o_totalprice"), F.lit("K")))
        .when(kind == 1, F.concat(F.lit("$"), whole.cast("string")))
        .when(kind == 2, F.concat(F.lit("<"), F.format_string("%.2f", F.col("o_totalprice") / 1000), F.lit("%")))
        .when(kind == 3, "n/a")
        .when(kind == 4, F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("-"), F.format_string("%.1f", "o_totalprice"), F.lit("m")))
    )
    return rounded(o.select("o_orderkey", text.parse_numeric(txt).alias("value")), 4, "value")


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'anodized|plated') THEN 'anodised' WHEN regexp_matches(lower(p_type), '\\bsteel\\b|\\bbrass\\b|copper|nickel|\\btin\\b') THEN 'metal' "
       "WHEN regexp_matches(lower(p_type), '^large|^economy') THEN 'large' WHEN regexp_matches(lower(p_type), '^small|^medium') THEN 'small' ELSE 'other' END AS concept FROM part")  # fmt: skip
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.classify(F.col("p_type"), CONCEPT_RULES, "other").alias("concept"))


@query("""SELECT o_orderkey, 'release:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS provisional,
  CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1) WHEN 1 THEN make_date(year(o_orderdate), month(o_orderdate), 1)
  ELSE make_date(year(o_orderdate), 1, 1) END AS period_start FROM orders""")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, at = tables.table(spark, sf_dir, "orders"), F.col("o_orderdate")
    year, kind = F.year(at).cast("string"), F.col("o_orderkey") % 3
    label = F.when(kind == 0, F.concat(year, F.lit("-Q"), F.quarter(at).cast("string"))).when(kind == 1, F.date_format(at, "yyyy-MM")).otherwise(year)
    return o.select("o_orderkey", text.provisional_key(at).alias("provisional"), text.period_start(label).alias("period_start"))


_FOLD = f"""WITH RECURSIVE {CLAIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY seq, source) AS k FROM claims),
f AS (SELECT identity, k, value, source AS owner, rank, 0 AS rev, 0 AS dis, 'single' AS cs FROM n WHERE k = 1 UNION ALL
 SELECT n.identity, n.k,
  CASE WHEN f.value <> n.value AND (n.source = f.owner OR n.rank < f.rank) THEN n.value ELSE f.value END,
  CASE WHEN f.value <> n.value AND (n.source = f.owner OR n.rank < f.rank) THEN n.source ELSE f.owner END,
  CASE WHEN f.value <> n.value AND (n.source = f.owner OR n.rank < f.rank) THEN n.rank ELSE f.rank END,
  f.rev + (f.value <> n.value AND n.source = f.owner)::INT, f.dis + (f.value <> n.value AND n.source <> f.owner)::INT,
  CASE WHEN f.value <> n.value AND n.source <> f.owner THEN 'disagree' WHEN f.value = n.value AND n.source <> f.owner AND f.cs <> 'disagree' THEN 'agree' ELSE f.cs END
 FROM f JOIN n ON n.identity = f.identity AND n.k = f.k + 1)
SELECT identity, k AS n_claims, value::DOUBLE AS value, owner, rev AS revisions, dis AS disagreements, cs AS cross_source FROM f QUALIFY row_number() OVER (PARTITION BY identity ORDER BY k DESC) = 1"""


@query(_FOLD.replace("k AS n_claims", "k::INT AS n_claims"))
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = consolidation.merge_claims(tables.claims(spark, sf_dir))
    return merged.select("identity", "n_claims", F.col("value").cast("double").alias("value"), "owner", "revisions", "disagreements", "cross_source")


@query(f"WITH {CLAIMS} SELECT identity, first(value ORDER BY rank, -seq)::DOUBLE AS value, first(source ORDER BY rank, -seq) AS owner FROM claims GROUP BY identity")
def best_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.best_claims(tables.claims(spark, sf_dir)).select("identity", F.col("value").cast("double").alias("value"), "owner")


@query(f"""WITH {CLAIMS}, l AS (SELECT *, lag(value) OVER (PARTITION BY identity, source ORDER BY seq) AS old FROM claims)
SELECT identity, source, seq, old::DOUBLE AS old_value, value::DOUBLE AS new_value FROM l WHERE old <> value""")
def value_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consolidation.value_revisions(tables.claims(spark, sf_dir))
    return found.select("identity", "source", "seq", F.col("old_value").cast("double").alias("old_value"), F.col("new_value").cast("double").alias("new_value"))


@query(f"WITH {CLAIMS} SELECT identity, count(DISTINCT source) AS sources, count(DISTINCT value) AS \"values\", min(value)::DOUBLE AS lowest, max(value)::DOUBLE AS highest FROM claims GROUP BY identity")
def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consolidation.cross_source(tables.claims(spark, sf_dir)).drop("field"), 6, "lowest", "highest")


@query("""WITH n AS (SELECT p_brand, p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9/ ]+', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM part)
SELECT p_brand, normal, count(*) AS n, min(p_partkey) AS survivor FROM n WHERE normal <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.exact_duplicates(tables.table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query("""WITH t AS (SELECT p_brand, p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9/ ]+', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'the', 'of', 'a', 'an', 'and', 'for'))) AS t FROM part),
j AS (SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS s FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT p_brand, a, b, round(i / (s - i), 6) AS score FROM j WHERE i / (s - i) >= 0.6""")
def duplicates_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_type", "p_name"))
    return rounded(consolidation.similar_names(part, "p_brand", "name", "p_partkey"), 6, "score")


@query("""WITH m AS (SELECT user_id, ts, coalesce(date_diff('second', lag(ts) OVER w, ts) > 1800, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS chain FROM m)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY user_id, chain HAVING count(*) > 1""".replace(
    "date_diff('second', lag(ts) OVER w, ts) > 1800", "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 > 1800"))
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.gap_groups(tables.table(spark, sf_dir, "events"), ["user_id"], "ts", 1800)


CHECKS = {
    "missing forecast": ("warning", "forecast IS NULL"),
    "missing previous": ("warning", "previous IS NULL"),
    "absurd value": ("error", "abs(CAST(actual AS DOUBLE)) > 1e17"),
    "zero value": ("error", "actual = 0"),
    "forecast off by half": ("info", "abs(CAST(actual AS DOUBLE) - forecast) > 0.5 * abs(CAST(actual AS DOUBLE))"),
    "weekend release": ("info", "weekday(ts) >= 5"),
}


@query(f"""WITH {RELEASES}, c AS (SELECT 'missing forecast' AS name, 'warning' AS severity, count_if(forecast IS NULL)::BIGINT AS count FROM releases
UNION ALL SELECT 'missing previous', 'warning', count_if(previous IS NULL)::BIGINT FROM releases UNION ALL SELECT 'absurd value', 'error', count_if(abs(actual::DOUBLE) > 1e17)::BIGINT FROM releases
UNION ALL SELECT 'zero value', 'error', count_if(actual = 0)::BIGINT FROM releases
UNION ALL SELECT 'forecast off by half', 'info', count_if(abs(actual::DOUBLE - forecast) > 0.5 * abs(actual::DOUBLE))::BIGINT FROM releases
UNION ALL SELECT 'weekend release', 'info', count_if(isodow(ts) >= 6)::BIGINT FROM releases) SELECT * FROM c WHERE count > 0""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.quality_checks(tables.releases(spark, sf_dir), CHECKS)


@query("""SELECT 'status' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY ALL""")
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of several fields in one scan."""
    o = tables.table(spark, sf_dir, "orders")
    parts = F.array(
        F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("year").alias("field"), F.year("o_orderdate").cast("string").alias("value")),
    )
    return o.select(F.explode(parts).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS source, count(*) AS rows_seen, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts
FROM orders GROUP BY ALL""")
def source_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(
        F.count("*").alias("rows_seen"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"),
        F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"),
    )


@query(f"""WITH {RELEASES}, s AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM releases), d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM s)
SELECT day, count(indicator) AS n FROM d LEFT JOIN releases ON ts::DATE = day GROUP BY day""")
def releases_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases per day, days without any too."""
    r = tables.releases(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = r.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(r, "day", "left").fillna(0, ["n"])


@query(f"""WITH {RELEASES} SELECT indicator, count(*) AS n, count(forecast) AS with_forecast, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(actual::DOUBLE), 4) AS mean_actual,
min(actual)::DOUBLE AS lowest, max(actual)::DOUBLE AS highest, count_if(actual::DOUBLE > forecast)::BIGINT AS beats FROM releases GROUP BY indicator""")
def indicator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.col("actual").cast("double")
    return tables.releases(spark, sf_dir).groupBy("indicator").agg(
        F.count("*").alias("n"), F.count("forecast").alias("with_forecast"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.round(F.avg(actual), 4).alias("mean_actual"), F.min(actual).alias("lowest"), F.max(actual).alias("highest"), F.count_if(actual > F.col("forecast")).alias("beats"),
    )


@query(f"""WITH {RELEASES}, n AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY ts DESC) AS k FROM releases)
SELECT indicator, string_agg(actual::BIGINT::VARCHAR, ',' ORDER BY ts) AS spark_values FROM n WHERE k <= 34 GROUP BY indicator""")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 34 values of each indicator, oldest first."""
    w = Window.partitionBy("indicator").orderBy(F.col("ts").desc())
    last = tables.releases(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 34")
    values = F.sort_array(F.collect_list(F.struct("ts", F.round("actual", 0).cast("long").alias("v"))))
    return last.groupBy("indicator").agg(F.array_join(F.transform(values, lambda x: x["v"].cast("string")), ",").alias("spark_values"))


@query(f"""WITH {RELEASES}, n AS (SELECT indicator, ts, row_number() OVER (PARTITION BY indicator ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY indicator) AS m FROM releases)
SELECT indicator, ts FROM n WHERE m <= 420 OR k = m - 1 OR (k < m - 1 AND k IN (SELECT floor(i * (m - 1) / 419.0::DOUBLE)::BIGINT FROM range(0, 419) t(i)))""")
def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 420 evenly spread points of each indicator, the first and the last among them."""
    r = tables.releases(spark, sf_dir).select("indicator", "ts")
    w = Window.partitionBy("indicator").orderBy("ts")
    n = r.withColumn("k", F.row_number().over(w) - 1)
    sizes = n.groupBy("indicator").agg(F.count("*").alias("m"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(418)), lambda i: F.floor(i * (F.col("m") - 1) / F.lit(419.0)))
    kept = sizes.select("indicator", F.explode(F.when(F.col("m") <= 420, F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).otherwise(F.array_union(steps, F.array(F.col("m") - 1)))).alias("k"))
    return n.join(kept.withColumn("k", F.col("k").cast("int")), ["indicator", "k"]).select("indicator", "ts")


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC, c_mktsegment LIMIT 3""")
def top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-three report: aggregate, order, limit."""
    o, c = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "customer")
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.orderBy(F.col("total").desc(), "c_mktsegment").limit(3)


# months of each indicator, those of the less important on the second day
_EDGES = f"""WITH RECURSIVE {RELEASES.replace('releases AS', 'every_release AS')}, releases AS (SELECT DISTINCT indicator, date_trunc('month', ts) + to_days((importance > 3)::INT) AS ts FROM every_release), sz AS (SELECT indicator, count(*) AS n FROM releases GROUP BY 1),
p AS (SELECT a.indicator AS a, b.indicator AS b, count(*) AS m FROM releases a JOIN releases b ON a.ts = b.ts AND a.indicator < b.indicator GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN sz x ON x.indicator = a JOIN sz y ON y.indicator = b WHERE m / least(x.n, y.n) >= 0.9),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, c) AS (SELECT a, a FROM w UNION SELECT b, c FROM r JOIN w ON a = node)
SELECT node AS indicator, min(c) AS release_group FROM r GROUP BY node"""


@query(_EDGES)
def release_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators that are published together: shared instants over the smaller series, then components."""
    month = F.date_add(F.trunc("ts", "month"), (F.col("importance") > 3).cast("int"))
    r = tables.releases(spark, sf_dir).select("indicator", month.alias("ts")).distinct()
    sizes = r.groupBy("indicator").agg(F.count("*").alias("n"))
    a, b = r.withColumnRenamed("indicator", "a"), r.withColumnRenamed("indicator", "b")
    shared = a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("m"))
    sized = shared.join(sizes.select(F.col("indicator").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("indicator").alias("b"), F.col("n").alias("nb")), "b")
    edges = sized.where(F.col("m") / F.least("na", "nb") >= 0.9).select("a", "b")
    return consolidation.components(edges).select(F.col("node").alias("indicator"), F.col("component").alias("release_group"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(((o_totalprice * 1000000)::BIGINT)::DOUBLE / 1e6, 2) END AS value FROM orders")
def decode_millionths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's integers in millionths with its mark for "no value"."""
    o = tables.table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit(consolidation.LONG_MIN)).otherwise(F.round(F.col("o_totalprice") * 1_000_000).cast("long"))
    return rounded(o.select("o_orderkey", consolidation.decode_millionths(raw).alias("value")), 2, "value")


@query(f"""WITH {RELEASES} SELECT indicator, ts, round(forecast, 4) AS forecast, previous::DOUBLE AS previous, CASE WHEN s THEN actual::DOUBLE END AS actual, CASE WHEN s THEN round(actual::DOUBLE - forecast, 4) END AS surprise,
 CASE WHEN s THEN CASE WHEN actual::DOUBLE - forecast > 0 THEN 'above' WHEN actual::DOUBLE - forecast < 0 THEN 'below' WHEN actual::DOUBLE - forecast = 0 THEN 'as forecast' END END AS reading
FROM (SELECT *, ts <= TIMESTAMP '1998-06-01' AS s FROM releases)""")
def visible_at_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators import browser

    out = browser.visible_at(tables.releases(spark, sf_dir), "1998-06-01 00:00:00")
    return rounded(out, 4, "forecast", "surprise").withColumns({c: F.col(c).cast("double") for c in ("previous", "actual")})


@query(f"""WITH {RELEASES}, t AS (SELECT ts, count(*) - 1 AS siblings FROM releases GROUP BY ts)
SELECT indicator, ts, siblings, coalesce((SELECT string_agg(v, ',' ORDER BY i DESC) FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i)), '') AS last_values FROM
(SELECT indicator, ts, list(round(actual)::BIGINT::VARCHAR) OVER (PARTITION BY indicator ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM releases) JOIN t USING (ts)""".replace(
    "coalesce((SELECT string_agg(v, ',' ORDER BY i DESC) FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i)), '')", "coalesce(array_to_string(list_reverse(l), ','), '')"))
def releases_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators import browser

    return browser.with_history(tables.releases(spark, sf_dir))


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS ids, count(DISTINCT o_orderstatus) AS actuals FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1 AND count(DISTINCT o_orderstatus) > 1""")
def fused_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which two events were fused, from observations kept as JSON."""
    payload = F.struct(F.struct(F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("actual")).alias("payload"))
    obs = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("release_id"), F.to_json(payload).alias("raw_json"))
    return consolidation.fused_releases(obs).withColumnRenamed("release_id", "o_custkey")
