"""One query per operator, or small group of operators, over the driver's tables, each with SQL that gives the same rows.

``events`` plays the chain: an event is a block, its whole second the block's time, its value in cents the price. ``orders`` and
``lineitem`` are parents and children, and a line is an output that lives from one event to another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import calendar, scalars as S
from .functions.lineage import cut, shared_folder
from .operators import aggregates as A
from .operators import chain, lookups, recursive, resample
from .operators import windows as Win
from .operators.ordered import running
from .plans import catalogue, frameworks, market, network, scripts, search, transactions
from .sources import tables
from .streaming import incremental, mempool, pool, price

DAY = 86_400
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, ts, price (cents), kind, user_id of all events."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("idx"), seconds.alias("ts"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("price"), F.col("event_type").alias("kind"), "user_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, qty (whole), cents, part, supplier, flag of all order lines."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("parent"), F.col("l_quantity").cast("long").alias("qty"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"))


def outputs(spark: SparkSession, sf_dir: str, priced: bool = True) -> DataFrame:
    """Lives of order lines as outputs, over all events: a line is made at event (order x 7919 mod their number) and spent up to
    211 events later, if that is before the last. Without ``priced``, times and prices are left out, and joins with events if
    there is exactly one at every height, where they would change nothing else."""
    ev = blocks(spark, sf_dir)
    many = ev.agg((F.max("idx") + 1).alias("_n"))
    if not priced:
        least, most, rows = ev.agg(F.min("idx"), F.max("idx"), F.count("*")).first()
        priced = rows == 0 or least < 0 or rows != most + 1 or not ev.groupBy("idx").count().filter("count > 1").isEmpty()
    height = F.col("parent") * 7919 % F.col("_n")
    made = lines(spark, sf_dir).crossJoin(F.broadcast(many)).withColumn("created_h", height)  # one row
    spent = F.col("created_h") + 1 + F.col("part") % 211
    rows = made.select("created_h", F.when(spent < F.col("_n"), spent).alias("spent_h"), F.col("cents").alias("sats"), F.col("supplier").alias("addr"), F.col("flag").alias("kind"), "part")
    if not priced:
        return rows.filter("created_h >= 0")
    born = ev.select(F.col("idx").alias("created_h"), F.col("ts").alias("created_ts"), F.col("price").alias("price_in"))
    dead = ev.select(F.col("idx").alias("spent_h"), F.col("ts").alias("spent_ts"), F.col("price").alias("price_out"))
    return rows.join(born, "created_h").join(dead, "spent_h", "left")


def scaled(c: Column, by: int = 10_000) -> Column:
    """A double as a whole number of parts, so that results compare exactly; null for NaN and where it's infinite."""
    c = c.cast("double")
    return F.when(F.abs(c) < float("inf"), F.floor(c * by + 0.5).cast("long"))


EV = "ev AS (SELECT event_id AS idx, (epoch_us(ts) // 1000000)::BIGINT AS ts, floor(value * 100 + 0.5)::BIGINT AS price, event_type AS kind, user_id FROM events)"
LI = "li AS (SELECT l_orderkey AS parent, l_quantity::BIGINT AS qty, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag FROM lineitem)"
OUT = f"""{EV}, {LI}, many AS (SELECT max(idx) + 1 AS n FROM ev),
    made AS (SELECT *, parent * 7919 % n AS created_h, parent * 7919 % n + 1 + part % 211 AS spent FROM li, many),
    lives AS (SELECT m.created_h, CASE WHEN m.spent < m.n THEN m.spent END AS spent_h, m.cents AS sats, m.supplier AS addr, m.flag AS kind, m.part,
                     b.ts AS created_ts, b.price AS price_in, d.ts AS spent_ts, d.price AS price_out
              FROM made m JOIN ev b ON b.idx = m.created_h LEFT JOIN ev d ON d.idx = m.spent AND m.spent < m.n)"""
#: The window of each row: the first row that is less than a day old.
STARTED = f"{EV}, started AS (SELECT *, min(idx) OVER (ORDER BY ts RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS start FROM ev)"


def sc(x: str, by: int = 10_000) -> str:
    return f"floor(({x}) * {by} + 0.5)::BIGINT"


# -------------------------------------------------------------------------------------------------- the flagship, 2.1, 2.2


@query(f"""WITH {STARTED}, cum AS (SELECT *, sum(price) OVER (ORDER BY idx) AS c FROM started),
    rolled AS (SELECT a.idx, a.ts, a.c - coalesce(b.c, 0) AS total, a.idx - a.start + 1 AS n FROM cum a LEFT JOIN cum b ON b.idx = a.start - 1)
    SELECT ((ts - 1230768000) // 86400)::BIGINT AS day, max_by(total, idx)::BIGINT AS sum_24h, {sc("max_by(total / n, idx)")} AS average_24h_e4 FROM rolled GROUP BY 1""")
def flagship(spark, sf_dir):
    """The last value of each day of the 24-hour sum and average of the price."""
    rolled = Win.rolling_time(blocks(spark, sf_dir), DAY, "price", ["sum", "average"])
    daily = resample.last_of(rolled, "day1", ["sum", "average"]).filter("sum is not null")
    return daily.select(F.col("bucket").alias("day"), F.col("sum").alias("sum_24h"), scaled(F.col("average")).alias("average_24h_e4"))


@query(f"WITH {EV}, n AS (SELECT max(idx) + 1 AS n FROM ev) SELECT idx, price FROM ev, n WHERE idx >= n - 100 AND idx < n - 10")
def scan_range_from_end(spark, sf_dir):
    return lookups.span(blocks(spark, sf_dir).select("idx", "price"), -100, -10)


@query(f"WITH {EV} SELECT arg_min(price, idx)::BIGINT AS first, arg_max(price, idx)::BIGINT AS last, min(CASE WHEN idx = 77 THEN price END)::BIGINT AS one, min(price) AS least, max(price) AS most, sum(price)::BIGINT AS total FROM ev")
def scan_points_and_range_aggregates(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return b.agg(F.min_by("price", "idx").alias("first"), F.max_by("price", "idx").alias("last"), F.min(F.when(F.col("idx") == 77, F.col("price"))).alias("one"), F.min("price").alias("least"), F.max("price").alias("most"), F.sum("price").alias("total"))


@query(f"WITH {EV}, w AS (SELECT user_id * 3 AS idx FROM ev) SELECT idx, price FROM w JOIN ev USING (idx)")
def scan_gather(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return lookups.gather(b.select("idx", "price"), b.select((F.col("user_id") * 3).alias("idx")))


@query("SELECT p_partkey AS part, p_name AS name FROM part WHERE p_partkey >= 100 AND p_partkey < 400 AND starts_with(p_brand, 'Brand#1')")
def key_scan(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), "p_brand")
    return tables.key_prefix(tables.key_range(p, "part", 100, 400), "p_brand", "Brand#1").drop("p_brand")


@query(f"""WITH {LI}, v AS (SELECT part, supplier, max(cents * 100000 + parent) AS seqno FROM li GROUP BY ALL),
    top AS (SELECT part, max_by(supplier, seqno) AS supplier, max(seqno) AS seqno FROM v GROUP BY part) SELECT part, supplier, seqno FROM top WHERE supplier % 5 <> 0""")
def newest_version_per_key(spark, sf_dir):
    v = lines(spark, sf_dir).groupBy("part", "supplier").agg(F.max(F.col("cents") * 100_000 + F.col("parent")).alias("seqno"))
    return lookups.newest(v.withColumn("dead", F.col("supplier") % 5 == 0), ["part"], "seqno", "dead").drop("dead")


@query("""WITH c AS (SELECT c_custkey AS key, floor(c_acctbal * 100 + 0.5)::BIGINT AS v, -1::BIGINT AS n FROM customer),
    ch AS (SELECT o_custkey AS key, floor(o_totalprice * 100 + 0.5)::BIGINT AS v, o_orderkey AS n FROM orders),
    top AS (SELECT key, max_by(v, n) AS v, max(n) AS n FROM (FROM c UNION ALL FROM ch) GROUP BY key) SELECT key, v FROM top WHERE n % 7 <> 0""")
def keyed_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long").alias("v"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("v"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 7 == 0).alias("dead"))
    return tables.upsert(c, o, ["key"], "n", "dead")


@query(f"WITH {EV} SELECT idx::BIGINT AS idx, coalesce(price, -1)::BIGINT AS value FROM range(20000) r(idx) LEFT JOIN ev USING (idx)")
def fill_to_length(spark, sf_dir):
    return tables.fill_to(blocks(spark, sf_dir).select("idx", F.col("price").alias("value")).filter("idx < 20000"), 20_000, -1)


@query(f"WITH {EV} SELECT idx, CASE WHEN idx >= 500 THEN price + 1 ELSE price END AS price FROM ev WHERE idx < 700")
def reorganisation(spark, sf_dir):
    b = blocks(spark, sf_dir).select("idx", "price")
    return incremental.replace_from(b, b.filter("idx >= 500 and idx < 700").withColumn("price", F.col("price") + 1))


@query(f"""WITH {EV} SELECT 'price' AS name, '{{"version":1,"index":"height","type":"bigint","start":10,"end":40,"stamp":"2024-02-01T00:00:00Z","data":[' || string_agg(price::VARCHAR, ',' ORDER BY idx) || ']}}' AS json FROM ev WHERE idx >= 10 AND idx < 40""")
def series_json(spark, sf_dir):
    b = blocks(spark, sf_dir).select("idx", "price").filter("idx >= 10 and idx < 40")
    return catalogue.as_json(b, ["price"], "height", stamp=F.lit("2024-02-01T00:00:00Z"))


@query(f"""WITH {EV} SELECT 'raw' AS form, '[[' || string_agg(price, ',' ORDER BY idx) || '],[' || string_agg(ts, ',' ORDER BY idx) || ']]' AS json FROM ev WHERE idx >= 10 AND idx < 40
    UNION ALL SELECT 'raw_one', '[' || string_agg(price, ',' ORDER BY idx) || ']' FROM ev WHERE idx >= 10 AND idx < 40
    UNION ALL SELECT 'legacy_one', price::VARCHAR FROM ev WHERE idx = 10""")
def series_json_forms(spark, sf_dir):
    """A range of two series and of one without an envelope, and one value in the older form."""
    b = blocks(spark, sf_dir).select("idx", "price", "ts").filter("idx >= 10 and idx < 40")
    forms = {"raw": catalogue.as_raw_json(b, ["price", "ts"]), "raw_one": catalogue.as_raw_json(b, ["price"]), "legacy_one": catalogue.as_legacy_json(b.filter("idx = 10"), ["price"])}
    one, two, three = (df.select(F.lit(form).alias("form"), "json") for form, df in forms.items())
    return one.unionByName(two).unionByName(three)


def _catalogue(spark, sf_dir) -> catalogue.Catalogue:
    c = catalogue.Catalogue()
    b = blocks(spark, sf_dir)
    c.add("price", lambda: b.select("idx", "ts", F.col("price").alias("value")))
    c.add("user-id", lambda: b.select("idx", "ts", F.col("user_id").alias("value")))
    return c


@query(f"""WITH {EV}, d AS (SELECT ((ts - 1230768000) // 86400)::BIGINT AS idx, max_by(price, idx) AS price, max_by(user_id, idx) AS user_id FROM ev GROUP BY 1), n AS (SELECT max(idx) AS m FROM d)
    SELECT r.idx, price, user_id FROM (SELECT unnest(range(m - 9, m + 1)) AS idx FROM n) r LEFT JOIN d USING (idx)""")
def series_range_daily(spark, sf_dir):
    return _catalogue(spark, sf_dir).select(["price", "user-id"], "day1", start=-10)


@query(f"WITH {EV} SELECT max_by(price, idx)::BIGINT AS value, max(idx // 2016)::BIGINT AS idx FROM ev")
def series_latest(spark, sf_dir):
    return _catalogue(spark, sf_dir).latest("price", "epoch").select("value", "idx")


# --------------------------------------------------------------------------------------------------------------- 2.3, 2.4


@query(f"""WITH {EV} SELECT idx, price + user_id AS added, greatest(price - user_id * 100, 0)::BIGINT AS saturated, CASE WHEN price >= user_id THEN price - user_id END AS checked, (price * user_id)::BIGINT AS multiplied,
    {sc("CASE WHEN user_id = 0 THEN NULL ELSE price / user_id END")} AS divided_e4, {sc("CASE WHEN user_id = 0 THEN NULL ELSE 100.0 * price / user_id END")} AS percentage_e4, {sc("CASE WHEN user_id = 0 THEN NULL ELSE 100.0 * price / user_id - 100 END")} AS difference_e4,
    (price // 2)::BIGINT AS halved, (-price)::BIGINT AS negated, CASE WHEN kind = 'view' THEN price ELSE 0 END::BIGINT AS masked FROM ev""")
def elementwise(spark, sf_dir):
    p, u = F.col("price"), F.col("user_id")
    finite = lambda c: F.when(u == 0, F.lit(None)).otherwise(scaled(c))
    return blocks(spark, sf_dir).select(
        "idx", (p + u).alias("added"), S.saturating_sub(p, u * 100).alias("saturated"), S.checked_sub(p, u).alias("checked"), (p * u).alias("multiplied"), finite(S.divide(p, u)).alias("divided_e4"),
        finite(S.percentage(p, u)).alias("percentage_e4"), finite(S.percentage_difference(p, u)).alias("difference_e4"), S.halve(p).alias("halved"), (-p).alias("negated"), S.mask(F.col("kind") == "view", p).alias("masked"),
    )


@query(f"""WITH {EV} SELECT idx, {sc("price / 1e8", 10**8)} AS btc_e8, (price::HUGEINT * 6543210 // 100000000)::BIGINT AS cents, coalesce((price::HUGEINT * 100000000 // nullif(user_id, 0))::BIGINT, 0) AS sats, {sc("price / 100.0")} AS dollars_e4,
    {sc("CASE WHEN user_id = 0 THEN 0 ELSE price / user_id END")} AS ratio_e4, {sc("CASE WHEN user_id = 0 THEN 0 ELSE price / user_id - 1 END")} AS ratio_difference_e4, {sc("price / 1e6", 10**6)} AS fixed_e6,
    ceil(price / 4.0)::BIGINT AS vsize, (price * 4)::BIGINT AS weight, (price // 500 * 500)::BIGINT AS lin500, CASE WHEN price <= 0 THEN 0 ELSE round(10 ** (floor(log10(price) * 100) / 100)) END::BIGINT AS log100,
    CASE WHEN price > 0 THEN round(log10(price) * 200) END::INTEGER AS bin FROM ev""")
def scalar_functions(spark, sf_dir):
    p, u = F.col("price"), F.col("user_id")
    return blocks(spark, sf_dir).select(
        "idx", scaled(S.sats_to_bitcoin(p), 10**8).alias("btc_e8"), S.sats_to_cents(p, F.lit(6_543_210)).alias("cents"), S.cents_to_sats(p, u).alias("sats"), scaled(S.cents_to_dollars(p)).alias("dollars_e4"), scaled(S.ratio(p, u)).alias("ratio_e4"),
        scaled(S.ratio_difference(p, u)).alias("ratio_difference_e4"), scaled(S.fixed_to_ratio(p), 10**6).alias("fixed_e6"), S.weight_to_vsize(p).alias("vsize"), S.vbytes_to_weight(p).alias("weight"), S.linear_floor(p, 500).alias("lin500"), S.log_floor(p, 100).alias("log100"), S.log_bin(p).alias("bin"),
    )


# -------------------------------------------------------------------------------------------------------------------- 2.5


@query(f"WITH {EV} SELECT idx, price + user_id + idx AS s, least(price, user_id, idx) AS low, greatest(price, user_id, idx) AS high, {sc('CASE WHEN user_id + idx > 0 THEN (user_id * price + idx * 2.0 * price) / (user_id + idx) ELSE 0 END')} AS weighted_e4 FROM ev")
def horizontal(spark, sf_dir):
    p, u, i = F.col("price"), F.col("user_id"), F.col("idx")
    return blocks(spark, sf_dir).select("idx", A.sum_of([p, u, i]).alias("s"), A.min_of([p, u, i]).alias("low"), A.max_of([p, u, i]).alias("high"), scaled(A.weighted_average_of([(u, p.cast("double")), (i, p * 2.0)])).alias("weighted_e4"))


@query(f"""WITH {LI} SELECT o_orderkey AS parent, coalesce(sum(cents), 0)::BIGINT AS total, coalesce(sum(CASE WHEN qty > 25 THEN cents ELSE 0 END), 0)::BIGINT AS large, count(li.parent)::BIGINT AS n, count(CASE WHEN flag = 'R' THEN 1 END)::BIGINT AS n_returned
    FROM orders LEFT JOIN li ON li.parent = o_orderkey GROUP BY o_orderkey""")
def ragged_aggregates(spark, sf_dir):
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"))
    return A.per_parent(parents, lines(spark, sf_dir), "parent", {"total": F.sum("cents"), "large": A.filtered_sum(F.col("cents"), F.col("qty") > 25), "n": F.count("*"), "n_returned": A.filtered_count(F.col("flag") == "R")})


@query(f"""WITH {EV}, f AS (SELECT ((ts - 1230768000) // 600)::BIGINT AS bucket, min(idx) AS first FROM ev GROUP BY 1), r AS (SELECT unnest(range((SELECT min(bucket) FROM f), (SELECT max(bucket) FROM f) + 1)) AS bucket)
    SELECT bucket, min(first) OVER (ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS first FROM r LEFT JOIN f USING (bucket)""")
def first_per_bucket(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("bucket", calendar.bucket(F.col("ts"), "minute10"))
    every = b.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).select(F.explode(F.sequence("a", "z")).alias("bucket"))
    return A.first_per_bucket(b, "bucket", every)


@query(f"WITH {EV}, f AS (SELECT idx // 7 AS p, min(idx) AS first FROM ev GROUP BY 1), n AS (SELECT count(*) AS n FROM ev) SELECT p AS parent, (coalesce(lead(first) OVER (ORDER BY p), n) - first)::BIGINT AS n FROM f, n")
def count_from_firsts(spark, sf_dir):
    b = blocks(spark, sf_dir)
    firsts = b.groupBy(F.floor(F.col("idx") / 7).alias("idx")).agg(F.min("idx").alias("first"))
    return A.count_from_firsts(firsts, "first", b.count()).select(F.col("idx").alias("parent"), F.col("n").cast("long"))


_RANKS = ", ".join(f"coalesce(vs[floor((len(vs) - 1) * {p} + 0.5)::INTEGER + 1], 0)::BIGINT AS {n}" for n, p in A.PERCENTILES.items())


@query(f"""WITH {LI}, r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY cents * 1000000 + part, qty) AS k FROM li),
    s AS (SELECT parent, coalesce(list(cents ORDER BY cents) FILTER (k > 1 AND cents > 0), []) AS vs FROM r GROUP BY parent) SELECT parent, {_RANKS} FROM s""")
def rank_distribution(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("k", F.col("cents") * 1_000_000 + F.col("part"))
    return A.rank_distribution(rows, "parent", "cents", "k", skip=1)


@query(f"""WITH {LI}, m AS (SELECT supplier, cents, sum(qty) AS w FROM li GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY supplier ORDER BY cents) AS cum, sum(w) OVER (PARTITION BY supplier) AS total FROM m)
    SELECT supplier, {", ".join(f"coalesce(min(CASE WHEN cum >= floor(total * {p} + 0.5) THEN cents END), 0)::BIGINT AS {n}" for n, p in A.PERCENTILES.items())} FROM r GROUP BY supplier""")
def weighted_distribution(spark, sf_dir):
    return A.weighted_distribution(lines(spark, sf_dir), "supplier", "cents", "qty")


@query(f"WITH {LI}, h AS (SELECT unnest(range(0, 300, 10)) AS parent), s AS (SELECT h.parent, list_sort(list(cents)) AS vs FROM h JOIN li ON li.parent BETWEEN h.parent - 4 AND h.parent GROUP BY h.parent) SELECT parent, {_RANKS} FROM s")
def pooled_distribution(spark, sf_dir):
    heights = spark.range(0, 300, 10).withColumnRenamed("id", "parent")
    return A.pooled_distribution(lines(spark, sf_dir), heights, "parent", "cents", 5)


@query(f"WITH {EV} SELECT (ts // 3600)::BIGINT AS bucket, floor((sum(price) + count(*) // 2) / count(*))::BIGINT AS avg_price, floor((sum(idx) + count(*) // 2) / count(*))::BIGINT AS avg_idx FROM ev GROUP BY 1")
def bucket_means(spark, sf_dir):
    return A.bucket_means(blocks(spark, sf_dir), "ts", 3600, ["price", "idx"])


@query(f"""WITH {LI}, b AS (SELECT flag, qty AS bucket, sum(cents)::DOUBLE AS w, count(*)::DOUBLE AS c FROM li GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY bucket) AS cw, sum(w) OVER (PARTITION BY flag) AS tw, sum(c) OVER (PARTITION BY flag) AS tc FROM b)
    SELECT flag, {sc("1 - 2 * sum(c / tc * (cw / tw + (cw - w) / tw) / 2)", 10**6)} AS gini_e6 FROM r GROUP BY flag""")
def gini(spark, sf_dir):
    b = lines(spark, sf_dir).groupBy("flag", F.col("qty").alias("bucket")).agg(F.sum("cents").cast("double").alias("w"), F.count("*").cast("double").alias("c"))
    return A.gini(b, "w", "c", ["flag"], "bucket").select("flag", scaled(F.col("gini"), 10**6).alias("gini_e6"))


@query(f"WITH {EV} SELECT kind, n, row_number() OVER (ORDER BY n DESC, kind)::INTEGER AS rank, {sc('n / sum(n) OVER ()')} AS share_e4 FROM (SELECT kind, count(*) AS n FROM ev GROUP BY kind)")
def ranking(spark, sf_dir):
    return A.ranking(blocks(spark, sf_dir), "kind").select("kind", "n", "rank", scaled(F.col("share")).alias("share_e4"))


@query(f"WITH {EV} SELECT kind, ((ts - 1230768000) // 86400)::BIGINT AS day, count(DISTINCT user_id)::BIGINT AS users FROM ev GROUP BY ALL")
def distinct_users(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("kind", calendar.bucket(F.col("ts"), "day1").alias("day")).agg(F.count_distinct("user_id").alias("users"))


# -------------------------------------------------------------------------------------------------------------------- 2.6


@query(f"WITH {STARTED} SELECT idx, start FROM started")
def window_starts(spark, sf_dir):
    return Win.window_start(blocks(spark, sf_dir), DAY).select("idx", "start")


@query(f"""WITH {STARTED}, j AS (SELECT a.idx, sum(b.price)::BIGINT AS total, count(*)::BIGINT AS n, min(b.price) AS low, max(b.price) AS high, avg(b.price) AS mean, stddev_pop(b.price) AS sd FROM started a JOIN ev b ON b.idx BETWEEN a.start AND a.idx GROUP BY a.idx)
    SELECT idx, total, n, low, high, {sc("mean")} AS average_e4, {sc("sd", 100)} AS sd_e2 FROM j""")
def rolling_time_windows(spark, sf_dir):
    r = Win.rolling_time(blocks(spark, sf_dir), DAY, "price", ["sum", "count", "min", "max", "average", "sd"])
    return r.select("idx", F.col("sum").alias("total"), F.col("count").alias("n"), F.col("min").alias("low"), F.col("max").alias("high"), scaled(F.col("average")).alias("average_e4"), scaled(F.col("sd"), 100).alias("sd_e2"))


@query(f"""WITH {EV}, started AS (SELECT *, min(idx) OVER (ORDER BY ts RANGE BETWEEN {6 * 3600 - 1} PRECEDING AND CURRENT ROW) AS start FROM ev),
    j AS (SELECT a.idx, quantile_cont(b.price::DOUBLE, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q, min(b.price) AS low, max(b.price) AS high FROM started a JOIN ev b ON b.idx BETWEEN a.start AND a.idx GROUP BY a.idx)
    SELECT idx, {sc("q[1]", 100)} AS p10, {sc("q[2]", 100)} AS p25, {sc("q[3]", 100)} AS p50, {sc("q[4]", 100)} AS p75, {sc("q[5]", 100)} AS p90, low, high FROM j""")
def rolling_distribution(spark, sf_dir):
    r = Win.rolling_time(blocks(spark, sf_dir), 6 * 3600, "price", ["distribution"])
    return r.select("idx", *(scaled(F.col(p), 100).alias(p) for p in Win.QUANTILES), "low", "high")


@query(f"""WITH {STARTED}, j AS (SELECT a.idx, a.price, b.price AS lookback FROM started a JOIN ev b ON b.idx = a.start)
    SELECT idx, lookback, (price - lookback)::BIGINT AS change, {sc("CASE WHEN lookback = 0 THEN 0 ELSE (price - lookback) / lookback END")} AS rate_e4 FROM j""")
def rolling_changes(spark, sf_dir):
    r = Win.rolling_change(blocks(spark, sf_dir), DAY, "price")
    return r.select("idx", "lookback", "change", scaled(F.col("rate")).alias("rate_e4"))


@query(f"""WITH {STARTED}, j AS (SELECT a.idx, a.user_id, sum(b.price)::BIGINT AS s FROM started a JOIN ev b ON b.idx BETWEEN a.start AND a.idx GROUP BY ALL) SELECT idx, {sc("CASE WHEN user_id = 0 THEN 0 ELSE s / user_id END")} AS ratio_e4 FROM j""")
def rolling_ratio(spark, sf_dir):
    return Win.rolling_ratio(blocks(spark, sf_dir), DAY, "price", "user_id", "ratio").select("idx", scaled(F.col("ratio")).alias("ratio_e4"))


@query(f"""WITH {EV} SELECT idx, sum(price) OVER w::BIGINT AS total, max(price) OVER w AS high, min(price) OVER w AS low, {sc("avg(price) OVER w")} AS sma_e4, {sc("quantile_cont(price::DOUBLE, 0.5) OVER w", 10)} AS median_e1, count(*) FILTER (price > 5000) OVER w AS n_large FROM ev WINDOW w AS (ORDER BY idx ROWS 29 PRECEDING)""")
def rolling_row_windows(spark, sf_dir):
    r = Win.rolling_rows(blocks(spark, sf_dir), 30, "price", ["sum", "max", "min", "sma", "median"], chunk=1000)
    r = Win.rolling_count(r, 30, F.col("price") > 5000, "n_large", chunk=1000)
    return r.select("idx", F.col("sum").alias("total"), F.col("max").alias("high"), F.col("min").alias("low"), scaled(F.col("sma")).alias("sma_e4"), scaled(F.col("median"), 10).alias("median_e1"), "n_large")


@query(f"""WITH {EV}, l AS (SELECT idx, price, lag(price, 10) OVER (ORDER BY idx) AS b FROM ev) SELECT idx, b AS previous, coalesce(price - b, 0)::BIGINT AS change, {sc("CASE WHEN b > 0 THEN price / b - 1 END")} AS ratio_change_e4, {sc("CASE WHEN b > 0 THEN 100.0 * (price / b - 1) END")} AS percentage_change_e4 FROM l""")
def lookback_rows(spark, sf_dir):
    r = Win.lookback_rows(blocks(spark, sf_dir), 10, "price", chunk=1000)
    return r.select("idx", scaled(F.col("previous"), 1).alias("previous"), "change", scaled(F.col("ratio_change")).alias("ratio_change_e4"), scaled(F.col("percentage_change")).alias("percentage_change_e4"))


@query(f"""WITH {EV} SELECT idx, sum(price) OVER w::BIGINT AS total, sum(price * user_id) OVER w::BIGINT AS total_product, count(*) FILTER (kind = 'view') OVER w AS n_views, count(*) FILTER (kind = 'view' AND idx >= 100) OVER w AS n_views_since FROM ev WINDOW w AS (ORDER BY idx)""")
def cumulative(spark, sf_dir):
    r = Win.cumulative(blocks(spark, sf_dir), F.col("price"), "total", chunk=1000)
    r = Win.cumulative(r, F.col("price") * F.col("user_id"), "total_product", chunk=1000)
    r = Win.cumulative_count(r, F.col("kind") == "view", "n_views", chunk=1000)
    r = Win.cumulative_count(r, F.col("kind") == "view", "n_views_since", since=100, chunk=1000)
    return r.select("idx", "total", "total_product", "n_views", "n_views_since")


@query(f"""WITH {EV}, r AS (SELECT idx, price, max(price) OVER w AS ath, min(nullif(price, 0)) OVER w AS atl FROM ev WINDOW w AS (ORDER BY idx)) SELECT idx, ath, coalesce(atl, 0)::BIGINT AS atl, {sc("CASE WHEN ath = 0 THEN 0 ELSE (price - ath) / ath END")} AS drawdown_e4 FROM r""")
def extremes(spark, sf_dir):
    return Win.extremes(blocks(spark, sf_dir), "price", skip_zero=True, chunk=1000).select("idx", "ath", "atl", scaled(F.col("drawdown")).alias("drawdown_e4"))


@query(f"WITH {EV} SELECT idx, {sc('stddev_pop(price) OVER (ORDER BY idx)', 100)} AS sd_e2 FROM ev")
def expanding_deviation(spark, sf_dir):
    return Win.expanding_sd(blocks(spark, sf_dir), "price", chunk=1000).select("idx", scaled(F.col("sd"), 100).alias("sd_e2"))


@query(f"""WITH {EV}, a AS (SELECT *, max(price) OVER (ORDER BY idx) AS ath FROM ev), b AS (SELECT idx, ts - max(CASE WHEN price = ath THEN ts END) OVER (ORDER BY idx) AS d FROM a) SELECT idx, {sc("d / 86400.0", 10**6)} AS days_since_e6, {sc("max(d) OVER (ORDER BY idx) / 86400.0", 10**6)} AS most_days_e6 FROM b""")
def since_peak(spark, sf_dir):
    r = Win.since_peak(blocks(spark, sf_dir), "price", chunk=1000)
    return r.select("idx", scaled(F.col("days_since"), 10**6).alias("days_since_e6"), scaled(F.col("most_days"), 10**6).alias("most_days_e6"))


@query(f"WITH {EV}, r AS (SELECT DISTINCT idx // 3 AS a, idx AS b FROM ev WHERE idx % 37 = 5) SELECT a::BIGINT AS a, b, max(price) AS peak FROM r JOIN ev ON ev.idx BETWEEN a AND b GROUP BY ALL")
def range_maxima(spark, sf_dir):
    b = blocks(spark, sf_dir)
    ranges = b.filter("idx % 37 = 5").select(F.floor(F.col("idx") / 3).alias("a"), F.col("idx").alias("b"))
    return Win.range_max(b, ranges, "price", block=16)


@query(f"WITH {EV}, o AS (SELECT o_orderkey AS idx, (epoch_us(o_orderdate) // 1000000)::BIGINT AS ts FROM orders) SELECT idx, max(ts) OVER (ORDER BY idx)::BIGINT AS mono FROM o")
def monotonic_times(spark, sf_dir):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), seconds.alias("ts"))
    return Win.monotonic(o, chunk=1000).select("idx", "mono")


# -------------------------------------------------------------------------------------------------------------- 2.7 to 2.9


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT idx, price::DOUBLE AS ema, price::DOUBLE AS rma FROM ev WHERE idx = 0 UNION ALL
    SELECT v.idx, CASE WHEN v.idx < 10 THEN (e.ema * v.idx + v.price) / (v.idx + 1) ELSE v.price * (2.0 / 11) + e.ema * (1 - 2.0 / 11) END, CASE WHEN v.idx < 10 THEN (e.rma * v.idx + v.price) / (v.idx + 1) ELSE v.price * 0.1 + e.rma * 0.9 END FROM e JOIN ev v ON v.idx = e.idx + 1)
    SELECT idx, {sc("ema", 1000)} AS ema_e3, {sc("rma", 1000)} AS rma_e3 FROM e""")
def exponential_averages(spark, sf_dir):
    b = blocks(spark, sf_dir).select("idx", "price")
    r = recursive.ema_rows(recursive.ema_rows(b, 10, "price", "ema", chunk=1000), 10, "price", "rma", wilder=True, chunk=1000)
    return r.select("idx", scaled(F.col("ema"), 1000).alias("ema_e3"), scaled(F.col("rma"), 1000).alias("rma_e3"))


@query(f"""WITH RECURSIVE {STARTED}, e AS (SELECT idx, price::DOUBLE AS ema, price::DOUBLE AS rma FROM started WHERE idx = 0 UNION ALL
    SELECT v.idx, v.price * (2.0 / (v.idx - v.start + 2)) + e.ema * (1 - 2.0 / (v.idx - v.start + 2)), v.price * (1.0 / (v.idx - v.start + 1)) + e.rma * (1 - 1.0 / (v.idx - v.start + 1)) FROM e JOIN started v ON v.idx = e.idx + 1)
    SELECT idx, {sc("ema", 1000)} AS ema_e3, {sc("rma", 1000)} AS rma_e3 FROM e""")
def exponential_averages_by_time(spark, sf_dir):
    b = Win.window_start(blocks(spark, sf_dir), DAY).select("idx", "price", "start")
    r = recursive.ema_time(recursive.ema_time(b, "start", "price", "ema", chunk=1000), "start", "price", "rma", wilder=True, chunk=1000)
    return r.select("idx", scaled(F.col("ema"), 1000).alias("ema_e3"), scaled(F.col("rma"), 1000).alias("rma_e3"))


@query(f"""WITH {EV}, t AS (SELECT idx, CASE WHEN price < 500 THEN false WHEN price > 20000 THEN true END AS turn FROM ev) SELECT idx, coalesce(last_value(turn IGNORE NULLS) OVER (ORDER BY idx), false) AS active FROM t""")
def signal_latch(spark, sf_dir):
    return recursive.latch(blocks(spark, sf_dir), F.col("price") > 20_000, F.col("price") < 500, "active", chunk=1000).select("idx", "active")


@query(f"""WITH {EV}, c AS (SELECT idx, round(log10(price) * 200)::INTEGER AS bin, 1 AS n FROM ev WHERE price > 0) SELECT c.idx + a.age AS idx, bin, {sc("sum(0.25 * 0.75 ** a.age * n)", 10**6)} AS ema_e6 FROM c, (SELECT unnest(range(12)) AS age) a WHERE c.idx + a.age <= (SELECT max(idx) FROM c) GROUP BY 1, 2""")
def histogram_average(spark, sf_dir):
    counts = blocks(spark, sf_dir).select("idx", S.log_bin(F.col("price")).alias("bin"), F.lit(1).alias("n")).filter("bin is not null")
    return recursive.bins_ema(counts, 0.25, 12).select("idx", "bin", scaled(F.col("ema"), 10**6).alias("ema_e6"))


_GRAIN_SQL = {
    "minute10": "(ts - 1230768000) // 600", "minute30": "(ts - 1230768000) // 1800", "hour1": "(ts - 1230768000) // 3600", "hour4": "(ts - 1230768000) // 14400", "hour12": "(ts - 1230768000) // 43200",
    "day1": "(ts - 1230768000) // 86400", "day3": "(ts - 1230768000 + 86400) // 259200", "week1": "date_diff('day', DATE '2008-12-29', date_trunc('week', to_timestamp(ts) AT TIME ZONE 'UTC')::DATE) // 7",
    "month1": "m", "month3": "m // 3", "month6": "m // 6", "year1": "y - 2009", "year10": "(y - 2000) // 10", "halving": "idx // 210000", "epoch": "idx // 2016",
}


@query(f"""WITH {EV}, d AS (SELECT *, (year(to_timestamp(ts) AT TIME ZONE 'UTC') - 2009) * 12 + month(to_timestamp(ts) AT TIME ZONE 'UTC') - 1 AS m, year(to_timestamp(ts) AT TIME ZONE 'UTC') AS y FROM ev)
    {" UNION ALL ".join(f"SELECT '{g}' AS grain, ({x})::BIGINT AS bucket, max_by(price, idx) AS price FROM d GROUP BY 2" for g, x in _GRAIN_SQL.items())}""")
def resampled_all_grains(spark, sf_dir):
    b = blocks(spark, sf_dir)
    parts = [resample.last_of(b, g, ["price"]).filter("price is not null") for g in calendar.GRAINS] + [resample.last_by_height(b, g, ["price"]) for g in calendar.HEIGHTS]
    out = None
    for g, p in zip((*calendar.GRAINS, *calendar.HEIGHTS), parts, strict=True):
        p = p.select(F.lit(g).alias("grain"), "bucket", "price")
        out = p if out is None else out.unionByName(p)
    return out


@query(f"""WITH {EV}, o AS (SELECT ((ts - 1230768000) // 600)::BIGINT AS bucket, arg_min(price, idx) AS open, max(price) AS high, min(price) AS low, arg_max(price, idx) AS close FROM ev GROUP BY 1),
    r AS (SELECT b.bucket, open, high, low, close, last_value(close IGNORE NULLS) OVER (ORDER BY b.bucket) AS before FROM (SELECT unnest(range((SELECT min(bucket) FROM o), (SELECT max(bucket) FROM o) + 1)) AS bucket) b LEFT JOIN o USING (bucket))
    SELECT bucket, coalesce(open, before) AS open, coalesce(high, before) AS high, coalesce(low, before) AS low, coalesce(close, before) AS close FROM r""")
def ohlc(spark, sf_dir):
    return resample.ohlc(blocks(spark, sf_dir), "minute10", "price")


@query(f"WITH {EV}, c AS (SELECT idx, ts, sum(price) OVER (ORDER BY idx)::BIGINT AS c FROM ev) SELECT idx, CASE WHEN ts >= 1704499200 THEN c - coalesce((SELECT max_by(c, idx) FROM c WHERE ts < 1704499200), 0) ELSE 0 END::BIGINT AS since FROM c")
def since_a_day(spark, sf_dir):
    c = Win.cumulative(blocks(spark, sf_dir), F.col("price"), "c", chunk=1000)
    return resample.since(c, "c", F.col("ts") >= 1_704_499_200).select("idx", "since")


# -------------------------------------------------------------------------------------------------------------------- 2.10


@query(f"WITH {EV}, p AS (SELECT idx AS id, 1704067200 + idx * 97 AS t FROM ev), m AS (SELECT ts, min(idx) AS h FROM ev GROUP BY ts) SELECT id, t, h AS at FROM p ASOF LEFT JOIN m ON p.t <= m.ts")
def height_at_or_after_time(spark, sf_dir):
    b = blocks(spark, sf_dir)
    points = b.select(F.col("idx").alias("id"), (1_704_067_200 + F.col("idx") * 97).alias("t"))
    return lookups.as_of(points, b.select(F.col("ts").alias("t"), "idx"), "t", F.col("idx"), "at", forward=True)


@query(f"WITH {EV}, p AS (SELECT idx AS id, 1704067200 + idx * 97 AS t FROM ev), m AS (SELECT ts, max(idx) AS h FROM ev GROUP BY ts) SELECT id, t, h AS at FROM p ASOF LEFT JOIN m ON p.t >= m.ts")
def height_at_or_before_time(spark, sf_dir):
    b = blocks(spark, sf_dir)
    points = b.select(F.col("idx").alias("id"), (1_704_067_200 + F.col("idx") * 97).alias("t"))
    return lookups.as_of(points, b.select(F.col("ts").alias("t"), "idx"), "t", F.col("idx"), "at")


@query(f"WITH {LI}, o AS (SELECT row_number() OVER (ORDER BY parent, part, supplier, qty, cents) - 1 AS txout_idx, * FROM li), i AS (SELECT txout_idx, txout_idx // 2 AS txin_idx FROM o WHERE part % 3 = 0) SELECT o.txout_idx, txin_idx FROM o LEFT JOIN i USING (txout_idx)")
def output_spenders(spark, sf_dir):
    o = _numbered(spark, sf_dir)
    i = o.filter("part % 3 = 0").select("txout_idx", F.floor(F.col("txout_idx") / 2).alias("txin_idx"))
    return lookups.spenders(o.select("txout_idx"), i)


def _numbered(spark, sf_dir) -> DataFrame:
    """Numbered outputs: each order's lines are numbered, and start where those of the orders before end."""
    li = lines(spark, sf_dir)
    first = running(li.groupBy("parent").agg(F.count("*").alias("_n")), {"_upto": ("sum", F.col("_n"))}, None, "parent").select("parent", (F.col("_upto") - F.col("_n")).alias("_first"))
    nth = F.row_number().over(W.partitionBy("parent").orderBy("part", "supplier", "qty", "cents"))
    return li.withColumn("_nth", nth).join(first, "parent").withColumn("txout_idx", (F.col("_first") + F.col("_nth") - 1).cast("long")).drop("_nth", "_first")


@query(f"WITH {LI}, o AS (SELECT row_number() OVER (ORDER BY parent, part, supplier, qty, cents) - 1 AS txout_idx, * FROM li) SELECT flag, count(*) AS n, sum(cents)::BIGINT AS sats FROM o WHERE part % 3 <> 0 GROUP BY flag")
def unspent_outputs(spark, sf_dir):
    o = _numbered(spark, sf_dir)
    return lookups.unspent(o, o.filter("part % 3 = 0").select("txout_idx")).groupBy("flag").agg(F.count("*").alias("n"), F.sum("cents").alias("sats"))


@query(f"WITH {EV}, f AS (SELECT user_id, min(idx) AS f FROM ev GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY f) - 1 AS id FROM f) SELECT idx, id FROM ev JOIN r USING (user_id)")
def ids_by_first_appearance(spark, sf_dir):
    return lookups.first_seen_ids(blocks(spark, sf_dir), "user_id", "idx").select("idx", "id")


@query("""WITH n(priority, tag, name) AS (VALUES (1, 'BUILD', 'builders'), (2, 'AUTO', 'autos'), (3, 'MACH', 'machines')) SELECT c_custkey AS id, CASE WHEN c_nationkey = 7 THEN 'seven' ELSE coalesce((SELECT arg_min(name, priority) FROM n WHERE contains(c_mktsegment, tag)), 'unknown') END AS name FROM customer""")
def first_matching_name(spark, sf_dir):
    names = spark.createDataFrame([(1, "BUILD", "builders", None), (2, "AUTO", "autos", None), (3, "MACH", "machines", None), (4, None, "seven", 7)], "priority int, tag string, name string, address int")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey")
    return lookups.first_match(c, "c_mktsegment", names, exact="c_nationkey").select("id", "name")


@query(f"WITH {LI}, c(cohort, lo, hi) AS (VALUES ('small', 0, 10), ('middle', 10, 30), ('large', 30, NULL), ('most', 5, NULL)) SELECT cohort, count(*) AS n, sum(cents)::BIGINT AS sats FROM li JOIN c ON qty >= lo AND (hi IS NULL OR qty < hi) GROUP BY cohort")
def cohort_membership(spark, sf_dir):
    dim = spark.createDataFrame([("small", 0, 10), ("middle", 10, 30), ("large", 30, None), ("most", 5, None)], "cohort string, lo long, hi long")
    return lookups.cohort_of(lines(spark, sf_dir), "qty", dim).groupBy("cohort").agg(F.count("*").alias("n"), F.sum("cents").alias("sats"))


# -------------------------------------------------------------------------------------------------------------------- 2.11


@query(f"""WITH {OUT}, e AS (SELECT kind, created_h AS height, 1 AS sign, sats, price_in FROM lives UNION ALL SELECT kind, spent_h, -1, sats, price_in FROM lives WHERE spent_h IS NOT NULL),
    d AS (SELECT kind, height, sum(sign * sats) AS ds, sum(sign) AS dn, count(*) FILTER (sign < 0) AS dx, sum(sign * price_in::HUGEINT * sats) AS dc, sum(sign * price_in::HUGEINT * price_in * sats) AS dc2 FROM e GROUP BY ALL),
    r AS (SELECT kind, height, sum(ds) OVER w AS supply, sum(dn) OVER w AS utxo_count, sum(dx) OVER w AS spent_count, sum(dc) OVER w AS cap, sum(dc2) OVER w AS cap2 FROM d WINDOW w AS (PARTITION BY kind ORDER BY height))
    SELECT kind, height::BIGINT AS height, supply::BIGINT AS supply, utxo_count::BIGINT AS utxo_count, spent_count::BIGINT AS spent_count, (cap // 100000000)::BIGINT AS realized_cap, (cap2 // 100000000)::BIGINT AS capitalized_cap FROM r""")
def ledger_state(spark, sf_dir):
    s = chain.state_by_height(outputs(spark, sf_dir), ["kind"])
    return s.withColumns({c: F.col(c).cast("long") for c in ("realized_cap", "capitalized_cap")})


@query(f"""WITH {OUT}, s AS (SELECT * FROM lives WHERE spent_h IS NOT NULL) SELECT spent_h::BIGINT AS height, (sum(greatest(price_out - price_in, 0)::HUGEINT * sats) // 100000000)::BIGINT AS profit, (sum(greatest(price_in - price_out, 0)::HUGEINT * sats) // 100000000)::BIGINT AS loss,
    (sum(price_out::HUGEINT * sats) // 100000000)::BIGINT AS transfer_value, (sum(price_in::HUGEINT * sats) // 100000000)::BIGINT AS value_destroyed, sum(CASE WHEN price_out >= price_in THEN sats ELSE 0 END)::BIGINT AS sent_in_profit, sum(CASE WHEN price_out < price_in THEN sats ELSE 0 END)::BIGINT AS sent_in_loss,
    {sc("sum(sats::DOUBLE * (spent_ts - created_ts)) / 86400.0", 1)} AS satdays_destroyed FROM s GROUP BY 1""")
def realized_profit_and_loss(spark, sf_dir):
    r = chain.realized(outputs(spark, sf_dir))
    return r.select("height", *(F.col(c).cast("long") for c in ("profit", "loss", "transfer_value", "value_destroyed")), "sent_in_profit", "sent_in_loss", scaled(F.col("satdays_destroyed"), 1).alias("satdays_destroyed"))


@query(f"""WITH {OUT}, k AS (SELECT DISTINCT created_h, spent_h FROM lives WHERE spent_h IS NOT NULL), u AS (SELECT created_h, spent_h, unnest(range(created_h, spent_h + 1)) AS idx FROM k),
    p AS (SELECT created_h, spent_h, max(price) AS peak FROM u JOIN ev USING (idx) GROUP BY ALL)
    SELECT spent_h::BIGINT AS height, (sum((peak - price_out)::HUGEINT * sats) // 100000000)::BIGINT AS peak_regret FROM lives JOIN p USING (created_h, spent_h) GROUP BY 1""")
def peak_regret(spark, sf_dir):
    return chain.peak_regret(outputs(spark, sf_dir), blocks(spark, sf_dir).select("idx", "price")).select("height", F.col("peak_regret").cast("long"))


_BANDS = [("under_6h", 0, 6), ("6h_1d", 6, 24), ("over_1d", 24, None)]


@query(f"""WITH {OUT}, bands(cohort, lo, hi) AS (VALUES ('under_6h', 0, 6), ('6h_1d', 6, 24), ('over_1d', 24, NULL)), t AS (SELECT ts, min(idx) AS idx FROM ev GROUP BY ts),
    g AS (SELECT cohort, created_h, spent_h, created_ts + lo * 3600 AS young, created_ts + hi * 3600 AS old, sum(sats) AS sats FROM lives, bands GROUP BY ALL),
    y AS (SELECT g.*, t.idx AS enters FROM g ASOF JOIN t ON g.young <= t.ts), z AS (SELECT y.*, t.idx AS leaves FROM y ASOF LEFT JOIN t ON y.old <= t.ts),
    d AS (SELECT cohort, greatest(enters, created_h) AS a, least(leaves, spent_h) AS b, sats FROM z),
    c AS (SELECT cohort, a AS height, sats FROM d WHERE b IS NULL OR b > a UNION ALL SELECT cohort, b, -sats FROM d WHERE b > a UNION ALL SELECT cohort, idx, 0 FROM ev, bands),
    s AS (SELECT cohort, height, sum(sats) AS sats FROM c GROUP BY ALL)
    SELECT cohort, height::BIGINT AS height, (sum(sats) OVER (PARTITION BY cohort ORDER BY height))::BIGINT AS supply FROM s""")
def supply_by_age(spark, sf_dir):
    """The supply of each band at every height."""
    b = blocks(spark, sf_dir).select(F.col("idx").alias("height"), "ts")
    known = chain.age_supply(outputs(spark, sf_dir), b, _BANDS).select("cohort", "height", "supply")
    every = b.select("height").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n, _, _ in _BANDS], "cohort string")))
    held = running(every.join(known, ["cohort", "height"], "left"), {"held": ("last", F.col("supply"))}, ["cohort"], "height")
    return held.select("cohort", "height", F.coalesce("held", F.lit(0)).alias("supply"))


@query(f"""WITH {OUT} SELECT addr, count(*) AS funded_txos, count(spent_h) AS spent_txos, sum(sats)::BIGINT AS received, sum(CASE WHEN spent_h IS NULL THEN 0 ELSE sats END)::BIGINT AS sent, min(created_h)::BIGINT AS first_h, sum(CASE WHEN spent_h IS NULL THEN sats ELSE 0 END)::BIGINT AS balance, count(*) = count(spent_h) AS is_empty, count(*) > 1 AS reused FROM lives GROUP BY addr""")
def address_state(spark, sf_dir):
    return chain.address_state(outputs(spark, sf_dir), "addr")


_ADDR = f"""{OUT}, ae AS (SELECT addr, created_h AS height, 1 AS r, 0 AS s FROM lives UNION ALL SELECT addr, spent_h, 0, 1 FROM lives WHERE spent_h IS NOT NULL), ag AS (SELECT addr, height, sum(r) AS r, sum(s) AS s FROM ae GROUP BY ALL),
    ar AS (SELECT *, sum(r - s) OVER (PARTITION BY addr ORDER BY height) AS after FROM ag), am AS (SELECT *, after - r + s AS before, min(CASE WHEN r > 0 THEN height END) OVER (PARTITION BY addr) AS f FROM ar)"""


@query(f"""WITH {_ADDR} SELECT height::BIGINT AS height, count(*) FILTER (r > 0) AS receiving, count(*) FILTER (s > 0) AS sending, count(*) FILTER (r > 0 AND s > 0) AS bidirectional, count(*) AS active, count(*) FILTER (before = 0 AND f < height AND after > 0) AS reactivated, count(*) FILTER (f = height) AS new FROM am GROUP BY height""")
def address_activity(spark, sf_dir):
    return chain.address_activity(outputs(spark, sf_dir, priced=False), "addr")


@query(f"""WITH {_ADDR}, d AS (SELECT height, sum((after > 0)::INT - (before > 0)::INT) AS df, count(*) FILTER (f = height) AS dt FROM am GROUP BY height) SELECT height::BIGINT AS height, sum(dt) OVER w::BIGINT AS total, sum(df) OVER w::BIGINT AS funded, sum(dt - df) OVER w::BIGINT AS empty FROM d WINDOW w AS (ORDER BY height)""")
def address_counts(spark, sf_dir):
    return chain.address_counts(outputs(spark, sf_dir, priced=False), "addr")


@query(f"WITH {OUT}, r AS (SELECT created_h, row_number() OVER (PARTITION BY addr ORDER BY created_h, part, sats) AS n FROM lives) SELECT created_h::BIGINT AS height, count(*) AS reuses FROM r WHERE n > 1 GROUP BY 1")
def address_reuse(spark, sf_dir):
    rows = outputs(spark, sf_dir).withColumn("order", F.struct("created_h", "part", "sats"))
    return chain.reuse_events(rows, "addr", "order")


_INV = f"{OUT}, inv AS (SELECT kind, price_in AS price, sum(sats) AS sats FROM lives WHERE created_h <= 800 AND (spent_h IS NULL OR spent_h > 800) GROUP BY ALL)"


@query(f"""WITH {_INV}, r AS (SELECT *, sum(sats) OVER (PARTITION BY kind ORDER BY price) AS cum, sum(sats) OVER (PARTITION BY kind) AS a FROM inv)
    SELECT kind, min(price) AS lowest, {", ".join(f"min(CASE WHEN cum > greatest(a * {p} // 100 - 1, 0) THEN price END) AS p{p:02d}" for p in range(5, 100, 5))}, max(price) AS highest FROM r GROUP BY kind""")
def cost_basis_quantiles(spark, sf_dir):
    return chain.basis_quantiles(chain.inventory(outputs(spark, sf_dir), 800, ["kind"]), list(range(5, 100, 5)), ["kind"])


@query(f"""WITH {_INV} SELECT kind, CASE WHEN price <= 0 THEN 0 ELSE round(10 ** (floor(log10(price) * 50) / 50)) END::BIGINT AS bucket, sum(sats)::BIGINT AS sats, floor(sum(price::HUGEINT * sats) / 100000000)::BIGINT AS realized_cap, floor(sum((5000 - price)::HUGEINT * sats) / 100000000)::BIGINT AS unrealized FROM inv GROUP BY ALL""")
def urpd(spark, sf_dir):
    return chain.urpd(chain.inventory(outputs(spark, sf_dir), 800, ["kind"]), 5000, S.log_floor(F.col("price"), 50), ["kind"])


@query(f"""WITH {_INV} SELECT kind, ({" + ".join(f"(5000 * 100 - price * 100 >= {e} * price)::INT" for e in chain.PROFIT_EDGES)})::INTEGER AS range, sum(sats)::BIGINT AS sats FROM inv GROUP BY ALL""")
def profitability_ranges(spark, sf_dir):
    return chain.profitability(chain.inventory(outputs(spark, sf_dir), 800, ["kind"]), 5000, ["kind"])


@query(f"""WITH {_INV} SELECT kind, sum(CASE WHEN 5000 >= price THEN sats ELSE 0 END)::BIGINT AS supply_in_profit, sum(CASE WHEN 5000 < price THEN sats ELSE 0 END)::BIGINT AS supply_in_loss, (sum(CASE WHEN 5000 >= price THEN price::HUGEINT * sats ELSE 0 END) // 100000000)::BIGINT AS invested_in_profit,
    (sum(CASE WHEN 5000 < price THEN price::HUGEINT * sats ELSE 0 END) // 100000000)::BIGINT AS invested_in_loss, (sum(greatest(5000 - price, 0)::HUGEINT * sats) // 100000000)::BIGINT AS unrealized_profit, (sum(greatest(price - 5000, 0)::HUGEINT * sats) // 100000000)::BIGINT AS unrealized_loss,
    {sc("sum(CASE WHEN price * 100 BETWEEN 5000 * 95 AND 5000 * 105 THEN sats ELSE 0 END) / sum(sats)", 10**6)} AS density_e6 FROM inv GROUP BY kind""")
def unrealized_state(spark, sf_dir):
    inv = chain.inventory(outputs(spark, sf_dir), 800, ["kind"])
    u = chain.unrealized(inv, F.lit(5000), ["kind"])
    d = chain.density(inv, F.lit(5000), ["kind"]).select("kind", scaled(F.col("density"), 10**6).alias("density_e6"))
    return u.select("kind", *(F.col(c).cast("long") for c in u.columns[1:])).join(d, "kind")


@query(f"""WITH {OUT}, h AS (SELECT unnest([100, 400, 800]) AS height) SELECT height::BIGINT AS height, price_in AS price, sum(sats)::BIGINT AS sats FROM lives, h WHERE created_h <= height AND (spent_h IS NULL OR spent_h > height) GROUP BY ALL""")
def cost_basis_snapshots(spark, sf_dir):
    heights = spark.createDataFrame([(100,), (400,), (800,)], "height long")
    return chain.inventories(outputs(spark, sf_dir), heights)


@query(f"""WITH {_INV}, p(kind, parent) AS (VALUES ('A', 'all'), ('N', 'all'), ('R', 'all'), ('A', 'closed'), ('R', 'closed')) SELECT parent, 800::BIGINT AS height, sum(sats)::BIGINT AS sats FROM inv JOIN p USING (kind) GROUP BY parent""")
def parent_cohorts(spark, sf_dir):
    parents = spark.createDataFrame([("A", "all"), ("N", "all"), ("R", "all"), ("A", "closed"), ("R", "closed")], "cohort string, parent string")
    parts = chain.inventory(outputs(spark, sf_dir), 800, ["kind"]).groupBy(F.col("kind").alias("cohort")).agg(F.sum("sats").alias("sats")).withColumn("height", F.lit(800).cast("long"))
    return chain.parent_sums(parts, parents, ["sats"])


# -------------------------------------------------------------------------------------------------------------------- 2.12


@query(f"WITH {EV} SELECT idx, coalesce(greatest(ts - lag(ts) OVER (ORDER BY idx), 0), 0)::BIGINT AS interval, (2016 - idx % 2016)::BIGINT AS blocks_to_retarget, (210000 - idx % 210000)::BIGINT AS blocks_to_halving, (5000000000 >> least(idx // 210000, 63)::INTEGER)::BIGINT AS subsidy FROM ev")
def block_intervals(spark, sf_dir):
    b = network.intervals(blocks(spark, sf_dir))
    r = network.retarget(F.col("idx"))
    return b.select("idx", "interval", r["blocks_to_retarget"].alias("blocks_to_retarget"), r["blocks_to_halving"].alias("blocks_to_halving"), network.subsidy_at(F.col("idx")).alias("subsidy"))


@query(f"WITH {EV}, e AS (SELECT idx // 2016 AS epoch, arg_min(price, idx) AS difficulty FROM ev GROUP BY 1) SELECT epoch::BIGINT AS epoch, difficulty, {sc('CASE WHEN lag(difficulty) OVER w > 0 THEN difficulty / lag(difficulty) OVER w - 1 END')} AS adjustment_e4 FROM e WINDOW w AS (ORDER BY epoch)")
def difficulty_adjustments(spark, sf_dir):
    a = network.adjustments(blocks(spark, sf_dir).withColumnRenamed("price", "difficulty"))
    return a.select("epoch", "difficulty", scaled(F.col("adjustment")).alias("adjustment_e4"))


@query(f"""WITH {LI}, s AS (SELECT parent, count(*) FILTER (flag = 'R') AS i, count(*) FILTER (flag <> 'R') AS o, count(supplier) AS na, count(DISTINCT supplier) AS nd, count(DISTINCT qty) FILTER (qty <> 0) AS nv, count(*) FILTER (qty = 0) AS nz FROM li GROUP BY parent),
    c AS (SELECT *, i >= 5 * o AND o > 0 AS cons, o >= 5 * i AND i > 0 AS pay FROM s) SELECT parent AS tx_idx, cons AS consolidation, pay AS batch_payout, i >= 5 AND o >= 5 AND NOT cons AND NOT pay AND na = nd AND 2 * (nv + nz) <= i + o AS coinjoin FROM c""")
def transaction_patterns(spark, sf_dir):
    li = lines(spark, sf_dir)
    sides = li.select(F.col("parent").alias("tx_idx"), F.when(F.col("flag") == "R", "in").otherwise("out").alias("side"), F.col("qty").alias("sats"), F.col("supplier").alias("addr"))
    txs = li.select(F.col("parent").alias("tx_idx")).distinct().withColumns({"is_coinbase": F.lit(False), "has_token": F.lit(False)})
    return network.patterns(txs, sides)


@query(f"""WITH {LI}, o AS (SELECT o_orderkey AS tx_idx, 100 + o_orderkey % 50 AS vsize, o_orderkey % 100 = 0 AS cb FROM orders), i AS (SELECT parent AS tx_idx, sum(cents) AS v FROM li GROUP BY 1), u AS (SELECT parent AS tx_idx, sum(cents - qty) AS v FROM li GROUP BY 1)
    SELECT tx_idx, coalesce(i.v, 0)::BIGINT AS input_value, coalesce(u.v, 0)::BIGINT AS output_value, CASE WHEN cb THEN 0 ELSE coalesce(i.v, 0) - coalesce(u.v, 0) END::BIGINT AS fee, {sc("CASE WHEN cb THEN 0 ELSE coalesce(i.v, 0) - coalesce(u.v, 0) END / vsize")} AS fee_rate_e4 FROM o LEFT JOIN i USING (tx_idx) LEFT JOIN u USING (tx_idx)""")
def transaction_fees(spark, sf_dir):
    li = lines(spark, sf_dir)
    txs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_idx"), (100 + F.col("o_orderkey") % 50).alias("vsize"), (F.col("o_orderkey") % 100 == 0).alias("is_coinbase"))
    r = network.transaction_fees(txs, li.select(F.col("parent").alias("tx_idx"), F.col("cents").alias("sats")), li.select(F.col("parent").alias("tx_idx"), (F.col("cents") - F.col("qty")).alias("sats")))
    return r.select("tx_idx", "input_value", "output_value", "fee", scaled(F.col("fee_rate")).alias("fee_rate_e4"))


@query(f"WITH {LI} SELECT height, kind, n, {sc('n / sum(n) OVER (PARTITION BY height)')} AS share_e4 FROM (SELECT parent AS height, flag AS kind, count(*) AS n FROM li GROUP BY ALL)")
def outputs_by_type(spark, sf_dir):
    t = network.by_type(lines(spark, sf_dir).select(F.col("parent").alias("height"), F.col("flag").alias("kind")), "height", "kind")
    return t.select("height", "kind", "n", scaled(F.col("share")).alias("share_e4"))


@query(f"""WITH {STARTED}, c AS (SELECT a.*, a.idx - a.start + 1 AS n FROM started a), h AS (SELECT idx, n / 144 * (price * 4294967296.0 / 600) AS r FROM c) SELECT idx, {sc("r / 1e6", 1)} AS hash_rate, {sc("max(r) OVER (ORDER BY idx) / 1e6", 1)} AS hash_rate_ath FROM h""")
def hash_rate(spark, sf_dir):
    h = network.hash_rate(blocks(spark, sf_dir).withColumnRenamed("price", "difficulty"), days=())
    return h.select("idx", scaled(F.col("hash_rate") / 1e6, 1).alias("hash_rate"), scaled(F.col("hash_rate_ath") / 1e6, 1).alias("hash_rate_ath"))


@query(f"""WITH {EV}, d AS (SELECT ((ts - 1230768000) // 86400)::BIGINT AS idx, arg_max(price, idx) AS price FROM ev GROUP BY 1), s AS (SELECT *, CASE WHEN price = 0 THEN 0 ELSE 10000 * 100000000::HUGEINT // price END::BIGINT AS sats FROM d),
    w AS (SELECT idx, sum(sats) OVER (ORDER BY idx ROWS 6 PRECEDING)::BIGINT AS stack, (10000 * least(7, idx - (SELECT min(idx) FROM d) + 1))::BIGINT AS invested FROM s) SELECT idx, stack, invested, {sc("invested * 1e8 / stack", 100)} AS basis_e2 FROM w""")
def dollar_cost_averaging(spark, sf_dir):
    d = market.dca(blocks(spark, sf_dir), 7)
    return d.select("idx", "stack", F.col("invested").cast("long"), scaled(F.col("basis"), 100).alias("basis_e2"))


@query(f"""WITH {STARTED}, r AS (SELECT a.idx, a.ts, CASE WHEN b.price = 0 THEN 0 ELSE (a.price - b.price) / b.price END AS ret FROM started a JOIN ev b ON b.idx = a.start), w AS (SELECT *, min(idx) OVER (ORDER BY ts RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW) AS s7 FROM r)
    SELECT a.idx, {sc("stddev_pop(b.ret) * sqrt(7)", 100)} AS volatility_e2 FROM w a JOIN w b ON b.idx BETWEEN a.s7 AND a.idx GROUP BY a.idx""")
def volatility(spark, sf_dir):
    v = market.volatility(blocks(spark, sf_dir), 7)
    return v.select("idx", scaled(F.col("volatility"), 100).alias("volatility_e2"))


@query(None)
def technical_indicators(spark, sf_dir):
    """RSI, its stochastic, MACD, pi cycle and choppiness; tests hold them against plain loops."""
    b = blocks(spark, sf_dir).select("idx", "ts", "price")
    r = market.technical(b)
    return r.select("idx", *(scaled(F.col(c)).alias(f"{c}_e4") for c in ("rsi", "k", "d", "macd", "signal", "histogram", "pi_cycle", "choppiness")))


@query(f"""WITH {EV}, r AS (SELECT idx, price::DOUBLE AS created, CASE WHEN user_id % 2 = 0 THEN price / 2.0 ELSE 0 END AS destroyed, user_id FROM ev), c AS (SELECT *, sum(created) OVER (ORDER BY idx) AS c, sum(destroyed) OVER (ORDER BY idx) AS d FROM r)
    SELECT idx, {sc("d / c", 10**6)} AS liveliness_e6, {sc("1 - d / c", 10**6)} AS vaultedness_e6, {sc("1000 * d / c")} AS active_cap_e4, {sc("(1000 - 400) * 1.0")} AS investor_cap_e4 FROM c""")
def cointime(spark, sf_dir):
    p = F.col("price").cast("double")
    rows = blocks(spark, sf_dir).select("idx", p.alias("created"), F.when(F.col("user_id") % 2 == 0, p / 2).otherwise(0.0).alias("destroyed"), F.lit(1000.0).alias("realized_cap"), F.lit(400.0).alias("thermo_cap"), F.lit(2000.0).alias("market_cap"), F.lit(100.0).alias("supply"), p.alias("price"))
    c = frameworks.cointime(rows)
    return c.select("idx", scaled(F.col("liveliness"), 10**6).alias("liveliness_e6"), scaled(F.col("vaultedness"), 10**6).alias("vaultedness_e6"), scaled(F.col("active_cap")).alias("active_cap_e4"), scaled(F.col("investor_cap")).alias("investor_cap_e4"))


@query(f"""WITH {LI}, b AS (SELECT supplier, qty::DOUBLE AS x, exp(-0.01 * qty) * (1 + part % 7) AS h, cents::DOUBLE AS w FROM li), f AS (SELECT supplier, sum(w) AS w, sum(w * x) AS wx, sum(w * ln(h)) AS wy, sum(w * x * x) AS wxx, sum(w * x * ln(h)) AS wxy FROM b GROUP BY 1)
    SELECT supplier, {sc("CASE WHEN w * wxx - wx * wx = 0 THEN 0 ELSE (w * wxy - wx * wy) / (w * wxx - wx * wx) END")} AS slope_e4 FROM f""")
def hazard_decay(spark, sf_dir):
    b = lines(spark, sf_dir).select("supplier", F.col("qty").cast("double").alias("age"), (F.exp(-0.01 * F.col("qty")) * (1 + F.col("part") % 7)).alias("hazard"), F.col("cents").cast("double").alias("weight"))
    return frameworks.decay_fit(b, ["supplier"]).select("supplier", scaled(F.col("slope")).alias("slope_e4"))


@query(f"""WITH {_INV}, r AS (SELECT *, sum(sats) OVER (PARTITION BY kind ORDER BY price) AS cum, sum(sats) OVER (PARTITION BY kind) AS a FROM inv) SELECT kind, min(CASE WHEN (a - cum) / a <= 0.3 THEN price END) AS floor FROM r GROUP BY kind""")
def floor_price(spark, sf_dir):
    return frameworks.floor_price(chain.inventory(outputs(spark, sf_dir), 800, ["kind"]), F.lit(0.3), ["kind"])


_FLOORS = f"""{LI}, inv AS (SELECT supplier, cents // 10000 AS price, sum(qty) AS sats FROM li GROUP BY ALL),
    f AS (SELECT supplier, min(CASE WHEN (a - cum) / a <= 0.3 THEN price END) AS floor FROM (SELECT *, sum(sats) OVER (PARTITION BY supplier ORDER BY price) AS cum, sum(sats) OVER (PARTITION BY supplier) AS a FROM inv) GROUP BY supplier),
    k AS (SELECT supplier, floor, price, sum(sats) OVER (PARTITION BY supplier ORDER BY price) AS cum, sum(sats) OVER (PARTITION BY supplier) AS a FROM inv JOIN f USING (supplier) WHERE price >= floor)"""


@query(f"""WITH {_FLOORS} SELECT supplier, floor, {", ".join(f"min(CASE WHEN cum >= a * {p}::DOUBLE THEN price END) AS level_{round(100 * p)}" for p in frameworks.LEVELS)} FROM k GROUP BY ALL""")
def floor_levels(spark, sf_dir):
    """The floor of each supplier's amounts, and levels of what lies above."""
    inv = lines(spark, sf_dir).groupBy("supplier", F.floor(F.col("cents") / 10_000).alias("price")).agg(F.sum("qty").alias("sats"))
    return frameworks.levels_above(inv, frameworks.floor_price(inv, F.lit(0.3), ["supplier"]), ["supplier"])


@query(f"""WITH {EV}, d AS (SELECT ((ts - 1230768000) // 86400)::BIGINT AS day, max_by(price, idx)::DOUBLE AS price, count(*) AS n FROM ev GROUP BY 1)
    SELECT day, {sc("CASE WHEN row_number() OVER (ORDER BY day) > 5 THEN quantile_cont(price, 0.95) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END")} AS p95_e4 FROM d""")
def expanding_quantiles(spark, sf_dir):
    """Of each day, the 95th percentile of the closing prices of the days before, once there are five."""
    d = blocks(spark, sf_dir).groupBy(calendar.bucket(F.col("ts"), "day1").alias("day")).agg(F.max_by("price", "idx").cast("double").alias("price"))
    return frameworks.expanding_quantile(d, "price", 0.95, "q", "day", least=5).select("day", scaled(F.col("q")).alias("p95_e4"))


@query(None)
def rarity_bands(spark, sf_dir):
    """Ten bands of the price over 10,000 for each kind of event, and the score; tests hold the bands against a fold."""
    rows = blocks(spark, sf_dir).select("kind", "idx", "price", (F.col("price") / 10_000).alias("ratio"))
    r = frameworks.decayed_bands(rows, "ratio", frameworks.BANDS, ["kind"], half_life=2000, since=1000)
    price = {q: F.floor(F.col(q) * 10_000 + 0.5).cast("long") for q in frameworks.BANDS}
    names = list(frameworks.BANDS)
    score = frameworks.rarity_score(F.col("price"), [price[q] for q in names[:5]], [price[q] for q in names[5:]])
    return r.select("kind", "idx", *(price[q].alias(q) for q in names), frameworks.inner_percentile(price["p5"], price["p95"], 50).alias("inner_50"), score.alias("score"))


@query(f"""WITH {OUT}, r AS (SELECT spent_h AS idx, (sum(price_out::HUGEINT * sats) // 100000000)::BIGINT AS tv, (sum(price_in::HUGEINT * sats) // 100000000)::BIGINT AS vd FROM lives WHERE spent_h IS NOT NULL GROUP BY 1),
    t AS (SELECT r.*, ev.ts, row_number() OVER (ORDER BY idx) AS n, sum(tv) OVER (ORDER BY idx) AS ct, sum(vd) OVER (ORDER BY idx) AS cv FROM r JOIN ev USING (idx)),
    s AS (SELECT *, min(n) OVER (ORDER BY ts RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS start FROM t), w AS (SELECT a.idx, a.ct - coalesce(b.ct, 0) AS tv, a.cv - coalesce(b.cv, 0) AS vd FROM s a LEFT JOIN t b ON b.n = a.start - 1)
    SELECT idx::BIGINT AS idx, {sc("CASE WHEN vd = 0 THEN 0 ELSE tv / vd END")} AS sopr_e4 FROM w""")
def spent_output_profit_ratio(spark, sf_dir):
    r = chain.realized(outputs(spark, sf_dir)).withColumnRenamed("height", "idx").join(blocks(spark, sf_dir).select("idx", "ts"), "idx")
    r = r.select("idx", "ts", *(F.col(c).cast("long") for c in ("transfer_value", "value_destroyed", "profit", "loss")), F.lit(1).alias("realized_cap"), F.lit(1).alias("supply"), F.lit(1).alias("price"), F.col("sent_in_profit").alias("satdays_destroyed"), F.col("sent_in_loss").alias("volume"))
    return frameworks.realized_metrics(r, DAY).select("idx", scaled(F.col("sopr")).alias("sopr_e4"))


# -------------------------------------------------------------------------------------------------------------------- 2.13


def _snapshot(spark, sf_dir, shift: int) -> DataFrame:
    """Orders as unconfirmed transactions: parents are the order ten before, an outpoint is a part."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).filter(f"(k + {shift}) % 5 <> 0")
    spends = lines(spark, sf_dir).groupBy(F.col("parent").alias("k")).agg(F.sort_array(F.collect_set(F.concat(F.col("part").cast("string"), F.lit(":0")))).alias("spends"))
    none = F.array().cast("array<string>")
    return o.join(spends, "k", "left").select(F.col("k").cast("string").alias("txid"), (F.col("k") * 7919 % 5000 + 100).alias("fee"), (100 + F.col("k") % 400).alias("vsize"), F.when(F.col("k") % 10 != 0, F.array((F.col("k") - 1).cast("string"))).otherwise(none).alias("parents"), F.coalesce("spends", none).alias("spends"))


@query(f"""WITH {LI}, o AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k FROM o WHERE (k + 0) % 5 <> 0), b AS (SELECT k FROM o WHERE (k + 1) % 5 <> 0), added AS (SELECT k, k % 3 = 0 AS known FROM b WHERE k NOT IN (FROM a)), removed AS (SELECT k FROM a WHERE k NOT IN (FROM b)),
    sp AS (SELECT DISTINCT parent AS k, part FROM li), hit AS (SELECT DISTINCT r.k FROM removed r JOIN sp s ON s.k = r.k JOIN sp t ON t.part = s.part JOIN added d ON d.k = t.k AND NOT d.known)
    SELECT k::VARCHAR AS txid, CASE WHEN known THEN 'revived' ELSE 'fresh' END AS change FROM added UNION ALL SELECT k::VARCHAR, CASE WHEN k IN (FROM hit) THEN 'replaced' ELSE 'vanished' END FROM removed""")
def mempool_diff(spark, sf_dir):
    before, after = _snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1)
    buried = after.filter("cast(txid as long) % 3 = 0").select("txid")
    return mempool.diff(before, after, buried).select("txid", "change")


@query(None)
def mempool_blocks(spark, sf_dir):
    """Clusters, their chunks, and the block of each transaction; tests hold them against a plain loop."""
    s = _snapshot(spark, sf_dir, 0)
    return mempool.pack_blocks(mempool.linearize(s), s, most=20_000).select("txid", "block", scaled(F.col("chunk_rate")).alias("rate_e4"))


_BLOCK_AT = lambda p: f"min(CASE WHEN upto >= floor(total * {p / 100} + 0.5) THEN rate END)"


@query(f"""WITH t AS (SELECT o_orderkey::VARCHAR AS txid, o_orderkey * 7919 % 5000 + 100 AS fee, 100 + o_orderkey % 400 AS vsize FROM orders), r AS (SELECT *, fee / vsize AS rate FROM t),
    p AS (SELECT *, least((sum(vsize) OVER (ORDER BY rate DESC, txid ROWS UNBOUNDED PRECEDING) - vsize) // 500000, 7) AS block FROM r),
    c AS (SELECT *, sum(vsize) OVER (PARTITION BY block ORDER BY rate) AS upto, sum(vsize) OVER (PARTITION BY block) AS total FROM p)
    SELECT block::INTEGER AS block, count(*) AS n, sum(fee)::BIGINT AS fee, sum(vsize)::BIGINT AS size, {sc(_BLOCK_AT(50))} AS median_e4, CASE WHEN block = 0 THEN {sc(_BLOCK_AT(0))} ELSE {sc(_BLOCK_AT(5))} END AS low_e4, {sc(_BLOCK_AT(25))} AS p25_e4, {sc(_BLOCK_AT(90))} AS p90_e4, CASE WHEN block = 0 THEN {sc(_BLOCK_AT(100))} ELSE {sc(_BLOCK_AT(95))} END AS high_e4 FROM c GROUP BY block""")
def projected_blocks(spark, sf_dir):
    """Statistics of the blocks to come of all orders, none of them with a parent."""
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(k.cast("string").alias("txid"), (k * 7919 % 5000 + 100).alias("fee"), (100 + k % 400).alias("vsize"), F.array().cast("array<string>").alias("parents"))
    r = mempool.block_stats(mempool.pack_blocks(mempool.linearize(t), t, most=500_000), t)
    at = {"median_e4": F.col("median"), "low_e4": F.col("fee_range")[0], "p25_e4": F.col("fee_range")[2], "p90_e4": F.col("fee_range")[5], "high_e4": F.col("fee_range")[6]}
    return r.select("block", "n", "fee", "size", *(scaled(c).alias(n) for n, c in at.items()))


@query("WITH o AS (SELECT o_orderkey AS k FROM orders), a AS (FROM o WHERE k % 5 <> 0), b AS (FROM o WHERE (k + 1) % 5 <> 0) SELECT coalesce(a.k, b.k)::VARCHAR AS txid, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' ELSE 'retained' END AS state FROM a FULL JOIN b ON a.k = b.k")
def template_diff(spark, sf_dir):
    return mempool.template_diff(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1))


@query("WITH RECURSIVE l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 9 THEN o_orderkey + 1 END AS nxt FROM orders WHERE o_orderkey % 10 < 9) SELECT k::VARCHAR AS txid, (k // 10 * 10 + 9)::VARCHAR AS root FROM l")
def replacement_roots(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderkey % 10 < 9")
    return mempool.replacement_roots(o.select(F.col("o_orderkey").cast("string").alias("txid"), (F.col("o_orderkey") + 1).cast("string").alias("by")))


_SIZE = "(10 ** (length(cents::VARCHAR) - 1))::BIGINT"
_PAID = f"""{LI}, t AS (SELECT parent FROM li GROUP BY 1 HAVING count(*) <= 5 AND max((flag = 'A')::INT) = 0),
    m AS (SELECT parent, cents, flag, {_SIZE} AS size, (cents + {_SIZE} // 2) // {_SIZE} AS near FROM li),
    paid AS (SELECT parent, round(log10(cents) * 200)::INTEGER AS bin FROM m WHERE parent IN (FROM t) AND flag <> 'R' AND cents >= 1000 AND NOT (near IN (1, 2, 3, 5, 6, 10) AND abs(cents - near * size) * 1000 <= near * size))"""


def _payments(spark, sf_dir) -> DataFrame:
    """Order lines as outputs, 20 orders a block, of orders of at most five lines and none of them data."""
    kind = F.when(F.col("flag") == "A", "op_return").when(F.col("flag") == "R", "p2tr").otherwise("p2wpkh")
    o = lines(spark, sf_dir).select(F.floor(F.col("parent") / 20).alias("height"), F.col("parent").alias("tx_idx"), F.col("cents").alias("sats"), kind.alias("output_type"))
    return price.payments(o, few=5)


@query(f"WITH {_PAID} SELECT bin, count(*) AS n FROM paid GROUP BY 1")
def price_histogram(spark, sf_dir):
    return _payments(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"))


@query(None)
def price_from_outputs(spark, sf_dir):
    """The price of every block, the first 400 by the search that learns a shape; tests hold it against a fold written out."""
    rows = cut(price.histograms(_payments(spark, sf_dir)))
    out, _ = price.estimate(rows, rows.agg(F.max("height")).first()[0] + 1, price.State(0, 1200.0), fast_from=400)
    return out.select("height", scaled(F.col("bin")).alias("bin_e4"), "cents")


_STAYS = """c AS (SELECT o_orderkey AS k, o_orderkey % 40 AS a, 1 + o_orderkey % 6 AS s FROM orders),
    snap AS (SELECT DISTINCT k, unnest(range(a, a + s)) AS c FROM c UNION SELECT k, unnest(range(a + s + 1 + k % 5 * 20, a + s + 2 + k % 5 * 20 + k % 4)) FROM c WHERE k % 3 = 0),
    n AS (SELECT *, lag(c) OVER w AS b, lead(c) OVER w AS e, max(c) OVER () AS last FROM snap WINDOW w AS (PARTITION BY k ORDER BY c)),
    changes AS (SELECT k, c AS cycle, CASE WHEN c - b < 62 THEN 'revived' ELSE 'fresh' END AS change FROM n WHERE b IS NULL OR c > b + 1
                UNION ALL SELECT k, c + 1, 'vanished' FROM n WHERE (e IS NULL OR e > c + 1) AND c + 1 <= last)"""


def _pool_snapshots(spark, sf_dir) -> DataFrame:
    """Orders as unconfirmed transactions, a snapshot a minute: each stays for some, every third comes back a while later."""
    li = lines(spark, sf_dir).groupBy(F.col("parent").alias("k")).agg(F.sort_array(F.collect_list(S.log_bin(F.col("cents")))).alias("raw"))
    k = F.col("k")
    a, s = k % 40, 1 + k % 6
    again = a + s + 1 + k % 5 * 20
    stays = F.concat(F.sequence(a, a + s - 1), F.when(k % 3 == 0, F.sequence(again, again + k % 4)).otherwise(F.array().cast("array<bigint>")))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(li, "k", "left")
    at = F.timestamp_add("MINUTE", F.col("c").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return o.select(k.cast("string").alias("txid"), "raw", F.explode(F.array_distinct(stays)).alias("c")).select("txid", at.alias("at"), "raw")


def _by_cycle(found: DataFrame) -> DataFrame:
    cycle = F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp"), F.col("at"))
    return found.select("txid", cycle.alias("cycle"), "change")


@query(f"WITH {_STAYS} SELECT k::VARCHAR AS txid, cycle::BIGINT AS cycle, change FROM changes")
def pool_changes(spark, sf_dir):
    return _by_cycle(pool.changes(_pool_snapshots(spark, sf_dir), 60))


@query(f"WITH {_STAYS} SELECT k::VARCHAR AS txid, cycle::BIGINT AS cycle, change FROM changes")
def pool_changes_streamed(spark, sf_dir):
    """The same from a stream of snapshots that stops after half an hour of them and starts again."""
    rows = _pool_snapshots(spark, sf_dir)
    to = f"{shared_folder(spark)}/pool-{uuid.uuid4()}"
    late = F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp"), F.col("at"))
    for a, z in ((0, 30), (30, 1 << 30)):
        rows.filter((late >= a) & (late < z)).write.mode("append").parquet(f"{to}/in")
        pool.run_changes(spark.readStream.schema(rows.schema).parquet(f"{to}/in"), 60, f"{to}/out", f"{to}/marks")
    return _by_cycle(pool.stored_changes(spark, f"{to}/out"))


@query(f"""WITH {LI}, {_STAYS}, here AS (SELECT k, arg_max(change, cycle) AS change FROM changes GROUP BY k) SELECT 'raw' AS kind, round(log10(cents) * 200)::BIGINT AS bin, count(*) AS n FROM here JOIN li ON li.parent = k WHERE change <> 'vanished' GROUP BY 2""")
def live_histograms(spark, sf_dir):
    """The bins of what is in the pool at the end, by adding and taking what came and went."""
    return pool.live_counts(pool.changes(_pool_snapshots(spark, sf_dir), 60), ["raw"]).filter("n <> 0")


# -------------------------------------------------------------------------------------------------------------------- 2.14


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 5000 + 100 AS fee, 100 + o_orderkey % 400 AS vsize FROM orders),
    e AS (SELECT k AS a, k - d AS b FROM o, (VALUES (1), (3)) v(d) WHERE k % 10 >= d AND k - d IN (SELECT k FROM o)),
    r AS (SELECT a AS seed, b AS member FROM e UNION SELECT r.seed, e.b FROM r JOIN e ON e.a = r.member),
    up AS (SELECT seed AS k, count(*) AS n, sum(fee) AS f, sum(vsize) AS v FROM r JOIN o ON o.k = r.member GROUP BY 1),
    down AS (SELECT r.member AS k, count(*) AS n, sum(fee) AS f, sum(vsize) AS v, arg_min(o.k::VARCHAR, (-fee / vsize, o.k::VARCHAR)) AS best FROM r JOIN o ON o.k = r.seed GROUP BY 1)
    SELECT o.k::VARCHAR AS txid, fee, vsize, coalesce(up.n, 0) AS n_ancestors, coalesce(up.f, 0)::BIGINT AS ancestor_fee, coalesce(up.v, 0)::BIGINT AS ancestor_vsize, coalesce(down.n, 0) AS n_descendants, coalesce(down.f, 0)::BIGINT AS descendant_fee, coalesce(down.v, 0)::BIGINT AS descendant_vsize, best AS best_descendant
    FROM o LEFT JOIN up USING (k) LEFT JOIN down ON down.k = o.k""")
def transaction_packages(spark, sf_dir):
    """Ancestors and descendants of every order, whose parents are the first and the third before it in its ten."""
    k = F.col("o_orderkey")
    parents = F.array_compact(F.array(*(F.when(k % 10 >= d, (k - d).cast("string")) for d in (1, 3))))
    o = read(spark, sf_dir, "orders").select(k.cast("string").alias("txid"), (k * 7919 % 5000 + 100).alias("fee"), (100 + k % 400).alias("vsize"), parents.alias("parents"))
    return transactions.packages(o, o.select("txid"))


_LEAVES = """leaf AS (SELECT o_custkey // 7 AS block, row_number() OVER (PARTITION BY o_custkey // 7 ORDER BY o_orderkey) - 1 AS pos, unhex(sha256(unhex(sha256(o_orderkey::VARCHAR)))) AS hash FROM orders),
    tree AS (SELECT block, 0 AS level, pos, hash, count(*) OVER (PARTITION BY block) AS n FROM leaf
             UNION ALL SELECT block, level + 1, pos // 2, unhex(sha256(unhex(sha256(hash || coalesce(lead(hash) OVER (PARTITION BY block ORDER BY pos), hash))))), (n + 1) // 2 FROM tree WHERE n > 1 QUALIFY pos % 2 = 0)"""


def _leaves(spark, sf_dir) -> DataFrame:
    """Orders as transactions of blocks of seven customers each."""
    block = F.floor(F.col("o_custkey") / 7)
    pos = F.row_number().over(W.partitionBy(block).orderBy("o_orderkey")) - 1
    key = F.col("o_orderkey").cast("string").cast("binary")
    return read(spark, sf_dir, "orders").select(block.alias("block"), pos.cast("long").alias("pos"), transactions.double_sha(key).alias("hash"))


@query(f"WITH RECURSIVE {_LEAVES} SELECT block, level::INTEGER AS level, pos, lower(hex(hash)) AS hash FROM tree")
def merkle_levels(spark, sf_dir):
    return transactions.merkle_levels(_leaves(spark, sf_dir)).withColumn("hash", F.lower(F.hex("hash")))


@query(f"""WITH RECURSIVE {_LEAVES}, sizes AS (SELECT block, level, max(pos) AS last FROM tree GROUP BY ALL),
    asked AS (SELECT l.block, l.pos, s.level, least(xor(l.pos >> s.level, 1), s.last) AS at FROM leaf l JOIN sizes s ON s.block = l.block AND s.last > 0),
    p AS (SELECT a.block, a.pos, count(*) AS n, sha256(string_agg(lower(hex(t.hash)), ',' ORDER BY a.level)) AS sha FROM asked a JOIN tree t ON t.block = a.block AND t.level = a.level AND t.pos = a.at GROUP BY ALL)
    SELECT l.block, l.pos, coalesce(n, 0)::INTEGER AS n_hashes, coalesce(sha, sha256('')) AS proof_sha256, true AS folds FROM leaf l LEFT JOIN p ON p.block = l.block AND p.pos = l.pos""")
def merkle_proofs(spark, sf_dir):
    """The proof of every transaction, and whether it folds to its block's root."""
    levels = transactions.merkle_levels(_leaves(spark, sf_dir))
    proofs = transactions.merkle_proofs(levels, levels.filter("level = 0"), ends=True)
    folds = transactions.fold_proof(F.col("leaf"), F.col("pos"), F.col("proof")) == F.col("root")
    listed = F.array_join(F.transform("proof", lambda h: F.lower(F.hex(h))), ",")
    return proofs.select("block", "pos", F.size("proof").alias("n_hashes"), F.sha2(listed, 256).alias("proof_sha256"), folds.alias("folds"))


@query(f"""WITH {OUT}, h AS (SELECT addr, created_h AS height, row_number() OVER (ORDER BY created_h, addr, part, sats) AS pos FROM lives), c AS (SELECT addr, CASE WHEN addr % 3 > 0 THEN max(height) // 2 END AS upto FROM h GROUP BY addr),
    r AS (SELECT addr, height, row_number() OVER (PARTITION BY addr ORDER BY height DESC, pos DESC) AS nth FROM h JOIN c USING (addr) WHERE upto IS NULL OR height < upto) SELECT addr, height::BIGINT AS height, nth::INTEGER AS nth FROM r WHERE nth <= 25""")
def address_pages(spark, sf_dir):
    """The newest 25 entries of each address, or, of two thirds of them, the 25 before the middle of their history."""
    h = outputs(spark, sf_dir, priced=False).select("addr", F.col("created_h").alias("height"), F.struct("part", "sats").alias("pos"))
    c = h.groupBy("addr").agg(F.when(F.col("addr") % 3 > 0, F.floor(F.max("height") / 2)).alias("height")).withColumn("pos", F.lit(None).cast(h.schema["pos"].dataType))
    return transactions.history_pages(h, c, 25).select("addr", "height", "nth")


@query(None)
def name_search(spark, sf_dir):
    """The ten best names for what one may type for each of them: words in another form, joined, and with a letter missing."""
    part = read(spark, sf_dir, "part")
    names = part.select(F.lower(F.regexp_replace(F.concat_ws("_", "p_name", "p_type", "p_brand"), "[ #]", "_")).alias("name"))
    n = F.col("p_name")
    typed = F.array(F.upper(n), F.regexp_replace(n, " ", ""), F.concat(F.substring(n, 1, 2), F.expr("substring(p_name, 4)")), F.concat(n, F.lit(" "), F.lower("p_type")))
    return search.search(names, part.select(F.explode(typed).alias("query")), limit=10)


# ------------------------------------------------------------------------------------------------ sizes, scripts, features


@query(f"""WITH {STARTED}, w AS (SELECT *, price * 97 % 4000001 AS weight FROM started), c AS (SELECT *, weight // 4 AS vbytes, sum(weight // 4) OVER o AS cv, sum(weight) OVER o AS cw FROM w WINDOW o AS (ORDER BY idx))
    SELECT a.idx, a.vbytes::BIGINT AS vbytes, {sc("a.weight / 4000000", 1_000_000)} AS fullness_ppm, (a.cv - coalesce(b.cv, 0))::BIGINT AS vbytes_24h, {sc("(a.cw - coalesce(b.cw, 0)) / (a.idx - a.start + 1)", 100)} AS weight_average_e2 FROM c a LEFT JOIN c b ON b.idx = a.start - 1""")
def block_sizes(spark, sf_dir):
    """Virtual size, fullness, and both over a day, with weights made of prices."""
    b = blocks(spark, sf_dir).withColumn("weight", F.col("price") * 97 % 4_000_001)
    r = network.block_sizes(b)
    return r.select("idx", "vbytes", scaled(F.col("fullness"), 1_000_000).alias("fullness_ppm"), F.col("vbytes_sum").alias("vbytes_24h"), scaled(F.col("weight_average"), 100).alias("weight_average_e2"))


#: Hexadecimal digits of an order line in Spark and DuckDB.
LINE_DIGITS = "md5(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)))"
LINE_MD5 = "md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR)"


@query(f"""WITH RECURSIVE s AS (SELECT l_orderkey AS parent, l_linenumber AS line, translate(left({LINE_MD5}, 24), 'b9d4', 'a5c0') AS h FROM lineitem),
    w AS (SELECT parent, line, h, 0 AS spot, 0 AS num, 0 AS legacy, 0 AS accurate, 0 AS pushes, true AS clean FROM (SELECT DISTINCT parent, line, h FROM s)
          UNION ALL
          SELECT parent, line, h, CASE WHEN b > 78 THEN spot + 1 WHEN spot + head + n <= 12 THEN spot + head + n ELSE 99 END,
                 CASE WHEN b BETWEEN 81 AND 96 THEN b - 80 WHEN b BETWEEN 172 AND 175 THEN num ELSE 0 END,
                 legacy + CASE WHEN b IN (172, 173) THEN 1 WHEN b IN (174, 175) THEN 20 ELSE 0 END,
                 accurate + CASE WHEN b IN (172, 173) THEN 1 WHEN b IN (174, 175) THEN CASE WHEN num > 0 THEN num ELSE 20 END ELSE 0 END,
                 pushes + CASE WHEN b <= 78 AND spot + head + n <= 12 THEN 1 ELSE 0 END, clean AND b <= 96 AND (b > 78 OR spot + head + n <= 12)
          FROM (SELECT *, CASE WHEN b < 76 THEN 1 WHEN b = 76 THEN 2 WHEN b = 77 THEN 3 ELSE 5 END AS head,
                       CASE WHEN b < 76 THEN b WHEN spot + b - 75 + CASE WHEN b = 78 THEN 1 ELSE 0 END >= 12 THEN 99 WHEN b = 76 THEN x1 WHEN b = 77 THEN x1 + 256 * x2 ELSE x1 + 256 * x2 + 65536 * x3 + 16777216 * x4 END AS n
                FROM (SELECT *, ('0x' || substr(h, 2 * spot + 1, 2))::BIGINT AS b, coalesce(try_cast('0x' || substr(h, 2 * spot + 3, 2) AS BIGINT), 0) AS x1, coalesce(try_cast('0x' || substr(h, 2 * spot + 5, 2) AS BIGINT), 0) AS x2,
                             coalesce(try_cast('0x' || substr(h, 2 * spot + 7, 2) AS BIGINT), 0) AS x3, coalesce(try_cast('0x' || substr(h, 2 * spot + 9, 2) AS BIGINT), 0) AS x4 FROM w WHERE spot < 12)))
    SELECT parent, line, legacy, accurate, pushes, push_only FROM (SELECT parent, line, max(legacy)::BIGINT AS legacy, max(accurate)::BIGINT AS accurate, max(pushes)::BIGINT AS pushes, bool_and(clean) AS push_only FROM w GROUP BY parent, line) JOIN lineitem ON l_orderkey = parent AND l_linenumber = line""")
def script_instructions(spark, sf_dir):
    """Instructions of a script of twelve bytes for each order line, its bytes drawn so that checks are frequent."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("line"), F.expr(f"unhex(translate(left({LINE_DIGITS}, 24), 'b9d4', 'a5c0'))").alias("script"))
    w = li.select("parent", "line", scripts.walk(F.col("script")).alias("w"))
    return w.select("parent", "line", "w.legacy", "w.accurate", "w.pushes", "w.push_only")


#: Output scripts of order lines by part modulo 12, from their digits m (32) and n (64), with the type each is made to have.
MADE = ["unhex('')", "unhex('51024e73')", "unhex(concat('0014', left(n, 40)))", "unhex(concat('a914', left(n, 40), '87'))", "unhex(concat('76a914', left(n, 40), '88ac'))", "unhex(concat('0020', n))", "unhex(concat('5120', n))",
        "unhex(concat('2102', n, 'ac'))", "unhex(concat('4104', n, n, 'ac'))", "unhex(concat('6a20', n, 'acac'))", "unhex(concat('512102', n, '2103', n, '52ae'))", "unhex(concat('ae10', m, '52afac'))"]
MADE_TYPES = ["empty", "p2a", "p2wpkh", "p2sh", "p2pkh", "p2wsh", "p2tr", "p2pk33", "p2pk65", "op_return", "p2ms", "unknown"]
MADE_SIGOPS = [0, 0, 0, 0, 1, 0, 0, 1, 1, 2, 20, 41]
MADE_BITS = [9, 7, 4, 3, 2, 5, 6, 0, 0, 8, 1, 10]


def _made(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Inputs and outputs of orders: a line makes an output, and spends one of the type of its supplier modulo 12; where that is a
    script's hash, it shows a script of two of three keys."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_idx"), "l_partkey", "l_suppkey", F.floor(F.col("l_quantity") * 20).cast("long").alias("sats"), F.expr(LINE_DIGITS).alias("m")).withColumn("n", F.concat("m", "m"))
    script = F
    for k, x in enumerate(MADE):
        script = script.when(F.col("l_partkey") % 12 == k, F.expr(x))
    outputs = li.select("tx_idx", "sats", script.alias("script"))
    kind = F.element_at(F.array(*(F.lit(t) for t in MADE_TYPES)), (F.col("l_suppkey") % 12 + 1).cast("int"))
    keys = F.expr("unhex(concat('522102', n, '2103', n, '2102', n, '53ae'))")
    sig = F.when(F.col("prev_type") == "p2sh", F.concat(F.unhex(F.lit("4c69")), keys)).when(F.col("prev_type") == "unknown", F.unhex(F.lit("ac"))).otherwise(F.unhex(F.lit("")))
    witness = F.when(F.col("prev_type") == "p2wsh", F.array(F.unhex(F.lit("01")), keys)).when(F.col("prev_type") == "p2tr", F.array(F.unhex(F.lit("01")), F.unhex(F.lit("5001")))).otherwise(F.array().cast("array<binary>"))
    inputs = li.withColumn("prev_type", kind).select("tx_idx", (F.col("tx_idx") < 0).alias("is_coinbase"), "prev_type", sig.alias("script_sig"), witness.alias("witness"))
    return inputs, outputs


@query(f"""SELECT l_orderkey AS tx_idx, sum(4 * ({MADE_SIGOPS}[l_partkey % 12 + 1]) + CASE l_suppkey % 12 WHEN 3 THEN 12 WHEN 11 THEN 4 WHEN 2 THEN 1 WHEN 5 THEN 3 ELSE 0 END)::BIGINT AS sigops FROM lineitem GROUP BY 1""")
def signature_operations(spark, sf_dir):
    """The cost in signature operations of each order as a transaction."""
    return scripts.signature_operations(*_made(spark, sf_dir))


DUST_LIMITS = [network.DUST.get(t, 0) for t in MADE_TYPES]


@query(f"""WITH m AS (SELECT l_orderkey AS tx, bit_or((1 << ({MADE_BITS}[l_partkey % 12 + 1])) | (1 << ({MADE_BITS}[l_suppkey % 12 + 1])) | CASE WHEN l_suppkey % 12 = 6 THEN 1 << 14 ELSE 0 END
        | CASE WHEN floor(l_quantity * 20) < {DUST_LIMITS}[l_partkey % 12 + 1] THEN 1 << 21 ELSE 0 END) AS mask FROM lineitem GROUP BY 1)
    SELECT tx // 100 AS height, {", ".join(f"count(*) FILTER ((mask & {1 << bit}) <> 0) AS {name}" for name, bit in scripts.FEATURES.items())} FROM m GROUP BY 1""")
def features_by_block(spark, sf_dir):
    """How many orders of each hundred have each feature."""
    masks = scripts.features(*_made(spark, sf_dir)).withColumn("height", F.floor(F.col("tx_idx") / 100).cast("long"))
    return scripts.features_by_block(masks)


#: Beginnings of data outputs in hexadecimal digits, with the kind each has, and bare scripts up to the digits m of an order line.
BEGINNINGS = {
    "omni": "6f6d6e69", "stacks": "5831", "blockstack": "6964", "colu": "4343", "open_assets": "4f410100", "coinspark": "53504b", "poet": "504f4554", "docproof": "444f4350524f4f46",
    "opentimestamps": "0588960d73d71901", "factom": "466163746f6d2121", "eternity_wall": "4557", "memo": "6d0c", "bitproof": "4250", "ascribe": "4153435249424500", "stampery": "5374616d70657279", "epobc": "45504f4243",
}
BARE = {"runes": "6a5d02ff", "empty": "6a00", "veriblock": f"6a4c50{'ff' * 64}", "komodo": f"6a24{'ff' * 20}", "bare_hash": "6a14ffffffff", "unknown": "6a11ff"}
BEGUN = [f"6a{len(x) // 2 + 16:02x}{x}" for x in BEGINNINGS.values()] + list(BARE.values())
BEGUN_KINDS = [*BEGINNINGS, *BARE]
#: How many digits of the line follow.
FOLLOWING = [32] * len(BEGINNINGS) + [2, 0, 32, 32, 32, 32]


@query(f"SELECT l_orderkey // 100 AS height, {BEGUN_KINDS}[l_partkey % {len(BEGUN_KINDS)} + 1] AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2")
def data_output_kinds(spark, sf_dir):
    """How many order lines of each hundred orders have each kind of data, read from a script made for each."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("l_partkey") % len(BEGUN_KINDS) + 1).cast("int"))
    li = read(spark, sf_dir, "lineitem")
    script = F.unhex(F.concat(pick(BEGUN), F.substring(F.expr(LINE_DIGITS), F.lit(1), pick(FOLLOWING))))
    return li.select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("height"), network.op_return_kind(script).alias("kind")).groupBy("height", "kind").agg(F.count("*").alias("n"))


PHASE_SQL = """CASE WHEN average IS NULL THEN
        CASE WHEN price >= short THEN CASE WHEN price >= whole AND price >= long THEN 2 WHEN short > long OR price >= whole OR price >= long THEN 5 ELSE 3 END
             WHEN short > long AND price >= whole AND price >= long THEN 6 WHEN short > long AND (price >= whole OR price >= long) THEN 10
             WHEN long > whole THEN 8 ELSE 9 END
    WHEN price < least(whole, short, long, average) THEN CASE WHEN long > whole THEN 8 ELSE 9 END
    WHEN price < short AND (whole > price)::INT + (short > price)::INT + (long > price)::INT + (average > price)::INT = 2 THEN 7
    WHEN short > long AND NOT (price >= whole AND price >= long AND price >= average) THEN 10
    WHEN price >= average AND price >= short THEN CASE WHEN NOT (price >= whole AND price >= long) THEN 5 WHEN whole > average THEN 1 ELSE 2 END
    WHEN price >= average AND price >= whole AND price >= long THEN 6 WHEN price >= short THEN 3 WHEN price >= average THEN 4 ELSE 10 END"""


@query(f"WITH {EV}, p AS (SELECT idx, price, idx * 7919 % 20011 AS whole, idx * 104729 % 20021 AS short, idx * 1299709 % 20023 AS long, CASE WHEN idx % 5 > 0 THEN idx * 15485863 % 20029 END AS average FROM ev) SELECT idx, ({PHASE_SQL})::INTEGER AS phase FROM p")
def sentiment_phases(spark, sf_dir):
    """The phase of each price against four levels drawn for each event; every fifth has no yearly average."""
    drawn = lambda by, mod: F.col("idx") * by % mod
    average = F.when(F.col("idx") % 5 > 0, drawn(15_485_863, 20_029))
    return blocks(spark, sf_dir).select("idx", market.sentiment(F.col("price"), drawn(7919, 20_011), drawn(104_729, 20_021), drawn(1_299_709, 20_023), average).alias("phase"))
