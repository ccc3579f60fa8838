"""Queries on the operators that are more than one SQL statement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, identifiers
from ..operators import asof, crosssection, graph, inference, latent, sequential, storage
from ..sources import filings
from ..streaming import events as streams
from . import analytics, dialect, domain, text
from .dialect import DuckDB, Spark

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    dialect.register(spark, sf_dir)
    return domain.over_files(spark, sf_dir).sql(sql)


def oracle(sql: str) -> str:
    return domain.with_domain(DuckDB(), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for operators that go over their input often."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(oracle("SELECT p.instrument, p.day, round(m.cap, 2) AS cap, m.period_end FROM prices p ASOF LEFT JOIN market m ON p.instrument = m.instrument AND p.day > m.period_end"))
def asof_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price with the latest quarter's reference strictly before it."""
    prices = relation(spark, sf_dir, "SELECT instrument, day FROM prices")
    market = relation(spark, sf_dir, "SELECT instrument, period_end AS day, period_end, cap FROM market")
    out = asof.asof_join(prices, market, ["instrument"], "day", ["cap", "period_end"], strict=True)
    return out.select("instrument", "day", F.round("cap", 2).alias("cap"), "period_end")


@query(oracle("SELECT r.accession, v.period_end AS from_ FROM revisions r JOIN (SELECT filer_id, period_end, max(known) AS until FROM revisions GROUP BY 1, 2) v ON r.filer_id = v.filer_id AND r.known BETWEEN v.period_end AND v.until"))
def range_join_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with all periods whose span up to their last version holds them."""
    left = relation(spark, sf_dir, "SELECT accession, filer_id, known FROM revisions")
    right = relation(spark, sf_dir, "SELECT filer_id, period_end AS from_, max(known) AS until FROM revisions GROUP BY filer_id, period_end")
    return asof.range_join(left, right, ["filer_id"], "known", "from_", "until").select("accession", "from_")


@query(
    oracle(f"""WITH r AS (SELECT q, filer_id, w, row_number() OVER (PARTITION BY q ORDER BY w, filer_id, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n, instrument FROM numbered),
lim AS (SELECT q, quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.95) AS hi FROM numbered GROUP BY q)
SELECT r.q, filer_id, instrument, round({analytics.pct_rank("w", "r.q")}, 6) AS pct, {analytics.bins(DuckDB(), "rn", "n", 10)} AS decile, round(least(greatest(w, lo), hi), 6) AS winsorised,
round((w - avg(w) OVER (PARTITION BY r.q)) / stddev_pop(w) OVER (PARTITION BY r.q), 5) AS z FROM r JOIN lim ON r.q = lim.q""")
)
def crosssection_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, decile, winsorised value and z-score of position weights per quarter."""
    rows = relation(spark, sf_dir, "SELECT q, filer_id, instrument, w FROM numbered")
    moments = rows.groupBy("q").agg(F.percentile("w", F.lit(0.05)).alias("low"), F.percentile("w", F.lit(0.95)).alias("high"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("spread"))
    out = crosssection.ranked(rows, "w", ["q"], ["filer_id", "instrument"], lambda df: stored(df, "ranges")).join(moments, "q")
    decile = F.when(F.col("size") > 1, F.greatest(F.floor(((F.col("place") - 1) * 10 + F.col("size") - 2) / (F.col("size") - 1)), F.lit(1)) - 1).otherwise(0)
    cut = F.least(F.greatest("w", "low"), "high")
    return out.select("q", "filer_id", "instrument", F.round("rank", 6).alias("pct"), decile.alias("decile"), F.round(cut, 6).alias("winsorised"), F.round(F.try_divide(F.col("w") - F.col("mean"), "spread"), 5).alias("z"))


@query(oracle("SELECT q, filer_id, instrument, round(w - (avg(w) OVER p + regr_slope(w, ln(book)) OVER p * (ln(book) - avg(ln(book)) OVER p)), 5) + 0e0 AS residual FROM numbered WINDOW p AS (PARTITION BY q)"))
def weight_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position weight less its line on the log book within the quarter."""
    rows = relation(spark, sf_dir, "SELECT q, filer_id, instrument, w, ln(book) AS size FROM numbered")
    return crosssection.residual(rows, "w", "size", ["q"]).select("q", "filer_id", "instrument", (F.round("residual", 5) + F.lit(0.0)).alias("residual"))


@query(
    oracle("""WITH RECURSIVE e AS (SELECT DISTINCT a.cik AS src, b.cik AS dst FROM revisions a JOIN revisions b ON a.known = b.known AND a.filer_id = b.filer_id AND a.cik <> b.cik),
reach(node, other) AS (SELECT src, dst FROM e UNION SELECT src, src FROM e UNION SELECT r.node, e.dst FROM reach r JOIN e ON r.other = e.src)
SELECT node, min(other) AS "group" FROM reach GROUP BY node""")
)
def reporting_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of filers connected by filings of one family on one day."""
    edges = relation(spark, sf_dir, "SELECT DISTINCT a.cik AS src, b.cik AS dst FROM revisions a JOIN revisions b ON a.known = b.known AND a.filer_id = b.filer_id AND a.cik <> b.cik")
    return graph.groups(edges)


@query()
def overlap_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvector centrality of filers in the overlap of each quarter's books."""
    return graph.centrality(relation(spark, sf_dir, "SELECT q, filer_id AS row, instrument AS item, w FROM numbered"), by="q")


@query(
    oracle("""WITH RECURSIVE r AS (SELECT q, filer_id, row_number() OVER (PARTITION BY q ORDER BY max(book) DESC, filer_id) AS rank FROM numbered GROUP BY q, filer_id),
per AS (SELECT q, list({'k': filer_id, 'r': rank} ORDER BY rank) AS ranked FROM r WHERE rank <= 35 GROUP BY q), seq AS (SELECT *, row_number() OVER (ORDER BY q) AS i FROM per),
step(i, members, kept) AS (
  SELECT 1::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT i, stay || list_transform(list_filter(ranked, lambda x: x.r <= 25 AND NOT list_contains(stay, x.k::BIGINT))[1:25 - len(stay)], lambda x: x.k::BIGINT), stay FROM (
    SELECT s.i + 1 AS i, q.ranked, list_transform(list_filter(q.ranked, lambda x: list_contains(s.members, x.k::BIGINT)), lambda x: x.k::BIGINT)[1:25] AS stay FROM step s JOIN seq q ON q.i = s.i) z),
flat AS (SELECT i, unnest(members) AS key, kept FROM step WHERE i > 1)
SELECT now.q AS period, src.q AS source, f.key, r.rank::DOUBLE AS rank, CASE WHEN list_contains(f.kept, f.key) THEN 'retained' ELSE 'new' END AS status
FROM flat f JOIN seq now ON now.i = f.i JOIN seq src ON src.i = f.i - 1 JOIN r ON r.q = src.q AND r.filer_id = f.key""")
)
def hysteresis_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filers of a universe of 25 by book, in which members stay up to rank 35."""
    ranked = relation(spark, sf_dir, "SELECT q AS period, filer_id AS key, row_number() OVER (PARTITION BY q ORDER BY max(book) DESC, filer_id) AS rank FROM numbered GROUP BY q, filer_id")
    return sequential.hysteresis(ranked).withColumn("key", F.col("key").cast("long"))


@query(
    oracle("""WITH RECURSIVE c AS (SELECT known AS day, count(DISTINCT instrument) AS names FROM revisions JOIN holdings USING (accession) GROUP BY known),
d AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM prices) x), e AS (SELECT d.i FROM c JOIN d ON d.day = c.day WHERE names > greatest(3, 0.3 * (SELECT quantile_cont(names, 0.5) FROM c))),
w(i) AS (SELECT min(i) FROM e UNION ALL SELECT (SELECT min(e.i) FROM e WHERE e.i > w.i + 20) FROM w WHERE w.i IS NOT NULL) SELECT i FROM w WHERE i IS NOT NULL""")
)
def rebalance_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days on which filings change more than three names, and three tenths of a usual day's, spaced by more than twenty days."""
    days = relation(
        spark,
        sf_dir,
        """WITH c AS (SELECT known AS day, count(DISTINCT instrument) AS names FROM revisions JOIN holdings USING (accession) GROUP BY known), m AS (SELECT percentile(names, 0.5) AS usual FROM c),
d AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM prices) x) SELECT CAST(d.i AS BIGINT) AS i FROM c JOIN d ON d.day = c.day CROSS JOIN m WHERE names > greatest(3, 0.3 * usual)""",
    )
    return sequential.spaced(days)


@query()
def rank_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal quantiles of ranked weights."""
    rows = crosssection.ranked(relation(spark, sf_dir, "SELECT q, filer_id, instrument, w FROM numbered"), "w", ["q"], ["filer_id", "instrument"], lambda df: stored(df, "ranges"))
    p = F.col("rank") - F.lit(0.5) / F.col("size")
    return rows.select("q", "filer_id", "instrument", F.round(inference.inverse_normal(p), 6).alias("z"))


@query()
def latent_short_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unseen negative tilts per name from a normal distribution cut at the market weight."""
    rows = relation(
        spark,
        sf_dir,
        """WITH m AS (SELECT q, instrument, sum(value) / sum(sum(value)) OVER (PARTITION BY q) AS wm FROM numbered GROUP BY q, instrument), c AS (SELECT q, count(DISTINCT filer_id) AS f FROM numbered GROUP BY q)
SELECT n.q, n.instrument, count(*) AS n, 1 - count(*) / CAST(max(f) AS DOUBLE) AS p0, avg(w - wm) AS tilt, -max(wm) AS cut FROM numbered n JOIN m ON n.q = m.q AND n.instrument = m.instrument JOIN c ON c.q = n.q GROUP BY n.q, n.instrument""",
    ).where("n >= 10 and p0 > 0.02 and p0 <= 0.995")
    a = inference.inverse_normal(F.col("p0"))
    density = F.exp(-F.col("a") * F.col("a") / 2) / (2 * 3.141592653589793) ** 0.5
    rows = rows.withColumn("a", a).withColumn("phi", density).withColumn("sigma", F.try_divide(F.col("tilt") - F.col("cut"), F.col("phi") / (1 - F.col("p0")) - F.col("a")))
    return rows.select("q", "instrument", F.round(F.col("sigma") * (F.col("a") * F.col("p0") + F.col("phi")), 8).alias("ssi"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow FROM moves GROUP BY q, filer_id").where("flow is not null")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, f"WITH {analytics.SIGNALS} SELECT q, instrument, s, ln(cap) AS cap, ln(adv) AS adv, vol, fwd FROM panel_ WHERE vol IS NOT NULL")


@query()
def newey_west_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.newey_west(_flows(spark, sf_dir), "filer_id", "flow", "q")


@query()
def flow_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.block_bootstrap(_flows(spark, sf_dir), "filer_id", "flow", "q")


@query()
def signal_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.permutation_test(_signals(spark, sf_dir), "q", "s", "fwd")


@query()
def clustered_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.clustered_ols(_signals(spark, sf_dir), "fwd", ["s", "cap", "adv"], "q")


@query()
def flow_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of monthly returns over names."""
    rows = relation(spark, sf_dir, f"WITH {analytics.MONTHLY} SELECT month, instrument, ret FROM mret WHERE ret IS NOT NULL")
    return latent.pca(rows, "month", "instrument", "ret")


@query()
def crowding_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative factors of the value shares of each quarter."""
    return latent.nmf(relation(spark, sf_dir, "SELECT q, filer_id, instrument, w FROM numbered"), "q", "filer_id", "instrument", "w")


@query()
def instrumented_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).where("fwd is not null")
    z = [F.coalesce(crosssection.zscore(F.col(c), ["q"]), F.lit(0.0)).alias(c) for c in ("s", "cap", "adv", "vol")]
    return latent.ipca(rows.select("q", *z, F.lit(1.0).alias("one"), "fwd"), "q", ["one", "s", "cap", "adv", "vol"], "fwd")


@query()
def ridge_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward ridge forecasts of the next return."""
    return latent.ridge_walk_forward(_signals(spark, sf_dir), "q", "instrument", ["s", "cap", "adv", "vol"], "fwd").select("q", "instrument", F.round("forecast", 6).alias("forecast"), "fwd")


@query()
def independent_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent components of names' net buying, forced and informed ones told apart."""
    rows = relation(spark, sf_dir, "SELECT q, instrument, sum(value - value_before) / nullif(sum(value_before), 0) AS flow FROM moves GROUP BY q, instrument").where("flow is not null")
    lo, hi = (F.expr(f"percentile(flow, {p}) over (partition by q)") for p in (0.05, 0.95))
    rows = rows.select("q", "instrument", F.least(F.greatest("flow", lo), hi).alias("flow"))
    return latent.ica(stored(rows, "flows"), "q", "instrument", "flow")


@query()
def trade_breadth_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quarter: filers' weights by how little their trades of the last eight quarters repeat others', and the quarter's breadth under them."""
    signs = relation(spark, sf_dir, "SELECT q + i AS q, i, filer_id, instrument, concat(i, '|', instrument) AS item, sign(shares - shares_before) AS s FROM moves LATERAL VIEW explode(sequence(0, 7)) e AS i WHERE q + i <= (SELECT max(q) FROM quarters)")
    weights = latent.gls_weights(signs, "filer_id", "item", "s", by="q")
    now = signs.where("i = 0").join(weights, ["q", "filer_id"])
    return now.groupBy("q", "instrument").agg(F.round(F.sum(F.col("weight") * F.col("s")), 6).alias("cab"), F.round(F.try_divide(F.sum(F.col("weight") * F.col("s")), F.sum(F.abs("weight"))), 6).alias("cab_scaled"))


@query()
def tree_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward forecasts of the next return by a forest and boosted trees, and their mean rank."""
    return latent.tree_walk_forward(stored(_signals(spark, sf_dir), "signals"), "q", ["s", "cap", "adv", "vol"], "fwd").select("q", "instrument", "forest", "boosted", "ensemble", "fwd")


@query()
def correlated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names grouped by the correlation of monthly returns, with weights by Sharpe ratio."""
    rows = relation(spark, sf_dir, f"WITH {analytics.MONTHLY} SELECT month, instrument, ret FROM mret WHERE ret IS NOT NULL")
    return latent.correlation_groups(rows, "month", "instrument", "ret", 4)


@query(oracle("SELECT CASE kind WHEN 'ORIGINAL' THEN '13F-HR' ELSE '13F-HR/A' END AS form, 'FILER ' || filer_id AS company, cik, known AS filed, 'edgar/data/' || accession || '.txt' AS path FROM revisions"))
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width index lines written from the filings and read back, headings left out."""
    lines = relation(spark, sf_dir, "SELECT format_string('%-12s%-40s%-12d%-12s%s', CASE kind WHEN 'ORIGINAL' THEN '13F-HR' ELSE '13F-HR/A' END, concat('FILER ', filer_id), cik, CAST(known AS STRING), concat('edgar/data/', accession, '.txt')) AS value FROM revisions")
    heading = spark.createDataFrame([("Form Type   Company Name   CIK   Date Filed   File Name",), ("-" * 80,)], "value string")
    return filings.index_lines(lines.unionByName(heading))


@query(oracle("SELECT cik, CAST(accession AS VARCHAR) AS accession, CAST(known AS VARCHAR) AS filed FROM revisions"))
def json_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filer's history as JSON of parallel arrays, turned to rows again."""
    documents = relation(spark, sf_dir, "SELECT cik, to_json(named_struct('accession', l.accession, 'filed', l.filed)) AS doc FROM (SELECT cik, collect_list(named_struct('accession', CAST(accession AS STRING), 'filed', CAST(known AS STRING))) AS l FROM revisions GROUP BY cik) x")
    return filings.json_columns(documents, "doc", ["accession", "filed"])


#: Ids in an array at most, so that two arrays give a bounded number of pairs.
ALIKE = 128


def alike(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows alike in ``by`` with their ``key`` in arrays (``ids``) of at most :data:`ALIKE`, nulls left out."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1
    rows = rows.where(F.col(key).isNotNull()).withColumn("_chunk", F.floor(place / ALIKE))
    return rows.groupBy(*by, "_chunk").agg(F.collect_list(key).alias("ids")).drop("_chunk")


def ordered_pairs(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """A row for each id of the array ``ids`` and each larger one of ``other_ids``."""
    pairs = pairs.withColumn(one, F.explode("ids")).drop("ids")
    return pairs.withColumn(other, F.explode("other_ids")).drop("other_ids").where(F.col(one) < F.col(other))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Few small rows that become many, over as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the other names of their brand and size: token overlap and matching blocks."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    q = lambda rows: rows.select("p_brand", "p_size", *[F.col(c).alias(f"other_{c}") for c in rows.columns if c not in ("p_brand", "p_size")])
    names = p.select("p_brand", "p_size", "p_name").distinct()
    names = names.join(q(names), ["p_brand", "p_size"]).select("p_name", "other_p_name").distinct()  # each two names are compared once
    tokens = [identifiers.name_tokens(F.col(c)) for c in names.columns]
    scored = names.select("*", F.round(identifiers.token_similarity(*tokens), 6).alias("jaccard"), F.round(identifiers.sequence_ratio(*names.columns), 6).alias("ratio"))
    groups = alike(p, ["p_brand", "p_size", "p_name"], "p_partkey")
    pairs = groups.join(q(groups), ["p_brand", "p_size"]).where(F.array_min("ids") < F.array_max("other_ids")).drop("p_brand", "p_size")
    pairs = spread(pairs, *names.columns).join(scored, names.columns, "left")  # names that are null have no score
    return ordered_pairs(pairs, "p_partkey", "other").select("p_partkey", "other", "jaccard", "ratio")


@query(text.repaired_sql())
def repaired_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same repair as :func:`identifier_repair`, as a column function."""
    raw = relation(spark, sf_dir, text.found_sql(Spark()))
    return raw.withColumn("r", identifiers.repair_identifier(F.col("found"))).select("p_partkey", "found", "r.fixed", "r.action")


@query("SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, CAST(CASE isodow(o_orderdate) WHEN 6 THEN o_orderdate + INTERVAL 2 DAY WHEN 7 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS DATE) AS rolled FROM orders")
def calendar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.quarter_end(day).alias("quarter_end"), calendar.quarter_label(day).alias("label"), calendar.roll_weekend(day).alias("rolled"))


@query()
def parsed_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written as envelopes with XML tables, split and parsed again."""
    dialect.register(spark, sf_dir)
    rows = relation(spark, sf_dir, "SELECT accession, instrument, shares, value FROM holdings")
    entry = F.format_string("<ns1:infoTable><ns1:nameOfIssuer>%s</ns1:nameOfIssuer><ns1:cusip>037833100</ns1:cusip><ns1:value>%.0f</ns1:value><ns1:sshPrnamt>%.0f</ns1:sshPrnamt></ns1:infoTable>", "instrument", "value", "shares")
    body = F.concat(F.lit("<SEC-DOCUMENT><DOCUMENT><TYPE>13F-HR\n<TEXT>cover</TEXT></DOCUMENT><DOCUMENT><TYPE>INFORMATION TABLE\n<TEXT>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</TEXT></DOCUMENT></SEC-DOCUMENT>"))
    raw = rows.groupBy("accession").agg(body.alias("raw"))
    tables = filings.envelope_documents(raw).where("type = 'INFORMATION TABLE'")
    return filings.information_table(tables).select("accession", "issuer", "cusip", "value", "shares")


ORACLE_SQL["parsed_submissions"] = oracle("SELECT accession, instrument AS issuer, '037833100' AS cusip, CAST(round(value) AS DOUBLE) AS value, CAST(round(shares) AS DOUBLE) AS shares FROM holdings")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows computed by a stream over the events file, run to its end."""
    path = shared_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    query_ = streams.tumbling(source).writeStream.outputMode("complete").format("memory").queryName(f"t{uuid.uuid4().hex}").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.table(query_.name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    oracle("""WITH v AS (SELECT r.*, coalesce(sum(value), 0) AS value FROM revisions r LEFT JOIN holdings h USING (accession) GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY filer_id, period_end ORDER BY known, accession) AS version FROM v),
b AS (SELECT *, coalesce(max(CASE WHEN kind <> 'NEW HOLDINGS' THEN version END) OVER (PARTITION BY filer_id, period_end ORDER BY version ROWS UNBOUNDED PRECEDING), 0) AS base FROM s)
SELECT filer_id, CAST(period_end AS VARCHAR) AS period, version, kind, round(sum(value) OVER (PARTITION BY filer_id, period_end, base ORDER BY version ROWS UNBOUNDED PRECEDING), 2) AS book FROM b""")
)
def stream_fold_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books folded in order of arrival by a stateful stream, against the batch windows."""
    path = shared_path(spark, "fold")
    rows = relation(spark, sf_dir, "SELECT r.filer_id, CAST(r.period_end AS STRING) AS period, row_number() OVER (PARTITION BY r.filer_id, r.period_end ORDER BY r.known, r.accession) AS seq, r.kind, coalesce(v.value, 0) AS value FROM revisions r LEFT JOIN (SELECT accession, sum(value) AS value FROM holdings GROUP BY accession) v ON r.accession = v.accession")
    rows = rows.select(F.col("filer_id").cast("long").alias("filer_id"), "period", F.col("seq").cast("long").alias("seq"), "kind", F.col("value").cast("double").alias("value"))
    rows.write.parquet(f"{path}/arrivals")
    source = spark.readStream.schema(rows.schema).parquet(f"{path}/arrivals")
    streams.drained(streams.fold_filings(source), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(streams.FOLD).parquet(f"{path}/out").withColumn("book", F.round("book", 2))
