"""The domain's relations over the given tables.

revisions    one row per filing: accession, cik, filer_id, known, period_end, kind
holdings     one row per filing and instrument: shares, value
visible      revisions known LAG days after their period's end
panel        each period's book per filer, amendments folded (variant: latest original or
             restatement, and every filing of new holdings)
books        panel with each position's weight w in its filer's book, and the book's value
quarters     the periods in order, numbered
prices       daily price, volume, return per instrument
market       per instrument and period: last price, median dollar volume, volatility, cap
funds        filers taken as funds: the third of them with the most positions over all quarters
splits       per quarter and instrument, the most common ratio of shares among holders of both quarters,
             in thousandths, where it has support and is no rounding matter
moves        positions against the previous quarter (full outer); shares_before in units of
             today (times the split), shares_reported as they were

Relations that many plans read are written once, as Parquet, and read from there
(:class:`Domain`); books and moves are partitioned by quarter, so a plan of one quarter reads
its files alone.  In DuckDB's dialect the relations stay the plain definitions, so what is
stored, and the arithmetic that takes the place of range joins, is checked against them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.storage import shared_folder
from .dialect import DuckDB, Spark

LAG, FILERS = 60, 100
#: Number of a period, 1 for the last quarter of 1994: arithmetic, so that no window over all periods is needed.
QUARTER = "CAST(year(period_end) * 4 + quarter(period_end) - 7979 AS BIGINT)"


#: What is written once, and the column that it is partitioned by; later ones read earlier ones.
STORED = {"holdings": None, "folded": None, "numbered": "q", "quarters": None, "prices": None, "market": None, "moves": "q"}


def relations(d: Spark) -> dict[str, str]:
    """The relations' definitions, each after those that it reads."""
    found = _plain(d)
    if isinstance(d, DuckDB):
        return found
    start = "CAST(date_trunc('quarter', day) AS DATE)"
    ends = " UNION ALL ".join(f"SELECT *, {d.plus(d.months(start, 3 * k), -1)} AS period_end FROM prices" for k in (1, 2))
    found["market"] = f"""SELECT period_end, instrument, max_by(price, day) AS price, {d.quantile("dollars", 0.5)} AS adv, stddev_samp(ret) AS vol, max_by(price, day) * sum(volume) AS cap
  FROM quarters JOIN ({ends}) p USING (period_end) WHERE day > {d.plus("period_end", -92)} GROUP BY period_end, instrument"""
    found["books"] = "SELECT period_end, filer_id, instrument, shares, value, w, book FROM numbered"
    found["numbered"] = f"""SELECT *, value / sum(value) OVER (PARTITION BY period_end, filer_id) AS w, sum(value) OVER (PARTITION BY period_end, filer_id) AS book, {QUARTER} AS q FROM panel"""
    order = ["revisions", "holdings", "visible", "folded", "panel", "numbered", "books"]
    return {name: found[name] for name in order} | {name: sql for name, sql in found.items() if name not in order}


def _plain(d: Spark) -> dict[str, str]:
    t = d.table
    return {
        "revisions": f"""SELECT o_orderkey AS accession, o_custkey AS cik, o_custkey % {FILERS} AS filer_id, CAST(o_orderdate AS DATE) AS known,
  {d.plus("CAST(date_trunc('quarter', o_orderdate) AS DATE)", -1)} AS period_end,
  CASE o_orderstatus WHEN 'F' THEN 'ORIGINAL' WHEN 'O' THEN 'RESTATEMENT' ELSE 'NEW HOLDINGS' END AS kind FROM {t("orders")}""",
        "holdings": f"""SELECT l_orderkey AS accession, p_brand AS instrument, sum(l_quantity) AS shares, sum(l_extendedprice) AS value
  FROM {t("lineitem")} JOIN {t("part")} ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand""",
        "visible": f"SELECT * FROM revisions WHERE known <= {d.plus('period_end', LAG)}",
        "folded": """SELECT accession, cik, filer_id, known, period_end, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY filer_id, period_end, kind = 'NEW HOLDINGS' ORDER BY known DESC, accession DESC) AS back FROM visible) v
  WHERE kind = 'NEW HOLDINGS' OR back = 1""",
        "panel": """SELECT period_end, filer_id, instrument, sum(shares) AS shares, sum(value) AS value
  FROM folded JOIN holdings USING (accession) GROUP BY period_end, filer_id, instrument""",
        "books": "SELECT *, value / sum(value) OVER (PARTITION BY period_end, filer_id) AS w, sum(value) OVER (PARTITION BY period_end, filer_id) AS book FROM panel",
        "quarters": f"SELECT period_end, {QUARTER} AS q FROM (SELECT DISTINCT period_end FROM visible) p",
        "numbered": f"SELECT *, {QUARTER} AS q FROM books",
        "trades": f"""SELECT p_brand AS instrument, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume, sum(l_extendedprice) AS dollars
  FROM {t("lineitem")} JOIN {t("part")} ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
        "prices": "SELECT *, price / lag(price) OVER (PARTITION BY instrument ORDER BY day) - 1 AS ret FROM trades",
        "market": f"""SELECT period_end, instrument, max_by(price, day) AS price, {d.quantile("dollars", 0.5)} AS adv, stddev_samp(ret) AS vol, max_by(price, day) * sum(volume) AS cap
  FROM quarters JOIN prices ON day <= period_end AND day > {d.plus("period_end", -92)} GROUP BY period_end, instrument""",
        "funds": """SELECT filer_id AS fund FROM (SELECT filer_id, ntile(3) OVER (ORDER BY count(*) DESC, filer_id) AS third FROM numbered GROUP BY filer_id) x WHERE third = 1""",
        "ratios": """SELECT c.q, c.filer_id, c.instrument, floor(c.shares / p.shares * 1000 + 0.5e0) / 1000 AS ratio
  FROM numbered c JOIN numbered p ON c.q = p.q + 1 AND c.filer_id = p.filer_id AND c.instrument = p.instrument WHERE c.shares > 0 AND p.shares > 0""",
        "splits": """SELECT q, instrument, ratio AS factor FROM (
  SELECT *, sum(k) OVER (PARTITION BY q, instrument) AS n, row_number() OVER (PARTITION BY q, instrument ORDER BY k DESC, ratio) AS rn, lead(k) OVER (PARTITION BY q, instrument ORDER BY k DESC, ratio) AS k2
  FROM (SELECT q, instrument, ratio, count(*) AS k FROM ratios GROUP BY q, instrument, ratio) r) o
  WHERE rn = 1 AND n >= 10 AND abs(ratio - 1) > 0.15 AND (k >= 0.1 * n OR (k >= 30 AND k >= 2.5 * coalesce(k2, 0)))""",
        "moves": """SELECT coalesce(c.q, p.q + 1) AS q, coalesce(c.filer_id, p.filer_id) AS filer_id, coalesce(c.instrument, p.instrument) AS instrument,
  coalesce(c.shares, 0) AS shares, coalesce(p.shares, 0) * coalesce(s.factor, 1e0) AS shares_before, coalesce(p.shares, 0) AS shares_reported, coalesce(c.value, 0) AS value, coalesce(p.value, 0) AS value_before, c.w, p.w AS w_before
  FROM numbered c FULL OUTER JOIN numbered p ON c.q = p.q + 1 AND c.filer_id = p.filer_id AND c.instrument = p.instrument
  LEFT JOIN splits s ON s.q = p.q + 1 AND s.instrument = p.instrument
  WHERE coalesce(c.q, p.q + 1) > (SELECT min(q) FROM quarters) AND coalesce(c.q, p.q + 1) <= (SELECT max(q) FROM quarters)""",
    }


def with_domain(d: Spark, body: str, views: Mapping[str, str] | None = None) -> str:
    """``body`` with a WITH clause of the relations that it needs, directly or through others; those of ``views`` are read from these."""
    known = relations(d) | {name: f"SELECT * FROM {view}" for name, view in (views or {}).items()}
    need: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(known[name])
                need.append(name)

    add(body)
    ordered = [n for n in known if n in need]
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in ordered)
    body = body.strip()
    return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE') :]}" if body.startswith("WITH RECURSIVE") else f"WITH {ctes},\n{body[4:]}" if body.startswith("WITH") else f"WITH {ctes}\n{body}"


class Domain:
    """The domain over some tables: plans run on it, and what they share is written once.

    ``given``: relations that the caller has, by the names above (revisions and holdings will
    do; prices, where there are, for what reads the market).  ``key`` names the store; with the
    same key, a store that is there already is read.  It lies in the folder that executors share.
    """

    def __init__(self, spark: SparkSession, given: Mapping[str, DataFrame] | None = None, key: str | None = None):
        self.spark, self.key = spark, key or uuid.uuid4().hex[:16]
        self.views: dict[str, str] = {}
        for name, rows in (given or {}).items():
            self._view(name, rows)

    def _view(self, name: str, rows: DataFrame) -> None:
        self.views[name] = f"hf_{self.key}_{name}"
        rows.createOrReplaceTempView(self.views[name])

    def sql(self, body: str) -> DataFrame:
        """The rows of a SELECT over the relations."""
        needed = with_domain(Spark(), body, self.views)
        for name, by in STORED.items():
            if name not in self.views and re.search(rf"(?m)(?:^|\bWITH(?: RECURSIVE)? ){name} AS \(", needed):
                self._store(name, by)
        return self.spark.sql(with_domain(Spark(), body, self.views))

    def run(self, name: str) -> DataFrame:
        """A plan by its name."""
        from .. import catalogue  # noqa: F401, registers the plans
        from .dialect import PLANS

        return self.sql(PLANS[name](Spark()))

    def _store(self, name: str, by: str | None) -> None:
        path = f"{shared_folder(self.spark)}/store-{self.key}/{name}"
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        schema = None
        if not fs.exists(fs_path(f"{path}/_columns")):
            rows = self.sql(f"SELECT * FROM ({relations(Spark())[name]}) r")
            schema = rows.schema
            own = f"{name}-{uuid.uuid4().hex}"
            made = f"{path.rpartition('/')[0]}/{own}"
            writer = (rows.hint("rebalance", by) if by else rows).write
            (writer.partitionBy(by) if by else writer).parquet(made)
            self.spark.createDataFrame([], schema).write.parquet(f"{made}/_columns")
            if not fs.exists(fs_path(path)):
                fs.rename(fs_path(made), fs_path(path))
            for left in (made, f"{path}/{own}"):  # another session was first, before or after the look
                fs.delete(fs_path(left), True)
        schema = schema or self.spark.read.parquet(f"{path}/_columns").schema
        self._view(name, self.spark.read.schema(schema).parquet(path))


def over_files(spark: SparkSession, sf_dir: str) -> Domain:
    """The domain over the tables of a folder; its store is known by the names, sizes and times of the files."""
    jvm = spark.sparkContext._jvm
    said = []
    for name in ("orders", "lineitem", "part"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        said += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(path))
    return Domain(spark, key=hashlib.md5("\n".join([str(relations(Spark())), *said]).encode()).hexdigest()[:16])
