"""Plans as SQL in two dialects: Spark's, which runs, and DuckDB's, which checks it.

A plan is a function of a dialect that returns one SELECT over the domain's relations
(:mod:`holdfold.plans.domain`); functions that the engines name differently come from
the dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Spark:
    def table(self, name: str) -> str:
        return f"hf_{name}"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def corr(self, a: str, b: str) -> str:
        """NaN where one of them doesn't vary; Spark's own corr fails there."""
        return f"CASE WHEN regr_count({a}, {b}) > 0 THEN coalesce(try_divide(regr_sxy({a}, {b}), sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b}))), double('NaN')) END"

    def over(self, a: str, b: str) -> str:
        """a / b of doubles; infinite or NaN where b is zero."""
        return f"coalesce(try_divide({a}, {b}), CASE WHEN {b} = 0 THEN sign({a}) * double('Infinity') END)"

    def days(self, end: str, start: str) -> str:
        return f"datediff({end}, {start})"

    def plus(self, day: str, n: int | str) -> str:
        return f"date_add({day}, {n})"

    def months(self, day: str, n: int | str) -> str:
        return f"add_months({day}, {n})"

    def last_seen(self, x: str) -> str:
        return f"last_value({x}) IGNORE NULLS"

    def extract_regex(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def replace_regex(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def strings(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), '|')"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def numbers(self, n: int) -> str:
        return f"(SELECT id AS i FROM range({n}))"

    def instant(self, x: str) -> str:
        return f"cast({x} AS timestamp_ntz)"

    def each(self, n: int) -> str:
        """A row for each i from 0 to n - 1, to be joined to what stands before."""
        return f"LATERAL VIEW explode(sequence(0, {n - 1})) e AS i"

    def local(self, x: str) -> str:
        """A time in UTC as New York's clocks show it."""
        return f"from_utc_timestamp(cast({x} AS timestamp_ntz), 'America/New_York')"

    def seconds(self, x: str) -> str:
        return f"unix_micros(to_utc_timestamp({x}, 'UTC')) / 1e6"


class DuckDB(Spark):
    def table(self, name: str) -> str:
        return name

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def corr(self, a: str, b: str) -> str:
        return f"corr({a}, {b})"

    def over(self, a: str, b: str) -> str:
        return f"{a} / {b}"

    def days(self, end: str, start: str) -> str:
        return f"date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE))"

    def plus(self, day: str, n: int | str) -> str:
        return f"CAST({day} + ({n}) * INTERVAL 1 DAY AS DATE)"

    def months(self, day: str, n: int | str) -> str:
        return f"CAST({day} + ({n}) * INTERVAL 1 MONTH AS DATE)"

    def last_seen(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def extract_regex(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def replace_regex(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def strings(self, x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list({x}))), '|')"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def numbers(self, n: int) -> str:
        return f"(SELECT range AS i FROM range({n}))"

    def instant(self, x: str) -> str:
        return f"CAST({x} AS TIMESTAMP)"

    def each(self, n: int) -> str:
        return f"CROSS JOIN (SELECT range AS i FROM range({n})) e"

    def local(self, x: str) -> str:
        return f"((CAST({x} AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"

    def seconds(self, x: str) -> str:
        return f"epoch_us({x}) / 1e6"


Plan = Callable[[Spark], str]
PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    """Registers a plan under its function's name."""
    PLANS[f.__name__] = f
    return f


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"hf_{t}")


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .domain import over_files

        register(spark, sf_dir)
        return over_files(spark, sf_dir).run(name)

    query.__name__ = name
    return query


def oracle(name: str) -> str:
    from .domain import with_domain

    return with_domain(DuckDB(), PLANS[name](DuckDB()))
