"""Plans on identifiers, names, pages and event streams."""

from __future__ import annotations

from .dialect import DuckDB, Spark, plan

#: Characters of a security identifier, in the order of their values (fixed value).
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"


def check_digit(x: str) -> str:
    """Check digit of eight characters: every second value doubled, digits added, modulo ten."""
    terms = []
    for k in range(1, 9):
        v = f"(strpos('{ALPHABET}', substr({x}, {k}, 1)) - 1)" + (" * 2" if k % 2 == 0 else "")
        terms.append(f"floor(({v}) / 10e0) + ({v}) % 10")
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS BIGINT)"


def _ids(d: Spark) -> str:
    body = check_digit("s8").replace("strpos(", "strpos(") if d.table("x") == "x" else check_digit("s8").replace("strpos(", "instr(")
    return f"""ids AS (SELECT p_partkey, s8, {body} AS digit FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 100000000 AS VARCHAR(20)), 8, '0') AS s8 FROM {d.table("part")}) x)"""


@plan
def identifier_check(d: Spark) -> str:
    """Check digits of security identifiers."""
    return f"WITH {_ids(d)} SELECT p_partkey, s8, digit FROM ids"


def found_sql(d: Spark) -> str:
    """Part numbers as identifiers that lost zeros or the check digit, or have a wrong one."""
    found = d.replace_regex("CASE WHEN p_partkey % 4 = 0 THEN concat(s8, CAST(digit AS VARCHAR(2))) WHEN p_partkey % 4 = 1 THEN s8 WHEN p_partkey % 4 = 2 THEN concat(s8, 'X') ELSE concat('1', substr(s8, 2, 7), CAST(digit AS VARCHAR(2))) END", "^0+", "")
    return f"WITH {_ids(d)} SELECT p_partkey, {found} AS found FROM ids"


def repaired_sql() -> str:
    return identifier_repair(DuckDB())


@plan
def identifier_repair(d: Spark) -> str:
    """Identifiers as found, some without leading zeros or check digit, some with a wrong one, brought back to nine characters."""
    digit = lambda x: check_digit(x).replace("strpos(", "strpos(" if d.table("x") == "x" else "instr(")
    return f"""WITH raw AS ({found_sql(d)}), p AS (SELECT p_partkey, found, lpad(found, 9, '0') AS padded FROM raw),
j AS (SELECT *, CAST({digit("substr(padded, 1, 8)")} AS VARCHAR(2)) = substr(padded, 9, 1) AND found <> '' AS valid, CASE WHEN length(found) >= 8 THEN concat(substr(found, 1, 8), CAST({digit("substr(concat(found, '00000000'), 1, 8)")} AS VARCHAR(2))) END AS checked FROM p)
SELECT p_partkey, found, CASE WHEN valid THEN padded ELSE checked END AS fixed,
CASE WHEN valid AND length(found) = 9 THEN 'ok' WHEN valid THEN 'padded' WHEN length(found) = 8 THEN 'appended_check' WHEN length(found) = 9 THEN 'recovered' ELSE 'invalid' END AS action FROM j"""


@plan
def classify_instruments(d: Spark) -> str:
    """Class of an instrument from its description; later rules come before earlier ones."""
    t = d.table
    up = "upper(p_type)"
    return f"""SELECT p_partkey, CASE WHEN {d.matches(up, "PROMO|OPTION|CALL|PUT")} THEN 'option' WHEN {d.matches(up, "ECONOMY|NOTE|BOND")} THEN 'debt' WHEN {d.matches(up, "STANDARD|ETF|FUND")} THEN 'fund' WHEN {d.matches(up, "SMALL|MEDIUM|LARGE|COM")} THEN 'common' ELSE 'other_security' END AS class FROM {t("part")}"""


@plan
def class_rejections(d: Spark) -> str:
    t = d.table
    return f"SELECT CASE WHEN {d.matches('upper(p_type)', 'PROMO')} THEN 'option' WHEN {d.matches('upper(p_type)', 'ECONOMY')} THEN 'debt' ELSE 'kept' END AS class, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM {t('lineitem')} JOIN {t('part')} ON l_partkey = p_partkey GROUP BY 1"


@plan
def normalise_names(d: Spark) -> str:
    """Names without punctuation and filler words, upper-cased."""
    t = d.table
    x = d.replace_regex("upper(p_name)", "[^A-Z0-9 ]", " ")
    y = d.replace_regex(x, " +(INC|CORP|LTD|THE|PART)\\b", "")
    return f"SELECT p_partkey, trim({d.replace_regex(y, ' +', ' ')}) AS name_key, substr(trim({x}), 1, 6) AS short_id, {d.replace_regex('upper(p_brand)', '[./ ]', '-')} AS ticker FROM {t('part')}"


@plan
def family_clusters(d: Spark) -> str:
    """Filers that may be one family, by name key."""
    t = d.table
    return f"SELECT substr(c_name, length(c_name) - 1, 2) AS name_key, c_nationkey, count(*) AS filers, {d.strings('lpad(CAST(c_custkey AS VARCHAR(20)), 10, ' + chr(39) + '0' + chr(39) + ')')} AS ciks FROM {t('customer')} GROUP BY 1, 2 HAVING count(*) > 1"


@plan
def clean_numbers(d: Spark) -> str:
    """Numbers out of text with separators, currency signs and placeholders."""
    t = d.table
    text = "CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' WHEN o_orderkey % 5 = 1 THEN concat('$', CAST(o_orderkey AS VARCHAR(20)), ',000') WHEN o_orderkey % 5 = 2 THEN '-' ELSE CAST(o_orderkey AS VARCHAR(20)) END"
    return f"SELECT o_orderkey, {d.number(d.replace_regex(text, '[$,]', ''))} AS number FROM {t('orders')}"


@plan
def event_properties(d: Spark) -> str:
    """JSON properties: values by key and type."""
    t = d.table
    return f"SELECT event_type, CAST({d.json('props', 'k')} AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM {t('events')} GROUP BY 1, 2"


@plan
def tumbling_windows(d: Spark) -> str:
    """Events and values by hour and type."""
    t = d.table
    return f"SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {t('events')} GROUP BY 1, 2"


@plan
def sessions(d: Spark) -> str:
    """Sessions of users: gaps over half an hour begin a new one."""
    t = d.table
    return f"""WITH g AS (SELECT user_id, {d.seconds("ts")} AS s, value, CASE WHEN {d.seconds("ts")} - lag({d.seconds("ts")}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS new_, ts, event_id FROM {t("events")}),
k AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total, round(max(s) - min(s), 3) AS seconds FROM k GROUP BY user_id, session"""


@plan
def arrival_nowcast(d: Spark) -> str:
    """Cumulative demand per user in order of arrival."""
    t = d.table
    return f"SELECT event_id, user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS demand FROM {t('events')}"


@plan
def html_titles(d: Spark) -> str:
    """Titles and languages scanned out of HTML."""
    t = d.table
    return f"SELECT page_id, {d.extract_regex('html', '<title>([^<]*)</title>')} AS title, {d.extract_regex('html', '<html lang=.([a-z]+)')} AS lang FROM {t('pages')}"


@plan
def text_digests(d: Spark) -> str:
    """SHA-256 digests of texts, with the number of documents that share one."""
    t = d.table
    digest = "sha256(text)" if t("x") == "x" else "sha2(text, 256)"
    return f"SELECT {digest} AS digest, count(*) AS n, min(doc_id) AS first_doc FROM {t('documents')} GROUP BY 1"
