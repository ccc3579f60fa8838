"""Plans on filings, books and position changes."""

from __future__ import annotations

from .dialect import DuckDB, Spark, plan


@plan
def pit_versions(d: Spark) -> str:
    """Running version number per filer and period."""
    return "SELECT accession, cik, period_end, row_number() OVER (PARTITION BY cik, period_end ORDER BY known, accession) - 1 AS seq FROM revisions"


@plan
def pit_fold_full(d: Spark) -> str:
    """Full store: after the last replacing version, additions stack up; of one instrument's rows the newest counts."""
    return """WITH seqs AS (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY known, accession) AS seq FROM visible),
based AS (SELECT *, max(CASE WHEN kind <> 'NEW HOLDINGS' THEN seq END) OVER (PARTITION BY cik, period_end) AS base FROM seqs),
kept AS (SELECT * FROM based WHERE base IS NULL OR seq >= base),
rows_ AS (SELECT k.cik, k.filer_id, k.period_end, h.instrument, h.shares, h.value, row_number() OVER (PARTITION BY k.cik, k.period_end, h.instrument ORDER BY k.seq DESC) AS rn FROM kept k JOIN holdings h USING (accession))
SELECT period_end, filer_id, cik, instrument, round(shares, 2) AS shares, round(value, 2) AS value FROM rows_ WHERE rn = 1"""


@plan
def pit_fold_panel(d: Spark) -> str:
    """Research panel: the latest replacing version and every visible addition, summed."""
    return "SELECT period_end, filer_id, instrument, round(shares, 2) AS shares, round(value, 2) AS value FROM panel"


@plan
def pit_fold_strict(d: Spark) -> str:
    """Strict fold: per cik, additions only after a base that exists; summed to filers, with the date from which it is available."""
    return """WITH seqs AS (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY known, accession) AS seq FROM visible),
based AS (SELECT *, max(CASE WHEN kind <> 'NEW HOLDINGS' THEN seq END) OVER (PARTITION BY cik, period_end) AS base FROM seqs),
kept AS (SELECT *, max(known) OVER (PARTITION BY filer_id, period_end) AS available FROM based WHERE seq >= base)
SELECT period_end, filer_id, instrument, max(available) AS available_date, round(sum(shares), 2) AS shares, round(sum(value), 2) AS value FROM kept JOIN holdings USING (accession) GROUP BY period_end, filer_id, instrument"""


@plan
def pit_fold_adapter(d: Spark) -> str:
    """Adapter fold: additions without a base stay; the newest row per cik and instrument, then summed to filers."""
    return """WITH seqs AS (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY known, accession) AS seq FROM visible),
based AS (SELECT *, coalesce(max(CASE WHEN kind <> 'NEW HOLDINGS' THEN seq END) OVER (PARTITION BY cik, period_end), -1) AS base FROM seqs),
last_ AS (SELECT b.filer_id, b.period_end, h.instrument, h.shares, h.value, row_number() OVER (PARTITION BY b.cik, b.period_end, h.instrument ORDER BY b.seq DESC) AS rn FROM based b JOIN holdings h USING (accession) WHERE b.seq >= b.base)
SELECT period_end, filer_id, instrument, round(sum(shares), 2) AS shares, round(sum(value), 2) AS value FROM last_ WHERE rn = 1 GROUP BY period_end, filer_id, instrument"""


@plan
def pit_as_of_book(d: Spark) -> str:
    """Every filer's books as they were knowable on one date."""
    return """WITH seen AS (SELECT * FROM revisions WHERE known <= DATE '1998-06-30'),
base AS (SELECT filer_id, period_end, max(CASE WHEN kind <> 'NEW HOLDINGS' THEN accession END) AS n, max_by(accession, known) AS latest FROM seen WHERE kind <> 'NEW HOLDINGS' GROUP BY filer_id, period_end),
ranked AS (SELECT *, row_number() OVER (PARTITION BY filer_id, period_end, kind = 'NEW HOLDINGS' ORDER BY known DESC, accession DESC) AS back FROM seen)
SELECT period_end, filer_id, count(DISTINCT instrument) AS positions, round(sum(value), 2) AS book FROM ranked JOIN holdings USING (accession) WHERE kind = 'NEW HOLDINGS' OR back = 1 GROUP BY period_end, filer_id"""


@plan
def pit_restatement_audit(d: Spark) -> str:
    """First against final book of each filer and quarter."""
    return """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY filer_id, period_end ORDER BY known, accession) AS seq, count(*) OVER (PARTITION BY filer_id, period_end) AS n FROM revisions WHERE kind <> 'NEW HOLDINGS'),
sums AS (SELECT r.filer_id, r.period_end, r.n, sum(CASE WHEN seq = 1 THEN value END) AS first_value, sum(CASE WHEN seq = n THEN value END) AS final_value,
  count(DISTINCT CASE WHEN seq = 1 THEN instrument END) AS first_names, count(DISTINCT CASE WHEN seq = n THEN instrument END) AS final_names FROM ranked r JOIN holdings USING (accession) GROUP BY r.filer_id, r.period_end, r.n)
SELECT filer_id, period_end, n AS versions, round(first_value, 2) AS first_value, round(final_value, 2) AS final_value, round(final_value / nullif(first_value, 0) - 1, 6) AS change, final_names - first_names AS names_added FROM sums WHERE n > 1"""


@plan
def pit_lag_profile(d: Spark) -> str:
    """Distribution of filing delays."""
    lag = d.days("known", "period_end")
    q = ", ".join(f"round({d.quantile('lag', p)}, 6) AS p{int(p * 100)}" for p in (0.05, 0.5, 0.9, 0.99))
    return f"SELECT kind, count(*) AS n, {q}, max(lag) AS worst, round(avg(CASE WHEN lag <= 45 THEN 1e0 ELSE 0e0 END), 6) AS within_45 FROM (SELECT kind, {lag} AS lag FROM revisions) r GROUP BY kind"


@plan
def pit_late_again(d: Spark) -> str:
    """How often a late filer is late again."""
    return f"""WITH lags AS (SELECT filer_id, period_end, max({d.days("known", "period_end")}) > 45 AS late FROM revisions GROUP BY filer_id, period_end),
pairs AS (SELECT late, lead(late) OVER (PARTITION BY filer_id ORDER BY period_end) AS next FROM lags)
SELECT late, count(*) AS n, round(avg(CASE WHEN next THEN 1e0 ELSE 0e0 END), 6) AS late_again FROM pairs WHERE next IS NOT NULL GROUP BY late"""


@plan
def pit_activation(d: Spark) -> str:
    """First month-end at which four fifths of a period's filers have filed, at latest 150 days on; then monotone."""
    return f"""WITH firsts AS (SELECT period_end, filer_id, min(known) AS known FROM revisions GROUP BY period_end, filer_id),
days AS (SELECT DISTINCT known AS day FROM revisions),
cover AS (SELECT f.period_end, day, sum(CASE WHEN known <= day THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS share FROM firsts f JOIN days ON day > f.period_end AND day <= {d.plus("f.period_end", 150)} GROUP BY f.period_end, day),
picked AS (SELECT period_end, coalesce(min(CASE WHEN share >= 0.8 THEN day END), max(day)) AS active FROM cover GROUP BY period_end)
SELECT period_end, active, max({d.plus("active", 1)}) OVER (ORDER BY period_end ROWS UNBOUNDED PRECEDING) AS trade_date FROM picked"""


@plan
def assign_signal_periods(d: Spark) -> str:
    """The latest active period at each month-end, not older than 200 days."""
    return f"""WITH active AS (SELECT period_end, {d.plus("period_end", 45)} AS live FROM quarters),
months AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month FROM prices)
SELECT month, max(period_end) AS period_end FROM months JOIN active ON live <= month GROUP BY month HAVING {d.days("month", "max(period_end)")} <= 200"""


@plan
def orphan_counts(d: Spark) -> str:
    """Holdings against covers: matched, and either side alone."""
    return f"""SELECT count(h.accession) AS holding_rows, sum(CASE WHEN h.accession IS NOT NULL AND r.accession IS NULL THEN 1 ELSE 0 END) AS orphans, sum(CASE WHEN h.accession IS NULL THEN 1 ELSE 0 END) AS empty_filings
FROM holdings h FULL OUTER JOIN revisions r ON h.accession = r.accession"""


@plan
def position_deltas(d: Spark) -> str:
    """Full outer change of every position."""
    return "SELECT q, filer_id, instrument, round(shares - shares_before, 4) + 0e0 AS d_shares, round(value - value_before, 3) + 0e0 AS d_value, shares_before = 0 AS opened, shares = 0 AS closed FROM moves"


@plan
def trade_deltas_signed(d: Spark) -> str:
    """The same changes as one signed sum over a union."""
    return """WITH signed AS (SELECT q, filer_id, instrument, shares FROM numbered UNION ALL SELECT q + 1, filer_id, instrument, -shares FROM numbered WHERE q < (SELECT max(q) FROM quarters))
SELECT q, instrument, round(sum(shares), 2) AS net_shares, count(DISTINCT filer_id) AS filers FROM signed WHERE q > (SELECT min(q) FROM quarters) GROUP BY q, instrument"""


@plan
def turnover(d: Spark) -> str:
    """Twice the absolute value change over both books."""
    return "SELECT q, filer_id, round(2 * sum(abs(value - value_before)) / nullif(sum(value + value_before), 0), 6) AS turnover FROM moves GROUP BY q, filer_id"


@plan
def entry_exit(d: Spark) -> str:
    """Names entered and left, against the previous holders."""
    return """SELECT q, instrument, sum(CASE WHEN shares_before = 0 THEN 1 ELSE 0 END) / CAST(greatest(sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END), 1) AS DOUBLE) AS entry_rate,
sum(CASE WHEN shares = 0 THEN 1 ELSE 0 END) / CAST(greatest(sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END), 1) AS DOUBLE) AS exit_rate FROM moves GROUP BY q, instrument"""


@plan
def set_stability(d: Spark) -> str:
    """Jaccard similarity of consecutive holder sets, with entries, exits and symmetric difference."""
    return """SELECT q, filer_id, sum(CASE WHEN shares > 0 AND shares_before > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS jaccard,
sum(CASE WHEN shares_before = 0 THEN 1 ELSE 0 END) AS entries, sum(CASE WHEN shares = 0 THEN 1 ELSE 0 END) AS exits, sum(CASE WHEN shares = 0 OR shares_before = 0 THEN 1 ELSE 0 END) AS churn FROM moves GROUP BY q, filer_id"""


@plan
def common_filers(d: Spark) -> str:
    """Per quarter: filers of this and the previous one, by intersection; new positions, by difference."""
    return """WITH f AS (SELECT DISTINCT q, filer_id FROM numbered), p AS (SELECT DISTINCT q, filer_id, instrument FROM numbered),
both_ AS (SELECT q, filer_id FROM f INTERSECT SELECT q + 1, filer_id FROM f), fresh AS (SELECT q, filer_id, instrument FROM p EXCEPT SELECT q + 1, filer_id, instrument FROM p),
a AS (SELECT q, count(*) AS common FROM both_ GROUP BY q), b AS (SELECT q, count(*) AS new_pairs FROM fresh GROUP BY q)
SELECT q, common, new_pairs FROM a JOIN b USING (q)"""


@plan
def breadth(d: Spark) -> str:
    """Share of filers holding a name, its change, and the change among filers of both quarters."""
    return """WITH n AS (SELECT q, count(DISTINCT filer_id) AS filers FROM numbered GROUP BY q),
both_ AS (SELECT a.q, a.filer_id FROM (SELECT DISTINCT q, filer_id FROM numbered) a JOIN (SELECT DISTINCT q, filer_id FROM numbered) b ON a.q = b.q + 1 AND a.filer_id = b.filer_id),
size_ AS (SELECT q, count(*) AS common FROM both_ GROUP BY q),
h AS (SELECT m.q, m.instrument, sum(CASE WHEN shares > 0 THEN 1 ELSE 0 END) AS holders, sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END) AS before,
  sum(CASE WHEN b.filer_id IS NOT NULL AND shares > 0 THEN 1 ELSE 0 END) - sum(CASE WHEN b.filer_id IS NOT NULL AND shares_before > 0 THEN 1 ELSE 0 END) AS d_common
  FROM moves m LEFT JOIN both_ b ON m.q = b.q AND m.filer_id = b.filer_id GROUP BY m.q, m.instrument)
SELECT h.q, instrument, round(holders / CAST(n.filers AS DOUBLE), 6) AS breadth_level, round(holders / CAST(n.filers AS DOUBLE) - before / CAST(p.filers AS DOUBLE), 6) AS dbreadth, round(d_common / CAST(common AS DOUBLE), 6) AS dbreadth_common
FROM h JOIN n ON h.q = n.q JOIN n p ON p.q = h.q - 1 JOIN size_ s ON s.q = h.q"""


@plan
def holder_concentration(d: Spark) -> str:
    """Herfindahl index over a name's holders, by shares."""
    return "SELECT q, instrument, round(sum(s * s), 6) AS herf_holders, count(*) AS holders FROM (SELECT q, instrument, shares / sum(shares) OVER (PARTITION BY q, instrument) AS s FROM numbered) x GROUP BY q, instrument"


@plan
def filer_stats(d: Spark) -> str:
    """Book size, number, top weight, Herfindahl index and its normalised form, one for a single position."""
    return """SELECT q, filer_id, round(max(book), 2) AS book, count(*) AS positions, round(max(w), 6) AS top1, round(sum(w * w), 6) AS hhi,
round(least(greatest((sum(w * w) - 1e0 / greatest(count(*), 2)) / (1 - 1e0 / greatest(count(*), 2)), 0), 1), 6) AS hhi_norm FROM numbered GROUP BY q, filer_id"""


@plan
def top_share(d: Spark) -> str:
    """Share of a quarter's value in its ten largest positions; ten of each of many parts of it come first, so no task orders a whole quarter."""
    if isinstance(d, DuckDB):
        return "SELECT q, round(sum(CASE WHEN rn <= 10 THEN value ELSE 0 END) / sum(value), 6) AS top10 FROM (SELECT q, value, row_number() OVER (PARTITION BY q ORDER BY value DESC, filer_id, instrument) AS rn FROM numbered) x GROUP BY q"
    return """WITH p AS (SELECT q, value, filer_id, instrument, row_number() OVER (PARTITION BY q, pmod(hash(filer_id, instrument), 256) ORDER BY value DESC) AS r FROM numbered),
t AS (SELECT q, value, row_number() OVER (PARTITION BY q ORDER BY value DESC) AS rn FROM p WHERE r <= 10), a AS (SELECT q, sum(value) AS value FROM numbered GROUP BY q)
SELECT t.q, round(sum(t.value) / max(a.value), 6) AS top10 FROM t JOIN a ON a.q = t.q WHERE rn <= 10 GROUP BY t.q"""


@plan
def new_conviction(d: Spark) -> str:
    """Share of filers in whose book a name weighs at least the book's ninth decile; the part new or grown by a quarter, splits apart.

    Every name with five holders now or before has its row, with zeros where no filer counts.
    """
    return f"""WITH limits AS (SELECT q, filer_id, {d.quantile("w", 0.9)} AS q90 FROM numbered GROUP BY q, filer_id),
n AS (SELECT q, count(*) AS filers FROM limits GROUP BY q),
t AS (SELECT m.q, m.instrument, m.filer_id, m.shares, m.shares_before, CASE WHEN m.w >= l.q90 THEN m.filer_id END AS top_,
  CASE WHEN m.w >= l.q90 AND (m.shares_before = 0 OR m.shares >= 1.25 * m.shares_before) THEN m.filer_id END AS fresh FROM moves m LEFT JOIN limits l ON m.q = l.q AND m.filer_id = l.filer_id)
SELECT t.q, instrument, round(count(DISTINCT top_) / CAST(max(n.filers) AS DOUBLE), 6) AS conviction_top, round(count(DISTINCT fresh) / CAST(max(n.filers) AS DOUBLE), 6) AS new_conviction
FROM t JOIN n ON t.q = n.q GROUP BY t.q, instrument HAVING greatest(sum(CASE WHEN shares > 0 THEN 1 ELSE 0 END), sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END)) >= 5"""


@plan
def trade_imbalance(d: Spark) -> str:
    """Buyers against sellers, by number and by volume, splits apart, of names with five holders now or before."""
    return """SELECT q, instrument, round((b - s) / nullif(CAST(b + s AS DOUBLE), 0), 6) AS ti, round((bv - sv) / nullif(bv + sv, 0), 6) AS vi, b + s AS n_active FROM (
SELECT q, instrument, sum(CASE WHEN shares > shares_before THEN 1 ELSE 0 END) AS b, sum(CASE WHEN shares < shares_before THEN 1 ELSE 0 END) AS s,
sum(greatest(shares - shares_before, 0)) AS bv, sum(greatest(shares_before - shares, 0)) AS sv,
greatest(sum(CASE WHEN shares > 0 THEN 1 ELSE 0 END), sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END)) AS crowd FROM moves GROUP BY q, instrument) x WHERE crowd >= 5"""


@plan
def caf_consensus(d: Spark) -> str:
    """Net dollar flow over a quarter's dollar volume; agreement of buyers and sellers."""
    return """SELECT m.q, m.instrument, round(sum((shares - shares_before) * price) / nullif(max(adv) * 63, 0), 6) + 0e0 AS caf,
CASE WHEN sum(CASE WHEN shares <> shares_before THEN 1 ELSE 0 END) >= 3 THEN round((sum(CASE WHEN shares > shares_before THEN 1 ELSE 0 END) - sum(CASE WHEN shares < shares_before THEN 1 ELSE 0 END)) / CAST(sum(CASE WHEN shares <> shares_before THEN 1 ELSE 0 END) AS DOUBLE), 6) END AS consensus
FROM moves m JOIN quarters k ON m.q = k.q JOIN market x ON x.period_end = k.period_end AND x.instrument = m.instrument GROUP BY m.q, m.instrument"""


@plan
def days_adv(d: Spark) -> str:
    """Dollars held over daily dollar volume, and the change at the same volume."""
    return "SELECT m.q, m.instrument, round(sum(value) / nullif(max(adv), 0), 6) AS days_adv, round((sum(value) - sum(value_before)) / nullif(max(adv), 0), 6) AS d_days_adv FROM moves m JOIN quarters k ON m.q = k.q JOIN market x ON x.period_end = k.period_end AND x.instrument = m.instrument GROUP BY m.q, m.instrument"


@plan
def institutional_ownership(d: Spark) -> str:
    """Shares held over shares outstanding (twice the traded volume here), its change over one and two quarters."""
    return """WITH io AS (SELECT n.q, n.instrument, sum(shares) / max(cap / price * 2) AS io FROM numbered n JOIN market x USING (period_end, instrument) GROUP BY n.q, n.instrument)
SELECT q, instrument, round(io, 6) AS pso, round(io - lag(io) OVER w, 6) AS dio, round(io - lag(io, 2) OVER w, 6) AS dio_2q FROM io WHERE io > 0 AND io < 1.5 WINDOW w AS (PARTITION BY instrument ORDER BY q)"""


@plan
def late_minus_early(d: Spark) -> str:
    """Ownership change of late filers less that of early ones, over the prior shares."""
    return f"""WITH first_ AS (SELECT filer_id, period_end, min(known) AS known FROM revisions GROUP BY filer_id, period_end),
side AS (SELECT k.q, filer_id, {d.days("known", "first_.period_end")} <= 20 AS early FROM first_ JOIN quarters k ON k.period_end = first_.period_end)
SELECT m.q, instrument, round((sum(CASE WHEN early THEN 0 ELSE shares - shares_before END) - sum(CASE WHEN early THEN shares - shares_before ELSE 0 END)) / nullif(sum(shares_before), 0), 6) AS late_minus_early FROM moves m JOIN side s ON m.q = s.q AND m.filer_id = s.filer_id GROUP BY m.q, instrument"""


@plan
def flow_rates(d: Spark) -> str:
    """A filer's net purchases over its previous book."""
    return "SELECT m.q, filer_id, round(sum((shares - shares_before) * price) / nullif(sum(value_before), 0), 6) AS flow FROM moves m JOIN quarters k ON m.q = k.q JOIN market x ON x.period_end = k.period_end AND x.instrument = m.instrument GROUP BY m.q, filer_id"


@plan
def footprint(d: Spark) -> str:
    """Book, impact cost by the square root law, and centrality as overlap with all other books."""
    return """WITH s AS (SELECT n.*, adv, vol, sum(w) OVER (PARTITION BY n.q, n.instrument) AS all_w FROM numbered n JOIN market x USING (period_end, instrument))
SELECT q, filer_id, round(max(book), 2) AS book, round(sum(value * vol * sqrt(value / nullif(adv, 0))), 2) AS impact_cost, round(10000 * sum(value * vol * sqrt(value / nullif(adv, 0))) / max(book), 6) AS impact_bps, round(sum(w * all_w) - sum(w * w), 6) AS centrality FROM s GROUP BY q, filer_id"""


@plan
def synchrony(d: Spark) -> str:
    """How far a filer trades in the direction of its peers."""
    return """WITH t AS (SELECT q, filer_id, instrument, sign(shares - shares_before) AS s, abs(value - value_before) AS size_ FROM moves WHERE shares <> shares_before),
p AS (SELECT *, (sum(s) OVER (PARTITION BY q, instrument) - s) / nullif(count(*) OVER (PARTITION BY q, instrument) - 1, 0) AS peers FROM t)
SELECT q, filer_id, round(sum(s * peers * size_) / nullif(sum(CASE WHEN peers IS NOT NULL THEN size_ END), 0), 6) AS synchrony FROM p GROUP BY q, filer_id"""


@plan
def split_factor(d: Spark) -> str:
    """Most common share ratio among holders of both quarters, in thousandths, and the factor where it has support."""
    return """WITH c AS (SELECT q, instrument, ratio, count(*) AS k FROM ratios GROUP BY q, instrument, ratio),
o AS (SELECT *, sum(k) OVER (PARTITION BY q, instrument) AS n, row_number() OVER (PARTITION BY q, instrument ORDER BY k DESC, ratio) AS rn FROM c)
SELECT o.q, o.instrument, ratio AS mode_ratio, k, n, coalesce(s.factor, 1e0) AS factor FROM o LEFT JOIN splits s ON o.q = s.q AND o.instrument = s.instrument WHERE rn = 1"""


@plan
def position_ages(d: Spark) -> str:
    """Consecutive quarters held, capped at four, by gaps and islands; ownership change by age."""
    return f"""WITH i AS (SELECT q, filer_id, instrument, shares, q - row_number() OVER (PARTITION BY filer_id, instrument ORDER BY q) AS island FROM numbered),
a AS (SELECT *, least(row_number() OVER (PARTITION BY filer_id, instrument, island ORDER BY q) - 1, 4) AS age FROM i)
SELECT q, age, count(*) AS positions, round(sum(shares), 2) AS shares, count(DISTINCT filer_id) AS filers FROM a GROUP BY q, age"""


@plan
def margins(d: Spark) -> str:
    """Extensive margin (births less deaths over prior holders) and intensive margin."""
    return "SELECT q, instrument, round((sum(CASE WHEN shares_before = 0 THEN 1 ELSE 0 END) - sum(CASE WHEN shares = 0 THEN 1 ELSE 0 END)) / nullif(CAST(sum(CASE WHEN shares_before > 0 THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS extensive, round(sum(CASE WHEN shares > 0 AND shares_before > 0 THEN shares - shares_before ELSE 0 END) / nullif(sum(shares_before), 0), 6) AS intensive FROM moves GROUP BY q, instrument"


@plan
def reporting_status(d: Spark) -> str:
    """Ledger: filings by kind and whether a later version replaced them."""
    return """WITH n AS (SELECT *, max(CASE WHEN kind <> 'NEW HOLDINGS' THEN known END) OVER (PARTITION BY cik, period_end) AS replaced FROM revisions)
SELECT kind, CASE WHEN replaced > known THEN 'superseded' ELSE 'live' END AS status, count(*) AS n FROM n GROUP BY kind, CASE WHEN replaced > known THEN 'superseded' ELSE 'live' END"""


@plan
def residual_duplicates(d: Spark) -> str:
    """Rows of one (period, instrument, shares) that more than one filer reports, and how many do."""
    return """WITH r AS (SELECT period_end, instrument, shares, filer_id, accession FROM folded JOIN holdings USING (accession) WHERE shares > 0),
n AS (SELECT period_end, instrument, shares, count(DISTINCT filer_id) AS filers FROM r GROUP BY period_end, instrument, shares HAVING count(DISTINCT filer_id) > 1)
SELECT period_end, instrument, shares, filers, filer_id, accession FROM n JOIN r USING (period_end, instrument, shares)"""


@plan
def overlap_network(d: Spark) -> str:
    """Overlap of filers' books as the sum of smaller weights, per quarter and pair that shares a name."""
    return "SELECT a.q, a.filer_id AS a, b.filer_id AS b, round(sum(least(a.w, b.w)), 6) AS overlap, count(*) AS shared FROM numbered a JOIN numbered b ON a.q = b.q AND a.instrument = b.instrument AND a.filer_id < b.filer_id GROUP BY a.q, a.filer_id, b.filer_id"


@plan
def coownership_diffusion(d: Spark) -> str:
    """Shock to a name spread over names held together with it, rows of the graph normalised.

    The graph's weights are sums over filers of both positions' values, so its product with the
    shocks needs only sums per filer; the graph itself, which the check forms, never is.
    """
    shock = "SELECT q, instrument, sum(greatest(value_before - value, 0)) / nullif(sum(value_before), 0) AS x FROM moves GROUP BY q, instrument"
    if isinstance(d, DuckDB):
        return f"""WITH e AS (SELECT a.q, a.instrument AS i, b.instrument AS j, sum(a.value + b.value) AS v FROM numbered a JOIN numbered b ON a.q = b.q AND a.filer_id = b.filer_id AND a.instrument <> b.instrument GROUP BY a.q, a.instrument, b.instrument),
p AS (SELECT q, i, j, v / sum(v) OVER (PARTITION BY q, i) AS p FROM e), shock AS ({shock})
SELECT p.q, i AS instrument, round(sum(p * x), 6) AS spill FROM p JOIN shock s ON p.q = s.q AND p.j = s.instrument GROUP BY p.q, i"""
    return f"""WITH shock AS ({shock}), h AS (SELECT n.q, n.filer_id, n.instrument, n.value AS v, coalesce(x, 0) AS x, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS known FROM numbered n JOIN shock s ON n.q = s.q AND n.instrument = s.instrument),
f AS (SELECT n.*, count(*) OVER w AS names, sum(v) OVER w AS vs, sum(x) OVER w AS xs, sum(v * x) OVER w AS vxs, sum(known) OVER w AS seen FROM h n WINDOW w AS (PARTITION BY q, filer_id))
SELECT q, instrument, CASE WHEN sum(seen - known) > 0 THEN round(sum(v * (xs - x) + vxs - v * x) / sum(v * (names - 1) + vs - v), 6) END AS spill FROM f WHERE names > 1 GROUP BY q, instrument"""


#: Leaders by book, positions that an eligible book has, quarters of score history.
LEADERS, POSITIONS, TRAIL = 20, (3, 500), 4
COPYCAT = f"""stats AS (SELECT q, filer_id, max(book) AS aum, count(*) AS n FROM numbered GROUP BY q, filer_id HAVING count(*) BETWEEN {POSITIONS[0]} AND {POSITIONS[1]}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY aum DESC, filer_id) AS rk FROM stats),
fresh AS (SELECT q, filer_id, instrument FROM moves WHERE shares_before = 0),
size_ AS (SELECT q, filer_id, count(*) AS n FROM fresh GROUP BY q, filer_id),
lead_ AS (SELECT r.q, r.filer_id FROM ranked r JOIN size_ s ON r.q = s.q AND r.filer_id = s.filer_id WHERE rk <= {LEADERS}),
many AS (SELECT q, count(*) AS leaders FROM lead_ GROUP BY q),
hits AS (SELECT f.q, f.filer_id AS follower, l.filer_id AS leader, count(*) AS hits FROM fresh f JOIN fresh l ON l.q = f.q - 1 AND l.instrument = f.instrument JOIN lead_ k ON k.q = l.q AND k.filer_id = l.filer_id GROUP BY f.q, f.filer_id, l.filer_id),
scored AS (SELECT h.q, follower, leader, hits / CAST(s.n AS DOUBLE) AS overlap, sum(hits) OVER (PARTITION BY h.q, follower) / CAST(s.n AS DOUBLE) / leaders AS usual
  FROM hits h JOIN size_ s ON s.q = h.q AND s.filer_id = h.follower JOIN stats e ON e.q = h.q AND e.filer_id = h.follower JOIN many m ON m.q = h.q - 1
  LEFT JOIN ranked b ON b.q = h.q - 1 AND b.filer_id = h.follower AND b.rk <= {LEADERS} WHERE s.n >= 3 AND b.filer_id IS NULL)"""


@plan
def copycat_overlap(d: Spark) -> str:
    """Share of a follower's new names that a leader, one of the largest eligible books, had entered the quarter before, and what it is over the mean of all leaders."""
    return f"WITH {COPYCAT} SELECT q, follower, leader, round(overlap, 6) AS overlap, round(overlap - usual, 6) AS excess FROM scored WHERE overlap - usual > 1e-12"


@plan
def copycat_shadow(d: Spark) -> str:
    """Assets that shadow a leader: followers' books times their mean excess overlap of this and the last TRAIL quarters."""
    return f"""WITH {COPYCAT}, spread_ AS (SELECT q + i AS q, follower, leader, overlap - usual AS x FROM scored {d.each(TRAIL + 1)} WHERE overlap - usual > 1e-12),
means AS (SELECT q, follower, leader, avg(x) AS x FROM spread_ GROUP BY q, follower, leader)
SELECT m.q, leader, round(sum(x * aum), 2) AS shadow, count(*) AS followers FROM means m JOIN stats s ON s.q = m.q AND s.filer_id = m.follower GROUP BY m.q, leader"""


@plan
def implied_flow(d: Spark) -> str:
    """Book growth not explained by the book's return."""
    return """WITH r AS (SELECT b.q, b.instrument, a.price / b.price - 1 AS r FROM (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) a JOIN (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) b ON a.q = b.q + 1 AND a.instrument = b.instrument),
b AS (SELECT n.q + 1 AS q, filer_id, sum(value) AS aum, sum(value * coalesce(r, 0)) / sum(value) AS r_book, sum(CASE WHEN r IS NOT NULL THEN value ELSE 0 END) / sum(value) AS cover FROM numbered n LEFT JOIN r ON n.q = r.q AND n.instrument = r.instrument GROUP BY n.q, filer_id),
c AS (SELECT q, filer_id, sum(value) AS aum FROM numbered GROUP BY q, filer_id)
SELECT c.q, c.filer_id, round(c.aum / b.aum - (1 + r_book), 6) AS flow, round(cover, 6) AS coverage FROM c JOIN b ON c.q = b.q AND c.filer_id = b.filer_id WHERE cover >= 0.6"""


@plan
def forced_supply(d: Spark) -> str:
    """Expected sales of distressed filers, most liquid names first, over daily volume; the top fifth."""
    return """WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow, sum(value_before) AS aum FROM moves GROUP BY q, filer_id),
rk AS (SELECT n.q, n.filer_id, n.instrument, n.w, adv, (rank() OVER (PARTITION BY n.q, n.filer_id ORDER BY adv) + (count(*) OVER (PARTITION BY n.q, n.filer_id, adv) - 1) / 2e0) / count(*) OVER (PARTITION BY n.q, n.filer_id) AS pecking FROM numbered n JOIN market x USING (period_end, instrument)),
s AS (SELECT r.q, r.instrument, sum(abs(flow) * aum * w * pecking) / max(adv) AS supply FROM rk r JOIN f ON r.q = f.q AND r.filer_id = f.filer_id WHERE flow < -0.1 GROUP BY r.q, r.instrument)
SELECT q, instrument, round(supply, 4) AS supply, rn <= greatest(CAST(floor(n * 0.2) AS BIGINT), 3) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY supply DESC, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM s) x"""


@plan
def sold_fraction(d: Spark) -> str:
    """Mean fraction sold of positions, distressed filers against the others."""
    return """WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) < -0.1 AS distressed FROM moves GROUP BY q, filer_id)
SELECT distressed, round(avg(greatest(shares_before - shares, 0) / shares_before), 6) AS sold, count(*) AS n FROM moves m JOIN f ON m.q = f.q AND m.filer_id = f.filer_id WHERE shares_before > 0 AND distressed IS NOT NULL GROUP BY distressed"""


@plan
def flow_beta(d: Spark) -> str:
    """Each filer's flow against the common, book-weighted flow."""
    return """WITH f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow, sum(value_before) AS aum FROM moves GROUP BY q, filer_id),
g AS (SELECT q, sum(flow * aum) / sum(aum) AS g FROM f WHERE flow IS NOT NULL GROUP BY q)
SELECT filer_id, count(*) AS n, round(covar_pop(flow, g) / nullif(var_pop(g), 0), 5) AS beta FROM f JOIN g ON f.q = g.q WHERE flow IS NOT NULL GROUP BY filer_id HAVING count(*) >= 8"""


#: Quarters of flows that a covariance looks back over, and its weight of the diagonal.
LOOKBACK, SHRINKAGE = 12, 0.25


def flow_history(d: Spark) -> str:
    """dev: for each quarter, filers' flows of the LOOKBACK quarters before, less their mean there; spans: how many quarters these are."""
    return f"""f AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow FROM moves GROUP BY q, filer_id),
past AS (SELECT q + i + 1 AS q, q AS at_, filer_id, flow FROM f {d.each(LOOKBACK)} WHERE flow IS NOT NULL),
dev AS (SELECT q, at_, filer_id, flow - avg(flow) OVER (PARTITION BY q, filer_id) AS u FROM past),
spans AS (SELECT q, count(DISTINCT at_) AS n FROM past GROUP BY q)"""


@plan
def flow_covariance(d: Spark) -> str:
    """Covariance of filers' flows over the quarters before, shrunk toward its diagonal; missing flows count as the filer's mean.

    A covariance shrunk so has no negative eigenvalue, so nothing is left to clip.  Pairs without a common quarter have none.
    """
    return f"""WITH {flow_history(d)}, pairs AS (SELECT a.q, a.filer_id AS a, b.filer_id AS b, sum(a.u * b.u) AS s FROM dev a JOIN dev b ON a.q = b.q AND a.at_ = b.at_ AND a.filer_id <= b.filer_id GROUP BY a.q, a.filer_id, b.filer_id)
SELECT p.q, a, b, round(s / (n - 1) * CASE WHEN a = b THEN 1 ELSE {1 - SHRINKAGE} END, 6) AS covariance FROM pairs p JOIN spans t ON p.q = t.q WHERE n > 1"""


@plan
def fragility(d: Spark) -> str:
    """Holders' positions through the shrunk covariance of their flows, over the squared cap, every quarter.

    The quadratic form is the variance of one weighted sum per name, and its diagonal another; no matrix is formed.
    """
    return f"""WITH {flow_history(d)},
s AS (SELECT n.q, n.instrument, at_, sum(n.value * u) AS x, sum(n.value * u * n.value * u) AS y, max(m.cap) AS cap FROM numbered n JOIN market m ON m.period_end = n.period_end AND m.instrument = n.instrument JOIN dev ON dev.q = n.q AND dev.filer_id = n.filer_id GROUP BY n.q, n.instrument, at_)
SELECT s.q, instrument, round(({1 - SHRINKAGE} * sum(x * x) + {SHRINKAGE} * sum(y)) / max(n - 1) / (max(cap) * max(cap)), 6) AS fragility FROM s JOIN spans t ON s.q = t.q WHERE n > 1 GROUP BY s.q, instrument"""


@plan
def active_share(d: Spark) -> str:
    """Half the absolute weight difference to the market, over held names, and one less the common weight."""
    return """WITH m AS (SELECT q, instrument, sum(value) / sum(sum(value)) OVER (PARTITION BY q) AS wm FROM numbered GROUP BY q, instrument)
SELECT n.q, filer_id, round(0.5 * sum(abs(w - wm)), 6) AS held_only, round(1 - sum(least(w, wm)), 6) AS active_share FROM numbered n JOIN m ON n.q = m.q AND n.instrument = m.instrument GROUP BY n.q, filer_id"""


@plan
def dacwb(d: Spark) -> str:
    """Conviction-weighted change of active weight, the drift of prices taken out."""
    return """WITH r AS (SELECT a.q, a.instrument, a.price / b.price - 1 AS r FROM (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) a JOIN (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) b ON a.q = b.q + 1 AND a.instrument = b.instrument),
j AS (SELECT m.q, m.filer_id, m.instrument, coalesce(w, 0) AS w, coalesce(w_before, 0) AS wb, coalesce(r, 0) AS r FROM moves m LEFT JOIN r ON m.q = r.q AND m.instrument = r.instrument),
k AS (SELECT *, wb * (1 + r) / nullif(sum(wb * (1 + r)) OVER (PARTITION BY q, filer_id), 0) AS drifted, sum(w * w) OVER (PARTITION BY q, filer_id) AS conviction FROM j)
SELECT q, instrument, round(sum(conviction * (w - coalesce(drifted, 0))) / sum(conviction), 6) AS dacwb, round(sum(conviction * (w - wb)) / sum(conviction), 6) AS no_drift FROM k WHERE conviction > 0 GROUP BY q, instrument"""


@plan
def rotation_identity(d: Spark) -> str:
    """Change of a book's exposure to a characteristic as price drift, characteristic drift and rotation, which add up."""
    return """WITH z AS (SELECT q, instrument, price, ln(adv) AS z FROM market JOIN quarters USING (period_end)),
j AS (SELECT m.q, filer_id, m.instrument, coalesce(w, 0) AS w, coalesce(w_before, 0) AS wb, b.z AS z0, a.z AS z1, a.price / b.price AS g FROM moves m JOIN z a ON a.q = m.q AND a.instrument = m.instrument JOIN z b ON b.q = m.q - 1 AND b.instrument = m.instrument),
k AS (SELECT *, wb * g / nullif(sum(wb * g) OVER (PARTITION BY q, filer_id), 0) * sum(wb) OVER (PARTITION BY q, filer_id) AS wd FROM j)
SELECT q, filer_id, round(sum((wd - wb) * z0), 6) AS price_drift, round(sum(wd * (z1 - z0)), 6) AS char_drift, round(sum((w - wd) * z1), 6) AS rotation, round(sum(w * z1 - wb * z0), 6) AS total FROM k WHERE wd IS NOT NULL GROUP BY q, filer_id"""


@plan
def window_dressing(d: Spark) -> str:
    """How much more often a filer sells losers than the rest, and its mean over eight quarters."""
    return """WITH r AS (SELECT a.q, a.instrument, a.price / b.price - 1 AS r FROM (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) a JOIN (SELECT q, x.* FROM market x JOIN quarters USING (period_end)) b ON a.q = b.q + 1 AND a.instrument = b.instrument),
s AS (SELECT m.q, filer_id, avg(CASE WHEN r <= -0.05 THEN CASE WHEN shares < shares_before THEN 1e0 ELSE 0e0 END END) - avg(CASE WHEN r > -0.05 THEN CASE WHEN shares < shares_before THEN 1e0 ELSE 0e0 END END) AS wd FROM moves m JOIN r ON m.q = r.q AND m.instrument = r.instrument WHERE shares_before > 0 GROUP BY m.q, filer_id)
SELECT q, filer_id, round(wd, 6) + 0e0 AS wd, CASE WHEN count(wd) OVER w >= 4 THEN round(avg(wd) OVER w, 6) + 0e0 END AS wd_mean FROM s WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""


@plan
def sigmoid_breadth(d: Spark) -> str:
    """Breadth with filers weighed by the sigmoid of their trailing performance."""
    return """WITH p AS (SELECT m.q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS perf FROM moves m GROUP BY m.q, filer_id),
t AS (SELECT q, filer_id, CASE WHEN count(perf) OVER w >= 3 THEN sum(perf) OVER w END AS s FROM p WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
z AS (SELECT q, filer_id, 1 / (1 + exp(-(s - avg(s) OVER (PARTITION BY q)) / nullif(stddev_pop(s) OVER (PARTITION BY q), 0))) AS sw FROM t WHERE s IS NOT NULL),
all_ AS (SELECT q, sum(sw) AS total FROM z GROUP BY q)
SELECT n.q, instrument, round(sum(sw) / max(total), 6) AS weighted_breadth FROM numbered n JOIN z ON n.q = z.q AND n.filer_id = z.filer_id JOIN all_ ON all_.q = n.q GROUP BY n.q, instrument"""


#: An eligible filer's number of names, smallest book, and quarters of history.
NAMES_HELD, SMALLEST, HISTORY = (10, 200), 1000, 8


@plan
def endogenous_universe(d: Spark) -> str:
    """Filers with enough names, concentration above the median, mean turnover of four quarters above the lower third, a book of some size, and history; each condition by itself too."""
    return f"""WITH t AS (SELECT q, filer_id, 2 * sum(abs(value - value_before)) / nullif(sum(value + value_before), 0) AS turn FROM moves GROUP BY q, filer_id),
s AS (SELECT q, filer_id, count(*) AS n, max(book) AS book, round(least(greatest((sum(w * w) - 1e0 / greatest(count(*), 2)) / (1 - 1e0 / greatest(count(*), 2)), 0), 1), 9) AS h FROM numbered GROUP BY q, filer_id),
u AS (SELECT s.*, round(avg(turn) OVER (PARTITION BY s.filer_id ORDER BY s.q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS turn4, row_number() OVER (PARTITION BY s.filer_id ORDER BY s.q) AS history FROM s LEFT JOIN t ON s.q = t.q AND s.filer_id = t.filer_id),
c AS (SELECT q, {d.quantile("h", 0.5)} AS h50, {d.quantile("turn4", 1 / 3)} AS t33 FROM u GROUP BY q),
e AS (SELECT u.q, u.filer_id, n BETWEEN {NAMES_HELD[0]} AND {NAMES_HELD[1]} AS elig_names, h > h50 AS elig_concentrated, coalesce(turn4 > t33 + 1e-9, false) AS elig_active, book > {SMALLEST} AS elig_size, history >= {HISTORY} AS elig_history FROM u JOIN c ON u.q = c.q)
SELECT *, elig_names AND elig_concentrated AND elig_active AND elig_size AND elig_history AS eligible FROM e"""


@plan
def nowcast_dio(d: Spark) -> str:
    """Ownership change from the filers seen by day 30, scaled by coverage, against the later truth; OOS fit."""
    return f"""WITH seen AS (SELECT DISTINCT filer_id, k.q FROM revisions r JOIN quarters k USING (period_end) WHERE {d.days("known", "r.period_end")} <= 30),
c AS (SELECT m.q, m.instrument, sum(CASE WHEN s.filer_id IS NOT NULL THEN m.shares - m.shares_before ELSE 0 END) AS part, sum(m.shares - m.shares_before) AS full_, sum(CASE WHEN s.filer_id IS NOT NULL THEN m.shares_before ELSE 0 END) / nullif(sum(m.shares_before), 0) AS cover FROM moves m LEFT JOIN seen s ON m.q = s.q AND m.filer_id = s.filer_id GROUP BY m.q, m.instrument),
p AS (SELECT *, part / greatest(cover, 0.15) AS guess FROM c WHERE cover IS NOT NULL)
SELECT q, count(*) AS n, round(1 - sum((full_ - guess) * (full_ - guess)) / nullif(sum(full_ * full_), 0), 5) AS r2_oos, round(avg(CASE WHEN sign(full_) = sign(guess) THEN 1e0 ELSE 0e0 END), 6) AS hit FROM p GROUP BY q"""


@plan
def ragged_edge(d: Spark) -> str:
    """Running census of buys and sells as filings arrive after a quarter's end."""
    return f"""WITH first_ AS (SELECT filer_id, period_end, min(known) AS known FROM revisions GROUP BY filer_id, period_end),
v AS (SELECT m.q, k.period_end, f.known, m.instrument, sum(CASE WHEN shares > shares_before THEN 1 ELSE -1 END) AS net, count(*) AS votes FROM moves m JOIN quarters k ON m.q = k.q JOIN first_ f ON f.filer_id = m.filer_id AND f.period_end = k.period_end WHERE shares <> shares_before GROUP BY m.q, k.period_end, f.known, m.instrument)
SELECT q, known, instrument, sum(net) OVER w AS running_net, sum(votes) OVER w AS running_votes FROM v WINDOW w AS (PARTITION BY q, instrument ORDER BY known ROWS UNBOUNDED PRECEDING)"""


@plan
def hazard(d: Spark) -> str:
    """Chance of another cut after k consecutive ones."""
    return """WITH t AS (SELECT q, filer_id, instrument, shares < shares_before AS cut FROM moves),
i AS (SELECT *, q - row_number() OVER (PARTITION BY filer_id, instrument, cut ORDER BY q) AS island FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY filer_id, instrument, cut, island ORDER BY q) AS run, lead(cut) OVER (PARTITION BY filer_id, instrument ORDER BY q) AS next_cut FROM i)
SELECT least(run, 3) AS k, count(*) AS n, round(avg(CASE WHEN next_cut THEN 1e0 ELSE 0e0 END), 6) AS hazard FROM r WHERE cut AND next_cut IS NOT NULL GROUP BY least(run, 3)"""


@plan
def lookthrough_pressure(d: Spark) -> str:
    """Demand for funds passed through to the names in their baskets, over their caps."""
    return """WITH fund AS (SELECT q, filer_id, sum(value - value_before) AS demand, sum(value_before) AS aum FROM moves WHERE filer_id IN (SELECT fund FROM funds) GROUP BY q, filer_id)
SELECT f.q, b.instrument, round(sum(f.demand * b.w) / nullif(max(x.cap), 0), 6) AS pressure FROM fund f JOIN numbered b ON b.q = f.q - 1 AND b.filer_id = f.filer_id JOIN quarters k ON k.q = f.q - 1 JOIN market x ON x.period_end = k.period_end AND x.instrument = b.instrument GROUP BY f.q, b.instrument"""


@plan
def direct_vs_fund(d: Spark) -> str:
    """Holdings implied by funds against direct ones, full outer."""
    return """WITH f AS (SELECT q, instrument, sum(value) AS v FROM numbered WHERE filer_id IN (SELECT fund FROM funds) GROUP BY q, instrument), g AS (SELECT q, instrument, sum(value) AS v FROM numbered WHERE filer_id NOT IN (SELECT fund FROM funds) GROUP BY q, instrument)
SELECT coalesce(f.q, g.q) AS q, coalesce(f.instrument, g.instrument) AS instrument, round(coalesce(g.v, 0) - coalesce(f.v, 0), 2) AS gap, round(coalesce(f.v, 0) / (coalesce(f.v, 0) + coalesce(g.v, 0)), 6) AS fund_share FROM f FULL OUTER JOIN g ON f.q = g.q AND f.instrument = g.instrument"""


@plan
def black_litterman_views(d: Spark) -> str:
    """Views implied by active weights under a one-index risk model."""
    return """WITH i AS (SELECT day, avg(ret) AS m FROM prices WHERE ret IS NOT NULL GROUP BY day),
b AS (SELECT p.instrument, covar_samp(ret, m) / var_samp(m) AS beta, var_samp(ret) AS v, var_samp(m) AS vm FROM prices p JOIN i ON p.day = i.day WHERE ret IS NOT NULL GROUP BY p.instrument),
m AS (SELECT q, instrument, sum(value) / sum(sum(value)) OVER (PARTITION BY q) AS wm FROM numbered GROUP BY q, instrument),
a AS (SELECT n.q, filer_id, n.instrument, w - wm AS wa, beta, vm, v - beta * beta * vm AS idio FROM numbered n JOIN m ON n.q = m.q AND n.instrument = m.instrument JOIN b ON b.instrument = n.instrument)
SELECT q, instrument, round(avg(idio * wa), 6) AS q_idio, round(avg(beta * bw * vm + idio * wa), 6) AS q_full FROM (SELECT *, sum(beta * wa) OVER (PARTITION BY q, filer_id) AS bw FROM a) x GROUP BY q, instrument"""


@plan
def crosswalk_audit(d: Spark) -> str:
    """Life of each instrument, gaps in it, and its filers at either end."""
    return "SELECT instrument, min(q) AS first_q, max(q) AS last_q, max(q) - min(q) + 1 - count(DISTINCT q) AS gaps, count(DISTINCT filer_id) AS filers FROM numbered GROUP BY instrument"


@plan
def base_checks(d: Spark) -> str:
    """Violation counts: negative positions, filings known before their period ends, rows that repeat."""
    t = d.table
    return f"""SELECT 'negative' AS rule, count(*) AS violations FROM holdings WHERE shares <= 0 OR value <= 0
UNION ALL SELECT 'early', count(*) FROM revisions WHERE known <= period_end
UNION ALL SELECT 'repeated_lines', (SELECT count(*) FROM {t("lineitem")}) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM {t("lineitem")}) x)"""
