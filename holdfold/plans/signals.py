"""Plans on flow-driven signals, universes of filers, funds, and their evaluation.

Relations that several plans share are CTEs below; rows per quarter, never per position,
are what windows without a partition run over.
"""

from __future__ import annotations

from .analytics import SIGNALS, bins, pct_rank
from .dialect import Spark, plan

#: Market by number of quarter; returns against the quarter before; flows of filers.
MARKET = "mq AS (SELECT q, x.* FROM market x JOIN quarters USING (period_end))"
RETURNS = f"""{MARKET},
rq AS (SELECT a.q, a.instrument, a.price / b.price - 1 AS r, a.adv, a.cap FROM mq a JOIN mq b ON a.q = b.q + 1 AND a.instrument = b.instrument)"""
FLOWS = "fl AS (SELECT q, filer_id, sum(value - value_before) / nullif(sum(value_before), 0) AS flow, sum(value_before) AS aum FROM moves GROUP BY q, filer_id)"
#: Filers below this number stand for funds.
FUNDS = 20


def r6(x: str) -> str:
    """``x`` in six places, without negative zeros."""
    return f"round({x}, 6) + 0e0"


@plan
def cascade(d: Spark) -> str:
    """Outflow expected after salient losses, its slope from past quarters only, on the names that didn't fall."""
    return f"""WITH {RETURNS}, {FLOWS},
se AS (SELECT rq.q, n.filer_id, sum(CASE WHEN r < -0.05 THEN -n.w * r ELSE 0 END) AS se FROM numbered n JOIN rq ON rq.q = n.q + 1 AND rq.instrument = n.instrument GROUP BY rq.q, n.filer_id),
pool AS (SELECT f.q, count(*) AS n, sum(se) AS x, sum(flow) AS y, sum(se * se) AS xx, sum(se * flow) AS xy FROM se JOIN fl f ON f.q = se.q + 1 AND f.filer_id = se.filer_id WHERE flow IS NOT NULL GROUP BY f.q),
past AS (SELECT q, count(*) OVER w AS quarters_, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM pool WINDOW w AS (ORDER BY q ROWS UNBOUNDED PRECEDING)),
slope AS (SELECT q, (n * xy - x * y) / nullif(n * xx - x * x, 0) AS b FROM past WHERE quarters_ >= 8)
SELECT se.q, m.instrument, {r6("sum(-b * se * m.value) / max(rq.adv)")} AS pressure FROM se JOIN slope s ON s.q = se.q JOIN numbered m ON m.q = se.q AND m.filer_id = se.filer_id JOIN rq ON rq.q = m.q AND rq.instrument = m.instrument
WHERE b < 0 AND rq.r >= -0.05 GROUP BY se.q, m.instrument"""


def cramer(y: str, xs: list[str]) -> list[str]:
    """Slopes of ``y`` on two or three centred regressors, from columns named like ``a_b`` for their product sums."""
    s = lambda a, b: "_".join(sorted((a, b)))

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'-' if k % 2 else '+'} {m[0][k]} * {det([row[:k] + row[k + 1 :] for row in m[1:]])}" for k in range(len(m))).removeprefix("+ ") + ")"

    full = [[s(a, b) for b in xs] for a in xs]
    return [f"{det([[s(a, y) if k == j else full[i][k] for k in range(len(xs))] for i, a in enumerate(xs)])} / nullif({det(full)}, 0)" for j in range(len(xs))]


@plan
def flow_forecast(d: Spark) -> str:
    """Next quarter's flow from flow, performance and its losses, by pooled least squares over the past; the weakest tenth."""
    names = "abcy"
    sums = ", ".join([f"sum({x}) AS s{x}" for x in names] + [f"sum({x} * {z}) AS {x}_{z}" for i, x in enumerate(names) for z in names[i:]])
    running = ", ".join([f"sum(s{x}) OVER w AS s{x}" for x in names] + [f"sum({x}_{z}) OVER w AS {x}_{z}" for i, x in enumerate(names) for z in names[i:]])
    centred = ", ".join(f"{x}_{z} - s{x} * s{z} / n AS {x}_{z}" for i, x in enumerate(names) for z in names[i:])
    ba, bb, bc = cramer("y", ["a", "b", "c"])
    return f"""WITH {RETURNS}, {FLOWS},
perf AS (SELECT rq.q, n.filer_id, sum(n.w * r) / sum(n.w) AS perf FROM numbered n JOIN rq ON rq.q = n.q + 1 AND rq.instrument = n.instrument GROUP BY rq.q, n.filer_id),
x AS (SELECT f.q, f.filer_id, flow AS a, perf AS b, least(perf, 0) AS c FROM fl f JOIN perf p ON p.q = f.q AND p.filer_id = f.filer_id WHERE flow IS NOT NULL),
pool AS (SELECT f.q, count(*) AS n, {sums} FROM (SELECT f.q, a, b, c, f.flow AS y FROM x JOIN fl f ON f.q = x.q + 1 AND f.filer_id = x.filer_id WHERE f.flow IS NOT NULL) f GROUP BY f.q),
past AS (SELECT q, sum(n) OVER w AS n, {running} FROM pool WINDOW w AS (ORDER BY q ROWS UNBOUNDED PRECEDING)),
mid AS (SELECT q, n, sa / n AS ma, sb / n AS mb, sc / n AS mc, sy / n AS my, {centred} FROM past WHERE n >= 40),
beta AS (SELECT q, ma, mb, mc, my, {ba} AS ba, {bb} AS bb, {bc} AS bc FROM mid),
guess AS (SELECT x.q, filer_id, my + ba * (a - ma) + bb * (b - mb) + bc * (c - mc) AS g FROM x JOIN beta ON beta.q = x.q)
SELECT q, filer_id, round(g, 5) + 0e0 AS forecast, row_number() OVER (PARTITION BY q ORDER BY g, filer_id) <= floor(count(*) OVER (PARTITION BY q) * 0.1) AS weakest FROM guess WHERE g IS NOT NULL"""


@plan
def headroom(d: Spark) -> str:
    """What buyers could still add before their usual largest weight, over dollar volume."""
    return f"""WITH {MARKET},
tops AS (SELECT q, filer_id, {d.quantile("w", 0.95)} AS q95, max(book) AS book FROM numbered GROUP BY q, filer_id HAVING count(*) >= 5),
usual AS (SELECT q, filer_id, book, avg(q95) OVER w AS w_max, count(*) OVER w AS n FROM tops WINDOW w AS (PARTITION BY filer_id ORDER BY q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT m.q, m.instrument, {r6("sum(greatest(w_max - coalesce(m.w, 0), 0) * book) / max(adv)")} AS headroom, count(*) AS buyers FROM moves m JOIN usual u ON u.q = m.q AND u.filer_id = m.filer_id JOIN mq ON mq.q = m.q AND mq.instrument = m.instrument
WHERE shares > shares_before AND n >= 4 GROUP BY m.q, m.instrument"""


@plan
def signed_fragility(d: Spark) -> str:
    """Flow pressure on a name, scaled by its usual size over eight quarters."""
    return f"""WITH {MARKET}, {FLOWS},
p AS (SELECT m.q, m.instrument, sum(flow * value_before) / max(adv) AS p FROM moves m JOIN fl f ON f.q = m.q AND f.filer_id = m.filer_id JOIN mq ON mq.q = m.q AND mq.instrument = m.instrument WHERE flow IS NOT NULL GROUP BY m.q, m.instrument),
c AS (SELECT q, instrument, p, p - avg(p) OVER (PARTITION BY q) AS z FROM p)
SELECT q, instrument, {r6("p")} AS pressure, CASE WHEN count(z) OVER w >= 4 THEN round(p * sqrt(avg(z * z) OVER w), 4) + 0e0 END AS signed_fragility FROM c WINDOW w AS (PARTITION BY instrument ORDER BY q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""


@plan
def breadth_universes(d: Spark) -> str:
    """Breadth among all filers, those away from the market's weights, and the patient third."""
    return """WITH m AS (SELECT q, instrument, sum(value) / sum(sum(value)) OVER (PARTITION BY q) AS wm FROM numbered GROUP BY q, instrument),
age AS (SELECT q, filer_id, instrument, w, row_number() OVER (PARTITION BY filer_id, instrument, island ORDER BY q) AS age FROM (SELECT *, q - row_number() OVER (PARTITION BY filer_id, instrument ORDER BY q) AS island FROM numbered) i),
f AS (SELECT a.q, filer_id, round(0.5 * sum(abs(w - wm)), 9) AS active, round(sum(w * age), 9) AS vw_age FROM age a JOIN m ON m.q = a.q AND m.instrument = a.instrument GROUP BY a.q, filer_id),
g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY vw_age DESC, filer_id) AS rn, count(*) OVER (PARTITION BY q) AS n FROM f),
u AS (SELECT q, filer_id, 'all' AS universe FROM g UNION ALL SELECT q, filer_id, 'active' FROM g WHERE active >= 0.25 UNION ALL SELECT q, filer_id, 'patient' FROM g WHERE rn * 3 <= n AND q > 8),
s AS (SELECT q, universe, count(*) AS filers FROM u GROUP BY q, universe)
SELECT b.q, u.universe, b.instrument, round(count(*) / CAST(max(s.filers) AS DOUBLE), 6) AS breadth FROM numbered b JOIN u ON u.q = b.q AND u.filer_id = b.filer_id JOIN s ON s.q = u.q AND s.universe = u.universe GROUP BY b.q, u.universe, b.instrument"""


@plan
def absorption(d: Spark) -> str:
    """Fresh buying against forced selling in the third of names sold hardest, and what distressed filers still hold."""
    return f"""WITH {MARKET}, {FLOWS},
t AS (SELECT m.q, m.instrument, sum(CASE WHEN flow < -0.1 THEN greatest(value_before - value, 0) ELSE 0 END) AS forced, sum(CASE WHEN flow < -0.1 THEN value ELSE 0 END) AS left_,
  sum(CASE WHEN coalesce(flow, 0) >= -0.1 AND (shares_before = 0 OR shares >= 1.25 * shares_before) THEN value - value_before ELSE 0 END) AS fresh, max(adv) AS adv
  FROM moves m JOIN fl f ON f.q = m.q AND f.filer_id = m.filer_id JOIN mq ON mq.q = m.q AND mq.instrument = m.instrument GROUP BY m.q, m.instrument),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY forced / adv DESC, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM t WHERE forced > 0)
SELECT q, instrument, {r6("least(greatest(fresh / forced, 0), 5)")} AS absorption, {r6("left_ / adv")} AS overhang FROM k WHERE rn * 3 <= n"""


@plan
def rotation_residual(d: Spark) -> str:
    """Active change of weights, without price drift and what size and momentum explain within each book."""
    ba, bb = cramer("y", ["a", "b"])
    return f"""WITH {RETURNS},
j AS (SELECT m.q, filer_id, m.instrument, coalesce(w, 0) AS w, coalesce(w_before, 0) * (1 + r) AS grown, ln(cap) AS a, r AS b FROM moves m JOIN rq ON rq.q = m.q AND rq.instrument = m.instrument),
k AS (SELECT *, w - grown / nullif(sum(grown) OVER (PARTITION BY q, filer_id), 0) AS y FROM j),
c AS (SELECT q, filer_id, instrument, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM k WHERE y IS NOT NULL WINDOW w AS (PARTITION BY q, filer_id)),
s AS (SELECT q, filer_id, count(*) AS n, sum(a * y) AS a_y, sum(b * y) AS b_y, sum(a * a) AS a_a, sum(b * b) AS b_b, sum(a * b) AS a_b FROM c GROUP BY q, filer_id),
e AS (SELECT q, filer_id, {ba} AS ba, {bb} AS b2 FROM s WHERE n >= 6)
SELECT c.q, instrument, round(sum(y - ba * a - b2 * b), 5) + 0e0 AS rotation, count(*) AS filers FROM c JOIN e ON e.q = c.q AND e.filer_id = c.filer_id WHERE ba IS NOT NULL GROUP BY c.q, instrument"""


@plan
def redundancy_weights(d: Spark) -> str:
    """One over the sum of a book's cosines with all books, linear in positions: each unit vector against their sum."""
    return """WITH u AS (SELECT q, filer_id, instrument, w / sqrt(sum(w * w) OVER (PARTITION BY q, filer_id)) AS u FROM numbered),
s AS (SELECT q, instrument, sum(u) AS s FROM u GROUP BY q, instrument)
SELECT u.q, filer_id, round(1 / greatest(sum(u * s), 1e-6), 6) AS weight FROM u JOIN s ON s.q = u.q AND s.instrument = u.instrument GROUP BY u.q, filer_id"""


@plan
def squeeze_alarm(d: Spark) -> str:
    """Days after a five-day rally on more than twice the usual volume."""
    return f"""WITH x AS (SELECT instrument, day, dollars, sum(ret) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rally,
  {d.quantile("dollars", 0.5)} OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS usual, count(*) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS n FROM prices)
SELECT instrument, day, {r6("rally")} AS rally, {r6("dollars / usual")} AS volume_ratio FROM x WHERE n >= 21 AND rally > 0.1 AND dollars > 2 * usual"""


@plan
def crowding_state(d: Spark) -> str:
    """A name's signal in standard deviations of its own past, eight quarters at least."""
    return f"""WITH {SIGNALS},
h AS (SELECT q, instrument, s, avg(s) OVER w AS m, stddev_samp(s) OVER w AS sd, count(s) OVER w AS n FROM panel_ WINDOW w AS (PARTITION BY instrument ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT q, instrument, CASE WHEN n >= 8 THEN round((s - m) / nullif(sd, 0), 5) + 0e0 END AS state FROM h"""


@plan
def conf_reveal(d: Spark) -> str:
    """Next return of names that additions disclosed in the last four quarters, against all names."""
    return f"""WITH {SIGNALS},
told AS (SELECT DISTINCT k.q, h.instrument FROM visible v JOIN quarters k ON k.period_end = v.period_end JOIN holdings h ON h.accession = v.accession WHERE v.kind = 'NEW HOLDINGS'),
flags AS (SELECT DISTINCT p.q, p.instrument FROM panel_ p JOIN told t ON t.instrument = p.instrument AND t.q BETWEEN p.q - 3 AND p.q)
SELECT p.q, count(f.q) AS flagged, count(*) AS names, {r6("avg(CASE WHEN f.q IS NOT NULL THEN fwd END) - avg(fwd)")} AS excess FROM panel_ p LEFT JOIN flags f ON f.q = p.q AND f.instrument = p.instrument WHERE fwd IS NOT NULL GROUP BY p.q"""


def entries(d: Spark) -> str:
    """Per quarter and name: the signal, and returns from the first trade strictly after availability, over some horizons."""
    at = ", ".join(f"lead(price, {h}) OVER w / price - 1 AS r{h}" for h in (1, 5, 10))
    return f"""{SIGNALS},
path AS (SELECT instrument, day, {at} FROM prices WINDOW w AS (PARTITION BY instrument ORDER BY day)),
live AS (SELECT q, {d.plus("period_end", 60)} AS live FROM quarters),
entry_ AS (SELECT l.q, p.instrument, min(p.day) AS day FROM live l JOIN path p ON p.day > l.live AND p.day <= {d.plus("l.live", 30)} GROUP BY l.q, p.instrument),
event_ AS (SELECT s.q, s.instrument, s.s, r1, r5, r10 FROM sig s JOIN entry_ e ON e.q = s.q AND e.instrument = s.instrument JOIN path p ON p.instrument = e.instrument AND p.day = e.day),
long_ AS (SELECT q, instrument, s, 1 AS horizon, r1 AS r FROM event_ UNION ALL SELECT q, instrument, s, 5, r5 FROM event_ UNION ALL SELECT q, instrument, s, 10, r10 FROM event_),
kept AS (SELECT * FROM long_ WHERE r IS NOT NULL AND s IS NOT NULL)"""


@plan
def event_study(d: Spark) -> str:
    """Outer quintiles' returns after entry strictly past availability, net of costs, by horizon."""
    return f"""WITH {entries(d)},
b AS (SELECT q, horizon, r, {bins(d, "rn", "n", 5)} AS bin FROM (SELECT *, row_number() OVER (PARTITION BY q, horizon ORDER BY s, instrument) AS rn, count(*) OVER (PARTITION BY q, horizon) AS n FROM kept) x),
e AS (SELECT q, horizon, avg(CASE WHEN bin = 4 THEN r END) - avg(CASE WHEN bin = 0 THEN r END) AS spread FROM b GROUP BY q, horizon)
SELECT horizon, count(spread) AS events, {r6("avg(spread)")} AS spread, {r6("avg(spread) - 0.002")} AS net, round(avg(spread) / nullif(stddev_samp(spread), 0) * sqrt(count(spread)), 5) + 0e0 AS t FROM e GROUP BY horizon"""


@plan
def forward_ic(d: Spark) -> str:
    """Rank correlation of the signal with returns, by quarter and horizon."""
    return f"""WITH {entries(d)},
r AS (SELECT q, horizon, {pct_rank("s", "q, horizon")} AS a, {pct_rank("r", "q, horizon")} AS b FROM kept)
SELECT q, horizon, count(*) AS n, {r6("corr(a, b)")} AS ic FROM r GROUP BY q, horizon HAVING count(*) >= 8"""


RANKED = f"""{SIGNALS},
rk AS (SELECT q, instrument, fwd, adv, vol, cap, {pct_rank("s", "q")} AS r FROM panel_ WHERE s IS NOT NULL),
dm AS (SELECT *, r - avg(r) OVER (PARTITION BY q) AS x FROM rk),
wt AS (SELECT q, instrument, fwd, adv, vol, cap, x / nullif(sum(abs(x)) OVER (PARTITION BY q), 0) AS wt FROM dm)"""


@plan
def target_backtest(d: Spark) -> str:
    """Target weights held a quarter: return, turnover, square-root impact at ten thousand in capital, borrow on shorts."""
    return f"""WITH {RANKED},
t AS (SELECT coalesce(a.q, b.q + 1) AS q, a.wt, a.fwd, coalesce(a.adv, b.adv) AS adv, coalesce(a.vol, b.vol) AS vol, abs(coalesce(a.wt, 0) - coalesce(b.wt, 0)) AS trade FROM wt a FULL OUTER JOIN wt b ON a.q = b.q + 1 AND a.instrument = b.instrument),
s AS (SELECT q, sum(wt * fwd) AS gross, sum(trade) AS turnover, sum(trade * vol * sqrt(trade * 1e4 / adv)) AS impact, sum(greatest(-wt, 0)) * 0.005 / 4 AS borrow FROM t GROUP BY q)
SELECT q, {r6("gross")} AS gross, {r6("turnover")} AS turnover, {r6("impact")} AS impact, {r6("borrow")} AS borrow, {r6("gross - impact - borrow")} AS net FROM s WHERE gross IS NOT NULL"""


@plan
def capacity_curve(d: Spark) -> str:
    """Impact cost of a quarter's trades, by capital."""
    return f"""WITH {RANKED},
t AS (SELECT a.q, abs(a.wt - b.wt) AS trade, a.vol, a.adv FROM wt a JOIN wt b ON a.q = b.q + 1 AND a.instrument = b.instrument),
grid AS (SELECT power(1e1, i + 3) AS capital FROM {d.numbers(5)} n)
SELECT capital, round(avg(cost), 5) AS cost FROM (SELECT capital, q, sum(trade * vol * sqrt(trade * capital / adv)) AS cost FROM t CROSS JOIN grid GROUP BY capital, q) c GROUP BY capital"""


@plan
def exposure_diagnostics(d: Spark) -> str:
    """Sides of the portfolio: gross, net, names, and the tilt to size."""
    return f"""WITH {RANKED}
SELECT q, {r6("sum(greatest(wt, 0))")} AS long_side, {r6("sum(greatest(-wt, 0))")} AS short_side, {r6("sum(abs(wt))")} AS gross, sum(CASE WHEN wt > 1e-9 THEN 1 ELSE 0 END) AS longs, sum(CASE WHEN wt < -1e-9 THEN 1 ELSE 0 END) AS shorts, {r6("sum(wt * ln(cap))")} AS size_tilt FROM wt WHERE wt IS NOT NULL GROUP BY q"""


@plan
def benchmark_spreads(d: Spark) -> str:
    """Tercile spreads of next returns by size, momentum and illiquidity."""
    return f"""WITH {RETURNS},
x AS (SELECT a.q, a.instrument, b.r AS nxt, -ln(a.cap) AS smb, a.r AS mom, -ln(a.adv) AS illiq FROM rq a JOIN rq b ON b.q = a.q + 1 AND b.instrument = a.instrument),
l AS (SELECT q, instrument, nxt, 'smb' AS sort_, smb AS v FROM x UNION ALL SELECT q, instrument, nxt, 'mom', mom FROM x UNION ALL SELECT q, instrument, nxt, 'illiq', illiq FROM x),
b AS (SELECT *, {bins(d, "rn", "n", 3)} AS bin FROM (SELECT *, row_number() OVER (PARTITION BY q, sort_ ORDER BY v, instrument) AS rn, count(*) OVER (PARTITION BY q, sort_) AS n FROM l) k)
SELECT q, sort_, {r6("avg(CASE WHEN bin = 2 THEN nxt END) - avg(CASE WHEN bin = 0 THEN nxt END)")} AS spread FROM b GROUP BY q, sort_"""


@plan
def calendar_returns(d: Spark) -> str:
    """Compounded returns by year of the mean name, quarter by quarter."""
    return f"""WITH {RETURNS},
m AS (SELECT q, avg(r) AS r FROM rq GROUP BY q)
SELECT year(period_end) AS year, count(*) AS quarters, {r6("exp(sum(ln(1 + r))) - 1")} AS ret FROM m JOIN quarters USING (q) GROUP BY year(period_end)"""


@plan
def residual_quarter_return(d: Spark) -> str:
    """Log return less market beta, the beta from strictly past quarters."""
    return f"""WITH {RETURNS},
x AS (SELECT q, instrument, ln(1 + r) AS y, avg(ln(1 + r)) OVER (PARTITION BY q) AS m FROM rq),
b AS (SELECT *, covar_pop(y, m) OVER w AS cv, var_pop(m) OVER w AS vm, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY instrument ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT q, instrument, CASE WHEN n >= 4 AND vm > 1e-12 THEN round(y - cv / vm * m, 5) + 0e0 END AS residual FROM b"""


@plan
def robust_caps(d: Spark) -> str:
    """Cap weights with outliers against dollar volume replaced by the fit, at most a tenth each, normalised."""
    return f"""WITH {MARKET},
f AS (SELECT q, regr_slope(ln(cap), ln(adv)) AS b, regr_intercept(ln(cap), ln(adv)) AS a FROM mq GROUP BY q HAVING count(*) >= 5),
e AS (SELECT mq.q, instrument, cap, a + b * ln(adv) AS fit, ln(cap) - a - b * ln(adv) AS e FROM mq JOIN f ON f.q = mq.q),
z AS (SELECT *, abs(e / nullif(stddev_samp(e) OVER (PARTITION BY q), 0)) > 2.5 AS outlier FROM e),
w AS (SELECT q, instrument, outlier, least(v / sum(v) OVER (PARTITION BY q), 0.1) AS w FROM (SELECT *, CASE WHEN outlier THEN exp(fit) ELSE cap END AS v FROM z) y)
SELECT q, instrument, outlier, {r6("w / sum(w) OVER (PARTITION BY q)")} AS weight FROM w"""


@plan
def config_bootstrap(d: Spark) -> str:
    """Low percentile of Sharpe ratios of two portfolios over 200 moving-block draws that both share."""
    return f"""WITH {SIGNALS},
k AS (SELECT q, fwd, row_number() OVER (PARTITION BY q ORDER BY s, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL),
b AS (SELECT q, fwd, {bins(d, "rn", "n", 3)} AS b3, {bins(d, "rn", "n", 5)} AS b5 FROM k),
s AS (SELECT q, avg(CASE WHEN b3 = 2 THEN fwd END) - avg(CASE WHEN b3 = 0 THEN fwd END) AS s3, avg(CASE WHEN b5 = 4 THEN fwd END) - avg(CASE WHEN b5 = 0 THEN fwd END) AS s5 FROM b GROUP BY q),
o AS (SELECT row_number() OVER (ORDER BY q) - 1 AS t, count(*) OVER () AS n, s3, s5 FROM s WHERE s3 IS NOT NULL AND s5 IS NOT NULL),
draws AS (SELECT i AS draw, ((i * 7919 + i * i * 31 + {d.idiv("t", "4")} * 104729) % n + t % 4) % n AS t FROM o CROSS JOIN {d.numbers(200)} r),
sh AS (SELECT draw, avg(s3) / nullif(stddev_samp(s3), 0) * 2 AS h3, avg(s5) / nullif(stddev_samp(s5), 0) * 2 AS h5 FROM draws x JOIN o ON o.t = x.t GROUP BY draw)
SELECT count(*) AS draws, round({d.quantile("h3", 0.05)}, 5) AS terciles_p5, round({d.quantile("h5", 0.05)}, 5) AS quintiles_p5 FROM sh"""


@plan
def exit_by_quintile(d: Spark) -> str:
    """Share of names without a later price, by quintile of the signal."""
    return f"""WITH {SIGNALS},
b AS (SELECT q, fwd, {bins(d, "rn", "n", 5)} AS quintile FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM panel_ WHERE s IS NOT NULL) x)
SELECT quintile, count(*) AS n, {r6("avg(CASE WHEN fwd IS NULL THEN 1e0 ELSE 0e0 END)")} AS missing FROM b GROUP BY quintile"""


@plan
def vote_intersection(d: Spark) -> str:
    """Names in the upper third by at least two of three signals."""
    return f"""WITH {SIGNALS},
l AS (SELECT q, instrument, s AS v, 1 AS voter FROM panel_ WHERE s IS NOT NULL UNION ALL SELECT q, instrument, -adv, 2 FROM panel_ UNION ALL SELECT q, instrument, -vol, 3 FROM panel_ WHERE vol IS NOT NULL),
t AS (SELECT q, instrument FROM (SELECT *, row_number() OVER (PARTITION BY q, voter ORDER BY v DESC, instrument) AS rn, count(*) OVER (PARTITION BY q, voter) AS n FROM l) x WHERE rn * 3 <= n)
SELECT q, instrument, count(*) AS votes FROM t GROUP BY q, instrument HAVING count(*) >= 2"""


SUPPLY = f"""{FLOWS}, {MARKET},
sup AS (SELECT m.q, m.instrument, c.cut, sum(CASE WHEN flow < -c.cut THEN -flow * value_before ELSE 0 END) / max(adv) AS supply FROM moves m JOIN fl f ON f.q = m.q AND f.filer_id = m.filer_id JOIN mq ON mq.q = m.q AND mq.instrument = m.instrument
  CROSS JOIN (SELECT * FROM (VALUES (0.05e0), (0.1e0), (0.2e0)) AS v(cut)) c GROUP BY m.q, m.instrument, c.cut)"""


@plan
def distress_surface(d: Spark) -> str:
    """Next excess return of the names most sold by distressed filers, by threshold of distress and fraction taken."""
    return f"""WITH {SUPPLY},
x AS (SELECT a.q, a.instrument, least(greatest(b.price / a.price - 1, -0.5), 0.5) AS r FROM mq a JOIN mq b ON b.q = a.q + 1 AND b.instrument = a.instrument),
e AS (SELECT s.q, s.cut, r - avg(r) OVER (PARTITION BY s.q, s.cut) AS e, row_number() OVER (PARTITION BY s.q, s.cut ORDER BY supply DESC, s.instrument) AS rn, count(*) OVER (PARTITION BY s.q, s.cut) AS n FROM sup s JOIN x ON x.q = s.q AND x.instrument = s.instrument),
p AS (SELECT * FROM (VALUES (1), (2), (3)) AS v(tenths))
SELECT cut, tenths, count(*) AS n, {r6("avg(e)")} AS excess FROM e JOIN p ON rn <= greatest({d.idiv("n * tenths", "10")}, 2) GROUP BY cut, tenths"""


@plan
def filtered_basket(d: Spark) -> str:
    """The fifth of names with the highest signal, without the third that distressed filers sell most."""
    return f"""WITH {SIGNALS}, {SUPPLY},
top_ AS (SELECT q, instrument, fwd FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM panel_ WHERE s IS NOT NULL) a WHERE rn * 5 <= n),
bad AS (SELECT q, instrument FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY supply DESC, instrument) AS rn, count(*) OVER (PARTITION BY q) AS n FROM sup WHERE cut = 0.1e0) b WHERE rn * 3 <= n AND supply > 0)
SELECT t.q, t.instrument, {r6("fwd")} AS fwd FROM top_ t WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.q = t.q AND bad.instrument = t.instrument)"""


@plan
def fund_features(d: Spark) -> str:
    """Funds' size, names, largest weight, turnover as the lesser of buys and sells, and its rank in the fund's own past."""
    return f"""WITH t AS (SELECT q, filer_id, least(sum(greatest(value - value_before, 0)), sum(greatest(value_before - value, 0))) / nullif(sum(value + value_before) / 2, 0) AS turnover, sum(value) AS aum, sum(CASE WHEN shares > 0 THEN 1 ELSE 0 END) AS names, max(w) AS top1 FROM moves WHERE filer_id < {FUNDS} GROUP BY q, filer_id),
h AS (SELECT a.q, a.filer_id, count(b.q) AS past, avg(CASE WHEN b.turnover <= a.turnover THEN 1e0 ELSE 0e0 END) AS pct FROM t a JOIN t b ON b.filer_id = a.filer_id AND b.q < a.q GROUP BY a.q, a.filer_id)
SELECT t.q, t.filer_id, round(aum, 2) AS aum, names, {r6("top1")} AS top1, {r6("turnover")} AS turnover, CASE WHEN past >= 4 THEN {r6("pct")} END AS own_percentile FROM t LEFT JOIN h ON h.q = t.q AND h.filer_id = t.filer_id"""


@plan
def run_prone_pressure(d: Spark) -> str:
    """Funds' demand passed through to names, scaled by the share that high-turnover funds hold."""
    return f"""WITH {MARKET},
t AS (SELECT q, filer_id, sum(abs(value - value_before)) / nullif(sum(value + value_before), 0) AS turn, sum(value - value_before) AS demand FROM moves WHERE filer_id < {FUNDS} GROUP BY q, filer_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn DESC, filer_id) * 3 <= count(*) OVER (PARTITION BY q) AS transient FROM t WHERE turn IS NOT NULL)
SELECT k.q, n.instrument, {r6("sum(demand * n.w) / max(cap)")} AS pressure, {r6("sum(CASE WHEN transient THEN n.value ELSE 0 END) / sum(n.value)")} AS run_prone, {r6("sum(demand * n.w) / max(cap) * sum(CASE WHEN transient THEN n.value ELSE 0 END) / sum(n.value)")} AS scaled
FROM k JOIN numbered n ON n.q = k.q AND n.filer_id = k.filer_id JOIN mq ON mq.q = n.q AND mq.instrument = n.instrument GROUP BY k.q, n.instrument"""


@plan
def fund_baseline_change(d: Spark) -> str:
    """Change of funds' holdings in a name over the mean of both quarters, its z-score, and the reversal."""
    return f"""WITH x AS (SELECT q, instrument, sum(shares - shares_before) / nullif(0.5 * sum(shares + shares_before), 0) AS c FROM moves WHERE filer_id < {FUNDS} GROUP BY q, instrument),
z AS (SELECT q, instrument, c, (c - avg(c) OVER (PARTITION BY q)) / nullif(stddev_pop(c) OVER (PARTITION BY q), 0) AS z FROM x)
SELECT q, instrument, {r6("c")} AS change, round(z, 5) + 0e0 AS z, round(-z, 5) + 0e0 AS reversal FROM z"""


@plan
def fund_overlap_shock(d: Spark) -> str:
    """Flows of the other funds, weighed by common weight: the sum of the lesser weights."""
    return f"""WITH {FLOWS},
o AS (SELECT a.q, a.filer_id, b.filer_id AS other, sum(least(a.w, b.w)) AS common FROM numbered a JOIN numbered b ON b.q = a.q AND b.instrument = a.instrument AND b.filer_id <> a.filer_id WHERE a.filer_id < {FUNDS} AND b.filer_id < {FUNDS} GROUP BY a.q, a.filer_id, b.filer_id)
SELECT o.q, o.filer_id, {r6("sum(common * flow) / nullif(sum(common), 0)")} AS shock, {r6("sum(common)")} AS overlap FROM o JOIN fl f ON f.q = o.q AND f.filer_id = o.other WHERE flow IS NOT NULL GROUP BY o.q, o.filer_id"""


@plan
def score_race(d: Spark) -> str:
    """Three ways to weigh two ranks, by past slopes, by past correlations, equally: their tercile spreads."""
    ba, bb = cramer("y", ["a", "b"])
    return f"""WITH {SIGNALS},
r AS (SELECT q, instrument, fwd, {pct_rank("s", "q")} - 0.5 AS a, {pct_rank("adv", "q")} - 0.5 AS b FROM panel_ WHERE fwd IS NOT NULL AND s IS NOT NULL),
c AS (SELECT q, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, fwd - avg(fwd) OVER w AS y FROM r WINDOW w AS (PARTITION BY q)),
m AS (SELECT q, sum(a * y) AS a_y, sum(b * y) AS b_y, sum(a * a) AS a_a, sum(b * b) AS b_b, sum(a * b) AS a_b, sum(y * y) AS yy FROM c GROUP BY q HAVING count(*) >= 8),
l AS (SELECT q, {ba} AS la, {bb} AS lb, a_y / nullif(sqrt(a_a * yy), 0) AS ia, b_y / nullif(sqrt(b_b * yy), 0) AS ib FROM m),
p AS (SELECT q, avg(la) OVER w AS la, avg(lb) OVER w AS lb, avg(ia) OVER w AS ia, avg(ib) OVER w AS ib, count(*) OVER w AS n FROM l WINDOW w AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT r.q, instrument, fwd, 'slopes' AS model, a * la + b * lb AS score FROM r JOIN p ON p.q = r.q WHERE n >= 4 UNION ALL SELECT r.q, instrument, fwd, 'correlations', a * ia + b * ib FROM r JOIN p ON p.q = r.q WHERE n >= 4 UNION ALL SELECT r.q, instrument, fwd, 'equal', a + b FROM r JOIN p ON p.q = r.q WHERE n >= 4),
k AS (SELECT *, {bins(d, "rn", "n", 3)} AS bin FROM (SELECT *, row_number() OVER (PARTITION BY q, model ORDER BY round(score, 9), instrument) AS rn, count(*) OVER (PARTITION BY q, model) AS n FROM s3) x),
e AS (SELECT q, model, avg(CASE WHEN bin = 2 THEN fwd END) - avg(CASE WHEN bin = 0 THEN fwd END) AS e FROM k GROUP BY q, model)
SELECT model, count(*) AS quarters, {r6("avg(e)")} AS spread, round(avg(e) / nullif(stddev_samp(e), 0) * 2, 5) + 0e0 AS sharpe FROM e GROUP BY model"""


@plan
def best_mapping(d: Spark) -> str:
    """One identifier per name: that with the highest weighted evidence, the smallest of equals."""
    t = d.table
    return f"""WITH traded AS (SELECT l_partkey, count(*) AS n FROM {t("lineitem")} GROUP BY l_partkey),
e AS (SELECT p_name, p_partkey, 4 * (CASE WHEN n >= 20 THEN 1 ELSE 0 END) + 2 * (CASE WHEN p_retailprice >= avg(p_retailprice) OVER (PARTITION BY p_name) THEN 1 ELSE 0 END) + (CASE WHEN p_size <= 25 THEN 1 ELSE 0 END) AS score FROM {t("part")} LEFT JOIN traded ON l_partkey = p_partkey),
k AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_name) AS candidates, sum(score) OVER (PARTITION BY p_name) AS total FROM e)
SELECT p_name, p_partkey, score, candidates, round(score / nullif(CAST(total AS DOUBLE), 0), 6) AS confidence FROM k WHERE rn = 1"""


@plan
def dataset_windows(d: Spark) -> str:
    """Publication windows: calendar quarters up to 2023, a stub of two months, then three months each from March 2024."""
    start = f"CASE WHEN i <= 44 THEN {d.months("DATE '2013-01-01'", 'CAST(3 * i AS INT)')} ELSE {d.months("DATE '2024-03-01'", 'CAST(3 * (i - 45) AS INT)')} END"
    return f"""WITH w AS (SELECT i, {start} AS first_day FROM {d.numbers(54)} n)
SELECT CAST(first_day AS DATE) AS first_day, CAST({d.plus("lead(first_day) OVER (ORDER BY first_day)", -1)} AS DATE) AS last_day, i = 44 AS stub FROM w"""


@plan
def vulnerability(d: Spark) -> str:
    """Consensus tilt of filers in a name over its spread, times the share of filers on the same side."""
    return f"""WITH m AS (SELECT q, instrument, sum(value) / sum(sum(value)) OVER (PARTITION BY q) AS wm FROM numbered GROUP BY q, instrument),
t AS (SELECT n.q, n.instrument, w - wm AS tilt FROM numbered n JOIN m ON m.q = n.q AND m.instrument = n.instrument),
a AS (SELECT q, instrument, avg(tilt) AS position_, stddev_pop(tilt) AS spread, avg(CASE WHEN tilt > 0 THEN 1e0 ELSE 0e0 END) AS over_, count(*) AS filers FROM t GROUP BY q, instrument)
SELECT q, instrument, filers, {r6("position_")} AS tilt, round(abs(position_) / greatest(spread, 0.05) * CASE WHEN position_ > 0 THEN over_ ELSE 1 - over_ END, 5) + 0e0 AS vulnerability FROM a"""


@plan
def identity_evidence(d: Spark) -> str:
    """Whether an identifier is a fund, out of several sources; those that the identifier's own type doesn't bear out are conflicts."""
    t = d.table
    age = d.days(f"(SELECT max(l_shipdate) FROM {t('lineitem')})", "last_day")
    return f"""WITH seen AS (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last_day, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM {t("lineitem")} GROUP BY l_partkey),
aged AS (SELECT *, {age} AS age FROM seen),
e AS (SELECT p_partkey, {d.matches("upper(p_type)", "STANDARD|ETF|FUND")} AS product, coalesce(returned, 0) = 1 AS regulator, coalesce(n, 0) >= 20 AS listed, coalesce(age, 9999) <= 548 AS recent, p_size <= 10 AS series, p_partkey % 50 = 0 AS seed FROM {t("part")} LEFT JOIN aged ON l_partkey = p_partkey),
v AS (SELECT *, regulator AND product AND recent AS regulator_ok, listed AND product AND (recent OR series) AS listed_ok, series AND product AS series_ok FROM e)
SELECT p_partkey, regulator_ok OR listed_ok OR series_ok OR seed AS is_fund, (regulator AND NOT regulator_ok) OR (listed AND NOT listed_ok) AS conflict,
1000 * (CASE WHEN recent THEN 1 ELSE 0 END) + 500 * (CASE WHEN seed THEN 1 ELSE 0 END) + 100 * (CASE WHEN listed THEN 1 ELSE 0 END) + 50 * (CASE WHEN regulator THEN 1 ELSE 0 END) + 10 * (CASE WHEN product THEN 1 ELSE 0 END) AS score,
CASE WHEN regulator_ok AND listed_ok THEN 'regulator_and_exchange' WHEN regulator_ok THEN 'regulator' WHEN listed_ok THEN 'exchange' WHEN series_ok THEN 'series' WHEN seed THEN 'seed' WHEN product THEN 'candidate' ELSE 'unconfirmed' END AS confidence FROM v"""
