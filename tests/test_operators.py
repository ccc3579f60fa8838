import datetime as dt
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from holdfold.functions import calendar, identifiers
from holdfold.operators import asof, crosssection, graph, inference, latent, sequential
from holdfold.sources import filings


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 4, 40)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 20, ("a", 5): 40, ("b", 1): None}
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", ["v"], strict=True).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 5): 40, ("b", 1): None}


def test_range_join(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    left = spark.createDataFrame([("a", day(5)), ("a", day(500)), ("b", day(5))], "k string, d date")
    right = spark.createDataFrame([("a", day(0), day(400), 1), ("a", day(300), day(600), 2)], "k string, s date, e date, v int")
    got = {(r.k, r.d, r.v) for r in asof.range_join(left, right, ["k"], "d", "s", "e").collect()}
    assert got == {("a", day(5), 1), ("a", day(500), 2)}


def test_crosssection_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "i": range(200), "x": rng.integers(0, 20, 200).astype(float), "y": rng.normal(size=200)})
    df = spark.createDataFrame(pdf)
    out = df.select("i", crosssection.pct_rank(F.col("x"), ["g"]).alias("p"), crosssection.winsorise(F.col("y"), ["g"], 0.05).alias("w"), crosssection.zscore(F.col("y"), ["g"], True).alias("z")).toPandas().sort_values("i")
    assert np.allclose(out["p"], pdf.groupby("g")["x"].rank(pct=True))
    low, high = pdf.groupby("g")["y"].transform(lambda s: s.quantile(0.05)), pdf.groupby("g")["y"].transform(lambda s: s.quantile(0.95))
    assert np.allclose(out["w"], pdf["y"].clip(low, high))
    assert np.allclose(out["z"], pdf.groupby("g")["y"].transform(lambda s: (s - s.mean()) / s.std()))
    res = crosssection.residual(df, "y", "x", ["g"]).toPandas().sort_values("i")
    for _, part in res.groupby("g"):
        fit = np.polyfit(part["x"], part["y"], 1)
        assert np.allclose(part["residual"], part["y"] - np.polyval(fit, part["x"]))


def test_groups_of_a_long_chain_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (103, 102)]
    got = {r.node: r.group for r in graph.groups(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_ranks_over_ranges_match_pandas(spark, tmp_path):
    """Nulls, ties, null groups and a group over many ranges; ranks are those of whole groups."""
    rng = np.random.default_rng(4)
    rows = [(None if k % 50 == 0 else int(k % 3 > 0), k, None if k % 17 == 0 else float(rng.integers(0, 40))) for k in range(700)]
    df = spark.createDataFrame(rows, "g int, k int, x double")

    def store(d):
        path = str(tmp_path / str(rng.integers(1 << 40)))
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    got = crosssection.ranked(df, "x", ["g"], ["k"], store, 9).toPandas().set_index("k").sort_index()
    pdf = pd.DataFrame(rows, columns=["g", "k", "x"]).set_index("k")
    groups = pdf.groupby(pdf["g"].fillna(-1))["x"]
    assert np.allclose(got["rank"].fillna(-1), groups.rank(pct=True).fillna(-1))
    place = pdf.reset_index().sort_values(["x", "k"]).dropna(subset=["x"]).pipe(lambda d: d.assign(p=d.groupby(d["g"].fillna(-1)).cumcount() + 1)).set_index("k")["p"].sort_index()
    assert (got["place"].dropna() == place).all() and len(got) == 700


def test_centrality_matches_eigenvector(spark):
    x = np.random.default_rng(1).random((6, 4))
    rows = [(i, j, float(x[i, j])) for i in range(6) for j in range(4)]
    got = {r.row: r.centrality for r in graph.centrality(spark.createDataFrame(rows, "row int, item int, w double"), 30).collect()}
    m = x @ x.T
    np.fill_diagonal(m, 0)
    v = np.linalg.eigh(m)[1][:, -1]
    assert np.allclose([got[i] for i in range(6)], v * np.sign(v[0]), atol=1e-4)


def test_hysteresis(spark):
    """Incumbents within the buffer stay, up to the target's size; only free places are offered, and only within the target."""
    ranks = {1: "abcd", 2: "bcda", 3: "dcba", 4: "dcba"}
    rows = [(p, k, i + 1) for p, order in ranks.items() for i, k in enumerate(order)]
    out = sequential.hysteresis(spark.createDataFrame(rows, "period int, key string, rank int"), 2, 3).collect()
    got = {(r.period, r.key, r.rank, r.status) for r in out}
    assert got == {(2, "a", 1, "new"), (2, "b", 2, "new"), (3, "b", 1, "retained"), (3, "c", 2, "new"), (4, "c", 2, "retained"), (4, "b", 3, "retained")}
    assert all(r.source == r.period - 1 for r in out)


def test_hysteresis_reduces_churn(spark):
    rng = np.random.default_rng(7)
    level = rng.normal(size=60)
    rows = [(q, m, int(r) + 1) for q in range(12) for m, r in enumerate(np.argsort(np.argsort(-(level + rng.normal(size=60)))))]
    ranked = spark.createDataFrame(rows, "period int, key int, rank int")
    hard, buffered = (sequential.hysteresis(ranked, 15, b).collect() for b in (15, 25))
    new = lambda out: sum(r.status == "new" for r in out)
    assert new(buffered) < new(hard) and len(hard) == len(buffered) == 11 * 15


def test_identifiers(spark):
    rows = [(x,) for x in ("037833100", "594918104", "88160R101", "02079K305", "02079K107", "037833010", "37833100", "03783310", None)]
    got = spark.createDataFrame(rows, "c string").select("c", identifiers.valid_identifier(F.col("c")).alias("ok"), identifiers.repair_identifier(F.col("c")).alias("r")).collect()
    assert [r.ok for r in got] == [True] * 5 + [False] * 4
    assert (got[6].r.fixed, got[6].r.action) == ("037833100", "padded")
    assert (got[7].r.fixed, got[7].r.action) == ("037833100", "appended_check")
    assert (got[5].r.fixed, got[5].r.action) == ("037833019", "recovered") and got[8].r.action == "invalid"
    odd = spark.createDataFrame([("GARBAGE!!",), ("0378 33-100",), ("",), ("1234567",)], "c string").select(identifiers.repair_identifier(F.col("c")).alias("r")).collect()
    assert [(r.r.fixed, r.r.action) for r in odd] == [(None, "invalid"), ("037833100", "ok"), (None, "invalid"), (None, "invalid")]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("The Big Corp.", "BIG fund", "$1,200", "N/A")], "a string, b string, n string, m string")
    r = df.select(identifiers.name_tokens(F.col("a")).alias("t"), identifiers.token_similarity(identifiers.name_tokens(F.col("a")), identifiers.name_tokens(F.col("b"))).alias("s"), identifiers.clean_number(F.col("n")).alias("n"), identifiers.clean_number(F.col("m")).alias("m")).first()
    assert (r.t, r.s, r.n, r.m) == (["BIG"], 0.5, 1200.0, None)


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 5, 15, 21, 30),), (dt.datetime(2020, 5, 15, 19, 30),)], "t timestamp")
    assert [r[0] for r in df.select(calendar.known_on(F.col("t"))).collect()] == [dt.date(2020, 5, 16), dt.date(2020, 5, 15)]
    assert [r.label for r in calendar.quarters_between(spark, "2019-12-01", "2020-02-01", 1).collect()] == ["2019Q3", "2019Q4", "2020Q1", "2020Q2"]
    days = spark.createDataFrame([("05-NOV-2021",), ("x",)], "s string").select(calendar.parse_day(F.col("s")))
    assert [r[0] for r in days.collect()] == [dt.date(2021, 11, 5), None]


def test_filing_readers(spark, tmp_path):
    lines = spark.createDataFrame([("13F-HR      ACME CAPITAL LLC     1234567     2020-05-15  edgar/data/1/0000000001-20-000001.txt",), ("header",), ("10-K   X INC   1   2020-05-15  p",)], "value string")
    r = filings.index_lines(lines).collect()
    assert len(r) == 1 and (r[0].company, r[0].cik, r[0].filed) == ("ACME CAPITAL LLC", 1234567, dt.date(2020, 5, 15))
    raw = "<DOCUMENT><TYPE>13F-HR\n<TEXT>c</TEXT></DOCUMENT><DOCUMENT><TYPE>INFORMATION TABLE\n<TEXT><n:infoTable><n:nameOfIssuer>A</n:nameOfIssuer><n:cusip>037833100</n:cusip><n:value>1,000</n:value><n:sshPrnamt>x</n:sshPrnamt></n:infoTable></TEXT></DOCUMENT>"
    docs = filings.envelope_documents(spark.createDataFrame([(1, raw)], "id int, raw string"))
    t = filings.information_table(docs.where("type = 'INFORMATION TABLE'")).first()
    assert (t.issuer, t.cusip, t.value, t.shares) == ("A", "037833100", 1000.0, None)
    text = filings.text_table(spark.createDataFrame([("APPLE INC   COM  037833100   1,234   56 SH\nnothing",)], "body string")).first()
    assert (text.issuer, text.cusip, text.value, text.shares) == ("APPLE INC", "037833100", 1234.0, 56.0)
    j = filings.json_columns(spark.createDataFrame([(7, '{"a":["1","2"],"b":["x","y"]}')], "cik int, j string"), "j", ["a", "b"])
    assert [tuple(r) for r in j.collect()] == [(7, "1", "x"), (7, "2", "y")]
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("Sub/SUBMISSION.TSV", "A\tB\n1\t2\n3\t4\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "w.zip"))
    assert [(r.A, r.B) for r in filings.zipped_table(files, "submission.tsv", ["A", "B"]).collect()] == [("1", "2"), ("3", "4")]


def test_inference_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.1, 1, 60)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "g string, i int, v double")
    got = {r.g: r for r in inference.newey_west(df, "g", "v", "i", 0).collect()}
    assert abs(got["a"].t - x.mean() / np.sqrt(((x - x.mean()) ** 2).sum()) * 60) < 1e-9 and got["b"].t is None
    y = 2 + 3 * x + rng.normal(size=60)
    rows = spark.createDataFrame([(i % 6, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "c int, x double, y double")
    beta = {r.name: r.beta for r in inference.clustered_ols(rows, "y", ["x"], "c").collect()}
    assert np.allclose([beta["x"], beta["intercept"]], np.polyfit(x, y, 1))
    assert abs(spark.range(1).select(inference.inverse_normal(F.lit(0.975))).first()[0] - 1.959964) < 1e-5


def test_pca_and_ridge(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    rows = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(50) for j in range(4)], "r int, c int, v double")
    got = {(r.c, r.component): r.loading for r in latent.pca(rows, "r", "c", "v", 1).collect()}
    v = np.linalg.eigh(np.cov(m.T))[1][:, -1]
    assert np.allclose([got[j, 0] for j in range(4)], v * np.sign(v[np.argmax(np.abs(v))]), atol=1e-8)
    pdf = pd.DataFrame({"p": np.repeat(range(5), 20), "k": range(100), "x": rng.normal(size=100)})
    pdf["y"] = 1 + 2 * pdf["x"]
    out = latent.ridge_walk_forward(spark.createDataFrame(pdf), "p", "k", ["x"], "y", 1e-9).toPandas()
    later = out[out.p > 0]
    assert np.allclose(later["forecast"], 1 + 2 * later["x"], atol=1e-5) and out[out.p == 0]["forecast"].isna().all()


def test_ica_separates_sources(spark):
    rng = np.random.default_rng(4)
    n = 300
    s = np.stack([rng.laplace(size=n) ** 3, np.sign(np.sin(np.arange(n) / 7))], axis=1)
    x = (s - s.mean(axis=0)) / s.std(axis=0) @ rng.normal(size=(2, 5))
    df = spark.createDataFrame([(t, i, float(x[t, i])) for t in range(n) for i in range(5)], "t int, i int, x double")
    out = latent.ica(df, "t", "i", "x", k=2).toPandas().pivot(index="t", columns="component", values="source").to_numpy()
    c = np.abs(np.corrcoef(out.T, s.T)[:2, 2:])
    assert c[0, 0] > 0.95 and c[1, 1] > 0.95


def test_gls_weights_match_the_direct_inverse(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-1, 2, (12, 6)).astype(float)
    m[0, 0] = 1.0
    m[3] = 0.0
    m[4] = m[5]
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(6)], "r int, i int, x double")
    got = {r.r: r.weight for r in latent.gls_weights(df, "r", "i", "x").collect()}
    keep = [i for i in range(12) if np.abs(m[i]).sum() > 0]
    u = m[keep] / np.linalg.norm(m[keep], axis=1, keepdims=True)
    want = np.linalg.solve(0.75 * u @ u.T + 0.25 * np.eye(len(keep)), np.ones(len(keep)))
    assert sorted(got) == keep and np.allclose([got[i] for i in keep], want)


def test_correlation_groups(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0.1, 1, 200), rng.normal(0.1, 1, 200)
    cols = {"a1": a, "a2": a + rng.normal(0, 0.1, 200), "b1": b, "b2": b + rng.normal(0, 0.1, 200)}
    df = spark.createDataFrame([(t, k, float(v[t])) for k, v in cols.items() for t in range(200)], "t int, i string, x double")
    out = latent.correlation_groups(df, "t", "i", "x", 2).toPandas().set_index("i")
    assert out.loc["a1", "group"] == out.loc["a2", "group"] != out.loc["b1", "group"] == out.loc["b2", "group"]
    assert np.allclose(out.groupby("group")["weight"].sum(), 1)


def test_tree_forecasts_use_the_past_alone(spark):
    rng = np.random.default_rng(7)
    rows = [(q, i, float(x), float(np.sign(x)) if q < 6 else 9.0) for q in range(8) for i, x in enumerate(rng.normal(size=40))]
    out = latent.tree_walk_forward(spark.createDataFrame(rows, "q int, i int, x double, y double"), "q", ["x"], "y", refit=6).toPandas()
    assert set(out["q"]) == {6, 7} and out["forest"].abs().max() <= 1.0001
    assert (np.sign(out["boosted"]) == np.sign(out["x"])).mean() > 0.9
    assert latent.tree_walk_forward(spark.createDataFrame([], "q int, i int, x double, y double"), "q", ["x"], "y").count() == 0


def test_nmf_has_every_period(spark):
    """Each period has its own factors, those that it has alone."""
    rng = np.random.default_rng(3)
    rows = [(q, r, f"i{i}", float(rng.random() + (i % 2 == r % 2))) for q in (1, 2, 40) for r in range(12) for i in range(6)]
    columns = "q long, r long, i string, w double"
    got = {(x.q, x.i, x.factor): x.loading for x in latent.nmf(spark.createDataFrame(rows, columns), "q", "r", "i", "w", k=2).collect()}
    assert len(got) == 3 * 6 * 2 and min(got.values()) >= 0
    alone = latent.nmf(spark.createDataFrame([x for x in rows if x[0] == 40], columns), "q", "r", "i", "w", k=2).collect()
    assert all(abs(got[40, x.i, x.factor] - x.loading) < 1e-6 for x in alone)
