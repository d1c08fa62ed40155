"""Functions and operators SQL cannot check, against plain Python; guards; range-split windows against plain ones."""

import json
import math

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from poolstat import reports
from poolstat.errors import AmbiguousStoredConfig, ConflictingRecord, DifferentialAttrition, JudgeScoresUnavailable, MixedPoolCoverage, NoCellsSelected, NoStoredConfig, PoolstatError, PoolsUnavailable, UnknownStoredConfig
from poolstat.functions import documents as D
from poolstat.functions import keys as K
from poolstat.functions import text as T
from poolstat.operators import frame as FR
from poolstat.operators import joins as J
from poolstat.operators import judging as JU
from poolstat.operators import ledger as L
from poolstat.operators import pricing as P
from poolstat.operators import resampling as R
from poolstat.operators import vectors as V
from poolstat.operators import windows as W
from poolstat.plans import store as PS
from poolstat.plans import views
from poolstat.sources import store as S


#: what a refusal inside a job comes back as; several at once are wrapped
REFUSED = (PySparkException, Py4JJavaError)


def stream(a):
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def test_hashes_and_generator(spark):
    words = ["", "a", "arm=S1|x", "Zürich", "𝄞 clef"]

    def units(s):
        raw = s.encode("utf-16-be")
        return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]

    def fnv(s):
        h = 0x811C9DC5
        for u in units(s):
            h = (h ^ u) * 0x01000193 & 0xFFFFFFFF
        return h

    def poly(s):
        h = 0
        for u in units(s):
            h = h * 31 + u & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", K.fnv1a(F.col("w")).alias("f"), K.poly31(F.col("w")).alias("p")).collect()
    assert [(r.w, r.f, r.p) for r in rows] == [(w, fnv(w), poly(w)) for w in words]
    draws, s = [r[0] for r in spark.range(300).select(K.mulberry32_at(F.lit(20260901), F.col("id"))).collect()], stream(20260901)
    assert draws == [next(s) for _ in range(300)]


def test_canonical_json_and_hashes():
    for x, want in ((1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (1e20, "100000000000000000000"), (-2.5, "-2.5"), (float("nan"), "null"), (0.0, "0")):
        assert D.stringify(x) == want
    assert D.stringify({"b": [1, None, True], "a": {"z": "é", "y": 1.0}}) == '{"a":{"y":1,"z":"é"},"b":[1,null,true]}'
    a, b = {"judgeHash": "x", "promptHash": "y", "other": 1}, {"promptHash": "y", "judgeHash": "x"}
    assert D.config_hash(a) == D.config_hash(b) != D.config_hash({"promptHash": "y"})
    assert D.arms_config_hash({"arms": {"A": {"label": "l", "_n": 1, "slots": [1]}}}) == D.arms_config_hash({"arms": {"A": {"slots": [1]}}})
    assert D.pair_set_hash([{"a": 1, "b": 2, "label": "s"}]) != D.pair_set_hash([{"a": 2, "b": 1, "label": "s"}])
    assert D.content_ids([{"a": 1}, {"a": 1}, {"a": 2}])[0][:-2] == D.content_ids([{"a": 1}])[0][:-2] and [i[-2:] for i in D.content_ids([{"a": 1}, {"a": 1}])] == ["-0", "-1"]
    assert D.judge_request_hash({"maxTokens": 5, "t": 1}) == D.judge_request_hash({"t": 1}, 5) and len(D.judge_hash({"x": ["m", "m"]}, "p")) == 12
    with pytest.raises(PoolstatError):
        D.judge_request_hash({"maxTokens": 5}, 6)


def test_salvage():
    assert D.salvage('[{"text":"a"},{"text":"b"}]') == ([{"text": "a"}, {"text": "b"}], True, 0)
    assert D.salvage('```json\n[{"t":"}"},{"t":"x\\"{"}, {"t": bad}]\n```') == ([{"t": "}"}, {"t": 'x"{'}], False, 1)
    assert D.salvage('[{"t":1},{"t":2') == ([{"t": 1}], False, 1) and D.salvage(None) == ([], False, 0) and D.salvage("{\"a\":1} tail") == ([{"a": 1}], True, 0)
    assert D.salvage("[1, 2]") == ([], True, 0) and D.salvage('[{"a": NaN}]')[1] is False


def test_range_split_windows_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(g), i, float(rng.integers(0, 40)) / 50, float(rng.integers(0, 30))) for i, g in enumerate(rng.integers(0, 3, 400))], "g int, i int, p double, v double").cache()
    calls = {"holm": lambda: W.holm(rows, "g", "p", "i"), "bh": lambda: W.benjamini_hochberg(rows, "g", "p", "i"), "rank": lambda: W.rank_with_ties(rows, "g", "v"), "order": lambda: W.order_by_score(rows, "g", "v", "i"), "pareto": lambda: J.pareto_frontier(rows, "p", "v")}
    plain = {k: sorted(map(tuple, f().collect())) for k, f in calls.items()}
    monkeypatch.setattr(W, "SPLIT_ROWS", 20)
    for k, f in calls.items():
        assert sorted(map(tuple, f().collect())) == plain[k], k


def test_p_values_and_ranks_refuse(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, 0.01)], "g int, i int, p double")
    assert {r.i: r.holm for r in W.holm(rows, "g", "p", "i").collect()} == {2: 0.5, 3: 0.02}
    with pytest.raises(PoolstatError):
        W.holm(rows, "g", "p", "i", 5)
    with pytest.raises(REFUSED, match=r"\[0, 1\]"):
        W.holm(rows.withColumn("p", F.lit(1.5)), "g", "p", "i").collect()
    with pytest.raises(REFUSED, match="without variance in group 1"):
        W.spearman(rows.fillna(0.5).withColumn("q", F.lit(1.0)), "g", "p", "q").collect()


def test_vectors_refuse_and_cut(spark):
    zero = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 0.0])], "pool int, k int, v array<double>")
    for f in (lambda: V.pool_diversity(zero, "pool", "v"), lambda: V.distinct_k(zero, "pool", "v", 0.5)):
        with pytest.raises(REFUSED):
            f().collect()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(1, i, [float(a) for a in v]) for i, v in enumerate(x)], "pool int, k int, v array<double>")
    d = V.distance_matrix(x)
    r = V.sensitivity(df, "pool", "v", 0.8, 0.2).first()
    assert (r.k_low, r.k, r.k_high) == tuple(len(V.average_linkage(d, t)) for t in (0.8 - 0.2, 0.8, 0.8 + 0.2))
    got = {r.k: r.cluster for r in V.clusters(df, "pool", "k", "v", 0.8).collect()}
    assert {frozenset(m) for m in V.average_linkage(d, 0.8)} == {frozenset(k for k in got if got[k] == c) for c in set(got.values())}


def test_bootstrap_equals_plain(spark):
    rng = np.random.default_rng(7)
    rows = [(f"a{k % 2}", f"b{int(rng.integers(0, 6))}", float(rng.integers(1, 9)), float(rng.random() + 0.1), f"k{k:03d}") for k in range(80)]
    df = spark.createDataFrame(rows, "arm string, brief string, response double, cost double, key string")
    got = {r.arm: r for r in R.bootstrap_ratio(df, "arm", "brief", "response", "cost", "key", 300, seed=9).collect()}
    for arm in ("a0", "a1"):
        own = sorted((r for r in rows if r[0] == arm), key=lambda r: r[4])
        briefs, s, samples = list(dict.fromkeys(r[1] for r in own)), stream(9), []
        for _ in range(300):
            pick = [briefs[math.floor(next(s) * len(briefs))] for _ in briefs]
            samples.append(sum(r[2] for b in pick for r in own if r[1] == b) / sum(r[3] for b in pick for r in own if r[1] == b))
        samples.sort()
        assert math.isclose(got[arm].ci_lower, samples[math.floor(0.025 * 300)], rel_tol=1e-9) or math.isclose(got[arm].ci_lower, samples[7], rel_tol=1e-9)
        assert math.isclose(got[arm].ci_upper, samples[292], rel_tol=1e-9)


def test_split_half_and_orders(spark):
    rng = np.random.default_rng(8)
    rows = [("t", i, [float(x) for x in rng.integers(1, 9, int(rng.integers(2, 6)))]) for i in range(24)]
    got = JU.split_half(spark.createDataFrame(rows, "g string, i int, s array<double>"), "g", "i", "s", splits=30, batch=7).first()
    s, total = stream(1), 0.0
    for _ in range(30):
        means = []
        for _, _, x in rows:
            x = list(x)
            for i in range(len(x) - 1, 0, -1):
                j = math.floor(next(s) * (i + 1))
                x[i], x[j] = x[j], x[i]
            h = len(x) // 2
            means.append((sum(x[:h]) / h, sum(x[h:]) / (len(x) - h)))
        order = sorted(range(24), key=lambda i: (means[i][0], i))
        low, high = order[:6], order[18:]
        guess = sorted(low + high, key=lambda i: (means[i][1], i))
        total += (len(set(low) & set(guess[:6])) + len(set(high) & set(guess[6:]))) / 12
    assert got.n == 24 and math.isclose(got.mean_accuracy, total / 30)
    assert sorted(JU.presentation_order(9, 3)) == list(range(9)) and JU.presentation_order(9, 3) != JU.presentation_order(9, 4)
    low, high = JU.split_half_interval([r[2] for r in rows], draws=20, splits=5, spark=spark)
    assert 0 <= low <= high <= 1
    with pytest.raises(PoolstatError):
        JU.split_half(spark.createDataFrame(rows[:5], "g string, i int, s array<double>"), "g", "i", "s")
    assert JU.accuracy_floor({}) == 0.561 and JU.accuracy_floor({"judge": {"accuracyFloor": 0.7}}) == 0.7
    with pytest.raises(PoolstatError):
        JU.rho_floor({})


def test_pricing_guards(spark):
    row = {"cell_key": "c", "timestamp": "2026-01-01", "billing_mode": "api", "pricing_regime": None, "model": "claude-1", "input_tokens": 1e6, "output_tokens": 0.0}
    schema = "cell_key string, timestamp string, billing_mode string, pricing_regime string, model string, input_tokens double, output_tokens double"
    for bad in ({"billing_mode": "cash"}, {"pricing_regime": "x"}, {"cell_key": None}, {"timestamp": ""}, {"model": None}):
        with pytest.raises(REFUSED):
            P.valid_ledger(spark.createDataFrame([row | bad], schema)).collect()
    with pytest.raises(PoolstatError):
        P.valid_ledger(spark.createDataFrame([row], schema).withColumn("cost_usd", F.lit(1.0)))
    with pytest.raises(PoolstatError):
        P.require_rates(P.price_lines(spark.createDataFrame([row | {"model": "claude-999"}], schema), views.rates(spark)))
    with pytest.raises(REFUSED):
        spark.range(1).select(P.provider_of(F.lit("other-1"))).collect()
    with pytest.raises(REFUSED):
        spark.range(1).select(P.effort_multiplier(F.lit("extreme"))).collect()
    ledger = spark.createDataFrame([row, row], schema).withColumn("row_id", F.monotonically_increasing_id())
    folded, done = P.folded_safely(ledger, views.rates(spark))
    assert done and folded.count() == 1 and folded.first().input_tokens == 2e6
    plan = spark.createDataFrame([(i, u) for i, u in enumerate((5.0, 8.0, 4.0, 1.0))], "i int, usd double")
    assert [r.admitted for r in P.admitted(plan, "i", "usd", 10.0).orderBy("i").collect()] == [True, False, True, True]


def test_store_guards(spark, tmp_path):
    stored = spark.createDataFrame([("k", '{"a":1,"b":2}')], "key string, body string")
    new = lambda body: spark.createDataFrame([("k", "completed", body), ("n", "failed", "{}")], "key string, state string, body string")
    assert {r.key: r.outcome for r in S.put_plan(stored, new('{"b":2.0,"a":1}')).collect()} == {"k": "unchanged", "n": "written"}
    with pytest.raises(ConflictingRecord):
        S.put_plan(stored, new('{"a":2}'))
    with pytest.raises(REFUSED):
        S.put_plan(stored, new('{"cost_usd":2}')).collect()
    S.put(spark, str(tmp_path / "s"), stored, new('{"b":2,"a":1}').withColumn("cfg", F.lit("c")))
    assert [r.key for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["n"]
    index = spark.createDataFrame([("k", "completed"), ("f", "failed")], "key string, state string")
    key = lambda k: spark.createDataFrame([(k,)], "key string")
    assert [r.key for r in S.remove(index, key("f")).collect()] == ["k"] and S.remove(index, key("k"), True).count() == 1
    for k in ("zz", "k"):
        with pytest.raises(PoolstatError):
            S.remove(index, key(k))
    (tmp_path / "bodies").mkdir()
    (tmp_path / "index.jsonl").write_text('{"key":"a","state":"failed","cfg":{"x":1}}\n\n{"key":"b","state":"completed","cfg":"c"}\n{"key":"a","state":"completed","cfg":"c"}\n')
    (tmp_path / "bodies" / "x.json").write_text(json.dumps({"key": "a", "result": {"distinct_k": 3}}))
    got = {r.key: (r.state, r.cfg) for r in S.read_index(spark, str(tmp_path)).collect()}
    assert got == {"a": ("completed", "c"), "b": ("completed", "c")}
    body = S.get(S.read_index(spark, str(tmp_path)), S.read_bodies(spark, str(tmp_path), "distinct_k int"), "a").first()
    assert body.result.distinct_k == 3 and S.resolve_store(spark, f"{tmp_path}/") == str(tmp_path)
    with pytest.raises(PoolstatError):
        S.resolve_store(spark, str(tmp_path / "nothing"))
    (tmp_path / "c.csv").write_text('id,title\n1,"a ""b"", c"\n2,d\n')
    assert [tuple(r) for r in S.read_quoted(spark, str(tmp_path / "c.csv")).collect()] == [("1", 'a "b", c'), ("2", "d")]
    (tmp_path / "f.csv").write_text("arm,n\nA,\nB,2\n")
    assert [tuple(r) for r in S.read_cells(spark, str(tmp_path / "f.csv")).collect()] == [("A", ""), ("B", "2")]
    (tmp_path / "r.json").write_text(json.dumps({"idea_id": ["a 1", "a1"], "topic": ["t", None], "score": [3, 5]}))
    idea = S.ideas_of(S.reviews(spark, str(tmp_path / "r.json"), "score")).first()
    assert (idea.idea_id, idea.topic, idea.scores) == ("a1", "t", [3.0, 5.0])
    with pytest.raises(PoolstatError):
        S.ideas_of(spark.createDataFrame([("a", "c", "t", 1.0), ("a", "d", "t", 1.0)], "idea_id string, condition string, topic string, score double"))
    with pytest.raises(PoolstatError):
        S.fixture_vectors(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([("y", [1.0])], "text string, v array<double>"))
    words = spark.createDataFrame([(w,) for w in ("c", "a", "b", "a", "d")], "word string")
    s, left, want = stream(20260731), ["a", "b", "c", "d"], []
    for _ in range(3):
        want.append(left.pop(math.floor(next(s) * len(left))))
    assert [r.word for r in S.sampled_keywords(words, 3).orderBy("position").collect()] == want


RECORD = "key string, arm string, brief string, replicate long, cfg string, state string, kind string, detail string, result struct<distinct_k: double>"


def records(spark, *states):
    rows = [(f"arm={a}|brief=b{i}|rep=0|cfg=c", a, f"b{i}", 0, "c", st, "timeout" if st == "failed" else None, None, (k,) if st == "completed" else None) for i, (a, st, k) in enumerate(states)]
    return spark.createDataFrame(rows, RECORD)


def test_frame_guards(spark):
    empty = PS.V.ledger(spark, "/root/testdata/sf0.001").limit(0).drop("l_returnflag", "l_linestatus", "l_linenumber")
    build = lambda rows, cfg="c": FR.build_frame(rows, empty, views.rates(spark), [cfg])
    good = records(spark, ("A", "completed", 2.0), ("B", "completed", 3.0), ("B", "failed", 0.0))
    frame = FR.cells_selected(build(good))
    assert frame.arms == ["A", "B"] and frame.rows.count() == 2 and FR.failures_by_arm(frame.excluded).first().n == 1
    with pytest.raises(DifferentialAttrition):
        build(records(spark, ("A", "completed", 2.0), ("B", "failed", 0.0)))
    with pytest.raises(NoCellsSelected, match="3 stale"):
        FR.cells_selected(build(good, "other"))
    with pytest.raises(REFUSED):
        build(records(spark, ("A", "completed", float("nan")))).rows.collect()
    with pytest.raises(REFUSED):
        build(records(spark, ("A", "lost", 1.0))).rows.collect()
    assert FR.resolve_config(good) == ["c"] and FR.exactly_one_other(["c", "d"], "c") == "d" and FR.exactly_one_other(["c"], "c") is None
    two = good.union(good.withColumn("key", F.replace("key", F.lit("cfg=c"), F.lit("cfg=d"))).withColumn("cfg", F.lit("d")))
    for error, f in ((AmbiguousStoredConfig, lambda: FR.resolve_config(two)), (UnknownStoredConfig, lambda: FR.resolve_config(good, "x")), (NoStoredConfig, lambda: FR.resolve_config(good.limit(0))), (PoolstatError, lambda: FR.subset(good, arm=["Z"]))):
        with pytest.raises(error):
            f()


def test_rarefied_frame(spark):
    rng = np.random.default_rng(5)
    pools = {f"arm={a}|brief=b{i}|rep=0|cfg=c": rng.normal(size=(n, 4)) for i, (a, n) in enumerate((("A", 9), ("B", 6)))}
    k = {key: float(len(V.average_linkage(V.distance_matrix(x), 0.9))) for key, x in pools.items()}
    keys = list(pools)
    frame = FR.build_frame(records(spark, ("A", "completed", k[keys[0]]), ("B", "completed", k[keys[1]])), PS.V.ledger(spark, "/root/testdata/sf0.001").limit(0).drop("l_returnflag", "l_linestatus", "l_linenumber"), views.rates(spark), ["c"])
    vectors = spark.createDataFrame([(key, i, [float(v) for v in row]) for key, x in pools.items() for i, row in enumerate(x)], "key string, position int, vector array<double>")
    rows = {r.key: r for r in R.rarefied_frame(frame, vectors, ["A", "B"], 0.9, rounds=40).rows.collect()}
    assert rows[keys[1]].response == rows[keys[1]].response_full_pool == k[keys[1]] and rows[keys[0]].rarefied_n == 6 and 1 <= rows[keys[0]].response <= 6
    with pytest.raises(REFUSED, match="differ"):
        R.rarefied_frame(frame, vectors, ["A", "B"], 0.2, rounds=2).rows.collect()
    with pytest.raises(PoolsUnavailable):
        R.rarefied_frame(frame, vectors.limit(0), ["A", "B"], 0.9)
    with pytest.raises(MixedPoolCoverage):
        R.rarefied_frame(frame, vectors.where(F.col("key") == keys[0]), ["A", "B"], 0.9)
    for bad in (lambda: R.rarefied_frame(frame, vectors, ["A"], 0.9), lambda: R.rarefied_frame(frame, vectors, ["A", "B"], 0.9, "poolDiversity"), lambda: R.cost_lane(R.rarefied_frame(frame, vectors, ["A", "B"], 0.9, rounds=2))):
        with pytest.raises(PoolstatError):
            bad()


def test_accounts_and_judges(spark):
    planned = spark.createDataFrame([("a",), ("b",)], "key string")
    states = lambda *rows: spark.createDataFrame(list(rows), "key string, state string, kind string, detail string")
    good = states(("a", "completed", None, None), ("b", "skipped", None, "budget_exceeded:x"))
    assert L.summary(L.account(planned, good)).first().skipped == 1 and L.skipped_by_reason(good).first().reason == "budget_exceeded"
    for bad in (states(("a", "completed", None, None)), states(("a", "completed", None, None), ("b", "failed", "odd", None)), states(*[("a", "completed", None, None)] * 2, ("b", "completed", None, None)), states(("a", "completed", None, None), ("b", "completed", None, None), ("c", "completed", None, None))):
        with pytest.raises(PoolstatError):
            L.account(planned, bad)
    assert T.expand_kinds(["transient", "refusal"])[-1] == "refusal" and len(T.expand_kinds(["transient", "timeout"])) == 5
    with pytest.raises(PoolstatError):
        T.expand_kinds(["nothing"])
    for text in ('{"originality": 11, "feasibility": 2}', '{"originality": 3}', "prose", '{"originality": "3", "feasibility": 2}'):
        with pytest.raises(REFUSED):
            spark.range(1).select(T.axis_scores(F.lit(text))["originality"]).collect()
    with pytest.raises(REFUSED):
        spark.range(1).select(JU.distinct_judge(F.array(F.lit("m")), F.array(F.lit("m")))).collect()
    one = spark.createDataFrame([("k", "p", "x", [(1.0, 2.0)])], "key string, pool string, judge_provider string, scores array<struct<originality: double, feasibility: double>>")
    pools = spark.createDataFrame([("p", "A", ["x"])], "pool string, arm string, generator_providers array<string>")
    with pytest.raises(JudgeScoresUnavailable):
        JU.score_frame(one, pools)


def test_reports(spark):
    points = spark.createDataFrame([("A", 2, 1.0, 2.0, True), ("B<", 3, 2.0, 1.0, False)], "arm string, n long, mean_cost double, mean_response double, on_frontier boolean")
    svg = reports.pareto_svg(points)
    assert svg.count("<circle") == 2 and "B&lt;" in svg
    lines = [r.value for r in reports.analysis_csv(points, ["arm", "n"]).collect()]
    assert sorted(lines) == ["A,2", "B<,3"] and "lmer" in reports.r_script("x.csv", "A")
    with pytest.raises(PoolstatError):
        reports.small(spark.range(reports.MAX_ROWS + 1))


def test_index_log_stream(spark, tmp_path):
    from poolstat.streaming import index_log

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"key": k, "state": "completed", "storedAt": "2026-01-01T00:00:00Z"}) for k in ("a", "b", "a")))
    log = index_log.first_of_key(index_log.read_log(spark, str(tmp_path / "in")))
    index_log.append_to(str(tmp_path / "out"), str(tmp_path / "cp"))(log).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_providers(spark):
    from poolstat.sources import providers as PR

    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    got = {r.text: r.vector for r in PR.embedded(texts, lambda ts: [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(ts)))]).collect()}
    assert got == {"a": [1.0, 0.0], "bb": [1.0, 0.0]}
    for bad in ([(0, [0.0, 0.0])], [(0, [1.0]), (0, [1.0])], []):
        with pytest.raises(PoolstatError):
            PR.unit_rows(bad, 1)
    waits, tries = [], iter([PR.Transient("busy", 7.0), PR.Transient("busy"), None])

    def call():
        e = next(tries)
        if e:
            raise e
        return "done"

    assert PR.with_retries(call, sleep=waits.append) == "done" and waits == [7.0, 2.0]
    requests = spark.createDataFrame([(f"r{i}", "p") for i in range(5)], "custom_id string, prompt string")
    replies = PR.asked(requests, lambda rs: [{"custom_id": r["custom_id"], "text": "t"} for r in rs if r["custom_id"] != "r3"], 2).collect()
    assert {r.custom_id: r.error for r in replies} == {"r0": None, "r1": None, "r2": None, "r3": "transport_error", "r4": None}


def test_stage_analysis(spark):
    from poolstat.operators import stages

    rng = np.random.default_rng(11)
    rows, items = [], []
    for a, spread in (("A", 0.2), ("B", 0.6), ("C", 1.5)):
        for b in range(5):
            key, x = f"arm={a}|brief=b{b}|rep=0|cfg=c", rng.normal(size=(8, 3)) * spread + [3.0, 0.0, 0.0]
            k = float(len(V.average_linkage(V.distance_matrix(x), 0.02)))
            rows.append((key, a, f"b{b}", 0, "c", "completed", None, None, (k,)))
            items += [(key, i, [float(v) for v in row]) for i, row in enumerate(x)]
    ledger = spark.createDataFrame([(r[0], "2026-01-01", "api", "single", "claude-1", 1e6, 1e5) for r in rows], "cell_key string, timestamp string, billing_mode string, pricing_regime string, model string, input_tokens double, output_tokens double")
    frame = FR.build_frame(spark.createDataFrame(rows, RECORD), ledger, views.rates(spark), ["c"])
    vectors = spark.createDataFrame(items, "key string, position int, vector array<double>")
    contrasts = [("s-1", "B", None), ("s-2", "C", "B")]
    stage = stages.analyse(frame, vectors, contrasts, "A", 0.02, rule={"A": "c"}, floor=8, rounds=2, iterations=50)
    means = {r.arm: r.m for r in stage.rarefied.rows.groupBy("arm").agg(F.avg("response").alias("m")).collect()}
    assert math.isclose(stage.results[0].estimate, means["B"] - means["A"], abs_tol=1e-6) and math.isclose(stage.results[1].estimate, means["C"] - means["B"], abs_tol=1e-6)
    assert stage.ladder.rung in ("R0", "R1", "R2") and stage.frontier.count() == 3 and stage.ratios.count() == 3 and stage.dropped.count() == 0
    assert "# Analysis" in reports.report(stage.frontier, stage.ladder, stage.results, stage.ratios, frame.excluded) and reports.pareto_svg(stage.frontier)
    with pytest.raises(PoolstatError, match="floor"):
        stages.analyse(frame, vectors, contrasts, "A", 0.02, rounds=2, iterations=5)
