from countweave.llm import mixing


def test_pfair_stays_within_one_block():
    for n in ({"a": 22, "b": 18, "c": 15, "d": 45}, {"a": 1, "b": 997}, {"x": 3, "y": 3, "z": 1}, {"only": 5}):
        plan = list(mixing.pfair(n))
        total = sum(n.values())
        assert [slot for _, _, slot in plan] == list(range(total))
        seen = dict.fromkeys(n, 0)
        for s, k, slot in plan:
            assert k == seen[s] and k * total // n[s] <= slot < -(-(k + 1) * total // n[s])
            seen[s] += 1
            assert all(abs(seen[x] - (slot + 1) * c / total) < 1 for x, c in n.items())
        assert seen == n


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


ROWS = [(i, " Big-One ", 10) for i in range(3000)] + [(10_000 + i, "small", 10) for i in range(20)] + [(20_000, "none", 5), (20_001, None, 5), (20_002, "big_one", 0)]
TARGETS = [("big_one", 0.5, 1), ("SMALL", 0.4, 3), ("absent", 0.1, 2), ("zero", 0.0, 2), ("nan", float("nan"), 2), (None, 0.3, 1)]


def slots(rows):
    at = {}
    for r in rows:
        assert at.setdefault(r["slot"], r["source"]) == r["source"]
    return at


def test_all_texts_once(spark):
    rep = {r["source"]: r for r in mixing.report(docs(spark, ROWS), targets(spark, TARGETS), "all").collect()}
    assert set(rep) == {"big_one", "small", "absent"}
    size = 3000 * 10 + 200
    assert rep["big_one"]["budget"] == round(size * 0.5) and 0 <= rep["big_one"]["mixed"] - rep["big_one"]["budget"] < 10
    assert rep["small"]["mixed"] == 600 and rep["small"]["passes"] == 3 and rep["small"]["shortfall"] == round(size * 0.4) - 600
    assert rep["absent"]["mixed"] == 0 and rep["absent"]["shortfall"] == round(size * 0.1)
    m = mixing.mix(docs(spark, ROWS), targets(spark, TARGETS), "all", block=100).collect()
    assert len({(r["doc_id"], r["pass"]) for r in m}) == len(m)
    assert sum(r["n_tokens"] for r in m if r["source"] == "small") == 600
    assert max(r["pass"] for r in m) == 2 and {r["source"] for r in m} == {"big_one", "small"}
    assert sorted(slots(m)) == list(range(len(slots(m))))  # no slot is empty


def test_shares_are_met(spark):
    d, t = docs(spark, ROWS), targets(spark, TARGETS)
    rep = {r["source"]: r for r in mixing.report(d, t).collect()}
    assert rep["small"]["reach"] == 1500 and rep["small"]["budget"] == 599 and rep["small"]["mixed"] == 600 and rep["small"]["shortfall"] == 0
    assert rep["big_one"]["mixed"] == 750
    m = mixing.mix(d, t, block=50).collect()
    for s in ("big_one", "small"):
        assert sum(r["n_tokens"] for r in m if r["source"] == s) == rep[s]["mixed"]
    # within a block of its weight at any time
    at = slots(m)
    n = sum(s == "small" for s in at.values())
    for k in range(len(at)):
        assert abs(sum(at[i] == "small" for i in range(k + 1)) - n / len(at) * (k + 1)) < 1


def test_tiny_shares_and_repeated_targets(spark):
    rows = [(i, "big", 50) for i in range(4000)] + [(9000 + i, "tiny", 5) for i in range(9)]
    t = targets(spark, [("big", 0.6, 2), ("Big", 0.39996, 3), ("tiny", 0.00004, 2)])
    rep = {r["source"]: r for r in mixing.report(docs(spark, rows), t, "all").collect()}
    m = mixing.mix(docs(spark, rows), t, "all").collect()
    assert rep["tiny"]["budget"] == 8 and rep["tiny"]["mixed"] == 10 == sum(r["n_tokens"] for r in m if r["source"] == "tiny")
    assert rep["big"]["max_repeats"] == 2 and rep["big"]["mixed"] == sum(r["n_tokens"] for r in m if r["source"] == "big")


def test_blocks_stay_few(spark):
    rows = [(i, "ab"[i % 2], 1000) for i in range(400)]
    m = mixing.mix(docs(spark, rows), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), block=10, blocks=20).collect()
    assert len(m) == 400 and len(slots(m)) <= 22


def test_empty(spark):
    t = targets(spark, [("a", 1.0, 1)])
    assert mixing.mix(docs(spark, []), t).count() == 0
    assert mixing.report(docs(spark, []), t).collect()[0]["shortfall"] == 0
    assert mixing.mix(docs(spark, [(1, "a", 5)]), targets(spark, [])).count() == 0
