from pyspark.sql import functions as F

from tidemill.llm import mixing


def test_raking_reaches_all_marginals():
    cells = {(a, b): 10.0 + 7 * i + 3 * j for i, a in enumerate("xyz") for j, b in enumerate(["p", None, "q"])}
    weight = mixing.rake(cells, [{"x": 1, "y": 2, "z": 1}, {"p": 3, "q": 1}], 200)
    total = sum(cells.values())
    have = lambda d, v: sum(cells[k] * weight[k] for k in cells if k[d] == v)
    assert abs(have(0, "y") - total / 2) < 1e-6 * total
    free = sum(n for k, n in cells.items() if k[1] is None)
    assert abs(have(1, "p") - 0.75 * (total - free)) < 1e-6 * total and abs(have(1, None) - free) < 1e-6 * total


def test_calibration_meets_the_budget():
    cells = {(i,): float(s) for i, s in enumerate([100, 50, 10, 5, 1])}
    weight = {(i,): w for i, w in enumerate([0.2, 1.0, 5.0, 40.0, 0.0])}
    for budget in (1.0, 30.0, 90.0, 164.9):
        chance = mixing.calibrate(cells, weight, budget)
        assert all(0 <= p <= 1 for p in chance.values())
        assert abs(sum(cells[k] * p for k, p in chance.items()) - budget) < 1e-9
    assert mixing.calibrate(cells, weight, 1000.0) == {(i,): float(i < 4) for i in range(5)}


def test_sample_and_odd_rows(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, i % 5 or None, "a" * (i % 11), "x") for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), rows[5]], "doc_id long, source string, lang int, text string, _chance string")
    targets = [{"s0": 0.6, "s1": 0.2, "s2": 0.2}, {"1": 1, "2": 1, "3": 1, "4": 1}]
    found = mixing.sample_mixture(docs, [F.col("source"), F.col("lang")], targets, F.length("text"), 0.4, chance_col="chance")
    out = found.collect()
    assert len(out) == 3002
    expected = sum(r["chance"] * len(r["text"] or "") for r in out)
    assert abs(expected - 0.4 * sum(len(r["text"] or "") for r in out)) < 1e-6
    drawn = mixing.sample_mixture(docs, [F.col("source"), F.col("lang")], targets, F.length("text"), 0.4)
    assert drawn.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in drawn.collect()))) == sorted(str(r["doc_id"]) for r in out if r["sampled"])
    share = sum(r["sampled"] for r in out if r["chance"] > 0) / len(out)
    assert abs(share - sum(r["chance"] for r in out) / len(out)) < 0.03


def test_many_cells_give_the_same(spark, monkeypatch):
    rows = [(i, f"s{i * i % 13}" if i % 7 else None, f"l{i % 3}", "a" * (i % 11)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    targets = [{f"s{i}": 1 + i for i in range(11)}, {"l0": 0.7, "l1": 0.2, "l2": 0.1}]

    def chances():
        found = mixing.sample_mixture(docs, [F.col("source"), F.col("lang")], targets, F.length("text"), 0.6, chance_col="chance", rounds=6)
        return sorted((r["doc_id"], round(r["chance"], 9), r["sampled"]) for r in found.collect())

    want = chances()
    monkeypatch.setattr(mixing, "MOST_CELLS", 5)
    assert chances() == want and any(c == 1 for _, c, _ in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.sample_mixture(docs, [F.col("source")], [None], F.length("text"), 0.5).collect() == []


def test_raking_as_a_table_ends_once_marginals_are_met(spark, monkeypatch):
    from tidemill.llm import mixing

    cells = {(a, b): float(3 + a * 7 + b * 5) for a in range(3) for b in range(4)}
    targets = [{"0": 0.5, "1": 0.3, "2": 0.2}, {str(b): 0.25 for b in range(4)}]
    plain = mixing.rake({(str(a), str(b)): n for (a, b), n in cells.items()}, targets, 60)
    written = []
    original = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: written.append(name) or original(df, name))
    table = spark.createDataFrame([(str(a), str(b), n) for (a, b), n in cells.items()], "a string, b string, _size double")
    found = {(r["a"], r["b"]): r["_weight"] for r in mixing.rake_table(table, ["a", "b"], targets, 60).collect()}
    assert all(abs(found[k] - plain[k]) < 1e-10 for k in plain) and written.count("mix-weights") < 60
