"""Trees, forests and boosting against slow versions written out row by row."""

import numpy as np
import pytest

from retentia.operators import trees


def gini(s):
    return (s[0] ** 2 + s[1] ** 2) / sum(s)


def slow_split(x, sums, part, ok):
    """Best (quality, feature, threshold, null side) by trying every cut, first among equals."""
    best = None
    for f in range(x.shape[1]):
        v = x[:, f]
        values = np.unique(v[~np.isnan(v)])
        has_null = np.isnan(v).any()
        for side in (False, True) if has_null else (False,):
            cuts = [(a + b) / 2 for a, b in zip(values, values[1:])] + ([np.inf] if has_null and not side and len(values) else [])
            for t in cuts:
                below = np.where(np.isnan(v), side, v < t)
                left, right = sums[below].sum(axis=0), sums[~below].sum(axis=0)
                if ok(left) and ok(right):
                    q = part(left) + part(right)
                    if best is None or q > best[0] * (1 + 1e-10):
                        best = (q, f, t, side)
    return best


def slow_tree(x, sums, part, ok, opened, value, gains, depth):
    s = sums.sum(axis=0)
    best = slow_split(x, sums, part, ok) if opened(s) and depth != 0 else None
    if best is None or not gains(best[0], s):
        return value(s)
    _, f, t, side = best
    below = np.where(np.isnan(x[:, f]), side, x[:, f] < t)
    again = lambda on: slow_tree(x[on], sums[on], part, ok, opened, value, gains, None if depth is None else depth - 1)
    return (f, t, side, again(below), again(~below))


def slow_value(tree, row):
    while isinstance(tree, tuple):
        f, t, side, left, right = tree
        tree = left if (side if np.isnan(row[f]) else row[f] < t) else right
    return tree


def slow_gini(x, y, depth=None):
    sums = np.column_stack([1.0 - y, y])
    return slow_tree(x, sums, gini, lambda s: s.sum() > 0, lambda s: s.min() > 0, lambda s: s[1] / s.sum(), lambda q, s: True, depth)


def slow_boost(x, y, rounds, depth):
    margin, out = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        sums = np.column_stack([p - y, p * (1 - p)])
        part = lambda s: s[0] ** 2 / (s[1] + 1)
        tree = slow_tree(
            x, sums, part, lambda s: s[1] >= 1, lambda s: s[1] >= 2, lambda s: -0.1 * s[0] / (s[1] + 1), lambda q, s: q - part(s) > 1e-6, depth
        )
        margin = margin + [slow_value(tree, r) for r in x]
        out.append(tree)
    return lambda r: 1 / (1 + np.exp(-sum(slow_value(t, r) for t in out)))


def data(n, seed, nulls=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)]).astype(float)
    if nulls:
        x[rng.random(n) < 0.15, 1] = np.nan
        x[rng.random(n) < 0.05, 0] = np.nan
    y = ((x[:, 0] % 7 > 3) ^ (np.nan_to_num(x[:, 1], nan=1.0) > 0.3) ^ (rng.random(n) < 0.1)).astype(float)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "key bigint, a double, b double, c double, y double").repartition(parts)


def scores(model, df):
    return {r["key"]: r["p"] for r in model.score(df, "p").collect()}


COLS = ["a", "b", "c"]


@pytest.mark.parametrize("small", [10_000, 60, 1], ids=["one task", "levels then tasks", "levels"])
@pytest.mark.parametrize("depth", [None, 2])
def test_a_tree_equals_the_slow_one(spark, small, depth):
    x, y = data(500, 1)
    df = frame(spark, x, y)
    slow = slow_gini(x, y, depth)
    got = scores(trees.fit_trees(df, COLS, "y", "key", small=small, depth=depth), df)
    want = {i: slow_value(slow, r) for i, r in enumerate(x)}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-12
    if depth is None:
        # Pure leaves: rows that no other row contradicts get their own label back.
        groups = {}
        for r, t in zip(x, y, strict=True):
            groups.setdefault(str(r), []).append(t)
        assert all(got[i] == pytest.approx(np.mean(groups[str(r)])) for i, r in enumerate(x))


def test_new_rows_fall_between_the_same_cuts(spark):
    x, y = data(300, 2)
    other, _ = data(200, 3)
    other = other + 0.25
    df, new = frame(spark, x, y), frame(spark, other, np.zeros(200))
    slow = slow_gini(x, y)
    want = [slow_value(slow, r) for r in other]
    for small in (10_000, 40):
        got = scores(trees.fit_trees(df, COLS, "y", "key", small=small), new)
        assert [got[i] for i in range(200)] == pytest.approx(want)


def test_a_model_too_large_to_send_scores_alike(spark):
    x, y = data(400, 4)
    df = frame(spark, x, y)
    settings = {"trees": 5, "bootstrap": True, "share": 1}
    sent = trees.fit_trees(df, COLS, "y", "key", **settings)
    kept = trees.fit_trees(df, COLS, "y", "key", small=50, sent_nodes=0, **settings)
    assert sent.subtrees is None and kept.subtrees is not None
    assert scores(sent, df) == pytest.approx(scores(kept, df))


def test_a_forest_draws_rows_and_features_and_repeats(spark):
    x, y = data(600, 5)
    df = frame(spark, x, y)
    one = scores(trees.fit_trees(df, COLS, "y", "key", trees=20, bootstrap=True, share=1), df)
    again = scores(trees.fit_trees(frame(spark, x, y, 7), COLS, "y", "key", trees=20, bootstrap=True, share=1), df)
    assert one == pytest.approx(again)
    assert len({round(v, 6) for v in one.values()}) > 10
    draws = np.array([trees._poisson(np.arange(4000, dtype=np.int64) * 7919, t, 19) for t in range(20)])
    assert draws.mean() == pytest.approx(1, abs=0.02) and draws.var() == pytest.approx(1, abs=0.04)
    assert abs(np.corrcoef(draws[0], draws[1])[0, 1]) < 0.06


@pytest.mark.parametrize("small", [10_000, 1], ids=["one task", "passes"])
@pytest.mark.parametrize(("rounds", "depth"), [(1, 1), (1, 2), (10, 3)])
def test_boosting_equals_the_slow_one(spark, small, rounds, depth):
    if small == 1 and rounds == 10:
        rounds = 4
    x, y = data(400, 6)
    df = frame(spark, x, y)
    slow = slow_boost(x, y, rounds, depth)
    got = scores(trees.fit_boosted(df, COLS, "y", "key", rounds=rounds, depth=depth, small=small), df)
    assert [got[i] for i in range(400)] == pytest.approx([slow(r) for r in x], abs=1e-9)


def test_margins_that_are_written_go_on_alike(spark):
    x, y = data(300, 7)
    df = frame(spark, x, y)
    one = scores(trees.fit_boosted(df, COLS, "y", "key", rounds=12, depth=1), df)
    passes = scores(trees.fit_boosted(df, COLS, "y", "key", rounds=12, depth=1, small=1), df)
    assert one == pytest.approx(passes, abs=1e-9)


def test_many_values_are_cut_at_quantiles_and_finished_exactly(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=900), rng.normal(size=900), np.zeros(900)])
    y = (x[:, 0] + 0.3 * rng.normal(size=900) > 0).astype(float)
    df = frame(spark, x, y)
    got = scores(trees.fit_trees(df, COLS, "y", "key", small=100, max_bins=16), df)
    assert [got[i] for i in range(900)] == list(y)


def test_rows_in_one_common_bin_get_bins_of_their_own(spark):
    rng = np.random.default_rng(11)
    # Two thirds of the values lie within a thousandth, a third are one value with both labels.
    x = np.column_stack([np.where(np.arange(600) % 3 == 0, 5.0, rng.normal(size=600) * 1e-3), np.zeros(600), np.ones(600)])
    y = (np.arange(600) % 2).astype(float)
    df = frame(spark, x, y)
    got = scores(trees.fit_trees(df, COLS, "y", "key", small=20, max_bins=4), df)
    assert all(got[i] == (0.5 if i % 3 == 0 else y[i]) for i in range(600))


def test_odd_tables(spark):
    df = frame(spark, *data(40, 9))
    with pytest.raises(ValueError):
        trees.fit_trees(df.where("key < 0"), COLS, "y", "key")
    with pytest.raises(ValueError):
        trees.fit_boosted(df.where("key < 0"), COLS, "y", "key")
    pure = df.selectExpr("key", "a", "b", "c", "1.0 as y")
    assert set(scores(trees.fit_trees(pure, COLS, "y", "key"), pure).values()) == {1.0}
    none = df.selectExpr("key", "cast(null as double) a", "cast(null as double) b", "cast(null as double) c", "y")
    assert len(set(scores(trees.fit_trees(none, COLS, "y", "key", small=1), none).values())) == 1
    assert trees.fit_trees(df, COLS, "y", "key").score(df.where("key < 0"), "p").count() == 0


@pytest.mark.parametrize("small", [600, 40], ids=["merged rows in one task", "passes over merged rows"])
def test_boosting_merges_rows_of_the_same_bins(spark, small):
    x, y = data(1500, 13)
    x[:, 0] %= 6
    df = frame(spark, x, y)
    alike = len(np.unique(np.nan_to_num(x, nan=99.0), axis=0))
    assert 40 < alike < 600
    context, group = spark.sparkContext, f"boosting {small}"
    context.setJobGroup(group, group)
    model = trees.fit_boosted(df, COLS, "y", "key", rounds=12, depth=2, small=small)
    jobs = len(context.statusTracker().getJobIdsForGroup(group))
    context.setJobGroup("others", "others")
    assert (jobs < 24) == (small == 600)  # no pass per level
    want = scores(trees.fit_boosted(df, COLS, "y", "key", rounds=12, depth=2), df)
    assert scores(model, df) == pytest.approx(want, abs=1e-9)


def test_sums_are_handed_on_before_they_pile_up(spark, monkeypatch):
    x, y = data(500, 14)
    df = frame(spark, x, y)
    rows = trees._prepared(df, COLS, "y", "key")
    starts = trees.bin_starts(rows, ["x0", "x1", "x2"], 256)

    def rows_of(batch, x):
        for tree in range(4):
            yield tree, np.zeros(len(x), dtype=int), np.ones(len(x)), batch.column("y").to_numpy(), None

    def sums():
        batches = rows.coalesce(1).toArrow().to_batches(max_chunksize=50)
        out = [b.num_rows for b in trees._cells_of(["x0", "x1", "x2"], starts, rows_of)(iter(batches))]
        return max(out), len(out)

    whole = sums()
    monkeypatch.setattr(trees, "HELD_CELLS", 20)
    small = sums()
    assert whole[1] == 12 and small[1] > 12 and small[0] <= whole[0]
