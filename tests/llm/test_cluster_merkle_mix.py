"""Clustering, Merkle manifest and mixing against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import clustering, merkle, mixing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Clustering


def brute_clusters(rows, k, rounds, salt="2:"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    signs = clustering.walsh()
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"{salt}{r[0]}") if r[0] is not None else "", list(signs.astype(object) @ np.array(r[1], dtype=object))))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (j, _), (_, v) in zip(assign(), kept, strict=True):
            groups[j].append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found, sums = assign(), Counter()
    for j, d in found:
        sums[j] += d
    return [
        (i, j, d, sums[j], sum(sums.values()), sha(",".join(map(str, centroids[j]))))
        for (j, d), (i, _) in zip(found, kept, strict=True)
    ]


def vectors(n, spread, seed):
    rng = random.Random(seed)
    return [(i, [rng.gauss(rng.choice([-1, 0, 1]) * spread, spread) for _ in range(64)]) for i in range(n)]


ODD = [
    (500, None),
    (501, [1.0] * 63),
    (502, [1.0] * 65),
    (503, [1.0] * 63 + [None]),
    (504, [float("nan")] + [1.0] * 63),
    (505, [float("-inf")] + [1.0] * 63),
    (None, [0.25] * 64),
    (None, [-0.25] * 64),
    (7, [0.5] * 64),
    (7, [0.5] * 64),
    (7, [-0.5] * 64),
]


@pytest.mark.parametrize(
    ("rows", "k"),
    [(vectors(150, 0.3, 1) + ODD, 12), (vectors(3, 0.3, 2), 40), (vectors(60, 3e4, 3) + ODD, 9), ([(i, [0.5] * 64) for i in range(20)], 4), (ODD[:6], 4)],
    ids=["mixed", "few", "wide", "ties", "none"],
)
def test_clusters_equal_brute_force(spark, rows, k):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, coefs string, cluster int")
    got = clustering.cluster(table.repartition(3), k=k, rounds=4).drop("centroid").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_clusters(rows, k, 4)))


def test_clusters_of_an_empty_table(spark):
    assert clustering.cluster(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_progressive_search_keeps_ties_and_drops_centroids_only_when_strictly_worse():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (400, 64)) * (rng.random((400, 64)) < 0.1)
    c = np.concatenate([x[:20], x[:10], np.zeros((3, 64), dtype=np.int64)])
    signs = clustering.walsh()
    number, distance = clustering.nearest(x @ signs.T, c @ signs.T)
    brute = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (number == brute.argmin(axis=1)).all() and (distance == brute.min(axis=1)).all()
    assert (signs @ signs.T == 64 * np.eye(64)).all() and (clustering.components(x @ signs.T) == x).all()


# Merkle manifest


def brute_merkle(rows):
    def digest(row, more=0):
        values = list(row)
        values[3] = None if values[3] is None else values[3] + more
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
        return levels

    def beside(levels, place):
        out = []
        for level in levels[:-1]:
            other = place ^ 1
            node = level[other] if other < len(level) else ""
            out.append((node, "") if place & 1 else ("", node))
            place //= 2
        return out

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, digest(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for place, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = beside(trees[g], place) + beside(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = digest(row, 1) if hit else leaf
            for before, after in proof:
                node = sha(before + node + after)
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node, node == top[-1][0]))
    return out


MERKLE = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, pos int, levels string"


@pytest.mark.parametrize("sizes", [{"en": 700, None: 300, "": 1, "dé": 257, "zh": 2, "fr": 256}, {None: 1}, {"en": 3}], ids=["many", "one", "three"])
def test_merkle_equals_brute_force(spark, sizes):
    rng = random.Random(4)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(5000), rng.choice(["a", None, "ü"]), lang, rng.choice([None, 1, 20]), rng.choice([None, "", "text ☃", "x" * 1000])))
    if len(rows) > 100:
        rows += rows[:40] + [(None, "a", "en", 1, "t"), (None, None, None, None, None), (-5, "a", "en", 9, "long " * 40_000)]
    table = spark.createDataFrame([(*r, "g", 0, "l") for r in rows], MERKLE).repartition(5)
    got = merkle.audit(table).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_merkle(rows)))


def test_merkle_of_an_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], MERKLE)).count() == 0


def test_merkle_climbs_three_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, "a", f"l{i % 7}" if i % 3 else "hot", 1, str(i)) for i in range(160)]
    table = spark.createDataFrame([(*r, "g", 0, "l") for r in rows], MERKLE).repartition(4)
    assert sorted(map(tuple, merkle.audit(table).collect())) == sorted(brute_merkle(rows))


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = {s: weights[i % len(weights)] for i, s in enumerate(names) if s not in capped}
        rest = total - sum(capped.values())
        out = {s: rest * w / sum(free.values()) for s, w in free.items()}
        above = {s for s, t in out.items() if t >= limit * sizes[s]}
        if not above:
            return capped | out
        capped |= {s: limit * sizes[s] for s in above}
        if len(capped) == len(names):
            return capped


def mix_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = min(3000, int(rng.paretovariate(0.8) * 5))
        rows.append((i, " \t".join(["wörd"] * words) + rng.choice(["", "\n"]), rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])))
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \n\t", "only empty"), (None, "one two", "a"), (None, "one two three", "b")]
    return rows + [(n + 3, "some words that repeat", "c")] * 25


MIX = "doc_id bigint, text string, source string, size int, key string, lot int"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = mix_rows(1500)
    table = spark.createDataFrame([(*r, 0, "k", 1) for r in rows], MIX).repartition(4)
    return rows, table, mixing.mix(table).collect()


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_mix_meets_targets(mixed):
    rows, _, got = mixed
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    assert sorted((repr(i), words(t), repr(s)) for i, t, s in rows) == sorted((repr(r.doc_id), r.size, repr(r.source)) for r in got)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        assert math.floor(r.target / r.source_size if r.source_size else 0) * r.size <= r.taken
    for s, aim in want.items():
        assert abs(taken[s] - aim) <= 30 + 0.002 * aim, s


def test_mix_is_the_same_on_any_partitioning(mixed):
    _, table, got = mixed
    again = mixing.mix(table.repartition(9).sortWithinPartitions(F.rand())).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_in_several_rounds_of_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOT", 4)
    monkeypatch.setattr(mixing, "STEP", 2)
    rows = mix_rows(600, seed=3)
    got = mixing.mix(spark.createDataFrame([(*r, 0, "k", 1) for r in rows], MIX)).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 30 + 0.002 * t for s, t in target.items())


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], MIX)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, 0, "k", 1), (2, "", "a", 0, "k", 1)], MIX)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_meeting_keeps_words_and_probabilities():
    rng = random.Random(2)
    for _ in range(300):
        a, b = rng.randint(1, 50), rng.randint(1, 50)
        m, n = rng.random() * a, rng.random() * b
        ends = [mixing._meet((a, m), (b, n), (i + 0.5) / 2000) for i in range(2000)]
        assert all(x + y == pytest.approx(m + n) and (x in (0, a) or y in (0, b)) for x, y in ends)
        assert sum(x for x, _ in ends) / 2000 == pytest.approx(m, abs=a / 500)


def test_the_last_documents_end_near_the_target():
    rng = random.Random(6)
    for _ in range(500):
        sizes = sorted((rng.randint(2**k, 2 ** (k + 1) - 1) for k in rng.sample(range(12), rng.randint(1, 8))), reverse=True)
        docs = [(n, rng.random() * n, rng.random()) for n in sizes]
        taken = mixing.settled(docs)
        off = abs(sum(n for n, up in zip(sizes, taken, strict=True) if up) - sum(m for _, m, _ in docs))
        assert off <= max(sizes)
    # Each document is taken as often as its probability says where the smaller ones can make up for it.
    ups = [mixing.settled([(40, 10.0, d / 100), (20, 15.0, 0.5), (15, 10.0, 0.5), (12, 7.0, 0.5)])[0] for d in range(100)]
    assert sum(ups) == 25
