"""Exact and SimHash deduplication against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from retentia.llm import components, exact_dedup, simhash

SCHEMA = "doc_id bigint, text string, key string, row_key string, fp int, keep_id string"
ROWS = [
    (5, "a b  c", "x", None, 1, "k"),
    (2, "ab c", "x", "y", None, None),
    (9, "a\tb\n c\r\x0b\x0c", None, None, None, None),
    (3, None, "x", None, None, None),
    (7, "", None, None, None, None),
    (8, " \t", None, None, None, None),
    (4, "long " * 50_000, None, None, None, None),
    (6, "long" * 50_000, None, None, None, None),
    (10, "a b c", None, None, None, None),
    (11, "eins zwei drei vier fünf", None, None, None, None),
    (11, "eins zwei drei vier fünf", None, None, None, None),
    (None, "no id", None, None, None, None),
    (None, "no  id", None, None, None, None),
    (None, "another without id", None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_exact_groups_equal_brute_force(docs):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t, *_ in ROWS:
        keep = min(groups[plain(t)])[3]
        sha = hashlib.sha256(plain(t).encode()).hexdigest()
        want.append((i, keep, len(groups[plain(t)]), i == keep, sha))
    got = [tuple(r) for r in exact_dedup.decide(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_leaves_one_row_of_each_group(docs):
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    texts = [plain(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({plain(t) for _, t, *_ in ROWS})
    assert {r.doc_id for r in left.collect()} >= {5 if len("a b  c") > len("a\tb\n c\r\x0b\x0c") else 9, 8, 4, 10, 11}


def test_runs_of_many_partitions_are_merged_whole(spark):
    rows = [(i, f"text {i % 40}") for i in range(4000)]
    records = exact_dedup.digest_table(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40))
    merged = exact_dedup.merge_runs(records.repartition(70)).collect()
    assert sorted((r.keep_id, r.group_size) for r in merged) == [(i, 100) for i in range(40)]


def test_repeated_ids_leave_the_longest_row_of_a_group(spark):
    rows = [(1, "a b"), (1, "a    b      "), (1, "a     b     "), (2, "ab"), (3, "c"), (3, "c"), (None, "d "), (None, "d"), (None, " d"), (3, "a")]
    left = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [(1, "a     b     "), (3, "c"), (None, " d"), (3, "a")]))


def test_rounds_merge_runs_and_group_nothing(spark):
    records = exact_dedup.digest_table(spark.createDataFrame([(i, f"t{i % 5}") for i in range(50)], "doc_id bigint, text string"))
    plan = exact_dedup.merge_runs(records.repartition(20))._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.decide(none).count() == exact_dedup.keep_one(none).count() == 0
    assert simhash.group(none).count() == simhash.keep_one(none).count() == 0


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_rows():
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = random.choices(words, k=random.choice([30, 200, 900]))
        for _ in range(8):
            copy = list(base)
            for _ in range(random.choice([0, 1, 2, 6])):
                copy[random.randrange(len(copy))] = random.choice(words).upper()
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "Two words"), (2004, "two WORDS"), (2004, "two words"), (None, "two words"), (None, "ein satz ohne nummer")]


def slow_components(fps, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 3])
def test_simhash_equals_brute_force(spark, crowded):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, key int, fp string").repartition(3)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(fps)
    ids = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        ids[r] += [i] if i is not None else []
    want = [(i, f"{f:016x}", min(ids[r], default=None)) for (i, _), f, r in zip(rows, fps, root, strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(docs, crowded=crowded).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r for r in root}) < len(rows)


def test_simhash_leaves_one_document_of_each_group(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, key string")
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    root = slow_components([slow_fingerprint(t) for _, t in rows])
    assert left.count() == len(set(root))


def test_simhash_leaves_one_row_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (1, long + " end"), (1, long), (2, long), (3, "other words of a text"), (3, "other words of a text"), (3, "no such thing here")]
    rows += [(None, "x"), (None, "x"), (None, " x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, fp int").repartition(3)
    marks = {t: slow_fingerprint(t) for _, t in rows}
    assert len(set(slow_components(list(marks.values())))) == 4
    left = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "3", "None"]
    assert len({r.text for r in left if r.doc_id == 3}) == 2


def test_very_long_text_counts_in_pieces():
    text = " ".join(f"word{i % 977}" for i in range(100_000))
    words = text.split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text, 4, 42) & (1 << 64) - 1 == want


def test_random_fingerprints_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:40]:
        for k in (1, 2, 3, 4, 5, 6):
            x = int(b)
            for bit in rng.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for crowded in (simhash.CROWDED, 2):
        assert same_groups(simhash.link(nodes, 4, crowded), signed, fps)


def same_groups(links, signed, fps):
    names = dict(components.components(links).collect())
    got = [names.get(x, x) for x in signed]
    want = slow_components(fps)
    return len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("crowded, few, most", [(16_384, 8, 1 << 20), (4, 4, 1 << 20), (16_384, 2, 40), (16_384, 512, 40), (6, 3, 20)])
def test_crowded_cells_lose_no_link(spark, monkeypatch, crowded, few, most):
    """Cells split in the task, dealt again in a second shuffle, and linked by balls."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(crowded + few)
    fps = set()
    for base in rng.integers(0, 1 << 63, 3, dtype=np.uint64):
        bits = rng.choice(64, 24, replace=False)  # texts of one kind differ in some bits only
        for _ in range(160):
            fps.add(int(base) ^ sum(1 << int(b) for b in rng.choice(bits, rng.integers(0, 9), replace=False)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert 20 < len(set(slow_components(fps))) < len(fps) - 20
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(5)
    assert same_groups(simhash.link(nodes, 4, crowded), signed, fps)


def test_grids_do_not_grow_with_the_table():
    assert {len(simhash.grids(n, 4)) for n in (0, 1, 10**5, 10**7, 10**9, 10**10)} == {15}
    top = simhash.grids(10**10, 4)
    assert all(x & m == 0 for m in top for x in simhash.grids(1 << 20, 4, m, simhash.NARROW))
    # Any four segments that differ leave one grid of either kind whole.
    for m in (0, top[3]):
        free = [s for s in range(32) if not m >> 2 * s & 3]
        finer = simhash.grids(5_000, 4, m, simhash.NARROW)
        for _ in range(300):
            differ = sum(3 << 2 * s for s in random.sample(free, 4))
            assert any(x & differ == 0 for x in finer)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 30)] + [(51, 50), (52, 51), (50, 52), (3, 3)]
    random.seed(1)
    random.shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    want = {i: 100 for i in range(101, 161)} | {i: 7 for i in range(8, 30)} | {51: 50, 52: 50}
    assert got == want
    none = spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    assert components.components(none).count() == 0
