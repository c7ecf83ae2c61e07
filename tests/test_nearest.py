"""Nearest rows against numpy, with copies, near copies, zero and missing vectors."""

import numpy as np
import pytest

from wardlens.operators import nearest

SCHEMA = "id long, v array<float>"


def exact(data, queries, k):
    known = [(i, np.array(v, float)) for i, v in data if v is not None]
    unit = {i: v / np.linalg.norm(v) if np.linalg.norm(v) else v for i, v in known}
    out = {}
    for q in queries:
        if q in unit:
            sims = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in unit if i != q)
            out[q] = [(i, -s) for s, i in sims[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["query"]), r["rn"])):
        out.setdefault(r["query"], []).append((r["neighbour"], r["similarity"]))
    return out


def agrees(got, want):
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        assert [s for _, s in near] == pytest.approx([s for _, s in want[q]], abs=1e-9), q
        assert len({i for i, _ in near}) == len(near) and q not in {i for i, _ in near}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = [rng.standard_normal(12).astype(np.float32).tolist() for _ in range(300)]
    rows += [rows[0]] * 200  # a third are copies
    rows += [(np.array(rows[1]) + rng.normal(0, 1e-3, 12)).astype(np.float32).tolist() for _ in range(80)]
    rows += [[0.0] * 12, [0.0] * 12, None]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [3, 5000])
def test_exact_search_equals_numpy(spark, data, monkeypatch, block):
    monkeypatch.setattr(nearest, "QUERIES_PER_BLOCK", block)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    queries = df.where("id % 20 = 0 or id >= 575")
    got = lists(nearest.nearest_rows(queries, df, "id", "v", 7))
    want = exact(data, [i for i, _ in data if i % 20 == 0 or i >= 575], 7)
    agrees(got, want)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]  # copies in key order


@pytest.mark.parametrize("per_bucket", [30, 10**6])
def test_neighbours_of_all_reach_the_recall(spark, data, per_bucket):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = lists(nearest.neighbours(df, "id", "v", 5, recall=0.9, per_bucket=per_bucket))
    want = exact(data, [i for i, _ in data], 5)
    assert set(got) == set(want) and all(len(near) == 5 for near in got.values())
    hits = sum(min(s for _, s in want[q]) - 1e-9 <= s for q, near in got.items() for _, s in near)
    assert hits >= 0.9 * 5 * len(want)
    if per_bucket == 10**6:
        agrees(got, want)
    assert [i for i, _ in got[310]] == [0, 300, 301, 302, 303]


def test_text_keys_few_rows_and_none(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0])], "id string, v array<double>")
    assert lists(nearest.nearest_rows(df, df, "id", "v", 5))["c"] == [("a", 0.0), ("b", 0.0)]
    assert lists(nearest.neighbours(df, "id", "v", 1)) == {"a": [("b", 1.0)], "b": [("a", 1.0)], "c": [("a", 0.0)]}
    none = df.limit(0)
    assert nearest.nearest_rows(df, none, "id", "v").count() == 0
    assert nearest.neighbours(none, "id", "v").count() == 0
    assert nearest.neighbours(df.where("id = 'a'"), "id", "v").count() == 0


def test_hot_buckets_are_divided_by_further_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.normal(0, 0.3, 16)).tolist()) for i in range(600)] + [(600 + i, rng.standard_normal(16).tolist()) for i in range(600)]
    coded = nearest._coded(nearest._known(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v"), "id", 42)
    extra = nearest._extra_bits(coded, 5, 20).collect()
    assert extra and max(r["extra"] for r in extra) >= 3


def test_larger_buckets_when_they_send_fewer_rows(spark, monkeypatch):
    rows = np.random.default_rng(5).standard_normal((3000, 32)).tolist()
    coded = nearest._coded(spark.createDataFrame(list(enumerate(rows)), "k long, vector array<double>"), "k", 42).localCheckpoint()
    chosen = nearest.calibrated(coded, "k", 42, 10, 0.9, 64)
    monkeypatch.setattr(nearest, "MORE_COMPARED", 0)
    smallest = nearest.calibrated(coded, "k", 42, 10, 0.9, 64)
    assert 0 < chosen[0] < smallest[0]
    assert nearest.rows_sent(3000, *chosen) < nearest.rows_sent(3000, *smallest)
    assert nearest.share_compared(*chosen) <= 1.25 * nearest.share_compared(*smallest)


@pytest.mark.parametrize("per_bucket", [30, 10**6])
def test_all_rows_are_searched_in_passes_of_bounded_size(spark, data, monkeypatch, per_bucket):
    """What one pass sends grows with the table, not with its square; vectors of floats are sent as such."""
    monkeypatch.setattr(nearest, "QUERIES_PER_BLOCK", 10)
    sent, search = [], nearest._searched

    def counted(cells, key, k):
        if k == 5:
            sent.append((cells.count(), cells.schema["vector"].dataType.simpleString()))
        return search(cells, key, k)

    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    monkeypatch.setattr(nearest, "calibrated", lambda coded, *a: (0, 1) if per_bucket == 10**6 else (3, 6))
    monkeypatch.setattr(nearest, "_searched", counted)
    got = lists(nearest.neighbours(df, "id", "v", 5, per_bucket=per_bucket))
    nodes = 300 + 80 + 1
    assert len(sent) > 2 and {kind for _, kind in sent} == {"array<float>"}
    stretches = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(n for n, _ in sent) <= nodes * (2 * nearest.SENT_AT_ONCE + stretches / len(sent))
    assert set(got) == {i for i, v in data if v is not None} and all(len(near) == 5 for near in got.values())
    if per_bucket == 10**6:
        agrees(got, exact(data, [i for i, _ in data], 5))


def test_queries_in_many_blocks_are_sent_to_few_stretches(spark, data, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES_PER_BLOCK", 100)
    df = nearest._known(spark.createDataFrame(data, SCHEMA), "id", "v")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = nearest._cells(df, df, "id")
    assert cells.where("not is_row").count() <= df.count() * -(-2 * partitions // 6)
    assert cells.select("cell").distinct().count() >= partitions
