import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from rollweave.llm import packing


def best_fit(capacity, sizes):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.data())
def test_sweep_is_best_fit_and_fills_no_container_twice(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=80))
    classes = Counter(sizes)
    segs, n = packing.sweep(capacity, classes)
    room, items, placed = [0] * n, [0] * n, Counter()
    for i, (size, rank, first, per, offset, position) in enumerate(segs):
        later = [r for s, r, *_ in segs[i + 1 :] if s == size]
        upto = min(later) if later else classes[size]
        for r in range(rank, upto):
            c = first + (r - rank) // per
            j = (r - rank) % per
            assert room[c] == offset + j * size and items[c] == position + j
            room[c] += size
            items[c] += 1
            placed[size] += 1
    assert placed == classes and all(0 < x <= capacity for x in room)
    # Supersteps may pass by a gap that opens behind them; the bound of the containers beyond sequential best fit:
    assert n <= best_fit(capacity, sizes) * 1.1 + 2


def test_near_sequential_best_fit_on_many_items():
    rng = random.Random(7)
    for capacity in (300, 512, 2048):
        sizes = [min(capacity, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(4000)]
        _, n = packing.sweep(capacity, Counter(sizes))
        least = -(-sum(sizes) // capacity)
        assert n <= best_fit(capacity, sizes) * 1.01 + 2 and n <= least * 1.05 + 2


def test_ranges_and_supersteps():
    assert [packing.range_of(s, 100) for s in (100, 51, 50, 26, 25, 12, 6, 1)] == [2, 2, 1, 1, 0, 0, 0, 0]
    climbs = {s: [t for t in range(packing.supersteps()) if s in packing.active(t)] for s in range(packing.RANGES)}
    assert min(climbs[0]) == 2 * (packing.RANGES - 1) and packing.supersteps() - 1 == max(climbs[packing.RANGES - 1])


def test_pack_whole_split_and_left_out(spark):
    items = spark.createDataFrame([(1, 5), (2, 25), (3, 10), (4, 0), (5, None), (6, 5), (6, 5)], "doc_id bigint, n int").selectExpr("*", "'x' AS k", "1 AS capacity")
    bins = spark.createDataFrame([(1, 10), (2, 100), (3, 0), (4, None)], "b int, cap int")
    rows = packing.pack(items, bins, "doc_id", "n", "b", "cap").collect()
    by = {b: [r for r in rows if r["b"] == b] for b in (1, 2)}
    assert {r["b"] for r in rows} == {1, 2}
    assert Counter((r["doc_id"], r["start_token"], r["n_tokens"]) for r in by[1]) == Counter({(1, 0, 5): 1, (2, 0, 10): 1, (2, 10, 10): 1, (2, 20, 5): 1, (3, 0, 10): 1, (6, 0, 5): 2})
    assert len({r["container"] for r in by[1]}) == 5 and len({r["container"] for r in by[2]}) == 1
    for b, cap in ((1, 10), (2, 100)):
        for c in {r["container"] for r in by[b]}:
            x = sorted((r["offset"], r["n_tokens"], r["position"]) for r in by[b] if r["container"] == c)
            assert [p for *_, p in x] == list(range(len(x)))
            assert all(a[0] + a[1] == n[0] for a, n in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= cap
    assert packing.pack(items.limit(0), bins, "doc_id", "n", "b", "cap").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 20_000)], "id bigint, text string")
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "id", "text").collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] >= 20_000
