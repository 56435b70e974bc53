import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.llm.packing import _Stock, packed, plan, reduced


def fewest(items, capacity):
    """The least number of containers, by trying."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                put(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        put(i + 1, bins)
        bins.pop()

    put(0, [])
    return best[0]


def tally(items):
    return {x: items.count(x) for x in set(items)}


@settings(max_examples=400, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_plan(case):
    capacity, items = case
    patterns, back = plan(tally(items), capacity), {}
    for n, held in patterns:
        assert n > 0 and sum(s * q for s, q in held.items()) <= capacity
        for s, q in held.items():
            back[s] = back.get(s, 0) + n * q
    assert back == tally(items)
    assert sum(n for n, _ in patterns) <= fewest(items, capacity) + 1
    # what the reduction fixes costs nothing
    stock = _Stock(tally(items))
    fixed = reduced(stock, capacity)
    assert sum(n for n, _ in fixed) + fewest([s for s, n in stock.n.items() for _ in range(n)], capacity) == fewest(items, capacity)


def test_close_to_the_bound():
    rng = random.Random(1)
    items = [min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20000)]
    n = sum(n for n, _ in plan(tally(items), 2048))
    assert n <= 1.002 * -(-sum(items) // 2048) + 1


KINDS = "container_kind string, capacity_tokens int, capacity int"


def test_packed(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, 0, -3, 7, 7, 7, 7, rng.randint(1, 130)]), 5, "clash") for i in range(600)] + [(1000, 10_000, 5, "clash"), (None, 4, 5, "x")]
    items = spark.createDataFrame(data, "doc_id bigint, size int, part int, kind string")
    kinds = spark.createDataFrame([("s", 50, 1), ("l", 128, 1), ("none", 0, 1), (None, 9, 1), ("s", 60, 1)], KINDS)
    out = packed(items, F.col("doc_id"), F.col("size"), kinds).collect()
    for kind, capacity in (("s", 50), ("l", 128)):
        own = [r for r in out if r["container_kind"] == kind]
        used = {}
        for r in own:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        want = {}
        for i, size, *_ in data:
            if size and size > 0:
                want[i] = want.get(i, 0) + size
        got = {}
        for r in own:
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        assert got == want
        # only items over the capacity are in pieces, and these fill containers but for the last
        pieces = [r for r in own if r["piece"] > 0]
        assert {r["doc_id"] for r in pieces} == {i for i, size, *_ in data if size and size > capacity}
        assert len(used) <= -(-sum(want.values()) // capacity) * 1.05 + 1
    assert {r["container_kind"] for r in out} == {"s", "l"}


def test_empty(spark):
    items, kinds = spark.createDataFrame([], "doc_id bigint, size int"), spark.createDataFrame([("s", 5, 1)], KINDS)
    assert packed(items, F.col("doc_id"), F.col("size"), kinds).count() == 0
    some = spark.createDataFrame([(1, 3)], "doc_id bigint, size int")
    assert packed(some, F.col("doc_id"), F.col("size"), kinds.where("false")).count() == 0
