import bisect
import random
from collections import Counter, defaultdict

from skein.llm import packing


def check(rows, docs, cap):
    pieces, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc].append((r.first_token, r.length))
        if r.container is not None:
            spans[r.container].append((r.start, r.start + r.length))
    want = defaultdict(Counter)
    for d, n in docs:
        want[d][n or 0] += 1
    for d, c in want.items():
        assert sum(length for _, length in pieces[d]) == sum(k * v for k, v in c.items())
        assert len(pieces[d]) == sum(v * max(1, -(-k // cap)) for k, v in c.items())
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= cap and all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))
    return len(spans)


def best_fit_decreasing(docs, cap):
    rooms = []
    for x in sorted(((x or 0) % cap for _, x in docs), reverse=True):
        if x:
            i = bisect.bisect_left(rooms, x)
            room = rooms.pop(i) if i < len(rooms) else cap
            bisect.insort(rooms, room - x)
    return sum((x or 0) // cap for _, x in docs) + len(rooms)


def test_random(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([rng.randrange(1, 300), rng.randrange(1, 5000), 700])) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 2048), (9003, 4096), (9004, 1), (9004, 1), (9004, 1)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc bigint, n int, part int")
    n = check(packing.pack(df, "doc", "n").collect(), docs, 2048)
    assert n <= 1.01 * best_fit_decreasing(docs, 2048)


def test_small(spark):
    df = spark.createDataFrame([], "doc bigint, n int")
    assert packing.pack(df, "doc", "n").count() == 0
    docs = [(i, 7) for i in range(100)]
    df = spark.createDataFrame(docs, "doc bigint, n int")
    assert check(packing.pack(df, "doc", "n", capacity=10).collect(), docs, 10) == 100


def test_plan_uses_every_length_once():
    rng = random.Random(4)
    for cap in (5, 64, 2048):
        for _ in range(5):
            hist = {rng.randrange(1, cap): rng.randrange(1, 50) for _ in range(30)}
            used = Counter()
            for p, t in packing.fit(hist, cap):
                assert sum(p) <= cap and t > 0
                for n in p:
                    used[n] += t
            assert used == Counter(hist)
