import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, error long, code string"


def brute(rows):
    """Lloyd over all vectors, one by one; no weights, no distinct parts."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    ints = [[int(np.floor(float(np.float32(c)) * 1024)) for c in v] for _, v, _ in kept]
    width = len(ints[0]) // 4
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:256]
    assigned, books = [], []
    for p in range(4):
        parts = [v[p * width : (p + 1) * width] for v in ints]
        book = [list(parts[k]) for k in order]
        near = lambda x: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e])), e))  # noqa: B023, E731
        for _ in range(4):
            members = defaultdict(list)
            for x in parts:
                members[near(x)].append(x)
            for e, own in members.items():
                book[e] = [sum(c) // len(own) for c in zip(*own)]
        assigned.append([(e, sum((a - b) ** 2 for a, b in zip(x, book[e]))) for x in parts for e in [near(x)]])
        books.append(book)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors, by_label = [sum(a[k][1] for a in assigned) for k in range(len(kept))], defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return sorted(((i, "".join(f"{a[k][0]:02x}" for a in assigned), errors[k], by_label[x], digest) for k, (i, _, x) in enumerate(kept)), key=str)


@pytest.mark.parametrize("n", [40, 330])
def test_against_lloyd_over_all(spark, n):
    r = random.Random(n)
    rows = [(i, [r.uniform(-1, 1) if i % 3 else r.choice([0.0, 0.5, -0.25]) for _ in range(8)], r.choice([None, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(50)] + [(5, rows[8][1], None), (5, rows[8][1], None), (None, rows[9][1], 3)]
    rows += [(-1, None, 1), (-2, [0.1] * 7 + [None], 1), (-3, [float("nan")] + [0.0] * 7, 2), (-4, [float("inf")] + [0.0] * 7, 2), (-5, [0.0] * 7 + [float("-inf")], None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 7, "clash") for x in rows], VECTORS).repartition(5)
    assert sorted(map(tuple, codes.op12(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute(rows)


def test_exact_beyond_doubles():
    """Large components take the integer path, which tells distances apart that doubles don't."""
    x = np.array([[1 << 26, 3], [-(1 << 26), 0]])
    book = np.array([[-(1 << 26), 1], [-(1 << 26), 2], [-(1 << 26), 3]])
    code, error = codes.nearest(x, book)
    assert code.tolist() == [2, 0] and error.tolist() == [1 << 54, 1]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1, 0, ""), (2, [], 1, 0, ""), (3, [1.0, 2.0, 3.0, 0.0, 0.0], None, 0, ""), (4, [3e38, -3e38], None, 0, "")]
    got = {r["vec_id"]: r for r in codes.op12(spark.createDataFrame(rows, VECTORS)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(r["error"] == 0 for r in got.values()) and got[1]["code"] == got[3]["code"]
    assert [r["code"] for r in codes.op12(spark.createDataFrame([(1, [], 1, 0, "")], VECTORS)).collect()] == ["00000000"]
    assert codes.op12(spark.createDataFrame([(1, None, 1, 0, "")], VECTORS)).count() == 0
