import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from raresift.llm import ballcodes as B
from raresift.llm.vectors import packed, unpacked, whole_numbers


def brute(rows, parts=B.PARTS, entries=B.ENTRIES, rounds=B.ROUNDS):
    """(id, code, error, label_error), digest by plain Python."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                row.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v, _), row in zip(kept, got) if row[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    per_label = {}
    for (_, _, lab), row in zip(kept, got):
        per_label[lab] = per_label.get(lab, 0) + sum(d for d, _ in row)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    told = [(-1 if i is None else i, "".join(f"{j:02x}" for _, j in row), sum(d for d, _ in row), per_label[lab], digest) for (i, _, lab), row in zip(kept, got)]
    return sorted(told)


def told(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))


def vectors(n=300, d=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, d))
    rows = [(i, (centres[i % 20] + rng.normal(size=d) * 0.1).tolist(), i % 3) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]  # a hot vector
    rows += [(2000, None, 1), (2001, [float("nan")] * d, 1), (2002, [None] + [1.0] * (d - 1), 2), (2003, [float("inf")] * d, 0)]
    rows += [(2004, [], None), (2005, [1.0, -2.0, 3.5], None), (2006, [0.0] * d, None), (5, rows[9][1], 2), (None, rows[3][1], None)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, x string, home string, first int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(parts)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def test_codes_equal_brute_force(spark):
    rows = vectors()
    assert told(B.coded_with_totals(frame(spark, rows))) == brute(as_float(rows))


def test_homes_written_anew_every_round(spark, monkeypatch):
    monkeypatch.setattr(B, "DRIFT", 0.0)
    rows = vectors(120)
    assert told(B.coded_with_totals(frame(spark, rows, 3))) == brute(as_float(rows))


@pytest.mark.parametrize("rows", [[], [(7, None, 1)], [(7, [0.5, -0.25], None), (8, [0.5, 0.25], 3)]])
def test_few_rows(spark, rows):
    assert told(B.coded_with_totals(frame(spark, rows, 2))) == brute(rows)


def test_partitions_do_not_matter(spark):
    rows = vectors(90)
    one = told(B.coded_with_totals(frame(spark, rows, 1)))
    assert one == told(B.coded_with_totals(frame(spark, rows, 7)))


def test_balls_are_exact_with_ties_and_save_distances():
    rng = np.random.default_rng(5)
    entries = rng.integers(-2, 3, (12, 3)) * 2
    x = rng.integers(-6, 7, (4000, 3))  # a grid full of ties, entries repeat
    want = B.nearest(x, entries)
    for home in (want[0], rng.integers(0, 12, 4000)):
        best, dist, _ = B.nearest_by_balls(x, entries, home, B.gaps(entries))
        assert (best == want[0]).all() and (dist == want[1]).all()
    far = rng.integers(-1000, 1000, (12, 3)) * 100
    near = far[rng.integers(0, 12, 5000)] + rng.integers(-30, 30, (5000, 3))
    home, _ = B.nearest(near, far)
    assert B.nearest_by_balls(near, far, home, B.gaps(far))[2] < 1.2 * len(near)  # stable cores


def test_whole_numbers_round_down_and_pad():
    col = pa.array([[0.5, -0.001], None, [1e300], [], [float("nan")], [None]], pa.list_(pa.float64()))
    whole, x = whole_numbers(col.slice(0), 4096, 1 << 24)
    assert whole.tolist() == [True, False, True, True, False, False]
    assert x.tolist() == [[2048, -5], [1 << 24, 0], [0, 0]]
    assert (unpacked(packed(x), 3, 2) == x).all() and (unpacked(packed(x[:1]), 1, 2) == x[:1]).all()
    whole, x = whole_numbers(col.slice(1, 3), 4096, 1 << 24)
    assert whole.tolist() == [False, True, True] and x.tolist() == [[1 << 24], [0]]
