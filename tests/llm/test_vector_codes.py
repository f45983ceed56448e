"""Product codes against plain Lloyd over all distances."""

import hashlib
from math import floor

import numpy as np
import pytest

from lodestone.llm import vector_codes
from lodestone.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def plainly(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error) of rows with vectors of one length, and the codebooks, with Python's integers."""
    kept = [(i, [floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = vector_codes.edges(len(kept[0][1]), parts)
    books = [[v[i:j] for _, v in kept[:entries]] for i, j in cuts]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [[min((square(v[i:j], c), e) for e, c in enumerate(book)) for _, v in kept] for (i, j), book in zip(cuts, books)]
        if turn == rounds:
            break
        for (i, j), book, mine in zip(cuts, books, near):
            for e in range(len(book)):
                members = [v[i:j] for (_, v), (_, m) in zip(kept, mine) if m == e]
                if members:
                    book[e] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, bytes(near[p][k][1] for p in range(parts)), sum(near[p][k][0] for p in range(parts))) for k, (i, _) in enumerate(kept)]
    return sorted(found, key=repr), [x for b in books for c in b for x in c]


def rows_of(seed, n, length, spread, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-spread, spread + 1, length) / 1024 + rng.choice([0, 0.25 / 1024], length)], int(rng.integers(3))) for i in rng.permutation(n)]
    return rows + [(n + k, rows[k % 5][1], None) for k in range(copies)]


@pytest.mark.parametrize(
    ("n", "length", "spread", "entries", "copies"),
    [(300, 8, 2, 40, 30), (200, 8, 300, 64, 0), (150, 6, 50, 256, 20), (60, 3, 5, 16, 0), (40, 4, 100_000_000, 12, 3), (30, 8, 1, 256, 200), (5, 8, 9, 256, 0), (1, 4, 3, 256, 0)],
)
def test_plain_lloyd(spark, n, length, spread, entries, copies):
    """Ties, copies, odd lengths, few and large numbers."""
    rows = rows_of(n, n, length, spread, copies)
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)
    want, books = plainly(rows, entries=entries)
    assert sorted(((r["vec_id"], bytes(r["code"]), r["error"]) for r in got.codes.collect()), key=repr) == want
    assert [x for b in got.codebooks for x in b.ravel().tolist()] == books
    assert got.fingerprint() == hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    approx = {r["vec_id"]: r["approx"] for r in vector_codes.decoded(got.codes, got.codebooks).collect()}
    assert all(len(a) == length for a in approx.values())


def test_groups_are_left_out():
    """On clustered vectors most distances are never taken after the first round."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (256, 16))
    x = (centres[rng.integers(256, size=5000)] + rng.integers(-20, 20, (5000, 16))).astype(np.int64)
    book = centres + rng.integers(-5, 5, centres.shape)
    part = vector_codes.Part(book, vector_codes.groups_of(book))
    mine, upper, lower = part.first(x)
    new = np.array([x[mine == e].mean(0).astype(np.int64) if (mine == e).any() else book[e] for e in range(256)])
    again = vector_codes.Part(new, part.groups, book)
    got, _, _, work = again.again(x, mine, upper, lower)
    assert (got == vector_codes.squares(x, new).argmin(1)).all()
    assert work < 0.1 * len(x) * 256


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = rows_of(3, 40, 8, 50)
    odd = [(100, None, 1), (101, [nan] * 8, 1), (102, [0.0] * 7 + [inf], 1), (103, [0.0] * 7 + [None], 2), (104, [1.0] * 4, 2), (None, [0.5] * 8, None), (None, [0.25] * 8, None), (7, [0.5] * 8, 0), (105, [3e38] * 8, 0), (106, [], 1)]
    frame = spark.createDataFrame(good + odd, SCHEMA)
    found = vector_codes.compress(frame, entries=30)
    got = vector_codes.digest(found, Scratch(spark, "t")).collect()
    assert len(got) == 40 + 6 and {r["vec_id"] for r in got} >= {104, 105, 106, None}
    rows = {r["vec_id"]: r for r in got}
    assert rows[104]["code"] is None and rows[106]["error"] is None and len(rows[105]["code"]) == 8
    want, books = plainly([*good, (None, [0.5] * 8, None), (None, [0.25] * 8, None), (7, [0.5] * 8, 0), (105, [vector_codes.span(8) / 1024] * 8, 0)], entries=30)
    label = {i: b for i, _, b in good} | {104: 2, 105: 0, 106: 1, None: None}
    for r in got:
        if r["vec_id"] != 7:  # two labels
            same = [x["error"] or 0 for x in got if x["vec_id"] != 7 and label[x["vec_id"]] == label[r["vec_id"]]]
            more = [x["error"] for x in got if x["vec_id"] == 7 and label[r["vec_id"]] in (label[7], 0)]
            assert r["label_error"] - sum(same) in (0, *more, sum(more))
    assert len({r["codebooks_sha256"] for r in got}) == 1
    assert sorted((r["code"], r["error"]) for r in got if r["vec_id"] is None) == sorted((c.hex(), e) for i, c, e in want if i is None)
    clash = frame.selectExpr("*", "1 AS code", "2 AS x", "3 AS v", "4 AS n", "5 AS error", "6 AS upper")
    assert sorted(map(repr, vector_codes.digest(vector_codes.compress(clash, entries=30), Scratch(spark, "t")).collect())) == sorted(map(repr, got))
    assert vector_codes.digest(vector_codes.compress(frame.limit(0)), Scratch(spark, "t")).collect() == []
    none = vector_codes.digest(vector_codes.compress(frame.where("vec_id in (100, 101)")), Scratch(spark, "t"))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
