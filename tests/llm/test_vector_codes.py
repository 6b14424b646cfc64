import hashlib
import random

import numpy as np
import pytest

from tessera.errors import ParameterError
from tessera.llm import vector_codes
from tests.oracle import same


def brute(rows, parts, entries, rounds, scale):
    """rows (id, label, integers): the contract in plain Python integers."""
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(rows[0][2]) // parts
    cut = lambda v, p: tuple(v[p * d : (p + 1) * d])
    books = [[cut(v, p) for _, _, v in rows[:entries]] for p in range(parts)]
    assign = lambda p, s: min(range(len(books[p])), key=lambda e: (far(books[p][e], s), e))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, v in rows:
                of.setdefault(assign(p, cut(v, p)), []).append(cut(v, p))
            for e, members in of.items():
                books[p][e] = tuple(sum(c) // len(members) for c in zip(*members))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, label, v in rows:
        at = [assign(p, cut(v, p)) for p in range(parts)]
        error = sum(far(books[p][e], cut(v, p)) for p, e in enumerate(at))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for e in at), error))
    return sorted(((i, code, error, by_label[label], digest) for i, label, code, error in out), key=repr)


@pytest.mark.parametrize("large", [8, 30_000, 200_000_000])
def test_ball_tree_as_all_distances(large):
    rng = np.random.default_rng(large)
    entries = rng.integers(-large, large, (77, 5))
    entries[40:50] = entries[3]  # equal entries: the smallest index wins
    x = np.concatenate([rng.integers(-large, large, (400, 5)), entries, (entries[:30] + entries[1:31]) // 2])
    at, best = vector_codes.BallTree(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_as_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1, 2]), [rnd.randrange(-6, 7) for _ in range(8)]) for i in rnd.sample(range(-500, 500), 150)]
    rows += rows[:20] + [(None, 1, [0] * 8), (None, 2, [1] * 8), (7000, None, [2] * 8), (7000, None, [-2] * 8)]
    odd = [(1, 1, None), (2, 1, [None] + [0.5] * 7), (3, None, [float("nan")] * 8), (4, 2, [float("inf")] * 8)]
    data = [(i, n, None if v is None else [None if c is None else c / 4 for c in v], "x", 1.0) for i, n, v in rows] + [(*o, "x", 1.0) for o in odd]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>, id string, code double").repartition(5)
    got = vector_codes.compressed(df, "vec_id", "embedding", "label", 4, 16, 3, 4.0).collect()
    assert sorted(((r["id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr) == brute(rows, 4, 16, 3, 4.0)


def test_codes_of_unusual_tables(spark):
    schema = "vec_id long, label string, embedding array<float>"
    run = lambda rows: vector_codes.compressed(spark.createDataFrame(rows, schema), "vec_id", "embedding", "label").collect()
    assert run([]) == [] and run([(1, "a", None)]) == []
    got = {r["id"]: r for r in run([(1, "a", []), (2, "a", [1.0] * 4), (3, "b", [1.0] * 8), (4, "b", [2.0] * 4), (5, None, [1.0])])}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {1: (None, None), 2: ("00000000", 0), 3: (None, None), 4: ("01010101", 0), 5: (None, None)}
    assert got[4]["label_error"] == 0 and got[5]["label_error"] is None
    with pytest.raises(ParameterError):
        run([(1, "a", [3e30] * 4)])


def test_label_sums_without_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.3)
    df = spark.createDataFrame([(i, None if i % 2 else f"l{i % 7}", i) for i in range(200)], "id int, g string, x long")
    got = vector_codes.with_group_sum(df, "g", "x", "s", 200).collect()
    want = {}
    for r in df.collect():
        want[r["g"]] = want.get(r["g"], 0) + r["x"]
    assert len(got) == 200 and all(r["s"] == want[r["g"]] for r in got)


def test_codes_as_sql(spark, small):
    same(spark, small, vector_codes.op11_vector_codes, vector_codes.ORACLE)
