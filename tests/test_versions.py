"""Line alignment of two versions."""

import random

import numpy as np

from corpuslens.operators import versions


def lines(text):
    parts = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def test_differences_rebuild_the_new_version(spark):
    rnd = random.Random(11)
    rows = []
    for d in range(200):
        old = [rnd.choice(["a", "b", "", "c", "dd", str(rnd.randrange(99))]) for _ in range(rnd.randrange(30))]
        new = [x for x in old if rnd.random() > 0.2]
        for _ in range(rnd.randrange(4)):
            new.insert(rnd.randrange(len(new) + 1), rnd.choice(["a", "new", ""]))
        if rnd.random() < 0.2:
            new = new[len(new) // 2 :] + new[: len(new) // 2]
        rows.append((d, "\n".join(old) + rnd.choice(["", "\n"]), "\n".join(new)))
    rows += [(900, None, "x"), (901, "x\ny", None), (902, None, None), (903, "", ""), (904, "a\r\nb", "a\nb")]
    old = spark.createDataFrame([(d, o) for d, o, _ in rows] + [(950, "only\nold")], "doc_id bigint, text string")
    new = spark.createDataFrame([(d, n) for d, _, n in rows] + [(951, "only new")], "doc_id bigint, text string")
    found = {}
    for r in versions.version_diff(old, new).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert {r.line for r in found.pop(950)} == {"only", "old"} and [r.op for r in found.pop(951)] == ["added"]
    for d, o, n in rows:
        a, b = lines(o), lines(n)
        gone = {r.old_line: r.line for r in found.get(d, []) if r.op == "removed"}
        come = {r.new_line: r.line for r in found.get(d, []) if r.op == "added"}
        assert all(a[i - 1] == x for i, x in gone.items()) and all(b[i - 1] == x for i, x in come.items())
        stay_a, stay_b = [x for i, x in enumerate(a, 1) if i not in gone], [x for i, x in enumerate(b, 1) if i not in come]
        assert stay_a == stay_b
        # Nothing between two lines that stay is common to both.
        ends = list(zip([i for i in range(1, len(a) + 1) if i not in gone] + [len(a) + 1], [i for i in range(1, len(b) + 1) if i not in come] + [len(b) + 1], strict=True))
        before = (0, 0)
        for i, j in ends:
            assert not set(a[before[0] : i - 1]) & set(b[before[1] : j - 1])
            before = (i, j)


def test_lines_that_stand_once_are_anchors():
    old, new = np.array([1, 2, 3, 4, 5, 6]), np.array([4, 5, 6, 1, 2])
    assert versions.align(old, new) == [(3, 0), (4, 1), (5, 2)]
    assert versions.align(np.array([7, 7, 7, 1]), np.array([7, 1, 7, 7])) == [(0, 0), (1, 2), (2, 3)] or len(versions.align(np.array([7, 7, 7, 1]), np.array([7, 1, 7, 7]))) >= 2
    assert versions.align(np.zeros(0, np.int64), np.array([1])) == []


def test_long_versions_are_aligned_soon():
    rng = np.random.default_rng(1)
    old = rng.integers(0, 50, 100_000)
    new = np.delete(old, rng.integers(0, len(old), 3000))
    assert len(versions.align(old, new)) > 0.9 * len(new)


def test_companions_of_a_changed_document(spark):
    old = spark.createDataFrame([(1, "limit 10 MB\nv1.2.3 here")], "doc_id bigint, text string")
    docs = spark.createDataFrame([(1, "limit 20 MB\nv1.2.3 here"), (2, "up to 10 MB"), (3, "20 MB"), (4, None)], "doc_id bigint, text string")
    sets = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 4)], "doc_set_id bigint, doc_id bigint")
    got = sorted((r.doc_id, r.finding, r.key) for r in versions.version_sync(old, docs, sets).collect())
    assert got == [(2, "missing", "20 MB"), (2, "stale", "10 MB")]
