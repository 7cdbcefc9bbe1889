import contextlib
import math
import os
import threading

import numpy as np
from llm_cases import classes, with_clashes

from evalspark.llm import embeddings
from evalspark.session import ensure_checkpoint_dir

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, t):
    one = {}
    for i, e, y in rows:
        one.setdefault(i, (e, y))
    ok = {i: np.array(e, float) for i, (e, y) in one.items()
          if i is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}

    def linked(a, b):
        if a == b or a not in ok or b not in ok or one[a][1] != one[b][1] or len(ok[a]) != len(ok[b]):
            return False
        return float(ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b]))) >= t

    ids = [i for i in one if i is not None]
    root = classes(ids, linked)
    return {i: (sum(linked(i, j) for j in ids), root[i], root[i] == i) for i in ids}


def cases(seed=0, dim=8):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for centre in range(6):
        c = rng.normal(size=dim)
        for _ in range(25):
            rows.append((n, [float(np.float32(x)) for x in c + rng.normal(size=dim) * 0.09], centre % 2))
            n += 1
    copy = rows[3][1]
    rows += [(1000 + i, copy, rows[3][2]) for i in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * dim, 0), (2003, [None] + copy[1:], 0), (2004, [float("nan")] + copy[1:], 0),
             (2005, [float("inf")] + copy[1:], 0), (2006, copy, None), (2007, copy[:4], rows[3][2]), (2008, [2 * x for x in copy], rows[3][2])]
    return rows


def test_links_components_and_kept_against_all_pairs(spark):
    rows = cases()
    want = brute(rows, 0.98)
    df = with_clashes(spark.createDataFrame([*rows, rows[0], (None, rows[3][1], 0)], KIND))
    for cell_rows, block_rows in ((20, 7), (10**6, 1024)):
        got = embeddings.near_duplicates(df, sample_rows=40, cell_rows=cell_rows, block_rows=block_rows).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want
        assert len(got) == len(want) + 1
        assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]


def test_cells_lose_no_link_at_low_thresholds(spark):
    rows = cases(3)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, KIND), threshold=0.7, sample_rows=30, cell_rows=8, block_rows=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows, 0.7)


def test_empty_tables(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None, 0)], KIND)).collect()[0].kept


def near_copies(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2:] = x[rng.integers(0, n // 2, n - n // 2)] * rng.uniform(0.5, 2, (n - n // 2, 1)) + rng.normal(size=(n - n // 2, dim)) * 0.12
    return [(i, [float(np.float32(z)) for z in row], i % 2) for i, row in enumerate(x)]


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(2)
    for dim in (1, 5, 23, 24, 64, 300):
        x = embeddings._unit(rng.normal(size=(60, dim)))
        for fitted in (x, x[:1], x[:0]):
            axes = embeddings.fit_axes(fitted)
            assert np.allclose(axes.T @ axes, np.eye(min(dim, 23)))
            s = embeddings.sketch(x, axes)
            assert np.allclose((s * s).sum(axis=1), 1)
            rough = (np.rint(s * embeddings.LEVELS) / embeddings.LEVELS).astype(np.float32)
            assert (rough @ rough.T >= x @ x.T - embeddings.SLACK).all()


def test_many_cells_and_blocks_of_long_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_ROWS", 9)
    monkeypatch.setattr(embeddings, "MOST_BYTES", 5 * 40 * 8)
    for threshold in (0.98, 0.3):
        rows = near_copies(5, 160, 40)
        got = embeddings.near_duplicates(spark.createDataFrame(rows, KIND), threshold, sample_rows=50, cell_rows=6, block_rows=5).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows, threshold)
        assert sum(r.n_links for r in got) > 60


def test_of_rows_with_the_same_id_the_smallest_counts(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 5), (3, [0.0, 1.0], 0), (3, [-1.0, 0.0], 0), (4, [-2.0, -0.0], 0),
            (5, [-3.0, 0.0], 0), (5, None, 0), (6, [1.0, 0.0], 0), (6, [1.0, 0.0, None], 0), (7, [1.0, 0.0], 0), (7, [1.0, 0.0], None),
            (8, [-2.0, 0.0], 0), (8, [-2.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [2.0, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (2, 1), 7: (0, 7), 8: (2, 3), None: (0, None)}


def test_disk_follows_the_vectors_not_their_pairs(spark):
    """Shuffle files and written tables take a few times the bytes of the vectors at most, whatever the cells and blocks."""
    shuffled = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    folders = [*shuffled, ensure_checkpoint_dir(spark).removeprefix("file:")]

    def files():
        found = {}
        for folder, _, names in (x for d in folders for x in os.walk(d)):
            for name in names:
                with contextlib.suppress(FileNotFoundError):  # Spark removes shuffle files when a job is over
                    found[f"{folder}/{name}"] = os.path.getsize(f"{folder}/{name}")
        return found

    x = np.random.default_rng(4).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], KIND)
    before, peak, over = files(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], sum(n for p, n in files().items() if p not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        rows = embeddings.near_duplicates(df, cell_rows=50, block_rows=100).collect()
    finally:
        over.set()
        watcher.join()
    assert len(rows) == 4000 and not any(r.n_links for r in rows)
    assert 0 < peak[0] < 8 * x.nbytes
