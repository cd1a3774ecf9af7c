import time

import numpy as np
import pyarrow as pa
import pytest

from geolith.llm import pitman_yor as py


def exact(c, base, rest, theta, d):
    """Mean and variance of the table count, by the recursion over all customers."""
    t = np.arange(1, c + 1)
    s = np.full(c, -np.inf)
    s[0] = 0.0
    for n in range(1, c):
        stay = np.where(t <= n, np.log(np.maximum(n - d * t, 1e-300)), -np.inf)
        s = np.logaddexp(np.concatenate(([-np.inf], s[:-1])), s + stay)
    s = s + np.cumsum(np.log((theta + d * (rest + t - 1)) * base))
    p = np.exp(s - s.max())
    p /= p.sum()
    mean = (p * t).sum()
    return mean, (p * t * t).sum() - mean**2


@pytest.mark.parametrize("c, base, tables", [(2, 0.3, 5), (40, 0.05, 60), (300, 0.02, 400), (3000, 0.01, 5000), (3000, 1e-4, 50), (2000, 0.6, 900)])
def test_a_sweep_reseats_every_customer(c, base, tables):
    """One sweep gives the table count its own distribution, whatever the customers; the mean is that of brute force."""
    n, theta, d = 1000, 1.0, 0.7
    # the pair holds one of the recorded tables
    at = py.Totals(np.full(2, base), np.full(1, c), np.full(1, tables + 1))
    got = py.part_tables(0, np.zeros(n, np.uint32), np.full(n, c), [at], theta, d, 1)[0]
    mean, var = exact(c, base, tables, theta, d)
    assert abs(got.mean() - mean) < 5 * np.sqrt(var / n) + 1e-9
    assert abs(got.var() - var) < 0.2 * var + 0.05


def test_hot_pairs_keep_no_start():
    """Two sweeps of a hot pair are as far apart as two draws; single moves would leave it where it was."""
    n, c = 400, 100_000
    at = py.Totals(np.full(2, 0.02), np.full(1, c), np.full(1, 20_001))
    a, b = py.part_tables(0, np.zeros(n, np.uint32), np.full(n, c), [at, at], 1.0, 0.7, 2)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.3


@pytest.mark.parametrize("c, base, tables, d", [(300, 0.02, 1_000_000, 0.7), (1000, 0.05, 300_000, 0.95), (500, 1 / 65_000, 600_000, 0.42), (3000, 0.1, 10_000, 0.1), (2000, 0.6, 900, 0.7)])
def test_crowded_pairs_have_their_distribution(c, base, tables, d):
    """Also where nearly every customer has a table of its own."""
    n = 20_000
    got = py._crowded(np.full(n, float(c)), np.full(n, 1 / d + tables), np.full(n, base), d, np.random.default_rng(4))
    mean, var = exact(c, base, tables, 1.0, d)
    assert got.min() >= 1 and got.max() <= c
    assert abs(got.mean() - mean) < 0.05 * np.sqrt(var) and abs(got.var() - var) < 0.05 * var


def test_crowded_draws_are_cheap():
    """The parent's draws run on the driver alone, some 80,000 in each sweep: no search at every point of a density."""
    n, rng = 2000, np.random.default_rng(4)
    c, x = rng.integers(300, 60_000, n).astype(float), rng.random((n, py.POINTS))

    def seconds(work):
        best = []
        for _ in range(3):
            start = time.process_time()
            work()
            best.append(time.process_time() - start)
        return min(best)

    draws = seconds(lambda: py._crowded(c, np.full(n, 2e6), np.full(n, 1 / 65_000), 0.4, rng))
    assert draws < 350 * seconds(lambda: np.exp(x))


def test_texts_are_read_twice(spark):
    """Once for the counts of words, and once for their numbers, which pairs are dealt from."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(k, f"the {k % 7} of the {k % 3}") for k in range(60)] + [(None, None), (7, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert py.score_documents(docs).count() == len(rows)
    assert read.value == 2 * len(rows)


def test_large_rows_are_taken_one_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"part": k, "pairs": b"x" * k} for k in range(3)])
    assert list(py._packed(batch)) == batch.to_pylist() and list(py._packed(pa.Table.from_batches([batch, batch]))) == 2 * batch.to_pylist()
