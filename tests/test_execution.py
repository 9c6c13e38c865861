import threading
import time

import pytest

from gridloom.operators import execution as E


def test_results_keep_their_order(spark):
    tasks = E.Tasks(spark)
    for n in (2, 3, 5, 7):
        tasks.add(lambda n=n: n * n)
    assert tasks.on_idle() == [4, 9, 25, 49] and tasks.on_idle() == [] and tasks.run([]) == []
    heard = []
    assert tasks.run([lambda n=n: n * n for n in range(1, 21)], lambda a, b: heard.append((a, b))) == [n * n for n in range(1, 21)]
    assert heard[-1] == (20, 20) and heard == sorted(heard)


def test_a_failing_task_fails_the_run(spark):
    def fail():
        raise ValueError("intentional failure")

    with pytest.raises(Exception, match="intentional failure"):
        E.Tasks(spark).run([fail, lambda: 1])
    assert E.Tasks(spark).run([lambda: 1]) == [1]


def test_cancel(spark):
    tasks = E.Tasks(spark)
    threading.Timer(1.5, lambda: tasks.cancel("stop-me")).start()
    with pytest.raises(E.Canceled, match="Remaining tasks canceled"):
        tasks.run([lambda: time.sleep(20)] * 4, tag="stop-me")


def test_a_pool_runs_no_more_than_its_workers(spark, tmp_path):
    def mark(n):
        at = tmp_path / f"run-{n}"
        at.touch()
        time.sleep(0.3)
        seen = len(list(tmp_path.glob("run-*")))
        at.unlink()
        return n, seen

    pool, heard = E.Tasks(spark, workers=2), []
    found = pool.run([lambda n=n: mark(n) for n in range(6)], lambda a, b: heard.append((a, b)))
    assert [n for n, _ in found] == list(range(6)) and max(seen for _, seen in found) <= 2
    assert heard == [(n, 6) for n in range(1, 7)]
    with pytest.raises(Exception, match="intentional failure"):
        pool.run([lambda: (_ for _ in ()).throw(ValueError("intentional failure")), lambda: 1])
    threading.Timer(0.15, lambda: pool.cancel("mine")).start()
    with pytest.raises(E.Canceled, match="Remaining tasks canceled"):
        pool.run([lambda: time.sleep(1)] * 4, tag="mine")
    assert pool.run([lambda: 1]) == [1]
    with pytest.raises(ValueError):
        E.Tasks(spark, workers=0)


def test_statistics(spark):
    df = spark.createDataFrame([("read", "plain", 4.0), ("read", "plain", 8.0), ("read", "pooled", 3.0), ("read", "pooled", 1.0)], "operation string, variant string, ms double")
    stats = E.timing_stats(df, "operation", "variant")
    row = stats.where("variant = 'plain'").first()
    assert (row["mean"], row["median"], row["min"], row["max"], row["stddev"]) == (6, 6, 4, 8, 2)
    assert {r.variant: r.speedup for r in E.speedups(stats, "plain").collect()} == {"plain": 1.0, "pooled": 3.0}
    assert len(E.timed(lambda: None, 1, 3)) == 3


def test_registry_needs_no_training_data_operators():
    import __spark_entry__ as entry

    assert {"read_full_1d", "write_block"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
