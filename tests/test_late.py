import datetime

from tidemill.streaming import incremental as streams

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def rows_of(spark, batch):
    return spark.createDataFrame([(i, BASE + datetime.timedelta(minutes=m) if m is not None else None) for i, m in batch], "id long, ts timestamp")


def plain(batches, length, delay):
    """(published windows with their ids by batch, late ids by batch), a batch at a time."""
    mark, held, out, late = None, [], [], []
    for batch in batches:
        some = [(i, m) for i, m in batch if m is not None]
        end = lambda m: (m // length + 1) * length
        late.append(sorted(i for i, m in some if mark is not None and end(m) <= mark))
        held += [(i, m) for i, m in some if mark is None or end(m) > mark]
        after = max([x for x in (mark, max((m for _, m in some), default=None)) if x is not None], default=None) if mark is None else mark
        if some:
            after = max(m for _, m in some) - delay if mark is None else max(mark, max(m for _, m in some) - delay)
        closed = {}
        for i, m in held:
            if after is not None and end(m) <= after and (mark is None or end(m) > mark):
                closed.setdefault(end(m) - length, []).append(i)
        out.append(sorted((w, sorted(ids)) for w, ids in closed.items()))
        mark = after
    return out, late


def test_batches_and_repeats(spark, tmp_path):
    from pyspark.sql import functions as F

    batches = [[(1, 5), (2, 65), (3, 10)], [(4, 62), (5, 200), (6, 3), (12, None)], [(7, 64), (8, 190), (9, 130)], [], [(10, 500), (11, 199)]]
    want, want_late = plain(batches, 60, 30)
    windows = streams.LateAwareWindows(spark, str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state"), "ts", "1 hour", delay="30 minutes", ids=F.sort_array(F.collect_list("id")))
    for n, batch in enumerate(batches):
        windows(rows_of(spark, batch), n)
        windows(rows_of(spark, batch), n)  # again, as after a crash
        found = sorted((int((r["window_start"].replace(tzinfo=datetime.UTC) - BASE).total_seconds() // 60), r["ids"]) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect())
        assert found == want[n], n
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "late" / f"batch={n}")).collect()) == want_late[n]
    assert any(want_late) and sum(map(bool, want)) >= 2
    assert len(list((tmp_path / "state" / "rows").iterdir())) < len(batches)  # rows of ended windows go
