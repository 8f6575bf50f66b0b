from pyspark.sql import functions as F

from cinequarry.operators import packing
from cinequarry.plans import curation
from cinequarry.plans import packing as plans
from conftest import SF


def test_runs_against_positions(spark):
    """Odd sizes: none, negative ones, nulls, and a bin that is longer than its width."""
    rows = [(1, 0, 3), (1, 1, 0), (1, 2, 5), (2, 0, -1), (2, 1, -9), (3, 0, None), (4, 0, 70), (5, 0, 2), (5, 1, None)]
    bins = spark.createDataFrame(rows, "bin long, slot long, seq_len long")
    want = []
    for b in {r[0] for r in rows}:
        own, x_off, used = [r for r in rows if r[0] == b], 0, None
        for _, slot, size in own:
            if size is not None:
                x_off += size
                at, n = x_off - size + slot * 4, max(0, size + 4)
                want += [(b, at + i, slot, (x_off - size + i) if i < size else slot * 4 + i - size, i >= size) for i in range(n)]
                used = max(at + size + 4, used or 0)
        want += [(b, at, own[-1][1] + 1, None, False) for at in range(used, 40)] if used is not None else []
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, packing.bin_tokens(bins, 40, 4).collect()), key=key) == sorted(want, key=key)


def test_runs_are_few(spark, monkeypatch):
    """Three runs a slot at most instead of 600 positions a bin, in tasks of a bounded size."""
    monkeypatch.setattr(plans, "PART_LINES", 1000)
    bins = plans.bins(spark, SF)
    lines = bins.count()
    assert bins.rdd.getNumPartitions() == -(-lines // 1000)
    assert packing.bin_runs(bins, 600, 4).count() <= 3 * lines
    assert "Generate explode(sequence" not in plans.q41_segment_expand(spark, SF)._jdf.queryExecution().toString()
    assert plans.q41_segment_expand(spark, SF).agg(F.min("positions")).first()[0] == 600


def test_schedule_by_windows(spark, tmp_path, monkeypatch):
    """Windows aren't multiplied by their slots, and repeated clips are one."""
    monkeypatch.setattr(curation, "PART_CLIPS", 2)
    rows = [(1, 700), (1, 1600), (2, 1600), (3, 10), (4, None), (5, 520), (None, 600)]
    docs = spark.createDataFrame([(i, "t", "en", "s", n) for i, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = curation.q08_frame_schedule(spark, str(tmp_path))
    want = set()
    for i, n in rows:
        for start in [5.0 * k for k in range(6) if n is not None and 5.0 * k + 5 <= n / 100 - 0.2]:
            frames = {round((start + s / 8) * 29.97) for s in range(41)}
            want.add((i, start, len(frames), min(frames), max(frames)))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
