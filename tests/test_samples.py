"""The layout of sample files, and merges of recorded streams."""

import pyarrow.parquet as pq
import pytest

from tidemark.operators import events
from tidemark.operators.scan import Even
from tidemark.sources import market


def test_sample_files_have_required_columns_and_bounded_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(market, "GROUP_ROWS", 1_000)
    rows = spark.range(0, 5_000, 1, 2).selectExpr("id as ts_us", "if(id % 10 = 0, null, cast(id as double)) as `a::out`", "if(id = 3, double('nan'), 1.0D) as target", "2 as target_future")
    config = market.SampleConfig(["a::out"], "a::out", "s::out", 5)
    market.write_samples(rows, config, str(tmp_path / "samples"))
    files = [pq.ParquetFile(p) for p in (tmp_path / "samples").glob("*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 4_499
    for f in files:
        assert all(f.metadata.row_group(k).num_rows <= 1_000 for k in range(f.metadata.num_row_groups))
        assert f.schema_arrow.names == ["a::out", "target", "target_future", "time"]
        assert [f.schema.column(k).max_definition_level for k in range(4)] == [0] * 4  # required
    got = market.read_samples(spark, str(tmp_path / "samples"), config, skip=10).collect()
    assert len(got) == 4_489 and [r["n"] for r in sorted(got, key=lambda r: r["time"])] == list(range(4_489))


@pytest.mark.parametrize("blocks", [4096, Even(2)])
@pytest.mark.parametrize("streams, want", [
    ([[(1, 2), (2, 3)]], [(1, 2), (2, 3)]),
    ([[(2, 3), (1, 2)]], [(2, 3), (1, 2)]),
    ([[(1, 2), (2, 3)], [(0, 2), (4, 3)]], [(0, 2), (1, 2), (2, 3), (4, 3)]),
    ([[(1, 2), (2, 3)], [(4, 2), (0, 3)]], [(1, 2), (2, 3), (4, 2), (0, 3)]),
    ([[(1, 2), (2, 3), (5, 6)], [(0, 2), (4, 3)]], [(0, 2), (1, 2), (2, 3), (4, 3), (5, 6)]),
    ([[(1, 2), (2, 3)], [(0, 1), (4, 2), (0, 3)]], [(0, 1), (1, 2), (2, 3), (4, 2), (0, 3)]),
    ([[(5, 0)], [(3, 1), (7, 1)], [(4, 2)], []], [(3, 1), (4, 2), (5, 0), (7, 1)]),
])
def test_streams_are_merged_by_time_and_keep_their_order(spark, streams, want, blocks):
    frames = [spark.createDataFrame([(k, *row) for k, row in enumerate(s)], "seq long, ts_us long, tag int") for s in streams]
    merged = events.collate(frames, [], block_us=blocks).orderBy(*events.ORDER).collect()
    assert [(r["ts_us"], r["tag"]) for r in merged] == want
