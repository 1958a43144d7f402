"""Streaming: append mode emits only closed windows, with final counts."""

from scrubline.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def test_append_windows_are_final(spark):
    complete = {tuple(r) for r in ST.rules_per_window(spark, SF, mode="complete").collect()}
    append = {tuple(r) for r in ST.rules_per_window(spark, SF, mode="append").collect()}
    assert append and append <= complete
    # the newest windows (within the 1-day delay of the last event) stay open
    assert len(complete) - 2 <= len(append) < len(complete)


def test_stream_dedup_is_distinct(spark):
    rows = ST.dedup_keys(spark, SF).collect()
    assert len(rows) == len({tuple(r) for r in rows})


def test_batch_only_operators_refuse_streams(spark):
    import pytest
    from scrubline.functions.exprs import BatchOnly
    from scrubline.operators import clean as C
    from scrubline.operators import dedup as D
    from scrubline.operators import fill as W
    from scrubline.operators import stats as S
    ev = ST.events_stream(spark, SF)
    with pytest.raises(BatchOnly):
        D.deduplicate(ev, ["user_id"], "first", order_by="event_id")
    with pytest.raises(BatchOnly):
        W.forward_fill(ev, ["value"], order_by="event_id")
    with pytest.raises(BatchOnly):
        S.impute_missing(ev, ["value"], "median")
    # row-local cleaners and constants are fine on a stream
    assert C.abs_negative(ev, ["value"]).isStreaming
    assert S.impute_missing(ev, ["value"], "constant", value=0.0).isStreaming


def test_dedup_within_watermark_drops_repeats(spark):
    from scrubline.streaming.stream import _run, dedup_within_watermark, events_stream
    ev = events_stream(spark, SF)
    out = _run(dedup_within_watermark(ev, ["event_id"]).select("event_id"), spark, "dedup-ww")
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert out.count() == total  # event_id is unique: nothing dropped, nothing added
