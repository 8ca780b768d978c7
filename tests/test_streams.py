"""Stateful streams over several micro-batches against a plain walk over the events."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.streaming import logs

SCHEMA = "key string, id long, ts timestamp, opens boolean, episode string"  # a column named as the result's
START = datetime(2024, 1, 1)


def batches(path, *parts):
    """Each part a file, read in this order; events are (key, minutes or None, opens), numbered as they come."""
    n, rows = 0, []
    for i, part in enumerate(parts):
        lines = []
        for key, minute, opens in part:
            ts = None if minute is None else START + timedelta(minutes=minute)
            lines.append(json.dumps({"key": key, "id": n, "ts": ts and str(ts), "opens": opens, "episode": "x"}))
            rows.append((key, minute, opens, n, i))
            n += 1
        (path / f"{i}.json").write_text("\n".join(lines) + "\n")
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return rows


def streamed(spark, path, **named):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))
    rows = logs.streamed_episodes(stream, "key", "ts", F.col("opens"), "1 hour", tie="id", **named)
    return sorted(((r["key"] or "", r["id"], r["episode"]) for r in logs.drained(spark, rows, "episodes", rocksdb=True).collect()))


def walked(rows, keep=None):
    out = {}
    for key in {r[0] for r in rows}:
        openers, last = 0, None
        for _, minute, opens, n, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            if keep and last is not None and minute - last >= keep:
                openers = 0
            openers, last = openers + bool(opens), minute
            out[(key or "", n)] = max(openers, 1)
    return sorted((k, n, e) for (k, n), e in out.items())


PARTS = (
    [("a", m, m % 20 == 5) for m in range(0, 60, 5)] + [("b", 7, None), (None, 9, True), (None, 9, False), (None, 8, False), ("a", None, True)],
    [("a", m, m % 3 == 0) for m in range(299, 240, -7)] + [("a", 55, True), ("b", 250, True), ("b", 250, True), ("b", 250, False)],
    [("a", 300, True), ("a", 290, True), ("a", 480, False), ("c", 481, False), (None, 470, True)],
    [("a", 30, True), ("c", 490, True), ("a", 700, True), ("b", 702, True)],  # the first one is late beyond doubt
    [("z", 5000, True)],
    [("z", 9000, True)],
)


@pytest.mark.parametrize("keep", [None, 180])
def test_episodes_over_micro_batches(spark, tmp_path, keep):
    rows = batches(tmp_path, *PARTS)
    known = [r for r in rows if r[1] is not None and r[0] != "z" and not (r[1] == 30 and r[4] == 3)]
    got = streamed(spark, tmp_path, slot_ms=600_000, keep_ms=keep and keep * 60_000)
    assert [r for r in got if r[0] != "z"] == walked(known, keep)


def test_slots_do_not_change_the_episodes(spark, tmp_path):
    batches(tmp_path, *PARTS)
    assert [r for r in streamed(spark, tmp_path, slot_ms=1) if r[0] != "z"] == [r for r in streamed(spark, tmp_path, slot_ms=7_200_000) if r[0] != "z"]


def test_a_stream_without_rows_has_no_episodes(spark, tmp_path):
    (tmp_path / "0.json").write_text("")
    assert streamed(spark, tmp_path) == []


def test_the_state_store_is_set_for_one_stream_alone(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    batches(tmp_path, [("a", 1, True)])
    streamed(spark, tmp_path)
    assert spark.conf.get(provider) == before


def test_tables_of_one_file_or_a_folder_are_read_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 5 else f"10.1.2.{i} a@b.io") for i in range(20)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows.toPandas().to_parquet(tmp_path / "one.parquet")
    for name in ("documents.parquet", "one.parquet"):
        got = logs.drained(spark, logs.screened(logs.parquet_stream(spark, str(tmp_path), name)).select("doc_id", F.size("hits").alias("n"), "score", "blocked"), "whole").collect()
        assert sorted(map(tuple, got)) == [(i, *((0, 0.0, False) if i == 5 else (2, 0.61, True))) for i in range(20)]


class Held:
    """State of one key in memory; counts the values that are written."""

    def __init__(self):
        self.values, self.written = [], 0

    def get(self):
        return iter(self.values)

    def appendValue(self, value):  # noqa: N802
        self.values.append(value)
        self.written += 1

    def appendList(self, values):  # noqa: N802
        for v in values:
            self.appendValue(v)

    def put(self, values):
        self.values = []
        self.appendList(values)

    def clear(self):
        self.values = []


def test_a_key_costs_a_few_values_of_state_however_many_its_events():
    import pandas as pd

    processor, waiting, timers, seen = logs.Episodes(3_600_000, None), Held(), [], Held()
    seen.get, seen.update = (lambda: seen.values[-1] if seen.values else None), seen.appendValue
    handle = type("Handle", (), {"registerTimer": lambda _, at: timers.append(at), "getValueState": lambda *_: seen, "getListState": lambda *_: waiting})()
    processor.init(handle)
    times = type("Times", (), {"getCurrentWatermarkInMs": lambda _: 3 * 3_600_000})()
    rows = pd.DataFrame({"at": [i * 9_000_000 for i in range(2_000)][::-1], "tie": range(2_000), "opens": [i % 10 == 0 for i in range(2_000)][::-1]})
    rows["flags"] = rows["opens"] + 2
    assert list(processor.handleInputRows(("a",), iter([rows[:1_500], rows[1_500:]]), times)) == []
    got = pd.concat(processor.handleExpiredTimer(("a",), times, None))
    assert got["at"].tolist() == sorted(a for a in rows["at"] if a < 3 * 3_600_000_000)
    assert got["episode"].tolist() == [i // 10 + 1 for i in range(len(got))] and set(got["key"]) == {"a"}
    assert waiting.written == 3 and seen.written == 1 and timers == [3_600_000, 4 * 3_600_000]  # two frames and what waits on


def test_whole_numbers_as_keys_and_null_ties(spark, tmp_path):
    big = 2**53 + 1
    rows = [(big, None, 1, True), (big, 3, 1, False), (big, 5, 2, True), (big, None, 2, False), (None, 7, 1, True), (None, 8, 2, True), (0, 9, 600, False)]
    spark.createDataFrame([(k, t, START + timedelta(minutes=m), o) for k, t, m, o in rows], "key long, id long, ts timestamp, opens boolean").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, id long, ts timestamp, opens boolean").json(f"{tmp_path}/in")
    got = logs.drained(spark, logs.streamed_episodes(stream, "key", "ts", F.col("opens"), "1 hour", tie="id"), "odd", rocksdb=True).collect()
    found = {(r["key"], r["id"], r["ts"].minute): r["episode"] for r in got}
    assert len(got) == 6 and found == {(big, None, 1): 1, (big, 3, 1): 1, (big, None, 2): 1, (big, 5, 2): 2, (None, 7, 1): 1, (None, 8, 2): 2}
