"""Streams over several batches: rescoring by the newest text, compaction, late rows, sessions."""

import datetime as dt
import os

import pytest

from termloom.operators import scores as S
from termloom.plans.match_jobs import evidence_of
from termloom.streaming import streams as ST

SCHEMA = "doc_id long, ts timestamp, version_id long, text string"
T0 = dt.datetime(2024, 5, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes a batch of rows as one file; files are read in the order of their times."""
    def write(no, rows, schema=SCHEMA):
        part = tmp_path / f"w{no}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        src = next(p for p in part.iterdir() if p.suffix == ".parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        to = tmp_path / "in" / f"f{no}.parquet"
        to.write_bytes(src.read_bytes())
        os.utime(to, (1_700_000_000 + no, 1_700_000_000 + no))

    write.path = str(tmp_path / "in")
    return write


def source(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder.path)


def scorer(spark):
    wanted = spark.createDataFrame([(1, "thti", 3), (1, "alpha beta", 2), (2, "gamma", 1), (2, "thti", 1)], "posting_id long, term string, w_job long")
    return lambda docs: S.weighted_coverage(wanted, evidence_of(spark, None, wanted.select("posting_id", "term"), docs.select("doc_id", "text")))


def rows(df):
    return {(r["posting_id"], r["doc_id"]): r["coverage"] for r in df.collect()}


def test_rescore_follows_the_newest_text(spark, folder, tmp_path):
    score, root = scorer(spark), str(tmp_path / "root")
    first = [(1, at(1), 1, "gamma and thti"), (2, at(1), 2, "nothing here"), (3, at(5), 3, "alpha with beta before"), (4, at(1), 9, "gamma")]
    second = [(1, at(2), 4, "beta then alpha"), (2, at(2), 5, "the thing"), (3, at(2), 6, "gamma gamma"),  # doc 3: late, stays out
              (4, at(3), 7, None)]  # doc 4 loses its text
    folder(0, first)
    folder(1, second)
    folder(2, first)  # redelivered as a whole
    got = rows(ST.stream_rescore(source(spark, folder), score, root))
    newest = spark.createDataFrame([(1, "beta then alpha"), (2, "the thing"), (3, "alpha with beta before"), (4, "")], "doc_id long, text string")
    assert got == rows(score(newest)) and got
    assert (2, 1) not in got and (2, 4) not in got  # terms of older versions are gone
    assert got[(1, 2)] == 60 and got[(1, 3)] == 40  # by synonym, by words in any order

    assert ST.compact(spark, root) == 2 and ST.compact(spark, root) == 2
    assert rows(ST.rescored(spark, root)) == got

    # resumed: only the new file is read; an old version does not come back, not even behind the base
    folder(3, [(4, at(2), 8, "gamma"), (5, at(0), 10, "thti"), (2, at(9), 11, "alpha beta")])
    again = rows(ST.stream_rescore(source(spark, folder), score, root))
    newest = spark.createDataFrame([(1, "beta then alpha"), (2, "alpha beta"), (3, "alpha with beta before"), (4, ""), (5, "thti")], "doc_id long, text string")
    assert again == rows(score(newest))
    assert ST.compact(spark, root) == 3 and rows(ST.rescored(spark, root)) == again


def test_a_replayed_batch_overwrites_itself(spark, folder, tmp_path):
    score, root = scorer(spark), str(tmp_path / "root")
    folder(0, [(1, at(1), 1, "gamma"), (2, at(1), 2, "thti")])
    got = rows(ST.stream_rescore(source(spark, folder), score, root))
    batch = spark.createDataFrame([(1, at(1), 1, "gamma"), (2, at(1), 2, "thti")], SCHEMA)
    for mode in ("overwrite", "append"):  # the same id again, or a copy of its rows
        ST.scored_batch(batch, score).write.mode(mode).parquet(f"{root}/delta/batch_id=0")
        assert rows(ST.rescored(spark, root)) == got


def test_sessions_merge_and_late_rows_fall(spark, folder):
    plain = "doc_id long, ts timestamp, version_id long"
    folder(0, [(1, at(0), 1), (1, at(2), 2), (2, at(0), 3)], plain)
    folder(1, [(1, at(1), 4), (1, at(30), 5), (2, at(3), 6)], plain)  # 4 joins 1 and 2; the watermark goes to 29
    folder(2, [(3, at(29.5), 8)], plain)
    folder(3, [(2, at(1), 7), (1, at(60), 9)], plain)  # 7 is too late: the batch before ran with the watermark of 29
    got = {(r["doc_id"], r["start"], r["end"], r["n"]) for r in ST.stream_sessions(source(spark, folder, plain), "90 minutes").collect()}
    h = dt.timedelta(minutes=90)
    assert got == {(1, at(0), at(2) + h, 3), (2, at(0), at(0) + h, 1), (2, at(3), at(3) + h, 1), (1, at(30), at(30) + h, 1), (3, at(29.5), at(29.5) + h, 1)}


def test_sliding_windows_over_batches(spark, folder):
    plain = "doc_id long, ts timestamp, version_id long"
    folder(0, [(1, at(1), 1), (1, at(7), 2)], plain)
    folder(1, [(1, at(3), 3), (1, at(40), 4)], plain)  # 3: its windows are still open
    folder(2, [(1, at(41), 6)], plain)
    folder(3, [(1, at(2), 5)], plain)  # dropped: its windows ended before the watermark of 39, with which the batch before ran
    got = {(int((r["start"] - T0).total_seconds() // 3600), r["n"]) for r in ST.stream_activity(source(spark, folder, plain), every="12 hours", slide="6 hours").collect()}
    assert got == {(-6, 2), (0, 3), (6, 1), (30, 2), (36, 2)}
