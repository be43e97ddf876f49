"""Lines that are appended to files, each once; half lines, torn ones, restarts, rewritten files."""

import json

import pytest

from playlake.streaming import tail
from playlake.streaming.merge import View
from playlake.streaming.tail import Piece, TailReader, records, sizes, tail_available, tail_lines, whole_until

UTS = 1_705_312_800


def play(k, fetched=1, track=None):
    return json.dumps({"id": f"{UTS + k}-0000000{k % 10}", "uts": UTS + k, "artist": "A", "track": track or f"t{k}", "source": "api", "fetched_at": fetched, "v": 1, "seq": k})


def seen(spark, path):
    return sorted((r.uts - UTS, r.track) for r in View(spark, path).read().collect())


def test_half_lines_torn_lines_and_restarts(spark, tmp_path):
    log, view, checkpoint = tmp_path / "log" / "month=2024-01", str(tmp_path / "view"), str(tmp_path / "cp")
    log.mkdir(parents=True)
    file = log / "a.json"
    half = play(2)
    file.write_text(f"{play(0)}\n\n{{\"id\": \"torn\n{play(1)}\n{half[:20]}")
    run = lambda: tail_available(spark, str(tmp_path / "log"), view, checkpoint)
    run()
    assert seen(spark, view) == [(0, "t0"), (1, "t1")]
    version = View(spark, view).version()
    run()  # nothing is new: the half line is no line yet
    assert View(spark, view).version() == version
    with file.open("a") as out:
        out.write(f"{half[20:]}\n{play(0, 2, 'newer')}\n")
    (log / "b.json").write_text(f"{play(3)}\n{play(4)}")
    (log / "_c.json").write_text(f"{play(9)}\n")
    run()
    assert seen(spark, view) == [(0, "newer"), (1, "t1"), (2, "t2"), (3, "t3")]
    with (log / "b.json").open("a") as out:
        out.write("\n")
    run()
    assert seen(spark, view) == [(0, "newer"), (1, "t1"), (2, "t2"), (3, "t3"), (4, "t4")]
    # A file that got shorter was rewritten: all of the log is read again, and the view has what is there now.
    file.write_text(f"{play(0, 3, 'newest')}\n")
    run()
    assert seen(spark, view) == [(0, "newest"), (3, "t3"), (4, "t4")]


def test_each_line_once_over_batches(spark, tmp_path):
    (tmp_path / "x.json").write_text("".join(f"{k}\n" for k in range(50)))
    got = []

    def run():
        stream = tail_lines(spark, str(tmp_path), pieceBytes=7).writeStream.foreachBatch(lambda df, _: got.extend(r.line for r in df.collect()))
        stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    with (tmp_path / "x.json").open("a") as out:
        out.write("".join(f"{k}\n" for k in range(50, 70)) + "7")
    run()
    with (tmp_path / "x.json").open("a") as out:
        out.write("0\n")
    run()
    assert sorted(got, key=int) == [str(k) for k in range(71)]


@pytest.mark.parametrize("piece", [1, 2, 5, 1000])
@pytest.mark.parametrize("block", [3, 1 << 16])
def test_pieces_and_ends(tmp_path, monkeypatch, piece, block):
    monkeypatch.setattr(tail, "BLOCK", block)
    text = "alpha\nb\n\nlonger line\né\nunfinished"
    (tmp_path / "x.json").write_text(text)
    reader = TailReader({"path": f"file://{tmp_path}", "pieceBytes": piece})
    end = reader.latestOffset()
    assert end == {"x.json": len(text.encode()) - len("unfinished")} and reader.initialOffset() == {} == reader.partitions(end, end) or reader.partitions(end, end) == []
    parts = reader.partitions({}, end)
    rows = [tuple(r.values()) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r[2] for r in rows] == ["alpha", "b", "longer line", "é"]
    assert all(text.encode()[at:].startswith(line.encode()) for _, at, line in rows)
    assert whole_until(str(tmp_path), "x.json", end["x.json"], len(text.encode())) == end["x.json"]
    with pytest.raises(tail.RewrittenLog):
        reader.partitions({"x.json": 10_000}, {"x.json": 10_000})
    assert sizes(str(tmp_path / "none")) == {} and isinstance(parts[0], Piece)


def test_records(spark):
    from pyspark.sql import functions as F, types as T

    rows = spark.createDataFrame([('{"a": 1}',), ("{",), ("",)], "line string").select(records(F.col("line"), T.StructType([T.StructField("a", T.IntegerType())])).alias("r"))
    assert [r.r.a if r.r else None for r in rows.collect()] == [1, None, None]
