"""Batches are committed once, whatever is handed over again."""

from courtflow.streaming import committed as C

SCHEMA = "match_id long, frame_number long, value string"


def test_replay_and_unfinished_batches(spark, tmp_path):
    path, told = str(tmp_path / "out"), []
    one = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 5, "n"), (2, None, "z")], SCHEMA)
    two = spark.createDataFrame([(1, 3, "c")], SCHEMA)

    def tell(rows, batch):
        told.append((batch, [r.value for r in rows.collect()]))

    def dies(rows, batch):
        raise RuntimeError("lost")

    assert C.committed(spark, path, one.schema).count() == 0
    assert C.write_batch(one, 0, path, "s", handlers=[tell])
    assert not C.write_batch(one, 0, path, "s", handlers=[tell])
    assert told == [(0, ["a", "b", "z", "n"])]
    try:
        C.write_batch(one, 1, path, "s", handlers=[dies])  # written, but not committed
    except RuntimeError:
        pass
    assert C.committed(spark, path, one.schema).count() == 4
    assert C.write_batch(two, 1, path, "s")  # what the first try left is gone
    assert C.write_batch(two, 0, path, "other")  # another stream has numbers of its own
    assert C.write_batch(two.limit(0), 2, path, "s")
    got = C.in_frame_order(C.committed(spark, path, one.schema)).collect()
    assert [r.value for r in got] == ["a", "b", "c", "c", "z", "n"]
    assert sorted(r.rows for r in C.commits(spark, path).collect()) == [0, 1, 1, 4]


def test_stream_hands_its_last_batch_over_again(spark, tmp_path):
    folder = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame([(n, f, str(f)) for f in range(5)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    path, checkpoint, told = str(tmp_path / "out"), tmp_path / "checkpoint", []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run = lambda: C.commit_to(stream, path, str(checkpoint), handlers=[lambda d, i: told.append(i)]).awaitTermination()
    run()
    for mark in ("2", ".2.crc"):
        (checkpoint / "commits" / mark).unlink()
    run()
    assert told == [0, 1, 2]
    assert C.committed(spark, path, stream.schema).count() == 15
