from __future__ import annotations

import socket
import struct
import threading

import pytest

from parley.sources.frames import TcpFrames
from parley.streaming import pipeline

SAID = [(1, 0, "A", "We decided to sell the boat"), (1, 1, "B", "See you at lunch"), (1, 2, "A", "Hm, the moon"), (2, 0, "C", "I heard a rumor that they left"), (2, 1, "C", "The pump test failed, a hard blocker"), (2, 2, None, "  "), (2, 3, "C", None)]
SCHEMA = "meeting_id bigint, seq bigint, speaker string, text string"


@pytest.mark.parametrize("batches", [1, 3])
def test_pipeline_stores_what_the_policy_keeps(spark, tmp_path, batches):
    df = spark.createDataFrame(SAID, SCHEMA)
    df.repartition(batches).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/out"
    for _ in range(2):  # the second run finds nothing new
        q = pipeline.started(stream, path, f"{tmp_path}/checkpoint")
        q.awaitTermination(120)
        q.stop()
    want = {(r["meeting_id"], r["seq"], r["action"]) for r in pipeline.decided(df).collect()}
    assert {(r["meeting_id"], r["seq"], r["action"]) for r in pipeline.read(spark, path, "audit").collect()} == want and len(want) == 5
    items = pipeline.read(spark, path, "items").collect()
    assert {r["content"] for r in items} == {"We decided to sell the boat", "The pump test failed, a hard blocker"} and len(items) == 2
    assert [r["content"] for r in pipeline.read(spark, path, "pending").collect()] == ["Hm, the moon"]
    sessions = {r["meeting_id"]: (r["processed"], r["retained"], r["discarded"], r["pending"]) for r in pipeline.closed(spark, path).collect()}
    assert sessions == {1: (3, 1, 1, 1), 2: (2, 1, 1, 0)} and pipeline.read(spark, path, "pending").count() == 0
    kept = "".join(str(r) for name in pipeline.SCHEMAS for r in pipeline.read(spark, path, name).collect())
    assert "lunch" not in kept and "rumor" not in kept and "moon" not in kept


def test_a_batch_stored_twice_counts_once(spark, tmp_path):
    df = spark.createDataFrame(SAID, SCHEMA)
    pipeline.created(spark, str(tmp_path))
    for _ in range(2):
        pipeline.stored(df, 7, str(tmp_path))
    assert pipeline.read(spark, str(tmp_path), "audit").count() == 5


def test_frames_over_tcp(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def node() -> None:
        link, _ = server.accept()
        with link:
            for i in range(5):
                link.sendall(struct.pack("<4h", *[i] * 4))
            link.sendall(b"\x01")  # part of a frame

    threading.Thread(target=node, daemon=True).start()
    spark.dataSource.register(TcpFrames)
    stream = spark.readStream.format("tcp_frames").option("port", server.getsockname()[1]).option("frame", 8).load()
    got = []
    q = stream.writeStream.foreachBatch(lambda b, _: got.extend((r["seq"], list(r["samples"])) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    for _ in range(60):
        if len(got) >= 5:
            break
        q.awaitTermination(1)
    q.stop()
    server.close()
    assert sorted(got) == [(i, [i] * 4) for i in range(5)]
