"""S1 directory streams and M1-M4 models (fit on batch, score a stream)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from agendum import schemas as S
from agendum.operators import topics as TP
from agendum.session import stream_checkpoint
from agendum.sources.events import decode_json, read_events


def _drain(df):
    name = "m_" + uuid.uuid4().hex[:8]
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", stream_checkpoint(df.sparkSession, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_read_events_directory_stream(spark, tmp_path):
    rows = [json.dumps({"meetingId": 131, "audioId": 315, "groupId": 1, "transcript": f"t{i}",
                        "isPartial": True}) for i in range(3)]
    (tmp_path / "a.json").write_text("\n".join(rows))
    s = read_events(spark, str(tmp_path), schema=S.TRANSCRIPT_MESSAGE, fmt="json")
    assert s.isStreaming
    got = _drain(s)
    assert sorted(r.transcript for r in got.collect()) == ["t0", "t1", "t2"]


def test_decode_json_flattens(spark):
    df = spark.createDataFrame([(1, '{"meetingId": 5, "transcript": "x"}')], "offset long, value string")
    out = decode_json(df, S.TRANSCRIPT_MESSAGE).collect()[0]
    assert (out.offset, out.meetingId, out.transcript) == (1, "5", "x")


def test_models_fit_on_batch_and_score_a_stream(spark, tmp_path):
    texts = ["write the api document", "design the login page", "api document review",
             "login page bug", "deploy the api"] * 4
    batch = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, text string")
    kw = TP.fit_keywords(batch, num_features=256)
    w2v = TP.fit_topic_vectors(batch, size=8, min_count=1, seed=1)
    batch.write.parquet(str(tmp_path / "seg"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "seg"))
    scored = _drain(TP.score_stream(TP.score_stream(stream, kw), w2v))
    assert scored.count() == len(texts)
    assert {"tfidf_vec", "topic_vec"} <= set(scored.columns)
    clusters = TP.cluster_topics(batch, k=2, size=8, min_count=1, seed=1)
    assert clusters.select(F.count_distinct("topic")).first()[0] <= 2
