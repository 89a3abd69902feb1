"""Streaming screen: files arriving in a folder are scored with the fitted
screen; a row scored by the stream equals the batch score."""

from pyspark.sql import functions as F

from labelsift.streaming import fit_screen, load_screen, save_screen, screen_batch, start_screen_stream


def test_stream_scores_new_files(spark, tmp_path):
    texts = [f"ordinary text about topic{i % 4} with common words extra{i % 7}" for i in range(78)]
    texts += ["zebra quantum xylophone violin", "zebra quantum xylophone cello"]
    train = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    fitted = fit_screen(train, "k", "text", trees=30, psi=32, contamination=0.05)
    src = tmp_path / "in"
    new = spark.createDataFrame([(1000, "ordinary text about topic1 with common words extra3"),
                                 (1001, "zebra quantum xylophone")], "k long, text string")
    new.write.parquet(str(src / "part1"))
    # a restarted driver scores with the saved screen
    save_screen(fitted, str(tmp_path / "screen"))
    restarted = load_screen(spark, str(tmp_path / "screen"))
    q = start_screen_stream(spark, str(src / "part1"), new.schema, "k", "text", restarted,
                            str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    out = {r["k"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(out) == {1000, 1001}
    assert out[1001]["score"] > out[1000]["score"]
    batch = {r["k"]: r["score"] for r in screen_batch(new, "k", "text", fitted).collect()}
    assert all(abs(batch[k] - out[k]["score"]) < 1e-12 for k in batch)
    assert out[1001]["potentially_suspicious"] is True and out[1000]["potentially_suspicious"] is False
