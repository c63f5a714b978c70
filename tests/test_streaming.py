from lokalis.streaming import ledgers


def test_ledger_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", True), (1, "2024-01-01 00:10:00", True), (1, "2024-01-01 01:05:00", True), (2, "2024-01-01 00:00:00", True), (2, "2024-01-01 00:01:00", False)]
    df = spark.createDataFrame(rows, "k long, ts string, failed boolean").selectExpr("k", "cast(ts as timestamp) as ts", "failed")
    df.write.parquet(str(tmp_path / "in"))

    def run(f, name, mode="update"):
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = f(src).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {r["k"]: (r["events"],) for r in run(lambda s: ledgers.activation_windows(s, "k"), "w1")}
    assert got == {1: (1,), 2: (2,)}
    got = {r["k"]: (r["streak"], r["tripped"]) for r in run(lambda s: ledgers.failure_streaks(s, "k", "failed"), "w2")}
    assert got == {1: (3, True), 2: (0, False)}
    assert run(lambda s: ledgers.rolling_counts(s, "k"), "w3")
