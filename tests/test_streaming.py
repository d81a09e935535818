from pyspark.sql import functions as F

from quire.streaming import incremental as inc


def test_watch_marks(spark):
    listing = spark.createDataFrame([("https://a/", n) for n in range(149, 154)], "url string, number int")
    state = spark.createDataFrame([("https://a", 150, 3)], "url string, last_number int, known_sections int")
    assert sorted(r["number"] for r in inc.new_sections(listing, state).collect()) == [151, 152, 153]
    row = inc.checked_state(listing, state).first()
    assert (row["last_number"], row["known_sections"], row["new_sections"]) == (150, 5, 3)
    assert inc.acknowledge(state, listing).first()["last_number"] == 153


def write_rows(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_watch_stream_waits_for_the_acknowledgement(spark, tmp_path):
    schema = "url string, kind string, number int"
    seen = []
    for i, rows in enumerate([[("u", "listing", 1), ("u", "listing", 2)], [("u", "listing", 3), ("u", "ack", 2)], [("u/", "listing", 2), ("u", "listing", 3)]]):
        write_rows(spark, tmp_path, "in", rows, schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = inc.run_to_folder(inc.watch_stream(stream), str(tmp_path / "job"), settings=inc.STORE)
        seen.append(sorted((r["number"], r["mark"]) for r in out.collect()))
    assert seen[0] == [(1, 0), (2, 0)] and seen[1] == [(1, 0), (2, 0), (3, 0)] and seen[2] == [(1, 0), (2, 0), (3, 0), (3, 2)]


def test_watch_begins_with_marks_and_forgets(spark, tmp_path):
    schema = "url string, kind string, number int, hour int"
    marks = spark.createDataFrame([("u/", 5), ("u", 4), ("never", 9)], "url string, last_number int")

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("t", F.timestamp_seconds(F.col("hour") * 3600))
        out = inc.run_to_folder(inc.watch_stream(stream, marks, "t", "1 hour", 10), str(tmp_path / "job"), settings=inc.STORE)
        return sorted((r["url"], r["number"] or -1, r["mark"], r["forgotten"]) for r in out.collect())

    write_rows(spark, tmp_path, "in", [("u", "listing", 5, 100), ("u", "listing", 6, 100), ("u", "listing", 7, 100), ("v", "listing", 1, 100)], schema)
    first = [("u", 6, 5, False), ("u", 7, 5, False), ("v", 1, 0, False)]
    assert [r for r in go() if r[0] != "never"] == first
    write_rows(spark, tmp_path, "in", [("u", "ack", 6, 101), ("v", "ack", 1, 108)], schema)
    assert [r for r in go() if r[0] != "never"] == first
    assert [r for r in go() if r[0] != "never"] == first  # from its checkpoint, nothing new
    # u was heard of at 101, v at 108: at 114 only u has been silent for ten hours, with 7 still open
    write_rows(spark, tmp_path, "in", [("w", "listing", 1, 114)], schema)
    got = go()
    assert ("u", 7, 6, True) in got and not any(r[0] == "v" and r[3] for r in got)
    write_rows(spark, tmp_path, "in", [("u", "listing", 2, 130)], schema)
    got = go()
    # the forgotten one begins anew; v has nothing open
    assert ("u", 2, 0, False) in got and ("v", -1, 1, True) in got


def test_resume_is_replay_safe(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "work_id string, number int, v string"
    one = spark.createDataFrame([("w", 1, "a"), ("w", 1, "a"), ("w", 2, "a")], schema)
    two = spark.createDataFrame([("w", 2, "b"), ("w", 3, "b")], schema)
    write = inc.resume_writer(root, schema, "v")
    for batch, i in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, i)
        rows = sorted((r["number"], r["v"]) for r in inc.read_batches(spark, root, schema).collect())
    assert rows == [(1, "a"), (2, "a"), (3, "b")]


def test_replace_keeps_the_newest_batch(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "work_id string, number int"
    write = inc.replace_writer(root)
    write(spark.createDataFrame([("w", 1), ("w", 2), ("v", 1)], schema), 0)
    write(spark.createDataFrame([("w", 5)], schema), 1)
    write(spark.createDataFrame([("w", 5)], schema), 1)
    assert sorted(tuple(r) for r in inc.replaced_sections(spark, root, schema).collect()) == [("v", 1), ("w", 5)]


def test_first_arrivals(spark, tmp_path):
    schema = "work_id string, number int, at timestamp"
    rows = [("w", 1), ("w", 1), ("w", 2)]
    df = spark.createDataFrame(rows, "work_id string, number int").withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = inc.run_to_folder(inc.first_arrivals(stream, "at", "1 hour"), str(tmp_path / "job"))
    assert sorted((r["work_id"], r["number"]) for r in out.collect()) == [("w", 1), ("w", 2)]


def test_late_arrivals_are_dropped(spark, tmp_path):
    schema = "work_id string, number int, at timestamp"
    late = []
    for rows in ([("w", 1, "10:00"), ("w", 2, "10:05")], [("w", 1, "10:20"), ("w", 3, "08:00"), ("w", 4, "12:00")], [("w", 1, "12:10"), ("w", 5, "09:00")]):
        df = spark.createDataFrame(rows, "work_id string, number int, at string").withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at", F.lit(":00"))))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        told = {}
        out = inc.run_to_folder(inc.first_arrivals(stream, "at", "1 hour"), str(tmp_path / "job"), told=told)
        late.append((told["read"], told["late"]))
    assert late == [(2, 0), (3, 1), (2, 1)]
    got = sorted((r["number"], str(r["at"])[11:16]) for r in out.collect())
    # 3 and 5 came over an hour late; the second 1 is a repeat, the third comes when the first is forgotten
    assert got == [(1, "10:00"), (1, "12:10"), (2, "10:05"), (4, "12:00")]


def test_stream_over_a_folder_of_files(spark, tmp_path):
    from quire import registry

    registry.load_all()
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("I1_watch_stream", "I3_incremental_load", "I4_replace_stream"):
        got, whole = (registry.QUERIES[name](spark, d).collect() for d in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_watch_calls_its_state_no_oftener_for_many_numbers():
    import pandas as pd

    def calls(count):
        made = []

        class Handle:
            def __getattr__(self, name):
                def call(*_):
                    made.append(name)
                    return None if name == "get" and len(made) < 5 else False if name == "containsKey" else Handle() if name.endswith("State") else []

                return call

        watch = inc.Watch(3_600_000)
        watch.init(Handle())
        rows = pd.DataFrame({"kind": "listing", "number": range(1, count + 1), "at": 0})
        assert [len(f) for f in watch.handleInputRows(("u",), iter([rows]), None)] == [count]
        return len(made)

    assert calls(1) == calls(500)
