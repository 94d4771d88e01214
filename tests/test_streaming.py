"""Change files and scans as streams."""

import json

from pyspark.sql import functions as F

from larder.operators.history import debounce
from larder.operators.runs import manifest
from larder.streaming.changes import apply_changes, commit, read_current, stream_changes
from larder.streaming.scans import debounce_exact, valid_scans

SCHEMA = "barcode string, file long, name string, countries array<string>"


def land(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def rec(code, file, name, *countries):
    return {"barcode": code, "file": file, "name": name, "countries": list(countries)}


def state(spark, root):
    return sorted(map(tuple, read_current(spark, root).select("barcode", "country", "name").collect()))


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "catalog")
    run = lambda: stream_changes(spark, str(landing), root, str(tmp_path / "checkpoint"), SCHEMA, ["es", "fr"]).awaitTermination()
    first = [rec("1", 1, "a", "es", "fr"), rec("2", 1, "b", "es")]
    second = [rec("1", 2, "a2", "fr"), rec("2", 2, None, "es"), rec("3", 2, "c", "es", "de")]
    land(landing, "f1.json", first)
    run()
    assert state(spark, root) == [("1", "es", "a"), ("1", "fr", "a"), ("2", "es", "b")]
    land(landing, "f2.json", second)
    run()
    run()  # nothing new: nothing changes
    assert state(spark, root) == [("1", "fr", "a2"), ("3", "es", "c")]
    frame = spark.createDataFrame([tuple(r.values()) for r in first + second], SCHEMA)
    empty = spark.createDataFrame([], "barcode string, name string, country string")
    batch = apply_changes(empty, frame, ["es", "fr"])
    assert sorted(map(tuple, batch.select("barcode", "country", "name").collect())) == state(spark, root)


def test_written_bytes_follow_the_changes(spark, tmp_path):
    """Some hundred changes all over the keys leave the base as it is; runs of like size are merged, and old ones go."""
    landing, root = tmp_path / "landing", str(tmp_path / "catalog")
    run = lambda: stream_changes(spark, str(landing), root, str(tmp_path / "checkpoint"), SCHEMA, ["es", "fr"]).awaitTermination()
    files = lambda: {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in (tmp_path / "catalog" / "runs").rglob("*.parquet")}
    want = {(str(i), c): f"n{i}" for i in range(20000) for c in ("es", "fr")}
    land(landing, "f0.json", [rec(str(i), 1, f"n{i}", "es", "fr") for i in range(20000)])
    run()
    base, counts = files(), []
    for batch in range(1, 8):
        changed = range(batch, 20000, 97)
        land(landing, f"f{batch}.json", [rec(str(i), batch + 1, f"b{batch}", "es") for i in changed])
        for i in changed:
            want[str(i), "es"] = f"b{batch}"
            want.pop((str(i), "fr"), None)
        before = files()
        run()
        after = files()
        written = sum(size for p, (_, size) in after.items() if p not in before)
        assert all(after[p] == base[p] for p in base) and written < sum(size for _, size in base.values()) / 3
        counts.append(len(manifest(spark, root)))
    assert max(counts) <= 3 and len(list((tmp_path / "catalog" / "manifest").iterdir())) == 2
    assert len(list((tmp_path / "catalog" / "runs").iterdir())) <= 6
    assert {(r[0], r[1]): r[2] for r in state(spark, root)} == want
    # So many changes that all runs become one, without the rows that are gone.
    land(landing, "f9.json", [rec(str(i), 9, None) for i in range(0, 20000, 2)])
    run()
    want = {k: v for k, v in want.items() if int(k[0]) % 2}
    assert {(r[0], r[1]): r[2] for r in state(spark, root)} == want
    assert [r.rows for r in manifest(spark, root)] == [len(want)]


def test_a_batch_that_runs_again_leaves_the_same(spark, tmp_path):
    root = str(tmp_path / "catalog")
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    one, two = frame([rec(str(i), 1, "a", "es") for i in range(50)]), frame([rec(str(i), 2, "b", "fr") for i in range(0, 50, 3)])
    for df, batch in ((one, 0), (two, 1), (two, 1), (two, 1)):
        commit(df, root, batch, ["es", "fr"], "barcode", ["file"])
    assert state(spark, root) == sorted([(str(i), "es", "a") for i in range(50) if i % 3] + [(str(i), "fr", "b") for i in range(0, 50, 3)])


def brute(rows, seconds):
    out, last = [], {}
    for user, code, at in rows:
        c, t = last.get(user, (None, float("-inf")))
        if code != c or at - t >= seconds:
            out.append((user, code, at))
            last[user] = (code, at)
    return out


def scan_rows():
    import random

    rng, rows, at = random.Random(5), [], 0.0
    for _ in range(600):
        at += rng.choice([0.4, 0.9, 3.0])
        rows.append(("hot" if rng.random() < 0.6 else f"u{rng.randrange(5)}", rng.choice(["a", "a", "a", "b"]), round(at, 3)))
    return rows


def test_batch_debounce_equals_the_sequential_rule(spark):
    rows = scan_rows()
    df = spark.createDataFrame([(u, c, t, i) for i, (u, c, t) in enumerate(rows)], "u string, c string, t double, i int").withColumn("at", F.timestamp_micros((F.col("t") * 1000000).cast("long")))
    got = sorted((r.u, r.c, r.t) for r in debounce(df, "u", "c", "at", "i", 2.5).collect())
    assert got == sorted(brute(rows, 2.5))


def test_stream_debounce_equals_the_sequential_rule(spark, tmp_path):
    rows = scan_rows()
    for n in range(3):
        part = rows[n * 200:(n + 1) * 200]
        land(tmp_path / "scans", f"s{n}.json", [{"u": u, "c": c, "t": t} for u, c, t in part])
    stream = (spark.readStream.schema("u string, c string, t double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "scans"))
              .withColumn("at", F.timestamp_micros((F.col("t") * 1000000).cast("long"))))
    q = (debounce_exact(stream, "u", "c", "at").writeStream.outputMode("append").format("memory").queryName("debounced")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.u, r.c, r.t) for r in spark.table("debounced").collect())
    assert got == sorted(brute(rows, 2.5))


def test_misread_codes_are_dropped(spark):
    df = spark.createDataFrame([(" 4006381333931",), ("4006381333932",), ("036000291452",)], "code string")
    assert [r.code for r in valid_scans(df).collect()] == ["4006381333931", "0036000291452"]
