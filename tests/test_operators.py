"""Set operators, skew and plans."""

import random

import pytest
from pyspark.sql import Window, functions as F

from larder.operators import diff, prefix, search
from larder.operators.latest import best_per_key, first_per_key, latest_per_key
from larder.plans import sync
from larder.sources import delta_files


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds more than a third of the rows."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", f"{i:06d}", rng.randrange(1, 50)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "g string, k string, w long")


def test_running_totals_match_brute_force(skewed):
    rows, df = skewed
    got = {(r.g, r.k): (r["rank"], r.cum, r.cum_total) for r in prefix.with_running(df, ["g"], ["k"], {"cum": "w"}).collect()}
    for g in {r[0] for r in rows}:
        run, total = 0, sum(w for x, _, w in rows if x == g)
        for i, (_, k, w) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            run += w
            assert got[(g, k)] == (i, run, total)
    assert len(got) == len(rows)


def test_weight_cuts_match_a_sequential_walk(spark, skewed):
    rows, df = skewed
    got = {}
    for r in prefix.weight_cuts(df, ["g"], "k", "w", 5).collect():
        got.setdefault(r.g, {})[r.cut_no] = r.cut_key
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        target, run, cuts = sum(r[2] for r in mine) / 5, 0, []
        for _, k, w in mine:
            run += w
            if len(cuts) < 4 and run >= target * (len(cuts) + 1):
                cuts.append(k)
        assert [got[g][i] for i in sorted(got[g])] == cuts


def test_a_heavy_key_takes_one_cut_only(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 100), ("g", "c", 1), ("g", "d", 1)], "g string, k string, w long")
    cuts = prefix.weight_cuts(df, ["g"], "k", "w", 4).orderBy("cut_no").collect()
    assert [(r.cut_no, r.cut_key) for r in cuts] == [(1, "b"), (2, "c"), (3, "d")]


def test_parts_cover_and_do_not_overlap(spark, skewed):
    from larder.operators.ranges import part_for

    _, df = skewed
    ranges = prefix.part_ranges(prefix.weight_cuts(df, ["g"], "k", "w", 4), ["g"])
    placed = part_for(df, ranges, ["g"], "k")
    assert placed.count() == df.count() and placed.filter("part IS NULL").count() == 0


@pytest.mark.parametrize("size", [1, 10])
def test_buckets_stay_small_on_larger_tables(spark, monkeypatch, size):
    from larder.operators import prefix as p_

    monkeypatch.setattr(p_, "BUCKET_ROWS", 2000)
    rows = spark.range(size * 12000).select((F.col("id") % 3 != 0).cast("int").alias("g"), F.xxhash64("id").alias("k"), F.lit(2).alias("w"))
    made = []
    keep = p_._placed
    monkeypatch.setattr(p_, "_placed", lambda *a: made.append(keep(*a)) or made[-1])
    out = p_.with_running(rows, ["g"], ["k"], {"run": "w"})
    largest = made[-1][0].groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert made[0][1] == size * 12000 and largest <= 2 * 2000
    w = Window.partitionBy("g").orderBy("k")
    want = rows.withColumn("rank", F.row_number().over(w)).withColumn("run", F.col("rank") * 2)
    assert out.select("g", "k", "rank", "run").exceptAll(want.select("g", "k", "rank", "run")).count() == 0 and out.count() == size * 12000


def test_parts_with_other_rows_are_found_by_sums(spark):
    rows = [(c, p, f"{c}{p}{i}", None if i % 5 == 0 else f"n{i}", float(i)) for c in "ab" for p in (1, 2) for i in range(40)]
    new = spark.createDataFrame(rows, "country string, part int, barcode string, name string, price double")
    key, cols = ["country", "part", "barcode"], ["name", "price"]
    old = new.filter("price <> 3").withColumn("name", F.when(F.col("price") == 7, "old").otherwise(F.col("name")))
    delta = diff.changes(new, old, key, cols, ["name"])
    assert diff.differing_parts(old, delta, new, key, cols, ["country", "part"]).collect() == []
    assert diff.violations(old, delta, new, key, cols).collect() == []
    # A forgotten row, and a value that has moved to another column: only their parts are looked at.
    wrong = delta.filter("NOT (country = 'a' AND part = 2 AND price = 3)")
    moved = new.withColumn("name", F.when(F.col("barcode") == "b16", None).otherwise(F.col("name")))
    assert sorted(map(tuple, diff.differing_parts(old, wrong, moved, key, cols, ["country", "part"]).collect())) == [("a", 2), ("b", 1)]
    assert {(r.barcode, r.side) for r in diff.violations(old, wrong, new, key, cols).collect()} == {("a23", "missing")}
    swapped = new.withColumn("name", F.when(F.col("barcode") == "a10", "n1").when(F.col("barcode") == "a11", None).otherwise(F.col("name")))
    assert diff.differing_parts(old, delta, swapped, key, cols, ["country", "part"]).count() == 1


def test_stored_columns_come_from_every_file(spark, tmp_path):
    from larder.schema import lacking_columns, stored_columns

    whole = spark.createDataFrame([("a b", 1, "x", "n", 1.0), ("c:d", 2, "y", "m", 2.0)], "country string, part int, barcode string, name string, price double")
    for df in (whole, whole.filter("part = 2").drop("price")):
        df.write.mode("append").partitionBy("country", "part").parquet(str(tmp_path / "c"))
    stored = stored_columns(spark, str(tmp_path / "c"))
    assert stored.select("country", "part", "file").distinct().count() == 3
    assert [tuple(r) for r in lacking_columns(stored, ["barcode", "name", "price", "brands"]).orderBy("country").collect()] == [("a b", "1", ["brands"]), ("c:d", "2", ["brands", "price"])]


def test_change_files_of_a_folder(spark, tmp_path):
    for name in ("x_100_200.json.gz", "x_300_400.json.gz", "x_200_300.json.gz", "notes.txt"):
        (tmp_path / name).write_bytes(b"{}")
    got = delta_files.pending(spark, str(tmp_path), 200).collect()
    assert [(r["from"], r["to"]) for r in got] == [(200, 300), (300, 400)] and got[0].path.endswith("x_200_300.json.gz")
    with pytest.raises(Exception, match="older than the history"):
        delta_files.pending(spark, str(tmp_path), 50).collect()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_bytes(b"{}")
    with pytest.raises(Exception, match="no file name"):
        delta_files.pending(spark, str(tmp_path / "other"), 50).collect()


def test_a_replaced_table_has_another_stamp(spark, tmp_path):
    from larder.session import files_stamp

    path = str(tmp_path / "t.parquet")
    assert files_stamp(spark, path) == files_stamp(spark, path + "x")  # nothing there
    stamps = []
    for n in (3, 4, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        stamps += [files_stamp(spark, path), files_stamp(spark, path)]
    assert stamps[0] == stamps[1] and len(set(stamps)) == 3


def test_a_part_is_found_by_halving(spark):
    import random

    from larder.operators import ranges as r_

    rng = random.Random(3)
    cuts = {g: sorted({f"{rng.randrange(10 ** 6)}" for _ in range(n)}) for g, n in (("a", 4000), ("b", 3), ("c", 1))}
    lines = [(g, i + 1, lo, hi) for g, c in cuts.items() for i, (lo, hi) in enumerate(zip([None, *c], [*c, None]))]
    # Of the last group the ends are closed, and one has no range at all.
    lines = [x for x in lines if not (x[0] == "b" and (x[2] is None or x[3] is None))]
    keys = [(g, f"{rng.randrange(10 ** 6)}") for g in "abcd" for _ in range(500)] + [(g, k) for g, c in cuts.items() for k in c] + [("a", None), ("c", None), ("a", "")]
    df = spark.createDataFrame(keys, "g string, k string")
    parts = spark.createDataFrame(lines, "g string, part int, from_key string, to_key string")
    by_group = {g: [x for x in lines if x[0] == g] for g in "abc"}

    def brute(g, k, last):
        if g not in by_group:
            return 1
        hit = [x[1] for x in by_group[g] if k is not None and (x[2] is None or k >= x[2]) and (x[3] is None or k < x[3])]
        return hit[0] if hit else max(x[1] for x in by_group[g]) if last else None

    old = r_.DEAL_ROWS
    try:
        r_.DEAL_ROWS = 600  # the group with most rows is dealt, the others aren't
        for last in (False, True):
            got = r_.part_for(df, parts, ["g"], "k", fallback_last=last).collect()
            key = lambda x: tuple((v is not None, v) for v in x)
            assert sorted(map(tuple, got), key=key) == sorted([(g, k, brute(g, k, last)) for g, k in keys], key=key)
    finally:
        r_.DEAL_ROWS = old


def test_large_top_n_equals_window(skewed):
    rows, df = skewed
    big = prefix.top_n_per_group(df, ["g"], ["w", "k"], 1500, descending={"w"})
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, k) for _, k, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:1500]}
    assert {(r.g, r.k) for r in big.collect()} == want


def test_positions_share_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, 4.0), (2, 3.0), (1, None)], "g int, v double")
    got = sorted((r.g, r.v, r.position) for r in prefix.position_in_group(df, ["g"], "v").collect() if r.v is not None)
    assert got == [(1, 1.0, 0.0), (1, 1.0, 0.0), (1, 2.0, 0.67), (1, 4.0, 1.0), (2, 3.0, None)]


def test_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], ["t"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in first_per_key(df, ["k"], ["t"]).collect()} == {("a", "x"), ("b", None)}
    ties = df.withColumn("p", F.lit(1))
    assert {(r.k, r.v) for r in best_per_key(ties, ["k"], F.col("p"), "t").collect()} == {("a", "x"), ("b", None)}


# ---------------------------------------------------------------- deltas

def generations(spark):
    rng = random.Random(3)
    make = lambda: {f"{rng.randrange(300):04d}": (rng.choice(["n", None, "m"]), rng.choice([1.0, None, 2.0])) for _ in range(200)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "barcode string, name string, price double")
    return frame(make()), frame(make())


def test_delta_is_the_difference_both_ways(spark):
    old, new = generations(spark)
    cols = ["name", "price"]
    for a, b in ((old, new), (new, old)):
        delta = diff.changes(b, a, ["barcode"], cols, ["name"])
        assert diff.violations(a, delta, b, ["barcode"], cols).count() == 0
        assert diff.upserts(b, a, ["barcode"], cols, ["name"]).count() == delta.filter("op = 'u'").count()
        assert diff.deletes(b, a, ["barcode"]).count() == delta.filter("op = 'd'").count()


def test_forgotten_delete_is_seen(spark):
    old, new = generations(spark)
    delta = diff.changes(new, old, ["barcode"], ["name", "price"], ["name"]).filter("op = 'u'")
    sides = {r.side for r in diff.violations(old, delta, new, ["barcode"], ["name", "price"]).collect()}
    assert sides == {"unexpected"}


def test_delta_ignores_unknown_columns(spark):
    base = spark.createDataFrame([("1", "a")], "barcode string, name string")
    delta = spark.createDataFrame([("u", 1, "2", "b", 9)], "op string, fts int, barcode string, name string, extra int")
    assert sorted(map(tuple, diff.apply_delta(base, delta, ["barcode"], ["name", "extra"]).collect())) == [("1", "a"), ("2", "b")]


def test_damaged_delta_file_is_refused(spark, tmp_path):
    old, new = generations(spark)
    place = lambda df: df.select(F.lit("c").alias("country"), F.lit(1).alias("part"), "*")
    found = diff.changes(place(new), place(old), ["country", "part", "barcode"], ["name", "price"], ["name"])
    counts = found.agg(F.count_if(F.col("op") == "u").alias("u"), F.count_if(F.col("op") == "d").alias("d")).first()
    manifest = lambda extra: spark.createDataFrame([("c", 1, "v1", "v2", "delta", counts.u + extra, counts.d)], "country string, part int, from string, to string, reason string, upserts long, deletes long")
    schema = "op string, fts int, barcode string, name string, price double"
    for extra, status, rows in ((0, "ok", counts.u + counts.d), (1, "incomplete", 0)):
        path = str(tmp_path / f"d{extra}")
        delta_files.write_delta(found, manifest(extra), ["name", "price"], path)
        headers, changes = delta_files.read_delta(spark, path, schema)
        assert headers.first().status == status and changes.count() == rows


def test_pending_files_need_an_unbroken_history(spark):
    listing = spark.createDataFrame([("x_100_200.json.gz",), ("x_200_300.json.gz",), ("readme",)], "path string")
    assert [r.to for r in delta_files.pending_files(listing, 200).collect()] == [300]
    with pytest.raises(Exception, match="older than the history"):
        delta_files.pending_files(listing, 50).collect()


@pytest.mark.parametrize("local,published,links,want", [
    ("a", "a", [], ("up-to-date", None)), (None, "a", [], ("full", "no-local-version")), ("a", None, [], ("full", "no-published-version")),
    ("a", "c", [("a", "b", 10), ("b", "c", 10)], ("deltas", None)), ("a", "c", [("a", "b", 10)], ("full", "broken-chain")),
    ("a", "z", [("a", "b", 1), ("b", "a", 1)], ("full", "broken-chain")), ("a", "b", [("a", "b", 360)], ("full", "delta-too-large")),
    ("a", "b", [("a", "b", 350)], ("deltas", None))])
def test_sync_plan(spark, local, published, links, want):
    parts = spark.createDataFrame([("c", 1, local, published, 1000)], "country string, part int, local string, published string, bytes long")
    deltas = spark.createDataFrame([("c", 1, *x) for x in links], "country string, part int, from string, to string, bytes long")
    row = sync.plan_sync(parts, deltas).first()
    assert (row.kind, row.reason) == want


# ---------------------------------------------------------------- search

def test_prefix_is_for_the_last_word_only(spark):
    df = spark.createDataFrame([(1, "Harina PAN"), (2, "Harina panificable"), (3, "Pan harinado"), (4, "Galletas")], "k int, name string")
    index = search.postings(df, "k", ["name"])
    find = lambda q: {r.k for r in search.prefix_search(index, "k", q).select("k").distinct().collect()}
    assert find("harina pan") == {1, 2} and find('"HARÍNA"') == {1, 2, 3} and find("pan") == {1, 2, 3} and find("''") == set()


# ---------------------------------------------------------------- plans

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_stage_without_python(spark):
    from larder.binding import additive_dim, products
    from larder.plans.scoring import health_scores

    text = plan(health_scores(products(spark, "/root/testdata/sf0.001"), additive_dim(spark)))
    before_broadcast = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in before_broadcast and "Python" not in text and "CartesianProduct" not in text


def test_top_n_limits_before_the_shuffle(spark, skewed):
    assert "WindowGroupLimit" in plan(prefix.top_n_per_group(skewed[1], ["g"], ["k"], 10))


def test_catalogue_scan_is_pruned(spark):
    from larder.binding import load
    from larder.operators.latest import latest_per_key

    rows = load(spark, "/root/testdata/sf0.001", "events").select("user_id", "event_id", "ts").filter("user_id = 3")
    text = plan(latest_per_key(rows, ["user_id"], ["ts"]))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in text and "props" not in text


def test_shared_folder_is_required_off_one_machine():
    from types import SimpleNamespace

    from larder.session import checkpoint_root

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                            sparkContext=SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(spark)


def test_republished_links_count_once(spark):
    from larder.plans.sync import walk_chains

    starts = spark.createDataFrame([("c", 1, "v1", "v4")], "country string, part int, local string, published string")
    links = [("c", 1, "v1", "v2", 5), ("c", 1, "v1", "v2", 7), ("c", 1, "v2", "v3", 1), ("c", 1, "v2", "v3", 1), ("c", 1, "v3", "v4", 2)]
    rows = walk_chains(starts, spark.createDataFrame(links, "country string, part int, from string, to string, bytes long")).collect()
    assert [(r.steps, r.bytes, r.complete) for r in rows] == [(3, 10.0, True)]


def test_listing_without_change_files_fails(spark):
    from larder.sources.delta_files import pending_files

    with pytest.raises(Exception, match="no file name"):
        pending_files(spark.createDataFrame([("a.txt",)], "path string"), 0).collect()
    empty = spark.createDataFrame([], "path string")
    assert pending_files(empty, 0).collect() == []


def test_part_for_finds_ranges_without_a_list_of_them(spark):
    """Thousands of ranges, a key that half of the rows share, and buckets that begin between two starts."""
    from bisect import bisect_right
    from larder.operators import ranges as r_

    rng = random.Random(3)
    starts = {g: sorted({f"{rng.randrange(10 ** 5):05d}" for _ in range(2000)}) for g in "ab"}
    keys = [(g, f"{rng.randrange(10 ** 5):05d}") for g in "ab" for _ in range(2000)] + [("a", starts["a"][7])] * 4000
    parts = prefix.ranges_from(spark.createDataFrame([(g, k) for g in starts for k in starts[g]], "g string, k string"), ["g"], "k")
    assert parts.count() == sum(map(len, starts.values())) + 2
    placed = r_.part_for(spark.createDataFrame(keys, "g string, k string"), parts, ["g"], "k")
    assert "collect_list" not in plan(placed)
    assert sorted(map(tuple, placed.collect())) == sorted((g, k, bisect_right(starts[g], k) + 1) for g, k in keys)


def test_rows_that_grow_are_dealt_by_their_number(spark, monkeypatch):
    """A small file is one split: its documents were rendered, its words counted, in one task."""
    from larder import rawdocs

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(rawdocs, "FILE_DOCUMENTS", 8, raising=False)
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    docs = rawdocs.raw_documents(spark, sf)
    assert docs.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, n // 8 + 1) > 2
    broken = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey % 200 = 0").count()
    assert docs.count() == n + 2 * broken


def test_scan_gives_what_an_index_gives(spark):
    rows = [(i, " ".join(rng_words)) for i, rng_words in enumerate([["the", "who"], ["The", "the", "when", "x"], ["a"], [], ["who"], ["thé", "what", "which"], ["the"] * 3 + ["why"]])] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    for text in ("the wh", "wh", "the", "none the", ""):
        index, scanned = search.postings(df, "id", ["t"]), search.scan(df, "id", ["t"], text)
        assert "Exchange" not in plan(scanned.filter("length > 0"))
        by = lambda got: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.collect())
        assert by(search.scan_bm25(scanned, "id", text)) == by(search.bm25(index, "id", text))
        assert by(search.scan_hits(scanned, "id")) == by(search.prefix_search(index, "id", text).select("id", "term", "tf", "length"))


def test_legal_rows_cut_texts_once(spark):
    from larder.queries import regulation

    assert "FileScan" not in plan(regulation.law_rows(spark, "/root/testdata/sf0.001"))
