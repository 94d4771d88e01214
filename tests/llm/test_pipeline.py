"""The registered queries against their SQL, and the pipeline stage by stage."""

import random
from itertools import groupby
from types import SimpleNamespace

import pytest

import corpus_pipeline
from larder.llm.queries import ORACLES, QUERIES
from oracle import compare, connect
from test_copies import brute_components, brute_repeats
from test_native import _check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) == []


def test_stages_hand_on_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        was, now = [{r.doc_id: r for r in df.collect()} for df in (before, after)]
        if name != "sentencepiece":
            assert after.columns == columns
        if name == "language_id":
            assert len(now) > 0.97 * len(was)
        elif name == "near_dedup":
            assert set(now) == {i for i, _, _, kept in brute_components([(r.doc_id, r.text) for r in was.values()]) if kept}
        elif name == "substring_dedup":
            want = {i: (n, gone, text) for i, n, gone, text in brute_repeats([(r.doc_id, r.text) for r in was.values()])}
            assert set(now) == {i for i, (n, gone, _) in want.items() if gone < n or n == 0}
            assert all(r.text == (want[i][2] if want[i][1] else was[i].text) and r.n_chars == len(r.text) for i, r in now.items())
        elif name == "mixing":
            assert now == was
        else:
            assert all(r.text == was[r.doc_id].text and len(r.ids) == r.n_pieces for r in now.values())
        before = after


def test_run_writes_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_run_keeps_the_shares_of_sources_in_every_prefix(spark, tmp_path):
    r = random.Random(5)
    known = sorted({w for x in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").limit(40).collect() for w in x.text.lower().split() if w.isalpha()})
    sources = ["big"] * 900 + ["mid"] * 450 + ["small"] * 150
    rows = [(i, " ".join(r.choice(known) for _ in range(r.choice((30, 300)))), "en", s) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        out = corpus_pipeline.run(spark, str(tmp_path))
        got, files = out.select("source", "doc_id", "slot", "place").collect(), sorted(out.inputFiles())
        by_file = [x.doc_id for f in files for x in spark.read.option("maxPartitionBytes", "1g").parquet(f).coalesce(1).select("doc_id").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(files) > 3 and len(got) == len({x.doc_id for x in got}) > 1400
    # Blocks as they come in the result.
    blocks, seen, placed = [list(g) for _, g in groupby(got, key=lambda x: (x.source, x.slot))], {}, []
    for slot, block in enumerate(blocks):
        nth = seen[block[0].source] = seen.get(block[0].source, -1) + 1
        assert [(x.slot, x.place) for x in block] == [(slot, p) for p in range(len(block))]
        placed += [SimpleNamespace(source=x.source, block=nth, slot=slot) for x in block]
    _check(placed, 64, 1000)
    assert len(seen) == 3 and by_file == [x.doc_id for x in got]


def test_stages_take_odd_tables(spark, tmp_path):
    """Empty tables, NULLs in every column, empty texts, repeated rows and ids, and names that stages use themselves."""
    known = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(6).collect()
    rows = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in known] + [(None, None, None, None, None), (900, None, "en", "a", 0), (901, "", None, None, 0), (902, " \n ", "en", "a", 3)]
    rows += [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in known[:2]] * 2 + [(None, known[0].text, "en", "a", 5), (known[3].doc_id, known[4].text, "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", *[f"{i} AS {c}" for i, c in enumerate(("slot", "place", "ids", "n_pieces", "_block", "kept", "label", "score", "rank"))])
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        before = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, f"{tmp_path}/{name}")
            assert len(set(after.columns)) == len(after.columns) and set(docs.columns) <= set(after.columns)
            assert after.count() <= before.count()
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len({(r.slot, r.place) for r in out}) == len(out)
        # Clean documents stay, repeated rows once. Of two the text is kept elsewhere: in the row without an id, which
        # comes before all others, and under the smaller id that it also has.
        assert {x.doc_id for x in known if x not in (known[0], known[4])} <= {r.doc_id for r in out} if name == "odd" else out == []
        assert name == "empty" or known[0].text in [r.text for r in out]
        assert len({(r.doc_id, r.text) for r in out if r.doc_id is not None}) == len([r for r in out if r.doc_id is not None])


def test_the_last_stage_follows_the_order_of_the_mixture(spark, tmp_path):
    """Other orders of the same rows give other places; runs of one source go on from file to file."""
    from larder.llm.mixing import in_mixed_order

    r = random.Random(8)
    rows = [(i, f"text of {i}", "en", s, 9) for i, s in enumerate(["big"] * 700 + ["mid"] * 200 + [None] * 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, rows[::-1], sorted(rows, key=lambda _: r.random())):
        path = f"{tmp_path}/{given[0][0]}-{given[1][0]}"
        spark.createDataFrame(list(enumerate(given)), f"at int, d struct<{schema}>").repartitionByRange(23, "at").sortWithinPartitions("at").select("d.*").write.parquet(path)
        got = corpus_pipeline.sentencepiece(spark, spark.read.parquet(path), SF).collect()
        want, slot = [], -1
        for _, run in groupby(given, key=lambda x: x[3]):
            for at, row in enumerate(run):
                slot += at % 64 == 0
                want.append((row[0], slot, at % 64))
        assert [(x.doc_id, x.slot, x.place) for x in got] == want
    # Read off the mixture's files they are the places that the mixture gives.
    docs = spark.createDataFrame(rows, schema)
    corpus_pipeline.mixing(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.sentencepiece(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF)
    want = in_mixed_order(docs, slot="slot", place="place", **corpus_pipeline.MIXTURE)
    assert sorted(map(tuple, got.select("doc_id", "slot", "place").collect())) == sorted(map(tuple, want.select("doc_id", "slot", "place").collect()))
