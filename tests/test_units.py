import gzip
import os
import random
from datetime import datetime
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ellipsis, int_bytes, log_sum, string_bytes, tokenize
from tessera.operators import counting, graph, search
from tessera.plans import catalogue, lineage
from tessera.sources import ranged
from tessera.sources import text as io
from tessera.sources.arrivals import arrivals
from tessera.streaming import events, spine


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Rain, at LAST! (we'd waited: 31 days)", "rain at last we'd waited days"),
        ("7 boats left \t at 6am,\nnone came\r\nback.", "boats left at am none came back"),
        ("", ""),
        (" \n ", ""),
        ("--half-baked_ 99 Ñandú 3x3 o'er!", "half-baked and x o'er"),
    ],
)
def test_tokenize(spark, text, tokens):
    assert frame(spark, [(text,)], "s string").select(tokenize(F.col("s"))).first()[0] == tokens.split()


def lines(spark, *texts):
    return frame(spark, [(t,) for t in texts], "line string")


def test_bigrams_stay_on_a_line(spark):
    assert counting.bigram_count(lines(spark, "a b", "c", "", None)).collect() == [("a b", 1)]


def test_relative_frequencies(spark):
    got = {(r.l, r.r): r.val for r in counting.bigram_relfreq_pairs(lines(spark, "a b a b a c")).collect()}
    assert got == {("a", "*"): 3, ("a", "b"): 2 / 3, ("a", "c"): 1 / 3, ("b", "*"): 2, ("b", "a"): 1}
    stripes = {r.l: r.freqs for r in counting.bigram_relfreq_stripes(lines(spark, "a b a b a c")).collect()}
    assert stripes == {"a": {"b": 2 / 3, "c": 1 / 3}, "b": {"a": 1}}
    hot = counting.bigram_relfreq_stripes(lines(spark, *[f"a w{'xyz'[i % 3]}{'pqrst'[i // 3]}" for i in range(15)]), part=4).collect()
    assert len(hot) > 2 and len({k for r in hot for k in r.freqs}) == sum(len(r.freqs) for r in hot) == 15


def test_cooccurrence(spark):
    got = {(r.l + r.r): r.cnt for r in counting.cooccur_pairs(lines(spark, "a b c d")).collect()}
    assert got == dict.fromkeys("ab ac ba bc bd ca cb cd db dc".split(), 1)
    assert counting.cooccur_pairs(lines(spark, "a a")).collect() == [("a", "a", 2)]
    assert counting.cooccur_stripes(lines(spark, "x", "y", "y z")).orderBy("l").collect() == [("x", 0, {}), ("y", 0, {"z": 1}), ("z", 0, {"y": 1})]


def test_mean_is_cut_towards_zero(spark):
    rows = frame(spark, [("k", -3), ("k", -4), ("m", 3), ("m", 4), ("n", None)], "k string, v int")
    assert sorted(counting.int_mean(rows).collect()) == [("k", -3), ("m", 3), ("n", None)]


def test_key_values(spark, tmp_path):
    (tmp_path / "kv").write_text("a\t4\nnokey\n")
    assert io.read_key_values(spark, str(tmp_path / "kv")).collect() == [("a", 4), ("nokey", None)]
    io.write_key_values(frame(spark, [("a", 1)], "k string, v int"), str(tmp_path / "out"), 1)
    assert spark.read.text(str(tmp_path / "out")).collect() == [("a\t1",)]
    io.write_key_values(frame(spark, [("a", 1)], "k string, v int"), str(tmp_path / "out"), 1, tuples=True)
    assert spark.read.text(str(tmp_path / "out")).collect() == [("(a,1)",)]
    io.write_key_values(frame(spark, [("a", 1)], "k string, v int"), str(tmp_path / "out"), text=False)
    assert spark.read.parquet(str(tmp_path / "out")).collect() == [("a", 1)]
    assert io.read_lines(spark, str(tmp_path / "kv")).collect() == [("a\t4",), ("nokey",)]


def test_offsets(spark, tmp_path):
    (tmp_path / "f").write_text("ab cd\nefg\n\nhé ij\n")
    assert [r.docno for r in io.read_lines_with_offset(spark, str(tmp_path / "f")).collect()] == [0, 6, 10, 11]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "plain").write_text("a\n")
    (tmp_path / "mixed" / "packed.gz").write_bytes(gzip.compress(b"b\n"))
    for path in ("mixed", "mixed/*.gz", "mixed/packed.gz"):
        with pytest.raises(ValueError):
            io.read_lines_with_offset(spark, str(tmp_path / path))


def test_offsets_over_splits(spark, tmp_path):
    """Small splits, so that lines cross their ends; every offset leads to its line."""
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / name).write_text("".join(f"{name} é line {i}" + "x" * (i % 70) + "\r" * (i % 2) + "\n" for i in range(400)) + "the end")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = io.read_lines_with_offset(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 802
    whole = {name: (tmp_path / "in" / name).read_bytes() for name in ("one", "two")}
    for r in rows:
        assert any(w[r.docno :].partition(b"\n")[0] == r.line.encode() and (r.docno == 0 or w[r.docno - 1 : r.docno] == b"\n") for w in whole.values())


def test_table_put_get(spark):
    for n in (1, 2):
        io.put_table(frame(spark, [("a", n), ("b", 5)], "term string, cnt int"), "kv_test", "term")
    assert io.get_key(spark, "kv_test", "term", "a").collect() == [("a", 2)]
    assert io.get_key(spark, "kv_test", "term", "z").collect() == []
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in plan(io.get_key(spark, "kv_test", "term", "a"))


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_a_stored_index_is_pruned(spark, tmp_path):
    posts = search.store(search.postings(frame(spark, [(1, "red rose"), (2, "white rose"), (3, "red")], "doc_id bigint, text string")), str(tmp_path / "index"))
    assert sorted(search.lookup(posts, "rose").collect()) == [(1, 1), (2, 1)]
    asked = search.boolean(posts, "white red OR rose AND")
    assert sorted(asked.collect()) == [(1,), (2,)]
    fresh = plan(search.boolean(posts, "white red OR rose AND"))
    assert "In(term, [red,rose,white])" in fresh and fresh.count("Scan parquet") == 2  # the tree and its details
    texts = search.store_snippets(frame(spark, [(2, "y" * 90), (1, "red rose\nx")], "doc_id bigint, text string"), str(tmp_path / "snippets"))
    assert search.with_snippets(asked, texts).collect() == [(1, "red rose"), (2, "y" * 80 + "...")]


def test_bitmaps_answer_in_order_of_documents(spark, tmp_path):
    rng = random.Random(5)
    docs = [(d, {w for w in "abc" if rng.random() < 0.5}) for d in rng.sample(range(-70_000, 200_000), 3000)]
    posts = frame(spark, [(w, d, 1) for d, own in docs for w in own], "term string, docno bigint, tf bigint")
    index = search.store_bitmaps(posts, str(tmp_path / "bits"))
    want = {"a": lambda o: "a" in o, "a b AND": lambda o: o >= {"a", "b"}, "a b OR": lambda o: bool(o & {"a", "b"}), "a b OR c AND": lambda o: "c" in o and bool(o & {"a", "b"}), "a a AND": lambda o: "a" in o, "a none AND": lambda o: False, "none": lambda o: False}
    for query, holds in want.items():
        found = [r[0] for r in search.docnos(search.boolean_bits(index, query)).collect()]
        assert found == sorted(d for d, own in docs if holds(own)), query
    asked = search.docnos(search.boolean_bits(index, "a b AND"))
    text = plan(asked)
    assert "EqualTo(term,a)" in text and "EqualTo(term,b)" in text and "hashpartitioning(docno" not in text and "rangepartitioning(docno" not in text
    for bad in ("AND", "a b", ""):
        with pytest.raises(ValueError):
            search.boolean_bits(index, bad)


def test_lines_are_fetched_by_offset(spark, tmp_path):
    made = [(n, i, f"file {n} line {i} {'é漢' * (i % 60)}{' red' if i % 50 == 7 else ''}") for n in range(6) for i in range(200)]
    io.write_collection(frame(spark, made, "n int, i int, line string"), str(tmp_path / "all"), ["n"], ["i"])
    found = io.read_lines_with_offset(spark, str(tmp_path / "all"))
    assert found.select("file").distinct().count() == 6
    index = search.store_line_index(found, str(tmp_path / "index"))
    clip = lambda t: t if len(t) <= 80 else t[:80] + "..."
    got = search.matching_lines(index, "red")
    assert sorted(r.line for r in got.collect()) == sorted(clip(t) for _, _, t in made if t.endswith(" red"))
    assert sorted(r.line for r in search.matching_lines(index, "red", None).collect()) == sorted(t for _, _, t in made if t.endswith(" red"))
    text = plan(got)
    assert "Scan text" not in text and "In(term" in text or "EqualTo(term,red)" in text
    assert got.agg(F.sum("n_read")).first()[0] <= 24 * 4 * 81  # of some 150,000 bytes


def test_ranged_reads_of_any_bytes(spark, tmp_path):
    (tmp_path / "raw").write_bytes(b"\xff\xfe bad\n" + b"z" * 10_000 + b"\nlast")
    hits = frame(spark, [(str(tmp_path / "raw"), o) for o in (0, 7, 10_008, 10_012, 99_999, 0)], "file string, docno bigint")
    got = {r.docno: (r.line, r.n_read) for r in ranged.fetch_lines(hits, 80).collect()}
    assert got == {0: ("\ufffd\ufffd bad", 324), 7: ("z" * 80 + "...", 324), 10_008: ("last", 4), 10_012: ("", 0), 99_999: ("", 0)}
    assert {r.docno: r.line for r in ranged.fetch_lines(hits, None).collect()}[7] == "z" * 10_000


def test_random_pairs(spark):
    rows = io.random_key_values(spark, 50, 3, 10, seed=1).collect()
    assert len(rows) == 50 and all(len(r.k) == 3 and r.k.isalpha() and 0 <= r.v < 10 for r in rows)


def test_boolean_queries(spark):
    posts = search.postings(frame(spark, [(1, "red rose"), (2, "white rose"), (3, "red")], "doc_id bigint, text string"))
    ask = lambda q: sorted(r[0] for r in search.boolean(posts, q).collect())
    assert ask("white red OR rose AND") == [1, 2]
    assert ask("nothing red AND") == []
    for bad in ("AND", "a b", ""):
        with pytest.raises(ValueError):
            search.boolean(posts, bad)
    index = {r.term: (r.df, r.postings) for r in search.build_index(posts).collect()}
    assert index["red"] == (2, [(1, 1), (3, 1)])
    assert sorted((r.segment, r.postings) for r in search.build_index(posts, 2).where("term = 'red'").collect()) == [(0, [(1, 1)]), (1, [(3, 1)])]


def test_small_functions(spark):
    assert frame(spark, [("x" * 81,)], "s string").select(ellipsis(F.col("s"))).first()[0] == "x" * 80 + "..."
    row = spark.range(1).select(log_sum(F.log(F.lit(0.25)), F.log(F.lit(0.5))), log_sum(F.lit(float("-inf")), F.lit(-1.0))).first()
    assert row[0] == pytest.approx(-0.2876820724) and row[1] == -1


def test_bytes_and_log_sums(spark):
    row = frame(spark, [("é", -2)], "s string, i int").select(string_bytes(F.col("s")), int_bytes(F.col("i"))).first()
    assert (bytes(row[0]), bytes(row[1])) == ("é".encode(), b"\xff\xff\xff\xfe")
    rows = frame(spark, [("a", 1000.0), ("a", 1000.0), ("a", None), ("b", float("-inf")), ("c", -2.0)], "k string, x double")
    got = {r.k: r.x for r in counting.log_sum_by_key(rows).collect()}
    assert got["a"] == pytest.approx(1000 + 0.6931471806) and got["b"] == float("-inf") and got["c"] == -2
    text = frame(spark, [(1.5,)], "p double").select(F.format_string("%.4f", F.log("p")), F.format_string("%.5f", "p")).first()
    assert tuple(text) == ("0.4055", "1.50000")


def test_full_descending_sort(spark):
    counts = counting.word_count(frame(spark, [("b a c b a b",)], "text string"))
    assert counting.top_k(counts, "cnt", 2**31 - 1, "term").collect() == [("b", 3), ("a", 2), ("c", 1)]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


@pytest.fixture(scope="module")
def mini(spark):
    return graph.parse_adjacency(lines(spark, "0 1 2", "1 2", "2", "3 0 9", "4", ""))


def test_bfs(spark, mini):
    got = {r.id: r.dist for r in graph.bfs(mini, 0).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: None, 4: None}
    with pytest.raises(ValueError):
        graph.bfs(mini, 77)


def test_pagerank(spark, mini):
    want = [0.177241, 0.198013, 0.374154, 0.125296, 0.125296]
    for how in (False, True):
        got = {r.id: r.p for r in graph.pagerank(mini, 3, copartitioned=how).collect()}
        assert [round(got[i], 6) for i in range(5)] == want
    with pytest.raises(ValueError):
        graph.pagerank(mini)
    got = {r.id: r.p for r in graph.pagerank(mini, 3, source=0).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.51125, 0.217281, 0.271469, 0, 0]


def test_pagerank_goes_on_and_ends(spark, mini, tmp_path):
    graph.write_nodes(mini, str(tmp_path / "nodes"))
    nodes = graph.read_nodes(spark, str(tmp_path / "nodes"))
    graph.pagerank(nodes, 2, keep=str(tmp_path))
    again = {r.id: r.p for r in graph.pagerank(nodes, 3, keep=str(tmp_path), first=2).collect()}
    assert again == pytest.approx({r.id: r.p for r in graph.pagerank(mini, 3).collect()})
    end = {r.id: r.p for r in graph.pagerank(mini, tolerance=1e-10).collect()}
    assert end == pytest.approx({r.id: r.p for r in graph.pagerank(mini, 150).collect()}, abs=1e-9)
    back = {r.id: r.adj for r in graph.parse_adjacency(graph.adjacency_lines(mini)).collect()}
    assert back == {r.id: r.adj for r in mini.collect()}


def test_component_counts(spark):
    edges = frame(spark, [(1, 2), (2, 3), (5, 6), (9, 9)], "src int, dst int")
    assert graph.component_counts(graph.components(edges), edges).collect() == [(3, 6, 4)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = lambda *hours: frame(spark, [(f"2024-01-01 {h:02d}:30:00",) for h in hours], "s string").select(F.to_timestamp("s").alias("ts"))
    into, place = str(tmp_path / "in"), str(tmp_path / "state")
    counts = lambda: events.run_available(events.hourly_count(events.stream_of(spark, into), delay="1 day"), location=place)
    rows(1, 2, 2).coalesce(1).write.parquet(into)
    assert sorted((r.window_start.hour, r.cnt, r.batch) for r in counts().collect()) == [(1, 1, 0), (2, 2, 0)]
    rows(2, 3).coalesce(1).write.mode("append").parquet(into)
    assert [(r.window_start.hour, r.cnt) for r in counts().orderBy("window_start").collect()] == [(1, 1), (2, 3), (3, 1)]
    assert sorted((r.window_start.hour, r.batch > 0) for r in counts().collect()) == [(1, False), (2, True), (3, True)]


def at(spark, *times):
    return frame(spark, [(t,) for t in times], "s string").select(F.to_timestamp_ntz("s").alias("ts"))


def test_a_stream_counts_late_events(spark, tmp_path):
    for n, day in enumerate((10, 2, 20, 3)):
        at(spark, f"2024-01-{day:02d} 05:00:00").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.run_available(events.hourly_count(events.stream_of(spark, str(tmp_path / "in"))), location=str(tmp_path / "state"))
    batch = events.hourly_count(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(stream.select("window_start", "cnt").collect()) == sorted(batch.collect()) and batch.count() == 4


def test_arrivals_come_in_order_of_names(spark, tmp_path):
    into, place = str(tmp_path / "in"), str(tmp_path / "q")
    put = lambda name, *times: at(spark, *times).repartition(2).write.parquet(f"{into}/{name}")
    put("part-3", "2024-01-03 00:00:00")
    put("part-1", "2024-01-09 00:00:00", "2024-01-08 00:00:00")
    put("_part-0", "2024-01-01 00:00:00")
    pq.write_table(pa.table({"ts": pa.array([datetime(2024, 1, 5)], pa.timestamp("us"))}), f"{into}/part-2")
    log = events.BatchLog()
    run = lambda: events.batch_counts(arrivals(spark, into, at(spark, "2024-01-01 00:00:00").schema, place), location=place, log=log).orderBy("batch")
    assert [(r.batch, r.cnt, r.first_ts.day) for r in run().collect()] == [(0, 2, 8), (1, 1, 5), (2, 1, 3)]
    assert [r[:2] for r in log.rows] == [(0, 2), (1, 1), (2, 1)]
    put("part-5", "2024-01-07 00:00:00")
    put("part-4", "2024-01-06 00:00:00")
    assert [(r.cnt, r.first_ts.day) for r in run().collect()] == [(2, 8), (1, 5), (1, 3), (1, 6), (1, 7)]
    assert run().count() == 5


def test_spine_keeps_empty_windows_and_late_events(spark, tmp_path):
    into, place = str(tmp_path / "in"), str(tmp_path / "q")
    put = lambda name, *hours: at(spark, *[f"2024-01-01 {h:02d}:20:00" for h in hours]).write.parquet(f"{into}/{name}")
    kind = at(spark, "2024-01-01 00:00:00").schema
    run = lambda: [(r.window_start.hour, r.cnt) for r in spine.count_windows(arrivals(spark, into, kind, place), place).orderBy("window_start").collect()]
    folders = lambda: {r.window[11:13]: r.line for r in spine.closed_windows(arrivals(spark, into, kind, place), place).collect()}
    put("a", 5, 8, 8)
    assert run() == [(5, 1), (6, 0), (7, 0), (8, 2)]
    assert folders() == {"05": "(all,1)", "06": "(all,0)", "07": "(all,0)"}
    put("b", 3, 7, 10)  # two are late, one for a window that was closed
    assert run() == [(3, 1), (4, 0), (5, 1), (6, 0), (7, 1), (8, 2), (9, 0), (10, 1)]
    assert folders() == {"03": "(all,1)", "04": "(all,0)", "05": "(all,1)", "06": "(all,0)", "07": "(all,1)", "08": "(all,2)", "09": "(all,0)"}
    assert run()[-1] == (10, 1) and len(folders()) == 7


def test_a_batch_that_is_run_again_leaves_the_same_folders(spark, tmp_path):
    into, place = str(tmp_path / "in"), str(tmp_path / "q")
    at(spark, "2024-01-01 01:00:00", "2024-01-01 04:00:00").coalesce(1).write.parquet(f"{into}/a")
    run = lambda: spine.count_windows(arrivals(spark, into, at(spark, "2024-01-01 00:00:00").schema, place), place)
    before = sorted(run().collect())
    for p in (tmp_path / "q/state/commits").glob("*0*"):  # as if the driver had been lost before the batch was committed
        p.unlink()
    assert sorted(run().collect()) == before
    assert sorted(p.name for p in (tmp_path / "q/closed").glob("window=*")) == [f"window=2024-01-01T0{h}-00-00" for h in (1, 2, 3)]


def test_a_structure_on_disk_is_joined_as_it_is(spark, mini, tmp_path):
    graph.store_structure(mini, str(tmp_path / "s"), 3)
    nodes = graph.open_structure(spark, str(tmp_path / "s"), 3)  # as a later session opens it
    got = {r.id: r.p for r in graph.pagerank(nodes, 3, copartitioned=False).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.177241, 0.198013, 0.374154, 0.125296, 0.125296]
    ranks = lineage.cut(frame(spark, [(i, 0.2) for i in range(5)], "id int, p double"))
    joined = nodes.join(ranks.hint("merge"), "id")
    text = joined._sc._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1 and "Bucketed: true" in text  # the ranks' own


def test_steps_report_themselves(spark, mini):
    log = []
    graph.bfs(mini, 0, log=log)
    assert log == [{"step": 0, "frontier": 1, "reached": 1, "sent": 0}, {"step": 1, "frontier": 2, "reached": 3, "sent": 2}]
    log = []
    graph.pagerank(mini, 2, log=log)
    assert [(r["step"], r["active"]) for r in log] == [(1, 3), (2, 3)] and log[0]["lost"] == pytest.approx(0.5) and log[1]["lost"] == pytest.approx(0.5425)
    assert graph.pagerank(mini, tolerance=0.0, most=2).count() == 5


def test_a_hub_is_many_rows(spark):
    links = spark.range(5000).select(F.lit(0).alias("src"), (F.col("id") + 1).cast("int").alias("dst"))
    found = graph.bfs_links(links, catalogue._ids(links), 0).groupBy("dist").count().orderBy("dist").collect()
    assert found == [(0, 1), (1, 5000)]


def test_lookups_follow_a_changed_table(spark, tmp_path):
    write = lambda text: frame(spark, [(1, text, "en", "s")], "doc_id bigint, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    ask = lambda: [r.docno for r in catalogue.QUERIES["boolean_or"](spark, str(tmp_path)).collect()]
    write("some trash here")
    assert ask() == [1]
    write("all is clean")
    assert ask() == []


def test_written_tables_can_go(spark, tmp_path):
    table = lineage.written(spark.range(3), "passing")
    (file,) = {f.rpartition("/")[0] for f in table.inputFiles()}
    lineage.discard(table, spark.range(1))
    assert not os.path.exists(unquote(urlparse(file).path))


def test_components(spark):
    edges = frame(spark, [(i, i + 1) for i in range(20)] + [(40, 30), (None, 3), (50, 50)], "src int, dst int")
    got, again, mixed = ({r.id: r.comp for r in graph.components(edges, few=few).collect()} for few in (graph.FEW, 0, 20))
    assert got == again == mixed
    assert graph.components(edges.where("false")).collect() == []
    assert {i: got[i] for i in (0, 7, 20, 30, 40, 50)} == {0: 0, 7: 0, 20: 0, 30: 30, 40: 30, 50: 50}


def test_partitions(spark):
    nodes = spark.range(20).select(F.col("id").cast("int"))
    assert sorted(r["count"] for r in graph.range_partition(nodes, 4, 20).groupBy("part").count().collect()) == [5] * 4
    assert graph.partition_graph(nodes, 4, 20, by_range=True).rdd.glom().map(len).collect() == [5] * 4


def test_bfs_queries_go_to_the_end(spark, monkeypatch):
    chain = spark.createDataFrame([(i, [i + 1]) for i in range(1, 15)] + [(15, [])], "id int, adj array<int>")
    monkeypatch.setattr(catalogue, "edges", lambda s, d: graph.links_of(chain))
    assert {r.id: r.dist for r in catalogue._bfs(spark, "").collect()} == {i: i - 1 for i in range(1, 16)}


def test_numbers_as_text(spark):
    nodes = spark.createDataFrame([(1, -1.5, [2, 3]), (2, -0.00004, []), (3, 12345.67891, list(range(12)))], "id int, v double, adj array<int>")
    assert [r.txt for r in graph.node_text(nodes, "v", 4).orderBy("id").collect()] == ["{1 -1.5000 [2, 3]}", "{2 -0.0000 []}", "{3 12345.6789 [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]}"]
    assert [r.line for r in graph.rank_lines(nodes, "v").orderBy("id").collect()] == ["1\t-1.50000", "2\t-0.00004", "3\t12345.67891"]
