"""Named queries over the test tables, and for each the same result as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import int_bytes, string_bytes
from tessera.operators import counting, graph, search
from tessera.plans.lineage import fresh_path
from tessera.sources.arrivals import arrivals
from tessera.sources.text import LETTERS, get_key, lines, put_table, random_pairs, read_lines, read_lines_with_offset, spread, table, write_collection
from tessera.streaming.events import BatchLog, arrive, batch_counts, hourly_count, run_available, stream_of
from tessera.streaming.spine import closed_windows, count_windows

Query = Callable[[SparkSession, str], DataFrame]

TERM = "les"
RPN = {"boolean_and": "und la AND", "boolean_or": "scum trash OR", "boolean_nested": "the le OR und AND"}
LINES = "scum trash OR"
SOURCE = 1
BUCKETS = 8
#: What is written once in a session and then looked up, by session, name, and the files and times of the table it was made from.
_STORED: dict[tuple, str] = {}


def _once(spark: SparkSession, d: str, source: str, name: str, make: Callable[[], str]) -> str:
    files = table(spark, d, source).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, name, tuple(sorted(map(tuple, files))))
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(_documents(spark, d))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return counting.word_count(_documents(spark, d))


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(_documents(spark, d))


def _stored_posts(spark: SparkSession, d: str) -> DataFrame:
    """The stored index; the first query of a session writes it."""

    def make() -> str:
        path = fresh_path(spark, "index")
        search.store(_posts(spark, d), path)
        return path

    return search.stored(spark, _once(spark, d, "documents", "index", make))


def _stored_bits(spark: SparkSession, d: str) -> DataFrame:
    def make() -> str:
        path = fresh_path(spark, "bitmaps")
        search.store_bitmaps(_posts(spark, d), path)
        return path

    return search.stored_bitmaps(spark, _once(spark, d, "documents", "bitmaps", make))


def _snippets_of(spark: SparkSession, d: str) -> DataFrame:
    def make() -> str:
        path = fresh_path(spark, "snippets")
        search.store_snippets(_documents(spark, d), path)
        return path

    return spark.read.schema("docno bigint, snippet string").parquet(_once(spark, d, "documents", "snippets", make))


def _index_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index of bitmaps anew and reads it whole."""
    built = search.store_bitmaps(_posts(spark, d), fresh_path(spark, "bitmaps"))
    return built.groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("df"))


def _kv_lookup(spark: SparkSession, d: str) -> DataFrame:
    def make() -> str:
        name = f"tessera_words_{uuid.uuid4().hex}"
        put_table(_words(spark, d), name, "term")
        return name

    return get_key(spark, _once(spark, d, "documents", "words", make), "term", TERM)


def _kv_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _kv(spark, d).select(F.hex(string_bytes(F.col("k"))).alias("k"), F.hex(int_bytes(F.col("v"))).alias("v"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Part to order, over the whole table."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("src"), F.col("l_orderkey").cast("int").alias("dst")).distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(edges(spark, d))


def _kv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("k"), F.floor("value").cast("int").alias("v"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("ts")


def _relfreq_stripes(spark: SparkSession, d: str) -> DataFrame:
    stripes = counting.bigram_relfreq_stripes(_lines(spark, d))
    parts = stripes.select("l", F.size("freqs").alias("n"), F.array_max(F.map_values("freqs")).alias("most"), F.array_min(F.map_keys("freqs")).alias("first"), F.array_max(F.map_keys("freqs")).alias("last"))
    return parts.groupBy("l").agg(F.sum("n").alias("n_keys"), F.max("most").alias("freq_max"), F.min("first").alias("r_first"), F.max("last").alias("r_last"))


def _cooccur_stripes(spark: SparkSession, d: str) -> DataFrame:
    stripes = counting.cooccur_stripes(_lines(spark, d), 2)
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = stripes.select("l", F.size("counts").alias("n"), total.alias("t"), F.array_min(F.map_keys("counts")).alias("first"), F.array_max(F.map_keys("counts")).alias("last"))
    return parts.groupBy("l").agg(F.sum("n").alias("n_keys"), F.sum("t").alias("total"), F.min("first").alias("r_first"), F.max("last").alias("r_last"))


def _boolean(name: str) -> Query:
    return lambda spark, d: search.with_snippets(search.docnos(search.boolean_bits(_stored_bits(spark, d), RPN[name])), _snippets_of(spark, d))


def _index(spark: SparkSession, d: str) -> DataFrame:
    docs = F.transform("postings", lambda p: p["docno"])
    rows = search.build_index(_posts(spark, d)).select("term", "segment", "df", docs.alias("docs"), F.aggregate("postings", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"]).alias("tf"))
    of_row = rows.select("term", "df", "tf", F.element_at("docs", 1).alias("first"), F.element_at("docs", -1).alias("last"), (F.col("docs") == F.array_sort(F.array_distinct("docs"))).alias("ordered"))
    return of_row.groupBy("term").agg(F.sum("df").alias("df"), F.min("first").alias("first_docno"), F.max("last").alias("last_docno"), F.sum("tf").alias("total_tf"), F.bool_and("ordered").alias("in_order"))


def _ranks(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round(F.log("p"), 5).alias("logp"))


def _log_rank(spark: SparkSession, d: str, **how: object) -> DataFrame:
    return _ranks(graph.pagerank(_nodes(spark, d), **({"steps": 5} | how)))


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """Two steps, whose nodes and ranks are kept, and the other three from what was kept."""
    keep = fresh_path(spark, "ranks")
    graph.write_nodes(_nodes(spark, d), f"{keep}/nodes")
    graph.pagerank(graph.read_nodes(spark, f"{keep}/nodes"), 2, keep=keep)
    return _ranks(graph.pagerank(graph.read_nodes(spark, f"{keep}/nodes"), 5, keep=keep, first=2))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_nodes(spark, d), 5, source=SOURCE).select("id", F.round("p", 8).alias("p"))


def _bfs(spark: SparkSession, d: str, log: list[dict] | None = None) -> DataFrame:
    """(id, dist) of what is reached."""
    e = edges(spark, d)
    return graph.bfs_links(e, _ids(e), SOURCE, log=log)


def _ids(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def _bfs_distance(spark: SparkSession, d: str) -> DataFrame:
    return _ids(edges(spark, d)).join(_bfs(spark, d), "id", "left").select("id", "dist")


def _bfs_counters(spark: SparkSession, d: str) -> DataFrame:
    """What each step of a search reports of itself."""
    log: list[dict] = []
    _bfs(spark, d, log)
    return spark.createDataFrame(log, "step int, frontier bigint, reached bigint, sent bigint")


def _pagerank_counters(spark: SparkSession, d: str) -> DataFrame:
    log: list[dict] = []
    graph.pagerank(_nodes(spark, d), 5, log=log)
    return spark.createDataFrame(log, "step int, active bigint, lost double").withColumn("lost", F.round("lost", 8))


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over a structure that lies on disk by id; all steps join it as it is."""
    path = fresh_path(spark, "structure")
    graph.store_structure(_nodes(spark, d), path, BUCKETS)
    return _ranks(graph.pagerank(graph.open_structure(spark, path, BUCKETS), 5, copartitioned=False))


def _component_counts(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.component_counts(graph.components(e), e)


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    ids = _nodes(spark, d).select("id")
    return graph.range_partition(ids, 5, (ids.agg(F.max("id")).first()[0] or 0) + 1)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """The graph as adjacency text, written, read and parsed."""
    path = fresh_path(spark, "adjacency")
    graph.adjacency_lines(_nodes(spark, d)).write.text(path)
    nodes = graph.parse_adjacency(read_lines(spark, path))
    return nodes.select("id", F.size("adj").cast("bigint").alias("degree"), F.aggregate("adj", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.element_at(F.when(F.size("adj") > 0, F.col("adj")), 1).alias("first_dst"))


def _rank_dump(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their ranks after five steps, as text."""
    nodes = _nodes(spark, d)
    return graph.node_text(nodes.join(graph.pagerank(nodes, 5).select("id", F.ln("p").alias("logp")), "id"), "logp", 4)


def _dump(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_text(_nodes(spark, d).withColumn("degree", F.size("adj")), "degree")


def _customers(spark: SparkSession, d: str) -> str:
    """Customers as text, a file for each nation."""

    def make() -> str:
        path = fresh_path(spark, "customers")
        rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("line"))
        write_collection(rows, path, ["nation"], ["c_custkey"])
        return path

    return _once(spark, d, "customer", "customers", make)


def _nation() -> Column:
    return F.regexp_extract("file", "nation=([0-9]+)/", 1).cast("int").alias("nation")


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """Each line of these files with the byte it begins at."""
    return read_lines_with_offset(spark, _customers(spark, d)).select(_nation(), "docno", "line")


def _offset_search(spark: SparkSession, d: str) -> DataFrame:
    """Lines of these files that hold either word, fetched by their offsets."""

    def make() -> str:
        path = fresh_path(spark, "customer-lines")
        search.store_line_index(read_lines_with_offset(spark, _customers(spark, d)), path)
        return path

    index = search.stored_line_index(spark, _once(spark, d, "customer", "customer-lines", make))
    return search.matching_lines(index, "building machinery OR").select(_nation(), "docno", F.col("line").alias("snippet"))


def _line_search(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents, a file for each language and source, that satisfy a query, fetched by their offsets."""

    def make() -> str:
        text, path = fresh_path(spark, "collection"), fresh_path(spark, "lines")
        docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        write_collection(docs, text, ["lang", "source"], ["doc_id", "line_no"])
        search.store_line_index(read_lines_with_offset(spark, text), path)
        return path

    index = search.stored_line_index(spark, _once(spark, d, "documents", "lines", make))
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]*)/", 1).alias(name)
    return search.matching_lines(index, LINES).select(part("lang"), part("source"), "docno", F.col("line").alias("snippet"))


def _arrivals(spark: SparkSession, rows: DataFrame, late: bool) -> tuple[DataFrame, str]:
    """Events that arrive week by week, the latest week first if ``late``, as a stream, and where its query may live."""
    location = fresh_path(spark, "arrivals")
    week = F.date_trunc("week", "ts")
    arrive(rows, f"{location}/in", F.format_string("%05d", 99_999 - F.datediff(week, F.lit("1970-01-01"))) if late else F.date_format(week, "yyyy-MM-dd"))
    return arrivals(spark, f"{location}/in", rows.schema, location), location


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals counted batch by batch, in order of their names."""
    stream, location = _arrivals(spark, _events(spark, d), late=False)
    return batch_counts(stream, location=location)


def _batch_log(spark: SparkSession, d: str) -> DataFrame:
    """What the engine reports of the batches of an hourly count."""
    stream, location = _arrivals(spark, _events(spark, d), late=False)
    log = BatchLog()
    run_available(hourly_count(stream), "hourly", location, log=log)
    return log.table(spark)


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select("ts")


def _spine(spark: SparkSession, d: str) -> DataFrame:
    """Errors by the hour from arrivals that are late, hours without errors included."""
    stream, location = _arrivals(spark, _errors(spark, d), late=True)
    return count_windows(stream, location).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "cnt")


def _window_folders(spark: SparkSession, d: str) -> DataFrame:
    """The folders of the hours that are over."""
    stream, location = _arrivals(spark, _errors(spark, d), late=True)
    count_windows(stream, location)
    return closed_windows(stream, location)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return run_available(hourly_count(stream_of(spark, f"{d}/events*.parquet").select("ts")), "hourly").select("window_start", "cnt")


def _reached(spark: SparkSession, d: str) -> DataFrame:
    """The report of a search: nodes at each distance, and reached so far."""
    sizes = _bfs(spark, d).groupBy("dist").agg(F.count("*").alias("n"))
    return graph.running_total(sizes)


def _log_mass(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "events").where("value > 0").select(F.col("event_type").alias("k"), F.log("value").alias("x"))
    return counting.log_sum_by_key(pairs).select("k", F.round("x", 6).alias("x"))


QUERIES: dict[str, Query] = {
    "word_count": _words,
    "word_count_top20": lambda s, d: counting.top_k(_words(s, d), "cnt", 20, "term"),
    "word_count_imc": _words,
    "kv_lookup": _kv_lookup,
    "kv_bytes": _kv_bytes,
    "bigram_count": lambda s, d: counting.bigram_count(_lines(s, d)),
    "bigram_relfreq_pairs": lambda s, d: counting.bigram_relfreq_pairs(_lines(s, d)),
    "bigram_relfreq_stripes": _relfreq_stripes,
    "cooccur_pairs_w2": lambda s, d: counting.cooccur_pairs(_lines(s, d), 2),
    "cooccur_pairs_w3": lambda s, d: counting.cooccur_pairs(_lines(s, d), 3),
    "cooccur_stripes_w2": _cooccur_stripes,
    "mean_by_key": lambda s, d: counting.int_mean(_kv(s, d)),
    "posting_list": _posts,
    "term_df": lambda s, d: search.term_df(_posts(s, d)),
    "inverted_index": _index,
    "lookup_postings": lambda s, d: search.with_snippets(search.lookup(_stored_posts(s, d), TERM), _snippets_of(s, d)),
    "tf_histogram": lambda s, d: search.tf_histogram(_stored_posts(s, d), TERM),
    **{name: _boolean(name) for name in RPN},
    "index_build": _index_build,
    "graph_edges": edges,
    "graph_stats": lambda s, d: graph.graph_stats(_nodes(s, d)),
    "bfs_distance": _bfs_distance,
    "bfs_frontier_sizes": lambda s, d: _bfs(s, d).groupBy("dist").agg(F.count("*").alias("n")),
    "bfs_reachable": _bfs,
    "bfs_at_distance": lambda s, d: graph.at_distance(_bfs(s, d), 3),
    "bfs_counters": _bfs_counters,
    "bfs_report": _reached,
    "graph_encoded": _encoded,
    "pagerank_5": _log_rank,
    "pagerank_resumed_5": _resumed,
    "pagerank_tolerance": lambda s, d: _log_rank(s, d, steps=None, tolerance=1e-13),
    "pagerank_top20": lambda s, d: counting.top_k(_log_rank(s, d), "logp", 20, "id"),
    "pagerank_copartitioned_5": _bucketed,
    "pagerank_counters": _pagerank_counters,
    "pagerank_personalized_5": _personal,
    "connected_components": lambda s, d: graph.components(edges(s, d)),
    "component_counts": _component_counts,
    "range_partition": _ranges,
    "pagerank_top20_lines": lambda s, d: graph.rank_lines(counting.top_k(_log_rank(s, d), "logp", 20, "id"), "logp"),
    "node_dump": _dump,
    "pagerank_dump": _rank_dump,
    "event_count_hourly": lambda s, d: hourly_count(_events(s, d)),
    "event_count_stream": _event_stream,
    "event_batches": _batches,
    "log_mass": _log_mass,
    "line_offsets": _offsets,
    "offset_search": _offset_search,
    "line_search": _line_search,
    "event_batch_log": _batch_log,
    "event_spine": _spine,
    "window_folders": _window_folders,
    "random_kv": lambda s, d: random_pairs(table(s, d, "events").select(F.col("event_id").alias("id")), 2, 100, seed=7),
}

_TOKENS = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\f]+'), lambda t: regexp_replace(t, '^[^a-z]+|[^a-z]+$', '', 'g')), lambda t: t <> '')"
_DOC = f"with t as (select doc_id, {_TOKENS.format('text')} as t from documents), w as (select doc_id, unnest(t) as term from t)"
_LINE = f"with l as (select unnest(string_split(text, chr(10))) as line from documents), t as (select {_TOKENS.format('line')} as t from l)"
_PAIR = _LINE + ", p as (select t[i] as l, t[i + 1] as r from t, unnest(range(1, len(t))) as u(i))"
_COUNTS = _PAIR + ", c as (select l, r, count(*) as cnt from p group by l, r), m as (select l, sum(cnt)::bigint as total from c group by l)"
_EDGE = "select distinct l_partkey::int as src, l_orderkey::int as dst from lineitem"
_GRAPH = f"e as materialized ({_EDGE}), v as materialized (select src as id from e union select dst from e), n as (select count(*) as n from v), o as materialized (select src, count(*) as deg from e group by src)"


def _cooccur(window: int) -> str:
    return _LINE + f", p as (select t[i] as l, t[i + d] as r from t, unnest(range(1, len(t) + 1)) as u(i), unnest(range(-{window}, {window + 1})) as x(d) where d <> 0 and i + d between 1 and len(t))"


def _snippets(hits: str, extra: str = "") -> str:
    first = "string_split(d.text, chr(10))[1]"
    return f"{_DOC}, h as ({hits}) select h.docno{extra}, case when length({first}) > 80 then substr({first}, 1, 80) || '...' else {first} end as snippet from h join documents d on d.doc_id = h.docno"


def _hits(term: str) -> str:
    return f"select doc_id as docno from w where term = '{term}'"


def _rank_sql(steps: int, prior: str) -> str:
    ctes = [f"r0 as materialized (select id, {prior} as p from v, n)"]
    for i in range(1, steps + 1):
        ctes.append(f"m{i} as materialized (select v.id, coalesce(sum(r.p / o.deg), 0) as m from v left join e on e.dst = v.id left join r{i - 1} r on r.id = e.src left join o on o.src = e.src group by v.id)")
        ctes.append(f"x{i} as materialized (select greatest(0, 1 - sum(m)) as missing from m{i})")
        ctes.append(f"r{i} as materialized (select id, 0.15 * {prior} + 0.85 * (m + missing * {prior}) as p from m{i}, x{i}, n)")
    return f"with {_GRAPH}, {', '.join(ctes)}"


_BFS = f"with recursive e as materialized ({_EDGE}), v as materialized (select src as id from e union select dst from e), b as (select {SOURCE} as id, 0 as d union select e.dst, b.d + 1 from b join e on e.src = b.id where b.d < 30), x as materialized (select id, min(d)::int as dist from b group by id)"
_LABELS = f"e as materialized ({_EDGE}), b as materialized (select src as u, dst as v from e union select dst, src from e), c0 as materialized (select distinct u as id, u as comp from b), " + ", ".join(
    f"c{i} as materialized (select b.u as id, least(min(x.comp), any_value(o.comp))::int as comp from b join c{i - 1} x on x.id = b.v join c{i - 1} o on o.id = b.u group by b.u)" for i in range(1, 21)
)


def _draw(place: int, letter: bool = True) -> str:
    number = f"('0x' || substr(md5('7:{place}:' || id), 1, 12))::bigint"
    return f"substr('{LETTERS}', ({number} % 52 + 1)::int, 1)" if letter else number


_EVEN, _ONE = "1.0::double / n", f"(case when id = {SOURCE} then 1.0 else 0.0 end)::double"

_BEFORE = "(coalesce(sum(octet_length(encode(line)) + 1) over (partition by {0} order by {1} rows between unbounded preceding and 1 preceding), 0))::bigint"
_CUSTOMERS = f"with c as (select c_nationkey as nation, c_custkey, c_mktsegment, c_name || ' ' || c_mktsegment as line from customer), l as (select *, {_BEFORE.format('nation', 'c_custkey')} as docno from c)"
_HOURS = "with c as (select date_trunc('hour', ts) as h, count(*) as n from events where event_type = 'error' group by 1), s as (select x.h, coalesce(c.n, 0) as n from (select unnest(generate_series(min(h), max(h), interval 1 hour)) as h from c) x left join c on c.h = x.h)"

ORACLE: dict[str, str] = {
    "word_count": f"{_DOC} select term, count(*) as cnt from w group by term",
    "word_count_top20": f"{_DOC} select term, count(*) as cnt from w group by term order by cnt desc, term limit 20",
    "word_count_imc": f"{_DOC} select term, count(*) as cnt from w group by term",
    "kv_lookup": f"{_DOC} select term, count(*) as cnt from w where term = '{TERM}' group by term",
    "bigram_count": f"{_PAIR} select l || ' ' || r as bigram, count(*) as cnt from p group by l, r",
    "bigram_relfreq_pairs": f"{_COUNTS} select c.l, r, cnt::double / total as val from c join m on c.l = m.l union all select l, '*', total::double from m",
    "bigram_relfreq_stripes": f"{_COUNTS} select c.l, count(*) as n_keys, max(cnt::double / total) as freq_max, min(r) as r_first, max(r) as r_last from c join m on c.l = m.l group by c.l",
    "cooccur_pairs_w2": f"{_cooccur(2)} select l, r, count(*) as cnt from p group by l, r",
    "cooccur_pairs_w3": f"{_cooccur(3)} select l, r, count(*) as cnt from p group by l, r",
    "cooccur_stripes_w2": f"{_cooccur(2)}, a as (select distinct unnest(t) as l from t) select a.l, count(distinct r) as n_keys, count(r) as total, min(r) as r_first, max(r) as r_last from a left join p on a.l = p.l group by a.l",
    "mean_by_key": "select event_type as k, (sum(floor(value)::int)::bigint // count(*))::int as mean from events group by event_type",
    "posting_list": f"{_DOC} select term, doc_id as docno, count(*) as tf from w group by term, doc_id",
    "term_df": f"{_DOC} select term, count(distinct doc_id) as df from w group by term",
    "inverted_index": f"{_DOC} select term, count(distinct doc_id) as df, min(doc_id) as first_docno, max(doc_id) as last_docno, count(*) as total_tf, true as in_order from w group by term",
    "lookup_postings": _snippets(f"select doc_id as docno, count(*) as tf from w where term = '{TERM}' group by doc_id", ", h.tf"),
    "tf_histogram": f"{_DOC} select tf, count(*) as n_docs from (select count(*) as tf from w where term = '{TERM}' group by doc_id) group by tf",
    "boolean_and": _snippets(f"{_hits('und')} intersect {_hits('la')}"),
    "boolean_or": _snippets(f"{_hits('scum')} union {_hits('trash')}"),
    "boolean_nested": _snippets(f"({_hits('the')} union {_hits('le')}) intersect {_hits('und')}"),
    "graph_edges": _EDGE,
    "graph_stats": f"with {_GRAPH} select (select count(*) from v) as nodes, (select count(*) from e) as edges, (select count(*) from v where id not in (select src from e)) as dangling",
    "bfs_distance": f"{_BFS} select v.id, x.dist from v left join x on v.id = x.id",
    "bfs_frontier_sizes": f"{_BFS} select dist, count(*) as n from x group by dist",
    "bfs_reachable": f"{_BFS} select id, dist from x",
    "bfs_at_distance": f"{_BFS} select id, dist from x where dist = 3",
    "pagerank_5": f"{_rank_sql(5, _EVEN)} select id, round(ln(p), 5) as logp from r5",
    "pagerank_top20": f"{_rank_sql(5, _EVEN)} select id, round(ln(p), 5) as logp from r5 order by logp desc, id limit 20",
    "pagerank_copartitioned_5": f"{_rank_sql(5, _EVEN)} select id, round(ln(p), 5) as logp from r5",
    "pagerank_personalized_5": f"{_rank_sql(5, _ONE)} select id, round(p, 8) as p from r5",
    "connected_components": f"with {_LABELS} select id, comp from c20",
    "component_counts": f"with {_LABELS} select count(distinct comp) as components, count(*) as vertices, (select count(*) from e) as edges from c20",
    "bfs_report": f"{_BFS}, s as (select dist, count(*) as n from x group by dist) select dist, n, sum(n) over (order by dist)::bigint as reached from s",
    "graph_encoded": f"with e as materialized ({_EDGE}), v as (select src as id from e union select dst from e) select v.id, count(e.dst) as degree, coalesce(sum(e.dst), 0)::bigint as total, min(e.dst) as first_dst from v left join e on e.src = v.id group by v.id",
    "pagerank_resumed_5": f"{_rank_sql(5, _EVEN)} select id, round(ln(p), 5) as logp from r5",
    "pagerank_tolerance": f"{_rank_sql(60, _EVEN)} select id, round(ln(p), 5) as logp from r60",
    "kv_bytes": "select upper(hex(encode(event_type))) as k, printf('%08X', floor(value)::int & 4294967295::bigint) as v from events",
    "event_batches": "select row_number() over (order by w) - 1 as batch, cnt, first_ts from (select date_trunc('week', ts) as w, count(*) as cnt, min(ts) as first_ts from events group by 1)",
    "log_mass": "select event_type as k, round(ln(sum(value)), 6) as x from events where value > 0 group by event_type",
    "line_offsets": f"{_CUSTOMERS} select nation, docno, line from l",
    "offset_search": f"{_CUSTOMERS} select nation, docno, line as snippet from l where c_mktsegment in ('BUILDING', 'MACHINERY')",
    "line_search": (
        "with s as (select doc_id, lang, source, string_split(text, chr(10)) as a from documents), l as (select doc_id, lang, source, i, a[i] as line from s, unnest(range(1, len(a) + 1)) as u(i)),"
        f" o as (select lang, source, line, {_BEFORE.format('lang, source', 'doc_id, i')} as docno from l)"
        f" select lang, source, docno, case when length(line) > 80 then substr(line, 1, 80) || '...' else line end as snippet from o where list_has_any({_TOKENS.format('line')}, ['scum', 'trash'])"
    ),
    "index_build": f"{_DOC} select term, count(distinct doc_id) as df from w group by term",
    "bfs_counters": f"{_BFS}, s as (select dist, count(*) as n from x group by dist), m as (select dist + 1 as step, count(*) as sent from e join x on e.src = x.id group by dist) select dist as step, n as frontier, sum(n) over (order by dist)::bigint as reached, coalesce(sent, 0) as sent from s left join m on step = dist",
    "pagerank_counters": _rank_sql(5, _EVEN) + " " + " union all ".join(f"select {i}::int as step, (select count(*) from m{i} where m > 0) as active, (select round(missing, 8) from x{i}) as lost" for i in range(1, 6)),
    "event_batch_log": "with w as (select date_trunc('week', ts) as w, count(*) as n, count(distinct date_trunc('hour', ts)) as h from events group by 1) select row_number() over (order by w) - 1 as batch, n as rows, sum(h) over (order by w)::bigint as state_rows from w",
    "event_spine": f"{_HOURS} select h as window_start, n as cnt from s",
    "window_folders": f"{_HOURS} select strftime(h, '%Y-%m-%dT%H-%M-%S') as \"window\", '(all,' || n || ')' as line from s where h < (select max(h) from s)",
    "random_kv": f"select {_draw(1)} || {_draw(2)} as k, ({_draw(0, False)} % 100)::int as v from (select event_id as id from events)",
    "range_partition": f"with e as ({_EDGE}), v as (select src as id from e union select dst from e) select id, cast(floor(id / (select max(id) + 1 from v)::double * 5) % 5 as int) as part from v",
    "pagerank_top20_lines": f"{_rank_sql(5, _EVEN)} select id, printf('%d', id) || chr(9) || printf('%.5f', logp) as line from (select id, round(ln(p), 5) as logp from r5 order by logp desc, id limit 20)",
    "pagerank_dump": f"{_rank_sql(5, _EVEN)}, a as (select v.id, list_sort(list_filter(list(e.dst), lambda x: x is not null)) as adj from v left join e on e.src = v.id group by v.id) select id, '{{' || id || ' ' || printf('%.4f', ln(p)) || ' [' || array_to_string(list_transform(adj[1:10], lambda x: x::varchar), ', ') || ']}}' as txt from a join r5 using (id)",
    "node_dump": f"with e as ({_EDGE}), v as (select src as id from e union select dst from e), a as (select v.id, list_sort(list_filter(list(e.dst), lambda x: x is not null)) as adj from v left join e on e.src = v.id group by v.id) select id, '{{' || id || ' ' || len(adj) || ' [' || array_to_string(list_transform(adj[1:10], lambda x: x::varchar), ', ') || ']}}' as txt from a",
    "event_count_hourly": "select date_trunc('hour', ts) as window_start, count(*) as cnt from events group by 1",
    "event_count_stream": "select date_trunc('hour', ts) as window_start, count(*) as cnt from events group by 1",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["word_count_top20"](spark, sf_dir)
