"""One runnable query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.functions.strings import preview
from httplens.operators import ingest, keyed, lookup, ordered, replies
from httplens.operators.saved import SavedQueries
from httplens.plans.adhoc import execute, run_sql
from httplens.plans.catalogue import CATALOGUE
from httplens.session import scratch_path
from httplens.sources import clustered, exchanges, export, fixture
from httplens.sources import traffic as store
from httplens.streaming import capture as cap
from httplens.streaming import live

Query = Callable[[SparkSession, str], DataFrame]


def _readable(traffic: DataFrame) -> DataFrame:
    """Time as text, so that engines with other time zones' types compare equal."""
    return traffic.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _over_traffic(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(fixture.traffic(spark, sf_dir))


def _analysis(analysis_id: str) -> Query:
    return _over_traffic(CATALOGUE[analysis_id].run)


# --- sources, sinks, ingest ---------------------------------------------------


def _load(spark, sf_dir):
    path = scratch_path(spark, "traffic")
    fixture.traffic(spark, sf_dir).write.parquet(path)
    return _readable(store.load_traffic(spark, path))


def _normalize(spark, sf_dir):
    return _readable(ingest.normalize(fixture.raw_exchanges(spark, sf_dir)))


def _rejects(spark, sf_dir):
    """Exchanges as JSON texts, some cut short, some with a port that is no number, without an id or without text:
    what became of each."""
    raw = fixture.raw_exchanges(spark, sf_dir)
    sent = raw.select(F.col("id").alias("key"), F.to_json(F.struct(*raw.columns)).alias("json")).select("key", F.expr("""
        CASE key % 6 WHEN 1 THEN left(json, length(json) - 1) WHEN 2 THEN replace(json, '"port":', '"port":"eighty","x":')
                     WHEN 3 THEN replace(json, '"id":', '"nr":') WHEN 4 THEN NULL ELSE json END""").alias("value"))
    kept = exchanges.parse_exchanges(sent).select("id", F.lit("kept").alias("outcome"))
    rejected = exchanges.rejected_exchanges(sent).select(F.col("key").alias("id"), F.col("reason").alias("outcome"))
    return kept.unionByName(rejected)


def _append(spark, sf_dir):
    """GET requests are stored; then everything arrives twice, the repeat a minute later from elsewhere."""
    traffic = fixture.traffic(spark, sf_dir)
    repeat = traffic.withColumn("host", F.lit("repeat.invalid")).withColumn(
        "timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    stored = traffic.where("method = 'GET'").withColumn("host", F.concat(F.lit("stored."), "host"))
    return _readable(ingest.upsert_ignore(stored, repeat.unionByName(traffic)))


def _detail(spark, sf_dir):
    """The messages behind a result: all server errors."""
    traffic = fixture.traffic(spark, sf_dir)
    return lookup.message_detail(traffic, CATALOGUE["E1"].run(traffic, ordered=False))


def _all_details(spark, sf_dir):
    traffic = fixture.traffic(spark, sf_dir)
    return lookup.message_detail(traffic, lookup.default_listing(traffic, limit=None))


def _clustered(spark, sf_dir) -> str:
    path = scratch_path(spark, "clustered")
    clustered.write_clustered(fixture.traffic(spark, sf_dir), path, files=32)
    return path


def _from_files(run: Callable[[SparkSession, str, str], DataFrame], analysis_id: str) -> Query:
    """An analysis over the files that can hold its rows."""
    return lambda spark, sf_dir: run(spark, _clustered(spark, sf_dir), analysis_id)


def _message_files(spark, sf_dir):
    """The largest responses of the panel, looked up one by one."""
    path = _clustered(spark, sf_dir)
    return clustered.messages(spark, path, [r.id for r in clustered.largest_findings(spark, path, "E3").collect()])


def _no_time(spark, sf_dir):
    """Exchanges without a time get that of the batch: one time for all of them, between its start and its end."""
    raw = fixture.raw_exchanges(spark, sf_dir)
    started = spark.range(1).select(F.current_timestamp()).head()[0]
    dated = ingest.normalize(raw.withColumn("ts", F.when(F.col("id") % 2 == 0, F.col("ts"))))
    now = F.col("timestamp").between(F.lit(started), F.current_timestamp())
    return dated.select("id", F.when(F.col("id") % 2 == 0, F.lit("own")).when(now, "now").otherwise("other").alias("time"))


def _csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    traffic = fixture.traffic(spark, sf_dir)
    export.export(traffic, "CSV", path, compression="gzip")
    return _readable(export.read_csv(spark, path, traffic.schema))


def _json(spark, sf_dir):
    path = scratch_path(spark, "json")
    traffic = fixture.traffic(spark, sf_dir)
    export.export(traffic, "JSON", path, compression="gzip")
    return _readable(export.read_json(spark, path, traffic.schema))


def _parquet(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    export.export(_readable(fixture.traffic(spark, sf_dir)), "Parquet", path)
    return spark.read.parquet(path)


_EXPORTED = "SELECT host, method, count(*) AS requests, max(resp_length) AS largest FROM traffic GROUP BY host, method ; \n"


def _export_query(spark, sf_dir):
    path = scratch_path(spark, "export")
    export.export(_EXPORTED, "spreadsheet", path, traffic=fixture.traffic(spark, sf_dir))
    return export.read_csv(spark, path, "host string, method string, requests long, largest int")


def _json_inferred(spark, sf_dir):
    path = scratch_path(spark, "json")
    export.write_json(fixture.table(spark, sf_dir, "documents"), path)
    return export.read_json(spark, path)


def _project(spark, sf_dir):
    path = scratch_path(spark, "projects")
    store.save_project(fixture.traffic(spark, sf_dir).withColumn("project_id", F.lower("method")), path)
    return _readable(store.load_project(spark, path, "post"))


# --- ordered numbering and keyed tables --------------------------------------


def _saved(spark, sf_dir):
    """The documents as a keyed table."""
    return fixture.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("sql_text"))


def _stored(spark, sf_dir) -> SavedQueries:
    """The documents as the stored table, in the order of their ids."""
    table = SavedQueries(spark, scratch_path(spark, "saved"))
    table.append(_saved(spark, sf_dir).drop("id"))
    return table


def _undated(table: SavedQueries) -> DataFrame:
    return table.rows.select("id", "category", "name", "sql_text", F.col("created_at").isNotNull().alias("dated"))


def _stored_appends(spark, sf_dir):
    table = _stored(spark, sf_dir)
    table.append(_suggestions(spark, sf_dir))
    return _undated(table)


def _stored_delete(spark, sf_dir):
    """Every third row is deleted, then the first export is loaded again: no id comes twice."""
    table, path = _stored(spark, sf_dir), scratch_path(spark, "definitions")
    keyed.export_definitions(table.rows, path)
    table.delete(table.rows.where("id % 3 = 0"))
    table.load(path)
    return _undated(table)


def _array_import(spark, sf_dir):
    """Files that hold one array of definitions each, as another program exports them."""
    path = scratch_path(spark, "arrays")
    saved = _saved(spark, sf_dir)
    listed = saved.groupBy(F.floor(F.col("id") / 50).alias("file")).agg(
        F.to_json(F.collect_list(F.struct("category", "name", "sql_text"))).alias("value"))
    listed.select("value", "file").write.partitionBy("file").text(path)
    table = SavedQueries(spark, scratch_path(spark, "saved"))
    table.load(path, multi_line=True)
    return _undated(table)


def _suggestions(spark, sf_dir):
    blocks = replies.suggest(fixture.replies(spark, sf_dir), "md")
    place = F.concat_ws(".", *[F.col(c).cast("string") for c in ("conv_id", "turn", "block_no")])
    return blocks.select("category", place.alias("name"), "sql_text")


def _number(spark, sf_dir):
    items = fixture.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return ordered.number_rows(items, keys, "row_no", unique=False).withColumn(
        "l_shipdate", F.col("l_shipdate").cast("date").cast("string"))


def _append_with_ids(spark, sf_dir):
    return keyed.append_with_ids(_saved(spark, sf_dir), _suggestions(spark, sf_dir))


def _delete(spark, sf_dir):
    toxic = fixture.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return keyed.delete_keys(_saved(spark, sf_dir), toxic)


def _round_trip(spark, sf_dir):
    """Everything is exported and imported again, so that it is there twice."""
    saved, path = _saved(spark, sf_dir), scratch_path(spark, "definitions")
    keyed.export_definitions(saved, path)
    return keyed.import_definitions(saved, path)


# --- chat text ---------------------------------------------------------------


def _previews(spark, sf_dir):
    return fixture.table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


def _http_errors(spark, sf_dir):
    bodies = fixture.responses(spark, sf_dir).withColumn("status", (400 + F.col("conv_id") % 9).cast("int"))
    return replies.http_error(bodies, "status", "json").select("conv_id", "turn", "error")


# --- free SQL and its ordered relatives --------------------------------------

SQL = {
    "Q-0": """
        SELECT id, host, method, path, status_code FROM traffic
        WHERE status_code = 200 AND NOT contains(lower(req_headers), 'authorization')
          AND lower(path) RLIKE 'admin|manager|internal|private|restricted|staff'
        ORDER BY host, path, id;""",
    "Q1": """
        SELECT host, id, resp_length, place FROM (
            SELECT host, id, resp_length,
                   row_number() OVER (PARTITION BY host ORDER BY resp_length DESC, id) AS place
            FROM traffic)
        WHERE place <= 3""",
    "Q3": """
        SELECT host, method, count(*) AS requests FROM traffic GROUP BY ROLLUP (host, method)""",
    "Q4": """
        SELECT DISTINCT path FROM traffic WHERE status_code = 200
        EXCEPT
        SELECT DISTINCT path FROM traffic WHERE contains(lower(req_headers), 'authorization')""",
    "Q6": """
        SELECT id, host, method, path, status_code FROM traffic
        WHERE host IN (SELECT DISTINCT host FROM traffic WHERE status_code >= 500)""",
    "Q7": """
        SELECT id, get_json_object(req_headers, '$.Host') AS header_host,
               get_json_object(req_headers, '$.Authorization') AS authorization
        FROM traffic""",
}


def _sql(text: str) -> Query:
    return _over_traffic(lambda traffic: run_sql(traffic, text))


def _statement(spark, sf_dir):
    """A view made by a statement, then queried."""
    fixture.traffic(spark, sf_dir).createOrReplaceTempView("traffic")
    execute(spark, "CREATE OR REPLACE TEMPORARY VIEW denied AS SELECT * FROM traffic WHERE status_code IN (401, 403);")
    return spark.sql("SELECT host, count(*) AS refusals FROM denied GROUP BY host")


def _micros(column="timestamp"):
    return F.unix_micros(column)


def _gaps(traffic: DataFrame) -> DataFrame:
    """Time since the previous request to the same host."""
    seen = traffic.select("id", "host", _micros().alias("at"))
    gaps = ordered.previous_value(seen, ["host"], ["at", "id"], "at", "before")
    return gaps.where("before IS NOT NULL").select(
        "id", "host", (F.col("at") - F.col("before")).alias("gap_micros"))


def _refused_then_ok(traffic: DataFrame) -> DataFrame:
    """Each refused request with the 200 that followed on the same host and path, and whether that was within the hour."""
    seen = traffic.where("status_code IN (401, 200)").select(
        "id", "host", "path", "status_code", _micros().alias("at"))
    ok = F.when(F.col("status_code") == 200, F.struct("at", "id"))
    following = ordered.next_match(seen, ["host", "path"], ["at", "id"], ok, "ok").where(
        "status_code = 401 AND ok IS NOT NULL")
    after = F.col("ok.at") - F.col("at")
    return following.select(
        "id", "host", "path", F.col("ok.id").alias("ok_id"), after.alias("after_micros"),
        (after <= 3_600_000_000).alias("within_hour"))


def _running(traffic: DataFrame) -> DataFrame:
    seen = traffic.select("id", "host", "timestamp")
    return ordered.running_count(seen, ["host"], ["timestamp", "id"], "requests_so_far").drop("timestamp")


ORDERED = {"Q2": _gaps, "Q5": _refused_then_ok, "Q8": _running}


# --- streaming ----------------------------------------------------------------


def _twice(raw: DataFrame) -> DataFrame:
    """Every exchange delivered twice."""
    return raw.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")


def _in_parts(spark, sf_dir, start: Callable[[DataFrame, str], object], repeats: bool = True, parts: int = 3) -> None:
    """The exchanges arrive in ``parts`` batches; what has arrived comes again with each, a minute later and with other texts."""
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "inbox-checkpoint")
    part = F.pmod("event_id", F.lit(parts))
    for k in range(parts):
        _arrive(spark, sf_dir, part == k, f"{inbox}/own/{k}")
        stream = fixture.raw_stream(spark, sf_dir, f"{inbox}/own")
        if repeats:
            _arrive(spark, sf_dir, part <= k, f"{inbox}/again/{k}")
            again = fixture.raw_stream(spark, sf_dir, f"{inbox}/again")
            stream = stream.unionByName(_a_minute_later(_elsewhere(again)))
        start(stream, checkpoint).awaitTermination()


def _arrive(spark, sf_dir, which, path: str) -> None:
    """The events are put in the inbox; their pages meet them in the stream."""
    events = fixture.table(spark, sf_dir, "events").where(which)
    events.select(*fixture.EVENTS.fieldNames()).write.parquet(path)


def _elsewhere(raw: DataFrame) -> DataFrame:
    return raw.withColumn("host", F.lit("repeat.invalid")).withColumn("path", F.concat(F.lit("/again"), "path"))


def _a_minute_later(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))


def _drain(spark, start: Callable[[str, str], object], label: str) -> str:
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    start(path, checkpoint).awaitTermination()
    return path


def _captured(spark, sf_dir):
    """The stream is captured in parts with repeats, then all of it is sent from the start with other hosts."""
    path = scratch_path(spark, "capture")
    _in_parts(spark, sf_dir, lambda stream, c: cap.capture(stream, path, c, every=None))
    raw = fixture.raw_stream(spark, sf_dir)
    again = raw.withColumn("host", F.lit("repeat.invalid"))
    cap.capture(again, path, scratch_path(spark, "again-checkpoint"), every=None).awaitTermination()
    return _readable(store.load_traffic(spark, path))


def _stored_twice(spark, sf_dir):
    """A third of the messages is stored, then all of them with later repeats under other hosts, in two orders."""
    path, traffic = scratch_path(spark, "stored"), ingest.normalize(fixture.raw_exchanges(spark, sf_dir))
    cap.create_table(spark, path)
    later = traffic.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")).withColumn("host", F.lit("repeat.invalid"))
    cap.store_batch(traffic.where("id % 3 = 0"), path)
    cap.store_batch(later.unionByName(traffic).where("id % 3 < 2"), path)
    cap.store_batch(traffic.unionByName(later), path)
    return _readable(store.load_traffic(spark, path))


def _first_arrivals(spark, sf_dir):
    """Batches bring repeats of their own ids a minute later and of earlier batches' ids at the very same time."""
    path = scratch_path(spark, "first")
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "first-checkpoint")
    part = F.pmod("event_id", F.lit(2))
    for k in range(2):
        _arrive(spark, sf_dir, part == k, f"{inbox}/own/{k}")
        _arrive(spark, sf_dir, part < k, f"{inbox}/earlier/{k}")
        own = fixture.raw_stream(spark, sf_dir, f"{inbox}/own")
        earlier = fixture.raw_stream(spark, sf_dir, f"{inbox}/earlier")
        stream = own.unionByName(_a_minute_later(_elsewhere(own))).unionByName(_elsewhere(earlier))
        cap.keep_first(stream, path, checkpoint, every=None).awaitTermination()
    return _readable(cap.load_first(spark, path))


def _deduplicated(spark, sf_dir):
    stream = cap.deduplicated(_twice(fixture.raw_stream(spark, sf_dir)))
    path = _drain(spark, lambda p, c: cap.append_to(stream, p, c, every=None), "dedup")
    return _readable(store.load_traffic(spark, path))


def _live_timeline(spark, sf_dir):
    traffic = ingest.normalize(fixture.raw_stream(spark, sf_dir))
    path = _drain(spark, lambda p, c: live.live_timeline(traffic, p, c, every=None), "timeline")
    return live.latest_timeline(spark, path)


PANEL_ROWS = {
    "auth_failures": (("path",), "hits"),
    "server_errors": (("host", "path", "status_code"), "hits"),
    "attack_surface": (("method", "host", "path", "response_variants"), "requests"),
    "largest_responses": (("host", "method", "path", "status_code"), "resp_length"),
    "interesting_paths": (("host", "method", "path", "status_code"), "hits"),
    "hosts": (("host", "protocol", "unique_paths", "errors"), "requests"),
    "overview": (("unique_hosts",), "total_requests"),
}


def _panel_views(spark, sf_dir) -> str:
    path, panels = scratch_path(spark, "panel-traffic"), scratch_path(spark, "panels")
    _in_parts(spark, sf_dir, lambda stream, c: live.live_panels(stream, path, panels, c, every=None))
    return panels


def _live_sketches(spark, sf_dir):
    """Whether the number of different paths by united sketches is within four standard errors of the exact one."""
    panels = _panel_views(spark, sf_dir)
    about, exact = live.distinct_paths(spark, panels), live.latest_panel(spark, panels, "hosts").select("host", "protocol", "unique_paths")
    close = F.abs(F.col("about_paths") - F.col("unique_paths")) <= 0.065 * F.col("unique_paths") + 1
    return about.join(exact, ["host", "protocol"]).select("host", "protocol", "requests", close.alias("close"))


def _live_panels(spark, sf_dir):
    """All panels after several batches with repeats, as (panel, label, n)."""
    panels = _panel_views(spark, sf_dir)
    rows = [
        live.latest_panel(spark, panels, name).select(
            F.lit(name).alias("panel"),
            F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]).alias("label"),
            F.col(n).cast("long").alias("n"))
        for name, (keys, n) in PANEL_ROWS.items()]
    first, *rest = rows
    for other in rest:
        first = first.unionByName(other)
    return first


def _joined_findings(df: DataFrame) -> DataFrame:
    return df.withColumn("findings", F.array_join("findings", ","))


def _live_findings(spark, sf_dir):
    stream = live.live_findings(fixture.raw_stream(spark, sf_dir))
    path = _drain(spark, lambda p, c: cap.append_to(stream, p, c, every=None), "findings")
    return _joined_findings(spark.read.schema(stream.schema).parquet(path))


def _alerts(spark, sf_dir):
    """Spans of ten days, as the test events are minutes apart."""
    traffic = ingest.normalize(fixture.raw_stream(spark, sf_dir))
    path = _drain(spark, lambda p, c: live.auth_failure_alerts(
        traffic, p, c, every=None, span="10 days", slide="1 day"), "alerts")
    return live.latest_alerts(spark, path)


def _emitted(spark, sf_dir):
    """The alerts that left the stream, in three batches out of order."""
    path = scratch_path(spark, "emitted")
    _in_parts(spark, sf_dir, lambda stream, c: live.emitted_alerts(
        ingest.normalize(stream), path, c, every=None, span="10 days", slide="1 day", late="4000 days"), repeats=False)
    return live.past_alerts(spark, path).select("since", "host", "path", (F.col("failures") >= 3).alias("reached"))


LIMITED = ("A4", "I3", "I4", "E3", "E5", "O2", "O3", "O4", "O5", "O7", "C1", "C2", "C3", "C4", "C5", "C6", "X3",
           "R5", "S2", "D2", "D3", "D4", "D5", "D6", "M2", "M3", "M5")


# Limited lists in the order of ids.
FIRST = ("O4", "O7", "C1", "C2", "C6", "I4", "O3", "C3", "C4", "C5", "X3")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {i: _analysis(i) for i in CATALOGUE}
    found |= {f"{i}_all": _over_traffic(lambda t, i=i: CATALOGUE[i].run(t, limit=None)) for i in LIMITED}
    found["F1"] = _over_traffic(lambda t: _joined_findings(CATALOGUE["F1"].run(t)))
    found["F2_by_host"] = _over_traffic(lambda t: CATALOGUE["F2"].run(t, by=["host"]))
    found["M6_by_protocol"] = _over_traffic(lambda t: CATALOGUE["M6"].run(t, by=["protocol"]))
    found |= {
        "T-1": _load,
        "T-2": _normalize,
        "T-2_rejects": _rejects,
        "T-3": _append,
        "T-3_indexed": _stored_twice,
        "T-4": _captured,
        "T-5": _all_details,
        "V1": _detail,
        "T-6": _csv,
        "T-7": _json,
        "T-8": _parquet,
        "T-9": _export_query,
        "T-10": _json_inferred,
        "T-11": _over_traffic(lookup.default_listing),
        "T-12": _project,
        "T-2_no_time": _no_time,
        "T-5_files": _message_files,
        **{f"{i}_first": _from_files(clustered.first_findings, i) for i in FIRST},
        **{f"{i}_ranked": _from_files(clustered.largest_findings, i) for i in clustered.RANKINGS},
        "A2_sieved": _over_traffic(lambda t: CATALOGUE["A2"].run(t, sieved=True)),
        "O1_sieved": _over_traffic(lambda t: CATALOGUE["O1"].run(t, sieved=True)),
        "K-1": _number,
        "K-2_stored": _stored_appends,
        "K-4_stored": _stored_delete,
        "K-5_array": _array_import,
        "K-2": _append_with_ids,
        "K-3": lambda spark, sf_dir: keyed.listing(_saved(spark, sf_dir)),
        "K-4": _delete,
        "K-5": _round_trip,
        "K-6": lambda spark, sf_dir: keyed.category_tree(_saved(spark, sf_dir)),
        "K-6_categories": lambda spark, sf_dir: keyed.categories(_saved(spark, sf_dir)),
        "G-1": lambda spark, sf_dir: replies.extract_sql_blocks(fixture.replies(spark, sf_dir), "md"),
        "G-2": lambda spark, sf_dir: fixture.replies(spark, sf_dir).select(
            "conv_id", "turn", replies.looks_like_sql(F.col("md")).alias("is_sql")),
        "G-3": lambda spark, sf_dir: replies.suggest(fixture.replies(spark, sf_dir), "md").select(
            "conv_id", "turn", "block_no", "category", "preview"),
        "G-4": _previews,
        "G-5": lambda spark, sf_dir: replies.normalize_chat_response(
            fixture.responses(spark, sf_dir), "json").select("conv_id", "turn", "content", "error"),
        "G-6": _http_errors,
        "Q-00": _statement,
        "W-1": _deduplicated,
        "W-1_first": _first_arrivals,
        "W-2": _live_timeline,
        "W-3": _live_panels,
        "W-4": _live_findings,
        "W-5": _alerts,
        "W-3_sketches": _live_sketches,
        "W-5_emitted": _emitted,
    }
    found |= {name: _sql(text) for name, text in SQL.items()}
    found |= {name: _over_traffic(run) for name, run in ORDERED.items()}
    return found
