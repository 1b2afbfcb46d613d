"""Queries of formulas, user rules, vectors and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import formulas
from tallyspark.functions import numbers as N
from tallyspark.operators import boq, evaluate, expand, vectors
from tallyspark.plans.bindings import BOUND_RULES, Tables, half_up_sql, money_sql, sum_money_sql, sum_quantity_sql
from tallyspark.plans.registry import indian_sql, query, stamp, stamp_sql
from tallyspark.operators.expand import expand_with
from tallyspark.rules import active_rules, keyword_overrides, literal_table
from tallyspark.session import new_path
from tallyspark.sources import files, snapshots
from tallyspark.streaming import deadlines, live, monitors, runs

# ------------------------------------------------------------------ formulas

FORMULAS = (
    (1, "ceil(l_quantity / 4) * 2"),
    (2, "l_quantity * (1 + l_tax) / l_discount"),
    (3, "sqrt(l_quantity - 10) + 1"),
    (4, "round(l_quantity / 4)"),
    (5, "unknown_name * 2"),
    (6, " 12.5 "),
    (7, "abs(l_discount - l_tax) * floor(l_quantity / 3) ** 2"),
)
_VARIABLES = ("l_quantity", "l_discount", "l_tax")
_FORMULA_SQL = """coalesce(CASE l_linenumber WHEN 1 THEN ceil(l_quantity / 4) * 2
    WHEN 2 THEN l_quantity * (1 + l_tax) / nullif(l_discount, 0.0)
    WHEN 3 THEN CASE WHEN l_quantity >= 10 THEN sqrt(l_quantity - 10) + 1 END
    WHEN 4 THEN round_even(l_quantity / 4, 0) WHEN 5 THEN 0.0 WHEN 6 THEN 12.5
    WHEN 7 THEN abs(l_discount - l_tax) * pow(floor(l_quantity / 3), 2) END, 0.0)"""


def _with_formula(t: Tables):
    table = literal_table(t.spark, FORMULAS, "l_linenumber int, formula string")
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *_VARIABLES)
    return rows.join(table, "l_linenumber"), formulas.distinct_formulas(table, "formula")


@query(
    "u01_formulas",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({_FORMULA_SQL} AS DOUBLE) AS quantity FROM lineitem""",
)
def _(t: Tables):
    rows, texts = _with_formula(t)
    value = formulas.evaluate(F.col("formula"), texts, {v: F.col(v) for v in _VARIABLES})
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), value.alias("quantity"))


@query(
    "u02_chained_formulas",
    """SELECT l_orderkey, 2 * (l_quantity + l_linenumber) AS perimeter, 2 * (l_quantity + l_linenumber) * 8 AS gypsum,
    ceil(2 * (l_quantity + l_linenumber) * 8 / 32) AS boards, 0.0::DOUBLE AS loop_a, 'loop_a,loop_b' AS errors FROM lineitem""",
)
def _(t: Tables):
    definitions = {
        "boards": "ceil(gypsum / 32)",
        "gypsum": "perimeter * 8",
        "perimeter": "2 * (l_quantity + l_linenumber)",
        "loop_a": "loop_b + 1",
        "loop_b": "loop_a + 1",
    }
    rows = t.raw("lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    chained = formulas.with_chained(rows, definitions, ["l_quantity", "l_linenumber"])
    return chained.select(
        "l_orderkey", "perimeter", "gypsum", "boards", "loop_a", F.array_join("formula_errors", ",").alias("errors")
    )


_ESTIMATE_SQL = f"""estimates AS (SELECT o_custkey AS fixture, {money_sql(sum_quantity_sql(f'{_FORMULA_SQL} * l_extendedprice'))} AS estimate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


def _estimates(t: Tables):
    rows, texts = _with_formula(t)
    orders = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("fixture"))
    items = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("rate", F.col("l_extendedprice"))
    return evaluate.budget_estimates(items, texts, {v: F.col(v) for v in _VARIABLES})


@query("a14_budget_estimates", f"WITH {_ESTIMATE_SQL} SELECT * FROM estimates")
def _(t: Tables):
    return _estimates(t)


@query(
    "a15_budget_verdicts",
    f"""WITH {_ESTIMATE_SQL}, scaled AS (SELECT fixture, estimate, CAST(round_even(estimate, 0) AS BIGINT) AS estimated,
      CAST(round_even(6251940.0::DOUBLE * ((fixture % 2000 + 100.5) / 1900.0), 0) AS BIGINT) AS scaled_estimate FROM estimates),
    bands AS (SELECT *, CAST(trunc(scaled_estimate * 0.4::DOUBLE) AS BIGINT) AS scaled_low, CAST(trunc(scaled_estimate * 1.6::DOUBLE) AS BIGINT) AS scaled_high FROM scaled)
    SELECT fixture, estimated, scaled_estimate, scaled_low, scaled_high, CASE WHEN estimate BETWEEN 2500000 AND 5000000 THEN 'in range'
      WHEN estimate BETWEEN scaled_low AND scaled_high THEN 'in scaled range' ELSE 'out of range' END AS verdict FROM bands""",
)
def _(t: Tables):
    estimates = _estimates(t).withColumns(
        {
            "area": F.col("fixture") % 2000 + 100.5,
            "low_budget": F.lit(2_500_000.0),
            "high_budget": F.lit(5_000_000.0),
        }
    )
    return evaluate.budget_verdicts(estimates).drop("area", "low_budget", "high_budget", "estimate")


@query(
    "u03_user_rules",
    f"""WITH rows AS (SELECT p_partkey AS id, p_name || '-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS key, p_type AS object_type, p_brand || ' work' AS trade,
      CASE WHEN p_size % 2 = 0 THEN 'nos' ELSE 'sft' END AS unit, p_retailprice AS rate, p_name AS material,
      CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 1) || ', ' || upper(split_part(p_name, ' ', 2)) END AS keywords
      FROM part WHERE p_size % 5 <> 0 AND p_size < 25),
    active AS (SELECT object_type, arg_min(rate, key) AS rate, arg_min(unit, key) AS unit, arg_min(trade, key) AS trade FROM rows GROUP BY 1),
    words AS (SELECT id * 1000 AS priority, split_part(lower(keywords), ', ', 1) AS word, * FROM rows WHERE keywords IS NOT NULL
      UNION ALL SELECT id * 1000 + 1, split_part(lower(keywords), ', ', 2), * FROM rows WHERE keywords IS NOT NULL),
    best AS (SELECT label AS olabel, arg_min(unit, priority) AS ounit, arg_min(rate, priority) AS orate, arg_min(trade, priority) AS otrade
      FROM (SELECT DISTINCT label FROM objects) JOIN words ON contains(lower(label), word) GROUP BY 1),
    priced AS (SELECT project_id, coalesce(otrade, trade) AS trade, coalesce(ounit, unit) AS unit, coalesce(orate, rate) AS rate,
      CASE WHEN coalesce(ounit, unit) = 'nos' THEN 1 ELSE {half_up_sql('CASE WHEN quantity_estimate > 0 THEN quantity_estimate ELSE 1.0 END')} END AS quantity
      FROM objects JOIN active USING (object_type) LEFT JOIN best ON object_type = 'STANDARD' AND olabel = label)
    SELECT project_id, trade, CAST(count(*) AS BIGINT) AS count, {sum_money_sql(money_sql('quantity * rate'))} AS total FROM priced GROUP BY 1, 2""",
    ("objects",),
)
def _(t: Tables):
    first, second = (F.get(F.split("p_name", " "), F.lit(i)) for i in (0, 1))
    table = t.raw("part").select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("key"),
        F.col("p_type").alias("object_type"),
        F.concat("p_brand", F.lit(" work")).alias("trade"),
        F.when(F.col("p_size") % 2 == 0, "nos").otherwise("sft").alias("unit"),
        F.col("p_retailprice").alias("rate"),
        F.col("p_name").alias("material"),
        F.when(F.col("p_size") % 4 == 0, F.concat(first, F.lit(", "), F.upper(second))).alias("keywords"),
        (F.col("p_size") % 5 != 0).alias("active"),
        F.when(F.col("p_size") < 25, "v2").otherwise("v1").alias("ruleset_version"),
    )
    lines = expand.expand_lines(
        t.objects, active_rules(table, "v2"), keyword_overrides(table, "v2"), "STANDARD", "v2"
    )
    return boq.trade_summary(lines)


@query(
    "p26_context_lines",
    f"""SELECT project_id, trade || ': ₹' || {indian_sql(f"CAST({half_up_sql('total')} AS VARCHAR)")} || ' (' || n || ' items)' AS line
    FROM (SELECT project_id, trade, {sum_money_sql('total')} AS total, count(*) AS n FROM lines GROUP BY 1, 2)""",
    ("lines",),
)
def _(t: Tables):
    amount = N.indian_digits(F.col("total"), rounded=True)
    return boq.trade_summary(t.lines).select(
        "project_id",
        F.concat("trade", F.lit(": ₹"), amount, F.lit(" ("), F.col("count").cast("string"), F.lit(" items)")).alias("line"),
    )


# ------------------------------------------------------------------ vectors


@query(
    "v01_nearest_exact",
    """WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
    centres AS (SELECT label AS query_id, dim, avg(x) AS c FROM cells GROUP BY 1, 2),
    lengths AS (SELECT query_id, sqrt(sum(c * c)) AS qn FROM centres GROUP BY 1),
    norms AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM cells GROUP BY 1),
    scored AS (SELECT query_id, vec_id, floor(sum(c * x) / any_value(qn) / any_value(vn) * 1e6 + 0.5) / 1e6 AS similarity
      FROM cells JOIN centres USING (dim) JOIN lengths USING (query_id) JOIN norms USING (vec_id) GROUP BY 1, 2)
    SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, similarity, rank FROM (SELECT *,
      row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""",
)
def _(t: Tables):
    catalogue = t.raw("embeddings")
    return vectors.nearest_exact(vectors.class_centres(catalogue), catalogue.select("vec_id", "embedding"), 10)


@query("v02_nearest_approximate")
def _(t: Tables):
    catalogue = t.raw("embeddings")
    return vectors.nearest_approximate(vectors.class_centres(catalogue), catalogue.select("vec_id", "embedding"), 10)


# ------------------------------------------------------------------ streams

_LAST_SQL = """last AS (SELECT boq_item_id, arg_max(total, (ts, event_id)) FILTER (WHERE total IS NOT NULL) AS total,
    arg_max(rate, (ts, event_id)) FILTER (WHERE rate IS NOT NULL) AS rate,
    arg_max(material_name, (ts, event_id)) FILTER (WHERE material_name IS NOT NULL) AS material_name FROM changes GROUP BY 1)"""


def _stream(t: Tables, name: str):
    # a glob, so that one file is taken as well as a folder of files
    return runs.read_stream(t.spark, t.path(name) + "*", t.raw(name).schema)


def _event_stream(t: Tables):
    return _stream(t, "events")


def _late_events(t: Tables):
    """Events in deliveries of ten days, some up to three days late: rows of a key arrive out of order."""
    events = t.raw("events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 4) * 86_400_000_000
    far = F.max("ts") + F.expr("INTERVAL 60 DAYS")
    minus = {"event_id": F.lit(-4).cast("long"), "ts": far, "user_id": F.lit(-1).cast("long"), "event_type": F.lit("heartbeat")}
    heartbeat = events.agg(*[minus.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    return runs.delivered(events, F.floor(us / 864_000_000_000), heartbeat, "events")


LATE = "14 days"  # a delivery and its delay, however many files it comes in
DAY = 86_400.0


def _live_bill(t: Tables):
    return t.bill.select("id", "project_id", "total", "rate", "material_name")


@query(
    "st01_live_lines",
    f"""WITH {_LAST_SQL} SELECT b.id, b.project_id, coalesce(l.total, b.total) AS total, coalesce(l.rate, b.rate) AS rate,
    coalesce(l.material_name, b.material_name) AS material_name FROM bill b LEFT JOIN last l ON l.boq_item_id = b.id""",
    ("changes", "bill"),
)
def _(t: Tables):
    stream = live.last_values(t.as_changes(_event_stream(t)))
    return live.live_lines(_live_bill(t), runs.drained(stream, "lines", ["boq_item_id"]))


@query(
    "st01_last_values",
    f"WITH {_LAST_SQL} SELECT * FROM last",
    ("changes",),
)
def _(t: Tables):
    return live.last_values(t.changes)


@query(
    "st02_live_totals",
    f"""WITH {_LAST_SQL} SELECT b.project_id, {sum_money_sql('coalesce(l.total, b.total)')} AS total, CAST(count(*) AS BIGINT) AS lines
    FROM bill b LEFT JOIN last l ON l.boq_item_id = b.id GROUP BY 1""",
    ("changes", "bill"),
)
def _(t: Tables):
    lines = _live_bill(t)
    handle, root = live.total_batches(lines, "live", rows_per_bucket=10_000)
    runs.drain(live.last_values(t.as_changes(_event_stream(t))), "totals", "update", handle)
    return live.current_totals(lines, root)


@query(
    "j15_events_on_lines",
    """SELECT c.event_id, c.boq_item_id, c.total, c.rate, c.material_name, b.project_id, b.total AS current_total
    FROM changes c LEFT JOIN bill b ON b.id = c.boq_item_id""",
    ("changes", "bill"),
)
def _(t: Tables):
    joined = live.events_on_lines(t.as_changes(_event_stream(t)), t.bill)
    return runs.appended(joined.drop("ts"), "events-on-lines")


_RATES_SQL = f"""SELECT {stamp_sql("time_bucket(INTERVAL '5 minutes', ts)")} AS window_start, CAST(count(*) AS BIGINT) AS calls,
    CAST(count_if(failed) AS BIGINT) AS failures, count_if(failed) / count(*) AS failure_rate,
    CASE WHEN count_if(failed) / count(*) > 0.30 THEN 'critical' WHEN count_if(failed) / count(*) > 0.10 THEN 'warning' ELSE 'ok' END AS level
    FROM log GROUP BY 1"""


@query("st03_failure_rates", _RATES_SQL, ("log",))
def _(t: Tables):
    stream = monitors.failure_rates(t.as_log(_event_stream(t)))
    return runs.drained(stream, "failures", ["window_start"]).withColumn("window_start", stamp("window_start"))


@query("st03_failure_rates_batch", _RATES_SQL, ("log",))
def _(t: Tables):
    return monitors.failure_rates(t.log).withColumn("window_start", stamp("window_start"))


@query(
    "st04_latency_percentiles",
    f"""SELECT window_start, route, calls, error_rate, floor(p95 * 10000 + 0.5) / 10000.0 AS p95, floor(p99 * 10000 + 0.5) / 10000.0 AS p99,
    CASE WHEN p99 > 10 THEN 'critical' WHEN p99 > 5 THEN 'warning' ELSE 'ok' END AS level, p95 < 2 AND error_rate < 0.10 AS slo_met FROM (
      SELECT {stamp_sql("time_bucket(INTERVAL '1 day', ts)")} AS window_start, route, CAST(count(*) AS BIGINT) AS calls,
      count_if(failed) / count(*) AS error_rate, quantile_cont(floor(latency / 0.01 + 0.5) * 0.01::DOUBLE, 0.95) AS p95,
      quantile_cont(floor(latency / 0.01 + 0.5) * 0.01::DOUBLE, 0.99) AS p99 FROM log GROUP BY 1, 2)""",
    ("log",),
)
def _(t: Tables):
    alerts = monitors.latency_alerts(monitors.latency_percentiles(t.log, "1 day"))
    short = {c: (F.floor(F.col(c) * 10000 + 0.5) / 10000.0).cast("double") for c in ("p95", "p99")}
    return alerts.withColumns({**short, "window_start": stamp("window_start")})


@query(
    "st04_latency_stream",
    f"""SELECT {stamp_sql("time_bucket(INTERVAL '1 hour', ts)")} AS window_start, route, CAST(count(*) AS BIGINT) AS calls,
    quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99 FROM log GROUP BY 1, 2""",
    ("log",),
)
def _(t: Tables):
    stream = monitors.latency_sketch(t.as_log(_event_stream(t)))
    return runs.drained(stream, "latency", ["window_start", "route"]).withColumn("window_start", stamp("window_start"))


@query(
    "st05_over_limit",
    f"""SELECT {stamp_sql("time_bucket(INTERVAL '1 minute', ts)")} AS window_start, key, CAST(count(*) AS BIGINT) AS requests
    FROM (SELECT ts, route AS key FROM log) GROUP BY 1, 2 HAVING count(*) > 1""",
    ("log",),
)
def _(t: Tables):
    log = t.as_log(_event_stream(t)).select("ts", F.col("route").alias("key"))
    stream = monitors.over_limit(log, 1)
    return runs.drained(stream, "limits", ["window_start", "key"]).withColumn("window_start", stamp("window_start"))


@query(
    "st05_over_limit_sliding",
    f"""SELECT {stamp_sql('w')} AS window_start, key, CAST(count(*) AS BIGINT) AS requests FROM (
      SELECT route AS key, time_bucket(INTERVAL '10 seconds', ts) - to_seconds(10 * k) AS w FROM log, range(6) r(k)) GROUP BY 1, 2 HAVING count(*) > 1""",
    ("log",),
)
def _(t: Tables):
    log = t.as_log(_event_stream(t)).select("ts", F.col("route").alias("key"))
    stream = monitors.over_limit(log, 1, slide="10 seconds")
    return runs.drained(stream, "sliding", ["window_start", "key"]).withColumn("window_start", stamp("window_start"))


BUDGET = deadlines.polling_budget()


@query(
    "st06_readiness",
    f"""SELECT drawing_id, {stamp_sql('started')} AS started, CASE WHEN fin <= started + to_microseconds(307171875) THEN status ELSE 'timeout' END AS outcome,
    CASE WHEN fin <= started + to_microseconds(307171875) THEN {stamp_sql('fin')} END AS finished FROM (
      SELECT drawing_id, min(ts) AS started, min(CASE WHEN status IN ('processed','detected','error') THEN ts END) AS fin,
      arg_min(status, (ts, status)) FILTER (WHERE status IN ('processed','detected','error')) AS status FROM reports GROUP BY 1)""",
    ("reports",),
)
def _(t: Tables):
    done = deadlines.readiness(t.reports, BUDGET)
    return done.withColumns({c: stamp(c) for c in ("started", "finished")})


@query(
    "st06_readiness_stream",
    """SELECT drawing_id, CASE WHEN fin <= started + to_microseconds(307171875) THEN status ELSE 'timeout' END AS outcome FROM (
      SELECT drawing_id, min(ts) AS started, min(CASE WHEN status IN ('processed','detected','error') THEN ts END) AS fin,
      arg_min(status, (ts, status)) FILTER (WHERE status IN ('processed','detected','error')) AS status FROM reports GROUP BY 1)""",
    ("reports",),
)
def _(t: Tables):
    runs.use_rocksdb(t.spark)
    stream = deadlines.readiness_stream(t.as_reports(_late_events(t)), BUDGET, delay=LATE, forget_seconds=40 * DAY)
    return runs.appended(stream, "readiness").where("drawing_id >= 0")


@query(
    "st07_stuck_work",
    f"""SELECT key, event_id, {stamp_sql('ts')} AS ts, {stamp_sql('next_ts')} AS next_ts FROM (
      SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS next_ts FROM log)
    WHERE route = 'signup' AND (next_ts IS NULL OR next_ts > ts + to_minutes(5))""",
    ("log",),
)
def _(t: Tables):
    stuck = deadlines.stuck_work(t.log.withColumnRenamed("route", "status"), "signup")
    return stuck.withColumns({c: stamp(c) for c in ("ts", "next_ts")})


@query(
    "st07_stuck_work_stream",
    """SELECT key, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS next_ts FROM log)
    WHERE route = 'signup' AND (next_ts IS NULL OR next_ts > ts + to_minutes(5))""",
    ("log",),
)
def _(t: Tables):
    runs.use_rocksdb(t.spark)
    log = t.as_log(_late_events(t)).select("key", "event_id", F.col("route").alias("status"), "ts")
    return runs.appended(deadlines.stuck_work_stream(log, "signup", delay=LATE), "stuck")


@query(
    "st08_first_uploads",
    "SELECT DISTINCT sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents",
)
def _(t: Tables):
    uploads = t.raw("documents").select(
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("length"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"),
        F.col("doc_id").alias("path"),
    )
    stream = runs.delivered(uploads, F.col("path") % 3, uploads.limit(0), "uploads")
    handle, root = monitors.upload_batches(t.spark, uploads.schema, "uploads", rows_per_bucket=10_000)
    runs.drain(stream, "uploads", "append", handle)
    return snapshots.read(t.spark, root, "uploads").select("sha256", "length")


@query(
    "st09_reexpand",
    f"""WITH newer AS (SELECT DISTINCT drawing_id FROM objects WHERE drawing_id % 3 = 0 AND length(label) % 2 = 0)
    SELECT project_id, {sum_money_sql('total')} AS total, CAST(count(*) AS BIGINT) AS lines FROM lines
    WHERE drawing_id NOT IN (FROM newer) OR length(label) % 2 = 0 GROUP BY 1""",
    ("objects", "lines"),
)
def _(t: Tables):
    """Every drawing is uploaded, then a third of them again with other objects, which replace the first ones."""
    first = t.objects.withColumn("upload_id", F.lit(0).cast("long"))
    delivered = new_path(t.spark, "delivered-uploads")
    runs.deliver(first, delivered, by=["id"])
    again = t.spark.read.schema(first.schema).parquet(delivered).where((F.col("drawing_id") % 3 == 0) & (F.length("label") % 2 == 0))
    runs.deliver(again.withColumn("upload_id", F.lit(1).cast("long")), delivered, by=["id"])
    uploads = runs.read_stream(t.spark, delivered, first.schema, files_per_batch=runs.DELIVERY_FILES)
    handle, path = live.expand_batches(t.spark, lambda batch: expand_with(batch, BOUND_RULES), "reexpand")
    runs.drain(uploads, "reexpand", "append", handle)
    lines = live.current_lines(t.spark, path, t.lines.schema)
    return live.live_totals(lines)


@query(
    "st10_breaker_stream",
    f"""WITH breaks AS (SELECT *, NOT failed OR ts > lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) + to_hours(60) AS anew FROM log),
    islands AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS island FROM breaks)
    SELECT key, {stamp_sql('(list(ts ORDER BY ts, event_id))[3]')} AS opened FROM islands WHERE failed GROUP BY key, island HAVING count(*) >= 3""",
    ("log",),
)
def _(t: Tables):
    runs.use_rocksdb(t.spark)
    log = t.as_log(_late_events(t)).select("key", "event_id", "failed", "ts")
    stream = deadlines.breaker_stream(log, delay=LATE, forget_seconds=2.5 * DAY)
    return runs.appended(stream, "breaker").withColumn("opened", stamp("opened"))
