"""Windows and stateful streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import progress
from lectern.plans import banks
from lectern.plans.bindings import attempts, table
from lectern.plans.registry import registry
from lectern.streaming import limits, run, state, windows

QUERIES, ORACLES, register = registry()
_TUMBLING = """SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""


@register(_TUMBLING)
def tumbling(spark, sf):
    return windows.windowed(windows.with_event_time(table(spark, sf, "events")), "1 day", None, ["event_type"], "value")


@register("""WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * k) AS s, event_type, value FROM events, (VALUES (0), (1)) v(k))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def sliding(spark, sf):
    return windows.windowed(windows.with_event_time(table(spark, sf, "events")), "12 hours", "6 hours", ["event_type"], "value")


@register("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS b FROM events),
g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS session_start, user_id, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, sf):
    return windows.sessions(windows.with_event_time(table(spark, sf, "events")), "8 hours", ["user_id"])


@register(_TUMBLING)
def stream_tumbling(spark, sf):
    events = windows.with_event_time(run.read_stream(spark, f"{sf}/events.parquet"), delay="60 days")
    return run.last_updates(windows.windowed(events, "1 day", None, ["event_type"], "value"), ["window_start", "event_type"])


@register(banks.ORACLES["attempt_progress"])
def stream_progress(spark, sf):
    e = run.read_stream(spark, f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "correct").when(F.col("event_type") == "error", "incorrect").when(F.col("event_type") == "view", "completed").otherwise("add")
    e = e.select((k * 2 + F.col("user_id") % 2).alias("question_id"), kind.alias("kind"), "ts", "event_id")
    return run.last_updates(progress.progress(e), ["question_id"]).select("question_id", "attempts", "correct_count", "wrong_count", "status", "last_result")


@register(banks.ORACLES["srs_state"])
def stream_srs(spark, sf):
    e = run.read_stream(spark, f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "correct").when(F.col("event_type") == "error", "incorrect").when(F.col("event_type") == "view", "completed").otherwise("add")
    e = e.select((k * 2 + F.col("user_id") % 2).alias("question_id"), kind.alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    s = run.last_updates(state.srs_stream(e), ["question_id"])
    return s.select("question_id", "srs_level", "times_wrong", F.date_format(F.timestamp_micros("next_us"), "yyyy-MM-dd HH:mm:ss").alias("next_review_at"))


_CALLS = "x AS (SELECT user_id % 20 AS caller, epoch_us(ts) // 2000 AS us, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_us(ts) // 2000, event_id) AS k FROM events)"


@register(f"""WITH RECURSIVE {_CALLS},
r AS (SELECT caller, 0::BIGINT AS us, 0::BIGINT AS event_id, 0::BIGINT AS k, []::BIGINT[] AS recent, -1::BIGINT AS day, 0::BIGINT AS used, '' AS verdict FROM (SELECT DISTINCT caller FROM x)
  UNION ALL SELECT caller, us, event_id, k, CASE WHEN v = 'ok' THEN list_append(w, us) ELSE w END, d, u + (v = 'ok')::BIGINT, v FROM (
    SELECT *, CASE WHEN len(w) >= 15 THEN 'minute' WHEN u >= 300 THEN 'day' ELSE 'ok' END AS v FROM (
      SELECT x.caller, x.us, x.event_id, x.k, x.us // 86400000000 AS d, CASE WHEN x.us // 86400000000 = r.day THEN list_filter(r.recent, lambda t: t > x.us - 60000000) ELSE [] END AS w, CASE WHEN x.us // 86400000000 = r.day THEN r.used ELSE 0 END AS u
      FROM r JOIN x ON x.caller = r.caller AND x.k = r.k + 1))),
f AS (SELECT *, count(*) FILTER (verdict = 'ok') OVER (PARTITION BY day ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - (verdict = 'ok')::INT AS before FROM r WHERE k > 0)
SELECT caller, us, event_id AS call_id, CASE WHEN before >= 900 THEN 'global' ELSE verdict END AS verdict FROM f""")
def rate_limit(spark, sf):
    e = table(spark, sf, "events")
    # a month of events in minutes, so that limits bite
    us = F.expr("unix_micros(cast(ts as timestamp)) div 2000")
    return state.rate_limited(e.select((F.col("user_id") % 20).alias("caller"), us.alias("us"), F.col("event_id").alias("call_id")), 15, 300, 900)


@register(f"""WITH RECURSIVE {_CALLS}, y AS (SELECT caller, us, event_id, k, event_id % 400 AS tokens, CASE WHEN event_id % 37 = 0 THEN event_id % 400 WHEN event_id % 41 = 0 THEN 0 END AS retry FROM x),
r AS (SELECT caller, 0::BIGINT AS us, 0::BIGINT AS event_id, 0::BIGINT AS k, []::BIGINT[] AS recent, -1::BIGINT AS day, 0::BIGINT AS req, 0::BIGINT AS tok, 0::BIGINT AS until, false AS gone, '' AS verdict FROM (SELECT DISTINCT caller FROM y)
  UNION ALL SELECT caller, us, event_id, k, CASE WHEN v = 'ok' AND retry IS NULL THEN list_append(w, us) ELSE w END, d, q + (v = 'ok' AND retry IS NULL)::BIGINT, t + CASE WHEN v = 'ok' AND retry IS NULL THEN tokens ELSE 0 END,
    CASE WHEN v <> 'ok' THEN c WHEN retry IS NULL THEN 0 ELSE us + greatest(1, least(CASE retry WHEN 0 THEN 20 ELSE retry END, 3600)) * 1000000 END, g OR (v = 'ok' AND coalesce(retry, 0) > 300), v FROM (
    SELECT *, CASE WHEN us < c THEN 'cooldown' WHEN g THEN 'server' WHEN q >= 120 THEN 'requests' WHEN t >= 20000 THEN 'tokens' WHEN len(w) >= 9 THEN 'minute' ELSE 'ok' END AS v FROM (
      SELECT y.caller, y.us, y.event_id, y.k, y.tokens, y.retry, y.us // 86400000000 AS d, same, CASE WHEN same THEN list_filter(r.recent, lambda t: t > y.us - 60000000) ELSE [] END AS w, CASE WHEN same THEN r.req ELSE 0 END AS q,
        CASE WHEN same THEN r.tok ELSE 0 END AS t, CASE WHEN same THEN r.until ELSE 0 END AS c, same AND r.gone AS g
      FROM (SELECT r.*, y.us // 86400000000 = r.day AS same FROM r JOIN y ON y.caller = r.caller AND y.k = r.k + 1) r JOIN y ON y.caller = r.caller AND y.k = r.k + 1)))
SELECT caller AS model, us, event_id AS call_id, verdict FROM r WHERE k > 0""")
def model_quota(spark, sf):
    us, k = F.expr("unix_micros(cast(ts as timestamp)) div 2000"), F.col("event_id")
    retry = F.when(k % 37 == 0, k % 400).when(k % 41 == 0, 0)
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("model"), us.alias("us"), k.alias("call_id"), (k % 400).alias("tokens"), retry.alias("retry_s"))
    return state.quota_ledger(e, 9, 120, 20_000)


@register(ORACLES["rate_limit"].replace("CASE WHEN before >= 900 THEN 'global' ELSE verdict END", "verdict"))
def stream_rate_limit(spark, sf):
    us = F.expr("unix_micros(cast(ts as timestamp)) div 2000")
    calls = table(spark, sf, "events").select((F.col("user_id") % 20).alias("caller"), us.alias("us"), F.col("event_id").alias("call_id"))
    return run.appended(limits.rate_limited_stream(spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(run.staged(calls, ["us"], 3))))


@register(ORACLES["model_quota"])
def stream_model_quota(spark, sf):
    us, k = F.expr("unix_micros(cast(ts as timestamp)) div 2000"), F.col("event_id")
    retry = F.when(k % 37 == 0, k % 400).when(k % 41 == 0, 0)
    calls = table(spark, sf, "events").select((F.col("user_id") % 20).alias("model"), us.alias("us"), k.alias("call_id"), (k % 400).alias("tokens"), retry.alias("retry_s"))
    return run.appended(limits.quota_stream(spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(run.staged(calls, ["us"], 3)), 9, 120, 20_000))


_MATRIX = {"simple": {"short": "s1", "medium": "m1", "long": "l1"}, "standard": {"short": "m1", "medium": "q1", "long": "q1"}, "deep": {"short": "d1", "medium": "d1", "long": "gone"}}


@register("""WITH x AS (SELECT event_id, ['simple', 'standard', 'deep', 'odd', NULL][event_id % 5 + 1] AS a, ['short', 'medium', 'long', 'odd'][event_id % 4 + 1] AS b FROM events),
y AS (SELECT event_id, CASE WHEN a IN ('simple', 'standard', 'deep') THEN a ELSE 'standard' END AS a, CASE WHEN b IN ('short', 'medium', 'long') THEN b ELSE 'medium' END AS b FROM x)
SELECT event_id, CASE WHEN a = 'simple' THEN CASE b WHEN 'short' THEN 's1' WHEN 'medium' THEN 'm1' ELSE 'l1' END WHEN a = 'standard' THEN CASE b WHEN 'short' THEN 'm1' ELSE 'q1' END ELSE CASE b WHEN 'long' THEN 's1' ELSE 'd1' END END AS wanted FROM y""")
def intent_route(spark, sf):
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % m + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", pick(["simple", "standard", "deep", "odd", None], 5).alias("complexity"), pick(["short", "medium", "long", "odd"], 4).alias("length"))
    return state.intent(e, _MATRIX, ["s1", "m1", "l1", "q1", "d1"]).select("event_id", "wanted")


@register("""WITH RECURSIVE x AS (SELECT user_id AS key, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT key, us, event_id, k, us AS stored, false AS hit FROM x WHERE k = 1
  UNION ALL SELECT x.key, x.us, x.event_id, x.k, CASE WHEN x.us - r.stored < 21600000000 THEN r.stored ELSE x.us END, x.us - r.stored < 21600000000 FROM r JOIN x ON x.key = r.key AND x.k = r.k + 1)
SELECT key, us, event_id AS request_id, hit FROM r""")
def ttl_cache(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("request_id"))
    return state.cached(e)


@register("""WITH RECURSIVE x AS (SELECT user_id AS key, epoch_us(ts) // 20 AS us, event_id, row_number() OVER (ORDER BY epoch_us(ts) // 20, event_id) AS k FROM events),
r AS (SELECT 0::BIGINT AS key, 0::BIGINT AS us, 0::BIGINT AS event_id, 0::BIGINT AS k, []::STRUCT(key BIGINT, us BIGINT)[] AS held, false AS hit
  UNION ALL SELECT key, us, event_id, k, CASE WHEN v THEN held ELSE list_append(CASE WHEN len(rest) >= 100 THEN rest[2:] ELSE rest END, {'key': key, 'us': us}) END, v FROM (
    SELECT x.key, x.us, x.event_id, x.k, r.held, list_filter(r.held, lambda e: e.key <> x.key) AS rest, len(list_filter(r.held, lambda e: e.key = x.key AND x.us - e.us < 21600000000)) > 0 AS v FROM r JOIN x ON x.k = r.k + 1))
SELECT key, us, event_id AS request_id, hit FROM r WHERE k > 0""")
def capped_cache(spark, sf):
    # a month of events in a day and a half, so that the cap bites
    us = F.expr("unix_micros(cast(ts as timestamp)) div 20")
    return state.capped_cache(table(spark, sf, "events").select(F.col("user_id").alias("key"), us.alias("us"), F.col("event_id").alias("request_id")), cap=100, size=2048)


@register("""SELECT event_id, list_filter(list_distinct_in_order, lambda x: NOT list_contains(down, x))[1] AS model FROM (
 SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN [event_type] || list_filter(['view', 'click', 'error'], lambda x: x <> event_type) ELSE ['view', 'click', 'error'] END AS list_distinct_in_order,
  CASE user_id % 4 WHEN 0 THEN ['view'] WHEN 1 THEN ['click', 'view'] WHEN 2 THEN ['view', 'click', 'error'] ELSE []::VARCHAR[] END AS down FROM events)""")
def failover_route(spark, sf):
    u = F.col("user_id") % 4
    down = F.when(u == 0, F.array(F.lit("view"))).when(u == 1, F.array(F.lit("click"), F.lit("view"))).when(u == 2, F.array(F.lit("view"), F.lit("click"), F.lit("error"))).otherwise(F.array().cast("array<string>"))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type").isin("view", "click", "error"), F.col("event_type")).alias("wanted"), down.alias("down"))
    return state.failover(e, [("view", ""), ("click", ""), ("error", "")]).select("event_id", "model")
