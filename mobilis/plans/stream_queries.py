"""Queries that run as streams: evidence lands in three slices, and the job goes on after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.plans.common import CONNECTORS, EV, as_of, catalogue, evidence, table
from mobilis.sources.folders import landed, new_folder
from mobilis.streaming import commands, expiry, jobs, lookback, worker

Q, SQL, query = catalogue()

_SLICE = "CASE WHEN observed_at < TIMESTAMP '2024-01-11' THEN 0 WHEN observed_at < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _slices(rows: DataFrame, at: str = "observed_at") -> list[DataFrame]:
    time = F.col(at)
    first, second = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21"))
    return [rows.where(time < first), rows.where((time >= first) & (time < second)), rows.where(time >= second)]


def _fed(spark: SparkSession, slices: list[DataFrame], job: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Land slice after slice and start the job again on its folder after each."""
    feed, folder = new_folder(spark, "landed"), new_folder(spark, "jobs")
    out = None
    for part in slices:
        landed(part, feed)
        out = job(jobs.files(spark, feed, part.schema), folder)
    return out


def _evidence(spark: SparkSession, sf: str) -> list[DataFrame]:
    return _slices(evidence(spark, sf))


@query(f"""WITH {EV}, s AS (SELECT *, {_SLICE} AS slice FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY connector_code, source_event_id, slice ORDER BY observed_at DESC, evidence_id DESC) AS rn FROM s),
l AS (SELECT *, lag(content_hash) OVER (PARTITION BY connector_code, source_event_id ORDER BY slice) IS DISTINCT FROM content_hash AS fresh FROM r WHERE rn = 1)
SELECT connector_code, source_event_id, arg_max(content_hash, slice) AS content_hash, max(received_at) AS received_at, count(*) FILTER (fresh) AS version FROM l GROUP BY ALL""")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, _evidence(spark, sf), jobs.upsert_stream)


@query(f"""WITH {EV}, m AS (SELECT *, lag(content_hash) OVER w IS DISTINCT FROM content_hash AS fresh FROM ev WINDOW w AS (PARTITION BY connector_code, source_event_id ORDER BY observed_at, evidence_id))
SELECT evidence_id, CASE WHEN fresh THEN 'accepted' ELSE 'duplicate' END AS outcome,
  CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY connector_code, source_event_id ORDER BY observed_at, evidence_id) AS BIGINT) AS version FROM m""")
def stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, _evidence(spark, sf), jobs.outcome_stream)


@query(f"WITH {EV} SELECT evidence_id, connector_code, content_hash FROM ev")
def stream_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, [s.select("evidence_id", "connector_code", "content_hash") for s in _evidence(spark, sf)], jobs.change_feed)


@query(f"WITH {EV} SELECT connector_code, date_trunc('hour', observed_at) AS opens, count(*) AS n FROM ev GROUP BY ALL")
def stream_cadence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _fed(spark, _evidence(spark, sf), jobs.cadence_stream)


_STEP = """{b} AS (SELECT connector_code, external_key, CASE WHEN status IS NULL THEN CASE WHEN m{n} THEN 'active' END WHEN m{n} THEN 'active' WHEN status = 'active' AND s{n} THEN 'resolved' ELSE status END AS status,
  version + CASE WHEN m{n} OR (coalesce(status = 'active', false) AND s{n}) THEN 1 ELSE 0 END AS version, m1, m2, m3, s1, s2, s3 FROM {a})"""


@query(f"""WITH {EV}, sl AS (SELECT *, {_SLICE} AS slice FROM ev),
keys AS (SELECT connector_code, source_event_id AS external_key, bool_or(slice = 0 AND cents > 8000) AS m1, bool_or(slice = 1 AND cents > 8000) AS m2, bool_or(slice = 2 AND cents > 8000) AS m3 FROM sl GROUP BY ALL),
seen AS (SELECT connector_code, bool_or(slice = 0) AS s1, bool_or(slice = 1) AS s2, bool_or(slice = 2) AS s3 FROM sl GROUP BY 1),
p0 AS (SELECT k.*, s1, s2, s3, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS version FROM keys k JOIN seen USING (connector_code)),
{_STEP.format(a="p0", b="p1", n=1)}, {_STEP.format(a="p1", b="p2", n=2)}, {_STEP.format(a="p2", b="p3", n=3)}
SELECT connector_code, external_key, status, version FROM p3 WHERE status IS NOT NULL""")
def stream_incident_state(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents after three passes of detection."""
    slices = [s.withColumnRenamed("source_event_id", "external_key") for s in _evidence(spark, sf)]
    return _fed(spark, slices, lambda stream, folder: jobs.incident_stream(stream, F.col("cents") > 8000, folder))


@query("""WITH e AS (SELECT user_id AS incident_id, event_type AS h, value >= 50 AS decided, ts AS happened, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS slice, row_number() OVER (PARTITION BY user_id, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END ORDER BY ts DESC, event_id DESC) AS rn FROM events),
a AS (SELECT incident_id, max(h) FILTER (slice = 0) AS h0, bool_or(decided) FILTER (slice = 0) AS d0, max(happened) FILTER (slice = 0) AS t0, max(h) FILTER (slice = 1) AS h1, bool_or(decided) FILTER (slice = 1) AS d1, max(happened) FILTER (slice = 1) AS t1, max(h) FILTER (slice = 2) AS h2, bool_or(decided) FILTER (slice = 2) AS d2, max(happened) FILTER (slice = 2) AS t2 FROM e WHERE rn = 1 GROUP BY 1),
b AS (SELECT *, CASE WHEN h0 IS NOT NULL AND (h1 IS NULL OR h1 = h0) THEN h0 ELSE h1 END AS g1, CASE WHEN h0 IS NOT NULL AND (h1 IS NULL OR h1 = h0) THEN d0 ELSE d1 END AS e1, CASE WHEN h0 IS NOT NULL AND (h1 IS NULL OR h1 = h0) THEN t0 ELSE t1 END AS u1,
  CASE WHEN h0 IS NULL AND h1 IS NULL THEN 0 ELSE 1 END + CASE WHEN h0 IS NOT NULL AND h1 <> h0 AND d0 THEN 1 ELSE 0 END AS v1 FROM a)
SELECT incident_id, CASE WHEN g1 IS NOT NULL AND (h2 IS NULL OR h2 = g1) THEN g1 ELSE h2 END AS evidence_hash, CASE WHEN g1 IS NOT NULL AND (h2 IS NULL OR h2 = g1) THEN e1 ELSE d2 END AS decided,
  CASE WHEN g1 IS NOT NULL AND (h2 IS NULL OR h2 = g1) THEN u1 ELSE t2 END + INTERVAL 6 HOUR AS expires_at, CAST(CASE WHEN v1 = 0 THEN 1 ELSE v1 + CASE WHEN h2 <> g1 AND e1 THEN 1 ELSE 0 END END AS BIGINT) AS version FROM b""")
def stream_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of recommendations over three slices, each with its six hours to live."""
    from mobilis.operators.evidence import latest_per

    rows = table(spark, sf, "events").select(F.col("user_id").alias("incident_id"), F.col("event_type").alias("evidence_hash"), (F.col("value") >= 50).alias("decided"), F.col("ts").alias("at"), "event_id")
    slices = [latest_per(s, ["incident_id"], [F.desc("at"), F.desc("event_id")]).drop("event_id") for s in _slices(rows, "at")]
    return _fed(spark, slices, jobs.recommendation_stream)


_ORDER = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""WITH e AS (SELECT user_id, event_type AS evidence_hash, value >= 50 AS decided, ts, event_id, lag(event_type) OVER w IS DISTINCT FROM event_type AS fresh FROM events WINDOW w AS {_ORDER}),
n AS (SELECT *, lead(ts) OVER w AS next_at FROM e WHERE fresh WINDOW w AS {_ORDER}),
c AS (SELECT *, CASE WHEN decided THEN false ELSE coalesce(next_at >= ts + INTERVAL 6 HOUR, ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)) END AS expires FROM n),
v AS (SELECT *, CAST(1 + coalesce(sum(CASE WHEN decided OR expires THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS version FROM c)
SELECT user_id AS incident_id, version, evidence_hash, CASE WHEN decided THEN 'decided' ELSE 'awaiting_approval' END AS state, ts AS happened_at FROM v
UNION ALL SELECT user_id, version, evidence_hash, 'expired', ts + INTERVAL 6 HOUR FROM v WHERE expires""")
def stream_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Every write of a recommendation and every expiry, six hours after the last write, though no row comes for it."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("incident_id"), F.col("event_type").alias("evidence_hash"), (F.col("value") >= 50).alias("decided"), "ts", F.col("event_id").alias("place"))
    slices = [s.withColumn("at", F.col("ts").cast("timestamp")).drop("ts") for s in _slices(rows, "ts")]
    return _fed(spark, slices, expiry.expiring).select("incident_id", "version", "evidence_hash", "state", F.col("at").cast("timestamp_ntz").alias("happened_at"))


@query(f"""WITH {EV}, m AS (SELECT connector_code, received_at, observed_at - to_hours(CAST(k % 8 AS INTEGER)) AS observed_at FROM ev WHERE cents > 5000),
f AS (SELECT *, date_trunc('hour', observed_at - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS could, date_trunc('hour', received_at - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS can,
  date_trunc('hour', observed_at + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND) AS until FROM m),
p AS (SELECT connector_code, observed_at, could < can AS late, unnest(generate_series(can, until, INTERVAL 1 HOUR)) AS pass_at FROM f WHERE can <= until)
SELECT connector_code, pass_at, count(*) AS n, count(*) FILTER (late) AS n_late, max(observed_at) AS newest_at FROM p
WHERE pass_at <= (SELECT max(pass_at) FROM p) - INTERVAL 6 HOUR GROUP BY ALL""")
def stream_look_back(spark: SparkSession, sf: str) -> DataFrame:
    """What each hourly pass sees of the six hours before it; some evidence comes hours late."""
    rows = evidence(spark, sf).select("connector_code", "cents", "received_at", (F.col("observed_at") - F.make_dt_interval(hours=(F.col("k") % 8).cast("int"))).alias("observed_at"))
    slices = [s.withColumns({c: F.col(c).cast("timestamp") for c in ("received_at", "observed_at")}) for s in _slices(rows, "received_at")]
    passes = _fed(spark, slices, lambda stream, folder: lookback.look_back(stream, F.col("cents") > 5000, ["connector_code"], folder))
    return passes.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("pass_at", "newest_at")})


@query("""WITH s AS (SELECT 'worker-' || user_id AS worker, ts AS happened, event_id AS tick, CASE event_type WHEN 'signup' THEN 'terminated' WHEN 'click' THEN 'idle' ELSE 'progress' END AS kind,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'paused' WHEN 'purchase' THEN 'ingested' END AS outcome, CASE WHEN event_type = 'error' THEN 'no answer in ' || CAST(round(value) AS BIGINT) || ' s' END AS error FROM events),
l AS (SELECT worker, count(outcome) AS ticks, max(happened) AS last_at, arg_max(kind, (happened, tick)) AS kind, arg_max(struct_pack(o := outcome, e := error), (happened, tick)) FILTER (outcome IS NOT NULL) AS last FROM s GROUP BY 1)
SELECT worker, ticks, last_at, last.o AS last_outcome, last.e AS last_error, kind <> 'terminated' AND last_at > TIMESTAMP '2024-01-30 12:00:00' AS alive,
  CASE WHEN kind = 'terminated' THEN 'stopped' WHEN last_at <= TIMESTAMP '2024-01-30 12:00:00' THEN 'silent' WHEN last.o = 'paused' THEN 'paused' WHEN last.o = 'failed' THEN 'failing' ELSE 'live' END AS status FROM l""")
def worker_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Workers by their signs of life: silent after five intervals, paused without an active window."""
    kind = F.col("event_type")
    progress = table(spark, sf, "events").select(
        F.concat(F.lit("worker-"), "user_id").alias("worker"),
        F.col("ts").alias("at"),
        F.when(kind == "signup", "terminated").when(kind == "click", "idle").otherwise("progress").alias("kind"),
        F.col("event_id").alias("tick"),
        F.when(kind == "error", "failed").when(kind == "view", "paused").when(kind == "purchase", "ingested").alias("outcome"),
        F.when(kind == "error", F.concat(F.lit("no answer in "), F.round("value").cast("long").cast("string"), F.lit(" s"))).alias("error"),
    )
    return worker.liveness(progress, as_of(), 8640)


@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, rn, ts AS since, event_type AS body, 'applied' AS outcome FROM c WHERE rn = 1
  UNION ALL SELECT c.event_id, c.user_id, c.rn, CASE WHEN c.ts < f.since + INTERVAL 24 HOUR THEN f.since ELSE c.ts END, CASE WHEN c.ts < f.since + INTERVAL 24 HOUR THEN f.body ELSE c.event_type END,
    CASE WHEN c.ts >= f.since + INTERVAL 24 HOUR THEN 'applied' WHEN f.body = c.event_type THEN 'replayed' ELSE 'conflict' END FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT event_id AS command_id, outcome FROM f""")
def stream_commands_once(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of commands in a stream: a key is remembered for a day from when its request was applied."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("command_id"), F.col("event_type").alias("body"), "ts")
    slices = [s.withColumn("at", F.col("ts").cast("timestamp")).drop("ts") for s in _slices(rows, "ts")]
    return _fed(spark, slices, lambda stream, folder: commands.answered(stream, ["user_id"], folder)).select("command_id", "outcome")


@query(f"""WITH {EV}, l AS (SELECT connector_code, source_event_id, max(received_at) AS r FROM ev GROUP BY ALL)
SELECT connector_code, CASE WHEN connector_code = 'error' THEN 'no answer' END AS failure, CASE WHEN connector_code = 'error' THEN 0 ELSE count(*) END AS n_current FROM l GROUP BY 1""")
def sources_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """The intake of every connector as a stream of its own; one fails, and the others are taken in."""
    rows = evidence(spark, sf)
    feeds = {c: new_folder(spark, "landed") for c in CONNECTORS}
    folders = {c: new_folder(spark, "jobs") for c in CONNECTORS}
    counts: dict[str, int] = {}

    def intake(c: str) -> Callable[[], None]:
        def run() -> None:
            if c == "error":
                raise ConnectionError("no answer")
            counts[c] = jobs.upsert_stream(jobs.files(spark, feeds[c], rows.schema), folders[c]).count()

        return run

    for c, feed in feeds.items():
        landed(rows.where(F.col("connector_code") == c), feed)
    failed = jobs.isolated({c: intake(c) for c in CONNECTORS}, lambda: None)
    return spark.createDataFrame([(c, failed.get(c), counts.get(c, 0)) for c in CONNECTORS], "connector_code string, failure string, n_current long")
