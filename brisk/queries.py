"""Every operator as a query on the test tables, with DuckDB SQL beside it.

The `events` table stands in for the logs: signup is logon, error is device, view is http, purchase
is e-mail, click is file; `k` from props gives host (k mod 5), activity, URL, recipients, file name.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import arctan_scale, contains_any, distance, numeric_features, off_hours, top_deviation
from .models import detectors, risk
from .operators import daily, drift, metrics, panel, rules, scaling, selection, truth
from .operators.asof import asof_backward
from .operators.order import shared_folder, stored
from .plans import experiments
from .plans import features as feature_plans
from .sources import alerts as alert_source
from .sources import logs
from .streaming import activity as stream_activity

TERMS = daily.Terms(8, 18, ("site1",), ("job", "site2"), ("site3",), ("site4", "a.b"), ("secret",), ("int.com",))
ROLES = {"logon": "signup", "device": "error", "http": "view", "email": "purchase", "file": "click"}
QUERIES, ORACLES, SQL = {}, {}, {}


def as_text(df: DataFrame) -> DataFrame:
    """Days and times as text, so that results compare alike everywhere."""
    layout = {"date": "yyyy-MM-dd", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestamp": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    return df.select(*[F.date_format(c, layout[t]).alias(c) if t in layout else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, days: tuple[str, ...] = (), times: tuple[str, ...] = ()):
    """Register a query; `sql` may use the tables of E, `days` and `times` are its columns of such a type."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: as_text(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
            more = sql.strip()
            recursive = more.upper().startswith("WITH RECURSIVE ")
            more = ", " + more[15 if recursive else 5 :] if more.upper().startswith("WITH ") else " " + more
            text = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in days] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in times]
            whole = "WITH " + "RECURSIVE " * recursive + E + more
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(text)}) FROM ({whole})" if text else whole
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/brisk/{name}-{uuid.uuid4().hex[:12]}"


def r6(c):
    return F.round(c, 6)


# The adapter, for Spark and as the first tables of every SQL text.
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), F.col("ts").alias("timestamp"), F.to_date("ts").alias("day"), "event_type", "value", k.alias("k"), F.concat(F.lit("h"), k % 5).alias("pc"))


def log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    e = activity(spark, sf_dir).where(F.col("event_type") == ROLES[name])
    k = F.col("k")
    columns = {
        "logon": {"activity": F.when(k % 2 == 0, "Logon").otherwise("Logoff")},
        "device": {"activity": F.when(k % 2 == 0, "Connect").otherwise("Disconnect")},
        "http": {"url": F.concat(F.lit("http://site"), k, F.lit(".example.com"))},
        "email": {"to": F.when(F.col("value") > 10, "x@ext.com; y@int.com").otherwise("y@INT.com"), "cc": F.when(k % 4 == 0, "noat;").otherwise(F.lit(None).cast("string")), "size": F.round("value", 2).cast("string"), "attachments": F.when(k % 3 == 0, "a.txt").otherwise((k % 3).cast("string"))},
        "file": {"filename": F.concat(F.when(k >= 50, "Secret").otherwise("plain"), k)},
    }[name]
    return e.select("event_id", "user", "timestamp", "day", "pc", *[c.alias(n) for n, c in columns.items()])


E = """
e AS (SELECT event_id, user_id AS "user", ts, CAST(ts AS DATE) AS day, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
      'h' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS pc,
      (hour(ts) < 8 OR hour(ts) >= 18 OR isodow(ts) >= 6) AS off FROM events),
sc AS (SELECT "user", day, round(sum(value), 4) AS risk FROM e GROUP BY ALL),
lb AS (SELECT DISTINCT "user", day, 1 AS label FROM e WHERE event_type = 'error' AND k >= 80),
ro AS (SELECT sc.*, coalesce(label, 0) AS label FROM sc LEFT JOIN lb USING ("user", day)),
inc AS (SELECT event_id AS id, "user", day AS lo, CAST(ts + INTERVAL 2 DAY AS DATE) AS hi FROM e WHERE event_type = 'error' AND k >= 95),
al AS (SELECT "user", day FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY risk DESC, "user") AS n FROM sc) WHERE n <= 10),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM e),
grid AS (SELECT u."user", CAST(d.d AS DATE) AS day FROM (SELECT DISTINCT "user" FROM e) u, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM span) d),
cnt AS (SELECT "user", day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, coalesce(sum(k), 0) AS ks FROM e GROUP BY ALL),
pan AS (SELECT g."user", g.day, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks, CAST(coalesce(ks, 0) AS BIGINT) AS ks FROM grid g LEFT JOIN cnt USING ("user", day)),
bas AS (SELECT *, row_number() OVER w - 1 AS history_days, avg(ks) OVER b AS m, stddev_samp(ks) OVER b AS s, avg(views) OVER b AS mv, stddev_samp(views) OVER b AS sv FROM pan
        WINDOW w AS (PARTITION BY "user" ORDER BY day), b AS (PARTITION BY "user" ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
zs AS (SELECT *, CASE WHEN history_days >= 7 AND s > 0 THEN (ks - m) / s END AS z_ks, CASE WHEN history_days >= 7 AND sv > 0 THEN (views - mv) / sv END AS z_views FROM bas)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).groupBy("user", "day").agg(F.round(F.sum("value"), 4).alias("risk_score"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.day_labels(activity(spark, sf_dir).where("event_type = 'error' AND k >= 80"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = activity(spark, sf_dir).where("event_type = 'error' AND k >= 95")
    return rows.select(F.col("event_id").alias("incident_id"), "user", F.col("timestamp").alias("attack_start"), (F.col("timestamp") + F.expr("interval 2 days")).alias("attack_end"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = activity(spark, sf_dir)
    return panel.stack_days([
        e.groupBy("user", "day").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.coalesce(F.sum("k"), F.lit(0)).alias("ks")),
        e.groupBy("user", "day").agg(F.count_if(F.col("event_type") == "click").alias("clicks")),
    ])


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_panel(counters(spark, sf_dir)).select("user", "day", *[F.col(c).cast("long").alias(c) for c in ("views", "clicks", "ks")])


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.rolling_baselines(dense(spark, sf_dir), 14, 7, ["ks", "views"])


@query('SELECT "user", day, ks, round(z_ks, 6) AS z_ks FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY z_ks DESC, "user") AS n FROM zs WHERE z_ks IS NOT NULL) WHERE n <= 10', days=("day",))
def daily_outliers(spark, sf_dir):
    """Flagship: logs to dense panel, causal z values, the ten most unusual users of each day."""
    rows = baselines(spark, sf_dir).where("z_ks IS NOT NULL")
    return panel.top_per(rows, ["day"], [F.desc("z_ks"), F.asc("user")], 10).select("user", "day", "ks", r6("z_ks").alias("z_ks"))


@query("""WITH l AS (SELECT * FROM e WHERE event_type = 'signup'), f AS (SELECT "user", pc, min(day) AS day FROM l GROUP BY ALL),
 n AS (SELECT "user", day, count(*) AS c FROM (SELECT *, min(day) OVER (PARTITION BY "user") AS b FROM f) WHERE day > b GROUP BY ALL)
SELECT "user", day, count(*) AS logon_events, count(*) FILTER (k % 2 = 0) AS logon_count, count(*) FILTER (k % 2 <> 0) AS logoff_count, count(*) FILTER (off) AS logon_off_hours_events,
 count(DISTINCT pc) AS logon_unique_pcs, coalesce(max(n.c), 0) AS logon_new_pc_count FROM l LEFT JOIN n USING ("user", day) GROUP BY ALL""", days=("day",))
def logon_days(spark, sf_dir):
    return daily.logon_days(log(spark, sf_dir, "logon"), TERMS)


@query("SELECT \"user\", day, count(*) AS device_events, count(*) AS device_connect_count, count(*) FILTER (off) AS device_off_hours_events FROM e WHERE event_type = 'error' GROUP BY ALL", days=("day",))
def device_days(spark, sf_dir):
    return daily.device_days(log(spark, sf_dir, "device"), TERMS)


@query("""WITH u AS (SELECT *, 'http://site' || k || '.example.com' AS url FROM e WHERE event_type = 'view')
SELECT "user", day, count(*) AS http_events, count(*) FILTER (off) AS http_off_hours_events, count(*) FILTER (contains(url, 'site1')) AS http_watchlist_events, count(*) FILTER (regexp_matches(url, 'job|site2', 'i')) AS http_job_search_events,
 count(*) FILTER (contains(url, 'site3')) AS http_data_leak_events, count(*) FILTER (contains(url, 'site4')) AS http_monitoring_tool_events FROM u GROUP BY ALL""", days=("day",))
def http_days(spark, sf_dir):
    return daily.http_days(log(spark, sf_dir, "http"), TERMS)


@query("""WITH m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END AS att, CASE WHEN value > 10 THEN 2 ELSE 1 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS people,
 CASE WHEN value > 10 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS outside FROM e WHERE event_type = 'purchase')
SELECT "user", day, count(*) AS email_events, count(*) FILTER (att > 0) AS email_with_attachment_count, CAST(sum(att) AS BIGINT) AS email_attachment_total, round(sum(round(value, 2)), 6) AS email_total_bytes, CAST(sum(people) AS BIGINT) AS email_recipient_count,
 CAST(sum(outside) AS BIGINT) AS email_external_recipient_count, count(*) FILTER (outside > 0) AS email_external_events, count(*) FILTER (off) AS email_off_hours_events FROM m GROUP BY ALL""", days=("day",))
def email_days(spark, sf_dir):
    return daily.email_days(log(spark, sf_dir, "email"), TERMS).withColumn("email_total_bytes", r6("email_total_bytes"))


@query("SELECT \"user\", day, count(*) AS file_events, count(*) FILTER (off) AS file_off_hours_events, count(*) FILTER (k >= 50) AS sensitive_file_events FROM e WHERE event_type = 'click' GROUP BY ALL", days=("day",))
def file_days(spark, sf_dir):
    return daily.file_days(log(spark, sf_dir, "file"), TERMS)


@query("""WITH c AS (SELECT * FROM e WHERE event_type = 'click'), d AS (SELECT * FROM e WHERE event_type = 'error')
SELECT c."user", c.day, count(*) AS usb_connected_file_events, count(*) FILTER (c.off) AS usb_connected_file_off_hours_events, count(*) FILTER (c.k >= 50) AS usb_connected_sensitive_file_events
FROM c ASOF JOIN d ON c."user" = d."user" AND c.pc = d.pc AND c.ts >= d.ts WHERE d.k % 2 = 0 GROUP BY ALL""", days=("day",))
def usb_file_days(spark, sf_dir):
    return daily.usb_file_days(log(spark, sf_dir, "device"), log(spark, sf_dir, "file"), TERMS)


@query("""WITH c AS (SELECT * FROM e WHERE event_type = 'click'), m AS (SELECT * FROM e WHERE event_type = 'purchase' AND (value > 10 OR k % 4 = 0))
SELECT m."user", m.day, count(*) AS external_email_after_file_events, count(*) FILTER (c.k >= 50) AS external_email_after_sensitive_file_events
FROM m ASOF JOIN c ON m."user" = c."user" AND m.pc = c.pc AND m.ts >= c.ts WHERE m.ts - c.ts <= INTERVAL 2880 MINUTE GROUP BY ALL""", days=("day",))
def email_after_file_days(spark, sf_dir):
    return daily.email_after_file_days(log(spark, sf_dir, "file"), log(spark, sf_dir, "email"), TERMS, 2880)


@query("""WITH c AS (SELECT * FROM e WHERE event_type = 'click'), d AS (SELECT * FROM e WHERE event_type = 'error')
SELECT c.event_id, d.ts AS since, coalesce(d.k, -1) AS state FROM c ASOF LEFT JOIN d ON c."user" = d."user" AND c.ts >= d.ts""", times=("since",))
def device_state_asof(spark, sf_dir):
    e = activity(spark, sf_dir)
    right = e.where("event_type = 'error'").select("user", F.col("timestamp").alias("since"), F.col("k").alias("state"), "event_id")
    return asof_backward(e.where("event_type = 'click'").select("event_id", "user", "timestamp"), right, ["user"], "timestamp", "since", ["state"], tie="event_id").select("event_id", "since", F.coalesce("state", F.lit(-1)).alias("state"))


@query("""WITH m AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type = 'click')
SELECT m.event_id, CASE WHEN m.ts - c.ts <= INTERVAL 1 DAY THEN c.k ELSE -1 END AS k FROM m ASOF LEFT JOIN c ON m."user" = c."user" AND m.ts >= c.ts""")
def tolerance_asof(spark, sf_dir):
    e = activity(spark, sf_dir)
    right = e.where("event_type = 'click'").select("user", F.col("timestamp").alias("touched"), "k", "event_id")
    left = e.where("event_type = 'purchase'").select("event_id", "user", "timestamp")
    return asof_backward(left, right, ["user"], "timestamp", "touched", ["k"], F.expr("interval 1 day"), tie="event_id").select("event_id", F.coalesce("k", F.lit(-1)).alias("k"))


def _snapshots(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    days = F.explode(F.array(*[F.lit(date(2024, 1, d)) for d in (5, 15)]))
    rows = c.select(F.col("c_custkey").alias("user"), days.alias("snapshot_day"), F.concat(F.lit("r"), F.col("c_nationkey")).alias("role"), F.col("c_mktsegment").alias("department"), F.lit("t").alias("team"))
    return rows.withColumn("department", F.when(F.col("snapshot_day") == date(2024, 1, 15), F.concat("department", F.lit("2"))).otherwise(F.col("department"))).where((F.col("user") % 7 > 0))


SNAPS = """sn AS (SELECT c_custkey AS "user", d.d AS snapshot_day, 'r' || c_nationkey AS role, c_mktsegment || d.x AS department FROM customer, (VALUES (DATE '2024-01-05', ''), (DATE '2024-01-15', '2')) d(d, x) WHERE c_custkey % 7 > 0),
 org AS (SELECT p."user", p.day, p.views, p.ks, s.role, s.department, coalesce(s.role, 'unknown') || ' | ' || coalesce(s.department, 'unknown') AS org_peer_key FROM pan p ASOF LEFT JOIN sn s ON p."user" = s."user" AND p.day >= s.snapshot_day)"""


@query(f'WITH {SNAPS} SELECT "user", day, role, department, org_peer_key FROM org', days=("day",))
def org_asof(spark, sf_dir):
    return logs.attach_organisation(dense(spark, sf_dir), _snapshots(spark, sf_dir)).select("user", "day", "role", "department", "org_peer_key")


@query(f'WITH {SNAPS} SELECT org_peer_key, count(DISTINCT "user") AS users, round(avg(ks), 6) AS ks FROM org GROUP BY ALL HAVING count(DISTINCT "user") >= 5')
def org_profile_having(spark, sf_dir):
    rows = logs.attach_organisation(dense(spark, sf_dir), _snapshots(spark, sf_dir))
    return rows.groupBy("org_peer_key").agg(F.count_distinct("user").alias("users"), r6(F.avg("ks")).alias("ks")).where("users >= 5")


@query("SELECT * FROM pan", days=("day",))
def dense_panel(spark, sf_dir):
    return dense(spark, sf_dir)


@query('SELECT "user", day, history_days, round(m, 6) AS baseline_ks, round(s, 6) AS baseline_std_ks, history_days >= 7 AS baseline_ready FROM bas', days=("day",))
def rolling_baseline(spark, sf_dir):
    return baselines(spark, sf_dir).select("user", "day", "history_days", r6("baseline_ks").alias("baseline_ks"), r6("baseline_std_ks").alias("baseline_std_ks"), "baseline_ready")


@query('SELECT "user", day, round(z_ks, 6) AS z_ks, round(z_views, 6) AS z_views FROM zs', days=("day",))
def zscore(spark, sf_dir):
    return baselines(spark, sf_dir).select("user", "day", r6("z_ks").alias("z_ks"), r6("z_views").alias("z_views"))


@query('SELECT "user", round(avg(views), 6) AS views, round(avg(clicks), 6) AS clicks, round(avg(ks), 6) AS ks FROM pan GROUP BY ALL')
def user_profile(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d.groupBy("user").agg(*[r6(F.avg(c)).alias(c) for c in numeric_features(d)])


@query('SELECT "user", day, risk AS risk_score FROM al JOIN sc USING ("user", day)', days=("day",))
def top_k_per_day(spark, sf_dir):
    return panel.daily_alerts(scored(spark, sf_dir), 10)


@query('SELECT "user", max(risk) AS max_risk, round(avg(risk) FILTER (n <= 3), 6) AS top_q_mean_risk, count(*) AS scored_days FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY risk DESC, day) AS n FROM sc) GROUP BY ALL')
def top_q_mean_user(spark, sf_dir):
    return panel.user_scores(scored(spark, sf_dir)).withColumn("top_q_mean_risk", r6("top_q_mean_risk"))


@query('WITH x AS (SELECT DISTINCT "user", CAST(day - i AS DATE) AS day FROM lb, (SELECT unnest([1, 2]) AS i)) SELECT x."user", x.day, 1 AS label FROM x ANTI JOIN lb USING ("user", day)', days=("day",))
def early_window_anti(spark, sf_dir):
    return truth.day_labels(activity(spark, sf_dir).where("event_type = 'error' AND k >= 80"), 2).withColumn("label", F.col("label").cast("int"))


@query("""SELECT CAST(k % 3 AS VARCHAR) || ':f:' || row_number() OVER (PARTITION BY k % 3 ORDER BY CAST("user" AS VARCHAR)) AS incident_id, CAST("user" AS VARCHAR) AS "user", min(ts) AS attack_start, max(ts) AS attack_end,
 string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS evidence FROM e WHERE event_type = 'error' AND k >= 80 GROUP BY k % 3, "user" """, times=("attack_start", "attack_end"))
def incident_intervals(spark, sf_dir):
    rows = activity(spark, sf_dir).where("event_type = 'error' AND k >= 80")
    got = truth.incidents(rows.select(F.col("event_id").cast("string"), F.col("user").cast("string"), "timestamp", (F.col("k") % 3).cast("string").alias("release"), F.lit("f").alias("source_file")))
    return got.select("incident_id", "user", "attack_start", "attack_end", F.array_join("evidence_event_ids", ",").alias("evidence"))


@query("""WITH c AS (SELECT risk, sum(label) AS pos, sum(1 - label) AS neg FROM ro GROUP BY ALL), t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (ORDER BY risk DESC))
SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS pr_auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(pos) + sum(neg) AS BIGINT) AS observations FROM t""")
def roc_auc_average_precision(spark, sf_dir):
    out = metrics.auc_and_ap(metrics.with_labels(scored(spark, sf_dir), labelled(spark, sf_dir)))
    return out.withColumns({c: r6(c) for c in ("roc_auc", "pr_auc")})


@query("""WITH t AS (SELECT label FROM ro ORDER BY risk DESC, "user", day LIMIT 50), h AS (SELECT count(*) AS n, sum(label) AS h, (SELECT sum(label) FROM ro) AS p FROM t)
SELECT n AS alert_k, round(h / n, 6) AS precision_at_k, round(h / p, 6) AS recall_at_k, round(CASE WHEN h > 0 THEN 2 * (h / n) * (h / p) / (h / n + h / p) ELSE 0 END, 6) AS f1_at_k FROM h""")
def precision_recall_at_k(spark, sf_dir):
    out = metrics.at_k(metrics.with_labels(scored(spark, sf_dir), labelled(spark, sf_dir)), 50, [F.desc("risk_score"), F.asc("user"), F.asc("day")])
    return out.select("alert_k", *[r6(c).alias(c) for c in ("precision_at_k", "recall_at_k", "f1_at_k")])


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY risk DESC, day) AS n FROM sc WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'),
 u AS (SELECT "user", avg(risk) FILTER (n <= 3) AS q FROM s GROUP BY ALL), b AS (SELECT DISTINCT "user" FROM inc WHERE lo BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'),
 j AS (SELECT u."user", q, CAST(b."user" IS NOT NULL AS INT) AS label FROM u LEFT JOIN b USING ("user")), r AS (SELECT *, row_number() OVER (ORDER BY q DESC, "user") AS place FROM j),
 t AS (SELECT *, sum(label) OVER (ORDER BY place) AS hits FROM r WHERE place <= 20), p AS (SELECT sum(label) AS p, count(*) AS n FROM j),
 i AS (SELECT sum(1 / log2(x + 1)) AS ideal FROM p, range(1, 21) r(x) WHERE x <= p.p)
SELECT p.n AS scored_users, CAST(p.p AS BIGINT) AS positive_users, round(p.p / p.n, 6) AS user_prevalence, round((SELECT sum(label) FROM t) / least(20, p.n), 6) AS precision_at_k,
 round((SELECT sum(hits / place) FILTER (label > 0) FROM t) / least(p.p, 20), 6) AS map_at_k, round((SELECT sum(label / log2(place + 1)) FROM t) / i.ideal, 6) AS ndcg_at_k FROM p, i""")
def ndcg_map_at_k(spark, sf_dir):
    out = metrics.evaluate_users(scored(spark, sf_dir), incidents(spark, sf_dir), date(2024, 1, 5), date(2024, 1, 25), 20)
    return out.select("scored_users", "positive_users", *[r6(c).alias(c) for c in ("user_prevalence", "precision_at_k", "map_at_k", "ndcg_at_k")])


@query("""WITH m AS (SELECT id, al."user", al.day, inc.lo, al.day BETWEEN inc.lo AND inc.hi AS seen FROM al JOIN inc ON al."user" = inc."user" AND al.day BETWEEN inc.lo - 3 AND inc.hi),
 g AS (SELECT id, max(CAST(seen AS INT)) AS seen, min(day) FILTER (day < lo) AS warned, any_value(lo) AS lo FROM m GROUP BY id),
 x AS (SELECT coalesce(sum(seen), 0) AS d, count(warned) AS w, median(lo - warned) AS med FROM g), f AS (SELECT count(*) AS f FROM al ANTI JOIN m USING ("user", day)), n AS (SELECT count(*) AS n FROM inc), a AS (SELECT count(*) AS a FROM al), s AS (SELECT count(*) AS s FROM sc)
SELECT n AS incidents, CAST(d AS BIGINT) AS detected_incidents, round(d / n, 6) AS incident_detection_rate, w AS early_warned_incidents, round(w / n, 6) AS early_warning_rate, CAST(med AS DOUBLE) AS median_lead_time_days,
 round(a / d, 6) AS alerts_per_detected_incident, round(100 * f / s, 6) AS false_alerts_per_100_user_days FROM x, f, n, a, s""")
def incident_metrics(spark, sf_dir):
    out = metrics.evaluate_incidents(scored(spark, sf_dir), incidents(spark, sf_dir), 10, 3)
    return out.withColumns({c: r6(c) for c in ("incident_detection_rate", "early_warning_rate", "alerts_per_detected_incident", "false_alerts_per_100_user_days")})


def security_events(spark, sf_dir):
    k = F.col("k")
    kind = F.when(F.col("event_type") == "error", "device").when(F.col("event_type") == "click", "file").when(F.col("event_type") == "purchase", "email").otherwise("process")
    return rules.normalise(activity(spark, sf_dir).select(
        "event_id", "user", "timestamp", kind.alias("event_type"), F.when(F.col("event_type") == "error", "Connect").when(k % 10 == 0, "useradd").when(k % 10 == 1, "rm").when(k % 10 == 2, "systemctl stop").otherwise("view").alias("action"),
        F.when(k >= 50, "secret plan").otherwise("x").alias("object"), (F.col("value") > 10).alias("is_external"), F.col("pc").alias("host"),
    ))


@query("""WITH u AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER w AS ut, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS ui FROM e WINDOW w AS (PARTITION BY "user" ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT *, event_type = 'click' AND k >= 50 AND ts - ut <= INTERVAL 1 DAY AS arms FROM u),
 l AS (SELECT *, last_value(CASE WHEN arms THEN ts END IGNORE NULLS) OVER w AS art, last_value(CASE WHEN arms THEN event_id END IGNORE NULLS) OVER w AS ai, last_value(CASE WHEN arms THEN ui END IGNORE NULLS) OVER w AS aui FROM a WINDOW w AS (PARTITION BY "user" ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, row_number() OVER (PARTITION BY "user", ai ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM l WHERE event_type = 'purchase' AND value > 10 AND ts - art <= INTERVAL 1 DAY)
SELECT CAST("user" AS VARCHAR) AS "user", ts AS alert_timestamp, aui || ',' || ai || ',' || event_id AS evidence FROM m WHERE n = 1""", times=("alert_timestamp",))
def chain_rule(spark, sf_dir):
    got = rules.chain_alerts(security_events(spark, sf_dir), "secret", 24 * 60, ("user",))
    return got.select("user", "alert_timestamp", F.array_join("evidence_event_ids", ",").alias("evidence"))


@query("""WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'connect' WHEN k % 10 = 0 THEN 'useradd' WHEN k % 10 = 1 THEN 'rm' WHEN k % 10 = 2 THEN 'systemctl stop' ELSE 'view' END AS a FROM e)
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN a = 'useradd' THEN 'UEBA-CORR-002' ELSE 'UEBA-CORR-003' END AS rule_id, CASE a WHEN 'useradd' THEN 'T1098' WHEN 'rm' THEN 'T1485' ELSE 'T1489' END AS technique FROM s WHERE a IN ('useradd', 'rm', 'systemctl stop')""")
def keyword_rules(spark, sf_dir):
    return rules.word_alerts(security_events(spark, sf_dir)).select(F.col("evidence_event_ids")[0].alias("event_id"), "rule_id", F.col("mitre_technique_ids")[0].alias("technique"))


@query("""WITH d AS (SELECT DISTINCT "user", day FROM e WHERE event_type <> 'error' AND k % 10 IN (0, 1, 2))
SELECT "user", day, round(100 * (0.8 * risk / 100 + 0.2 * CASE WHEN d.day IS NULL THEN 0 ELSE 0.75 END), 6) AS risk_score, CAST(CASE WHEN d.day IS NULL THEN 0 ELSE 0.75 END AS DOUBLE) AS rule_component FROM sc LEFT JOIN d USING ("user", day)""", days=("day",))
def rule_risk_blend(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("user", F.col("user").cast("string"))
    return rules.blend(s, rules.word_alerts(security_events(spark, sf_dir))).select(F.col("user").cast("long").alias("user"), "day", r6("risk_score").alias("risk_score"), "rule_component")


@query("SELECT round(quantile_cont(risk, 0.95), 6) AS threshold FROM sc")
def quantile_threshold(spark, sf_dir):
    return drift.threshold(scored(spark, sf_dir), "risk_score", 0.95).select(r6("threshold").alias("threshold"))


@query('WITH q AS (SELECT quantile_cont(risk, 0.05) AS lo, quantile_cont(risk, 0.99) AS hi FROM sc) SELECT "user", day, round(0.5 + atan((risk - (lo + hi) / 2) / ((hi - lo) / 2)) / pi(), 6) AS scaled FROM sc, q', days=("day",))
def arctan_scaling(spark, sf_dir):
    s = scored(spark, sf_dir)
    q = s.agg(F.percentile("risk_score", F.array(F.lit(0.05), F.lit(0.99))).alias("q"))
    return s.crossJoin(F.broadcast(q)).select("user", "day", r6(arctan_scale(F.col("risk_score"), F.col("q")[0], F.col("q")[1])).alias("scaled"))


@query('SELECT "user", day, round((ks - (SELECT avg(ks) FROM pan)) / (SELECT stddev_pop(ks) FROM pan), 6) AS ks FROM pan', days=("day",))
def standard_scale(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d.select("user", "day", r6(scaling.scaled(scaling.standard_statistics(d, ["ks"]))[0]).alias("ks"))


@query('WITH q AS (SELECT median(ks) AS m, quantile_cont(ks, 0.75) - quantile_cont(ks, 0.25) AS iqr FROM pan) SELECT "user", day, round((ks - m) / CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 6) AS ks FROM pan, q', days=("day",))
def robust_scale(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d.select("user", "day", r6(scaling.scaled(scaling.robust_statistics(d, ["ks"]))[0]).alias("ks"))


@query("WITH c AS (SELECT embedding AS c FROM embeddings WHERE vec_id < 5) SELECT vec_id, round(min(list_distance(CAST(embedding AS DOUBLE[]), CAST(c AS DOUBLE[]))), 6) AS distance FROM embeddings, c GROUP BY vec_id")
def nearest_center_distance(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centres = [list(r["v"]) for r in rows.where("vec_id < 5").orderBy("vec_id").collect()]
    return rows.select("vec_id", r6(scaling.nearest(F.col("v"), centres)["d"]).alias("distance"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY views, "user", day) AS v, row_number() OVER (ORDER BY clicks, "user", day) AS c, row_number() OVER (ORDER BY ks, "user", day) AS k FROM pan)
SELECT a, b, round(x, 6) AS r FROM (SELECT 'views' AS a, 'clicks' AS b, corr(v, c) AS x FROM r UNION ALL SELECT 'views', 'ks', corr(v, k) FROM r UNION ALL SELECT 'clicks', 'ks', corr(c, k) FROM r)""")
def ordinal_rank_corr(spark, sf_dir):
    return selection.rank_correlations(dense(spark, sf_dir), ["views", "clicks", "ks"], ["user", "day"]).withColumn("r", r6("r"))


@query("""SELECT CAST(i + 1 AS INT) AS fold_id, lo AS train_start, CAST(lo + 9 + i * 5 AS DATE) AS train_end, CAST(lo + 11 + i * 5 AS DATE) AS validation_start, CAST(lo + 15 + i * 5 AS DATE) AS validation_end,
 CAST(lo + 17 + i * 5 AS DATE) AS test_start, CAST(lo + 21 + i * 5 AS DATE) AS test_end FROM span, (SELECT CAST(unnest(range(0, 100)) AS INT) AS i) WHERE lo + (21 + i * 5) <= hi""", days=("train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end"))
def fold_calendar(spark, sf_dir):
    folds = experiments.folds_of(activity(spark, sf_dir), train_days=10, validation_days=5, test_days=5, step_days=5, embargo_days=1)
    schema = "fold_id int, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date"
    return spark.createDataFrame([tuple(f.__dict__.values()) for f in folds], schema)


def _series(spark, sf_dir):
    return activity(spark, sf_dir).groupBy("day").agg(F.round(F.sum("value"), 4).alias("v")).withColumn("series", F.lit("all"))


@query("""WITH RECURSIVE s AS (SELECT day, round(sum(value), 4) AS v, row_number() OVER (ORDER BY day) AS i FROM e GROUP BY day),
 st AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS tot, CAST(0 AS DOUBLE) AS low, false AS fired, CAST(NULL AS DATE) AS day
  UNION ALL SELECT i, CASE WHEN f THEN 0 ELSE n END, CASE WHEN f THEN 0 ELSE mean END, CASE WHEN f THEN 0 ELSE tot END, CASE WHEN f THEN 0 ELSE low END, f, day
  FROM (SELECT *, n >= 5 AND tot - low > 20 AS f FROM (SELECT i, n, mean, tot, least(low, tot) AS low, day FROM (SELECT i, n, mean, tot + v - mean - 0.005 AS tot, low, day, v FROM (SELECT s.i, st.n + 1 AS n, st.mean + (s.v - st.mean) / (st.n + 1) AS mean, st.tot, st.low, s.day, s.v FROM st JOIN s ON s.i = st.i + 1)))))
SELECT i AS observations_at_detection, day FROM st WHERE fired""", days=("day",))
def page_hinkley(spark, sf_dir):
    got = drift.page_hinkley(_series(spark, sf_dir), "series", "day", "v", 0.005, 20.0, 5)
    return got.select("observations_at_detection", F.col("drift_time").alias("day"))


@query()
def adwin(spark, sf_dir):
    """ADWIN over the hourly sums of each type: a series has as many values as hours, not as events."""
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz").alias("timestamp")
    rows = activity(spark, sf_dir).groupBy(F.col("event_type").alias("series"), hour).agg(F.round(F.sum("value"), 4).alias("value"))
    return drift.detect(rows, "series", "timestamp", "value", "adwin", delta=0.05)


@query("""SELECT "user", day, CASE WHEN abs(coalesce(z_ks, 0)) >= abs(coalesce(z_views, 0)) THEN 'z_ks' ELSE 'z_views' END AS name, round(CASE WHEN abs(coalesce(z_ks, 0)) >= abs(coalesce(z_views, 0)) THEN coalesce(z_ks, 0) ELSE coalesce(z_views, 0) END, 6) AS value FROM zs""", days=("day",))
def top_deviation_feature(spark, sf_dir):
    return baselines(spark, sf_dir).withColumn("t", top_deviation(["z_ks", "z_views"])).select("user", "day", "t.name", r6("t.value").alias("value"))


@query("SELECT page_id, regexp_matches(url, 'example\\.org|/de/', 'i') AS hit FROM pages")
def watchlist_hits(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", contains_any(F.col("url"), ["example.org", "/de/"]).alias("hit"))


@query("SELECT event_id, k, off FROM e")
def json_prop_extract(spark, sf_dir):
    return activity(spark, sf_dir).select("event_id", "k", off_hours(F.col("timestamp"), 8, 18).alias("off"))


def alert_json(spark, sf_dir):
    """Alerts made from events, in the shapes that the normaliser tells apart."""
    k = F.col("k")
    kind = k % 5
    number = F.when(kind == 4, "11").otherwise("6416")
    provider = F.when(kind == 4, "Microsoft-Windows-Sysmon").otherwise("Security")
    win = F.struct(F.struct(number.alias("eventID"), provider.alias("providerName")).alias("system"), F.struct(F.concat(F.lit("u"), "user").alias("TargetUserName"), F.lit("8.8.8.8:443").alias("IpAddress"), F.when(kind == 4, "/tmp/f").alias("TargetFilename")).alias("eventdata"))
    body = F.struct(
        F.col("event_id").cast("string").alias("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(F.when(kind == 0, F.array(F.lit("syscheck"))).when(kind == 1, F.array(F.lit("Audit"))).otherwise(F.array().cast("array<string>")).alias("groups"), F.lit("seen").alias("description")).alias("rule"),
        F.struct(F.when(kind.isin(2, 4), win).alias("win"), F.when(kind == 0, "file_Added").alias("type"), F.when(kind == 0, "/tmp/x").alias("path"), F.when(kind == 3, "10.0.0.1").alias("srcip"), F.concat(F.lit("u"), "user").alias("user")).alias("data"),
        F.struct(F.col("pc").alias("name")).alias("agent"),
    )
    return activity(spark, sf_dir).select(F.to_json(body).alias("json"))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, 'u' || "user" AS "user", pc AS host, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
 CASE k % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'auditd' WHEN 2 THEN 'device' WHEN 4 THEN 'file' ELSE 'wazuh' END AS event_type, CASE k % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'unknown' WHEN 2 THEN 'device_connect' WHEN 4 THEN 'file_create' ELSE 'alert' END AS action,
 CASE k % 5 WHEN 0 THEN '/tmp/x' WHEN 1 THEN 'unknown' WHEN 2 THEN '8.8.8.8:443' WHEN 4 THEN '/tmp/f' ELSE 'seen' END AS object, k % 5 IN (2, 4) AS is_external FROM e""")
def alert_normaliser(spark, sf_dir):
    return alert_source.normalise(alert_json(spark, sf_dir))


@query("SELECT day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY ALL", days=("day",))
def stream_daily_counts(spark, sf_dir):
    """The streaming counters, drained once from the events files into a table in the shared folder. The
    watermark covers the whole period, so no order of files loses events."""
    schema = load(spark, sf_dir, "events").schema
    days = load(spark, sf_dir, "events").agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, "stream")
    counts = stream_activity.daily_counts(stream, late=f"{days + 1} days", by=("event_type",))
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/rows")
    run = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    latest = spark.read.parquet(f"{path}/rows").groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return latest.select("day", "event_type", "x.n", r6("x.total").alias("total"))


@query()
def user_day_features(spark, sf_dir):
    """All 31 counters of the five logs and both sequence features on the dense panel."""
    return feature_plans.user_days({name: log(spark, sf_dir, name) for name in ROLES}, TERMS).withColumn("email_total_bytes", r6("email_total_bytes"))


def _model_rows(spark, sf_dir):
    rows = logs.attach_organisation(dense(spark, sf_dir), _snapshots(spark, sf_dir))
    return panel.rolling_baselines(rows, 14, 7, ["views", "clicks", "ks"])


def _detector(family: str):
    def run(spark, sf_dir):
        rows = stored(baselines(spark, sf_dir).where("baseline_ready"))
        rows = rows.withColumn("_x", scaling.scaled(scaling.robust_statistics(rows, ["views", "ks", "z_ks", "z_views"])))
        return detectors.make(family, trees=50).fit(rows, "_x", ["user", "day"]).score(rows, "_x").select("user", "day", F.round("anomaly", 4 if family == "lof" else 6).alias("anomaly"))

    run.__name__ = {"isolation_forest": "isolation_scores"}.get(family, f"{family}_scores")
    return run


for _family in ("isolation_forest", "ocsvm", "autoencoder"):
    query()(_detector(_family))

query("""WITH r AS (SELECT "user", day, CAST(views AS DOUBLE) AS a, CAST(ks AS DOUBLE) AS b, z_ks AS c, z_views AS d FROM zs WHERE history_days >= 7),
 f AS (SELECT "user", day, a, b, coalesce(c, (SELECT median(c) FROM r)) AS c, coalesce(d, (SELECT median(d) FROM r)) AS d FROM r),
 st AS (SELECT median(a) AS ma, median(b) AS mb, median(c) AS mc, median(d) AS md, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ia, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS ib, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS ic, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS id FROM f),
 x AS (SELECT "user", day, row_number() OVER (ORDER BY "user", day) AS i, [(a - ma) / CASE WHEN ia > 0 THEN ia ELSE 1 END, (b - mb) / CASE WHEN ib > 0 THEN ib ELSE 1 END, (c - mc) / CASE WHEN ic > 0 THEN ic ELSE 1 END, (d - md) / CASE WHEN id > 0 THEN id ELSE 1 END] AS x FROM f, st),
 p AS (SELECT a.i, b.i AS j, list_distance(a.x, b.x) AS d, b.x FROM x a, x b),
 n AS (SELECT i, j, d FROM p WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, x, j) <= 35), rad AS (SELECT i, max(d) AS radius FROM n GROUP BY i),
 den AS (SELECT n.i, 1 / (avg(greatest(n.d, rad.radius)) + 1e-10) AS density FROM n JOIN rad ON rad.i = n.j GROUP BY n.i),
 q AS (SELECT i, j, d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, x, j) <= 35)
SELECT x."user", x.day, round(avg(den.density) * (avg(greatest(q.d, rad.radius)) + 1e-10), 4) AS anomaly FROM q JOIN rad ON rad.i = q.j JOIN den ON den.i = q.j JOIN x ON x.i = q.i GROUP BY ALL""", days=("day",))(_detector("lof"))


@query()
def kmeans_peers(spark, sf_dir):
    model = risk.fit(_model_rows(spark, sf_dir), date(2024, 1, 20), trees=20, clusters=4)
    return model.clusters.select("user", F.col("_cluster").alias("cluster"))


@query()
def risk_scores(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    got = risk.score(rows, risk.fit(rows, date(2024, 1, 20), trees=50, clusters=4))
    return got.select("user", "day", r6("risk_score").alias("risk_score"), r6("anomaly_component").alias("anomaly_component"), r6("peer_component").alias("peer_component"), "peer_source", "top_deviation_feature", r6("top_deviation_z").alias("top_deviation_z"))


@query("""WITH RECURSIVE f AS (SELECT "user", day, unnest([struct_pack(f := 'views', v := CAST(views AS DOUBLE)), struct_pack(f := 'clicks', v := CAST(clicks AS DOUBLE)), struct_pack(f := 'ks', v := CAST(ks AS DOUBLE)), struct_pack(f := 'ks2', v := CAST(2 * ks + 1 AS DOUBLE))], recursive := true) FROM bas WHERE history_days >= 7),
 r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v, "user", day) AS n FROM f),
 bad AS (SELECT a.f, list(b.f) AS partners FROM r a JOIN r b ON a."user" = b."user" AND a.day = b.day AND a.f <> b.f GROUP BY a.f, b.f HAVING abs(corr(a.n, b.n)) > 0.9),
 bads AS (SELECT f, list(p) AS partners FROM (SELECT f, unnest(partners) AS p FROM bad) GROUP BY f),
 o AS (SELECT f, row_number() OVER (ORDER BY var_pop(v) DESC) AS i FROM f GROUP BY f HAVING var_pop(v) > 0), ob AS (SELECT i, o.f, coalesce(list_distinct(partners), []) AS partners FROM o LEFT JOIN bads USING (f)),
 st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT ob.i, CASE WHEN list_has_any(kept, ob.partners) THEN kept ELSE list_append(kept, ob.f) END FROM st JOIN ob ON ob.i = st.i + 1),
 k AS (SELECT kept FROM st ORDER BY i DESC LIMIT 1)
SELECT CAST(unnest(range(len(kept))) AS BIGINT) AS place, unnest(kept) AS feature FROM k""")
def selected_features(spark, sf_dir):
    rows = baselines(spark, sf_dir).where("baseline_ready").withColumn("ks2", 2 * F.col("ks") + 1)
    kept = selection.correlation_filter(rows, ["views", "clicks", "ks", "ks2"], ["user", "day"])
    return spark.createDataFrame(list(enumerate(kept)), "place long, feature string")


@query()
def permutation_importance(spark, sf_dir):
    rows = metrics.with_labels(baselines(spark, sf_dir).where("baseline_ready"), labelled(spark, sf_dir))
    got = selection.permutation_importance(rows, ["ks", "views", "clicks"], ["user", "day"], lambda d: d.withColumn("s", F.col("ks") + F.col("views")), 3, column="s")
    return got.select("feature", *[r6(c).alias(c) for c in got.columns[1:]])


_FOLDS = {"train_days": 15, "validation_days": 5, "test_days": 6, "step_days": 4}
_SELECTION = {"correlation_limit": 0.9, "min_features": 2, "max_features": 6, "repetitions": 1}


@query()
def family_comparison(spark, sf_dir):
    rows = stored(_model_rows(spark, sf_dir))
    return experiments.compare_families(rows, labelled(spark, sf_dir), experiments.folds_of(rows, **_FOLDS), ["isolation_forest", "lof", "ocsvm", "autoencoder"], _SELECTION, trees=20, clusters=4)


@query("""WITH f AS (SELECT CAST(i + 1 AS INT) AS fold_id, lo + (20 + i * 4) AS a, lo + (25 + i * 4) AS b FROM span, (SELECT CAST(unnest(range(0, 100)) AS INT) AS i) WHERE lo + (25 + i * 4) <= hi)
SELECT fold_id, 'autoencoder' AS family, 'evaluated' AS status, CAST(count(label) AS BIGINT) AS positives, count(*) AS observations, round(count(label) / count(*), 6) AS prevalence, CAST(10 AS BIGINT) AS alert_k
FROM f JOIN bas ON day BETWEEN a AND b AND history_days >= 7 LEFT JOIN lb USING ("user", day) GROUP BY fold_id""")
def fold_observations(spark, sf_dir):
    """What of the comparison of one family over all folds does not depend on random numbers."""
    rows = stored(_model_rows(spark, sf_dir))
    got = experiments.compare_families(rows, labelled(spark, sf_dir), experiments.folds_of(rows, **_FOLDS), ["autoencoder"], _SELECTION, clusters=4)
    return got.select("fold_id", "family", "status", "positives", "observations", r6("prevalence").alias("prevalence"), "alert_k")


@query("SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS d FROM embeddings")
def euclidean_distance(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = rows.where("vec_id = 0").select(F.col("v").alias("w"))
    return rows.crossJoin(F.broadcast(one)).select("vec_id", r6(distance(F.col("v"), F.col("w"))).alias("d"))


from . import whole_queries  # noqa: E402, F401  (registers its queries)
