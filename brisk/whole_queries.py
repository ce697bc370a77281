"""Queries that run several operators in a row, start from files, or score by a fixed model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import off_hours
from .models import detectors, risk
from .operators import metrics, panel, rules, selection
from .queries import E, ORACLES, ROLES, SNAPS, SQL, _model_rows, activity, alert_json, dense, incidents, labelled, load, log, query, r6, scored, scratch
from .sources import alerts as alert_source
from .sources import logs
from .sources.files import write_csv
from .streaming import activity as stream_activity

# The counters of all logs on the calendar: the SQL of each log's own query, joined.
_PARTS = {
    "logon_days": ("logon_events", "logon_count", "logoff_count", "logon_off_hours_events", "logon_unique_pcs", "logon_new_pc_count"),
    "device_days": ("device_events", "device_connect_count", "device_off_hours_events"),
    "http_days": ("http_events", "http_off_hours_events", "http_watchlist_events", "http_job_search_events", "http_data_leak_events", "http_monitoring_tool_events"),
    "email_days": ("email_events", "email_with_attachment_count", "email_attachment_total", "email_total_bytes", "email_recipient_count", "email_external_recipient_count", "email_external_events", "email_off_hours_events"),
    "file_days": ("file_events", "file_off_hours_events", "sensitive_file_events"),
    "usb_file_days": ("usb_connected_file_events", "usb_connected_file_off_hours_events", "usb_connected_sensitive_file_events"),
    "email_after_file_days": ("external_email_after_file_events", "external_email_after_sensitive_file_events"),
}
ORACLES["user_day_features"] = (
    f"WITH {E}, "
    + ", ".join(f"{name} AS ({SQL[name].replace('2880 MINUTE', '60 MINUTE')})" for name in _PARTS)
    + ' SELECT grid."user", strftime(grid.day, \'%Y-%m-%d\') AS day, '
    + ", ".join(f"coalesce({name}.{c}, 0) AS {c}" for name, columns in _PARTS.items() for c in columns)
    + " FROM grid "
    + " ".join(f'LEFT JOIN {name} ON {name}."user" = grid."user" AND {name}.day = grid.day' for name in _PARTS)
)


@query("""WITH c AS (SELECT risk, sum(label) AS pos, sum(1 - label) AS neg FROM ro GROUP BY ALL), t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (ORDER BY risk DESC)),
 a AS (SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc, sum(pos * tp / (tp + fp)) / sum(pos) AS ap, sum(pos) AS p, sum(neg) AS n FROM t),
 r AS (SELECT label, row_number() OVER (ORDER BY risk DESC, "user", day) AS i FROM ro), h AS (SELECT sum(label) FILTER (i <= 50) AS h, sum(label) FILTER (i <= p) AS o FROM r, a)
SELECT round(roc, 6) AS roc_auc, round(ap, 6) AS pr_auc, CAST(p AS BIGINT) AS positives, CAST(p + n AS BIGINT) AS observations, round(p / (p + n), 6) AS prevalence, CAST(50 AS BIGINT) AS alert_k, round(h / 50, 6) AS precision_at_k, round(h / p, 6) AS recall_at_k,
 round(CASE WHEN h > 0 THEN 2 * (h / 50) * (h / p) / (h / 50 + h / p) ELSE 0 END, 6) AS f1_at_k, round(o / p, 6) AS precision_at_positives, round(o / p, 6) AS recall_at_positives FROM a, h""")
def day_metrics(spark, sf_dir):
    out = metrics.evaluate_days(scored(spark, sf_dir), labelled(spark, sf_dir), k=50)
    out = out.toDF(*["_at_".join([c.split("_at_")[0], "positives"]) if c.endswith("_positives") else c for c in out.columns])
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("""WITH s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'connect' WHEN k % 10 = 0 THEN 'useradd' WHEN k % 10 = 1 THEN 'rm' WHEN k % 10 = 2 THEN 'systemctl stop' ELSE 'view' END AS a FROM e),
 u AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER w AS ut, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS ui FROM e WINDOW w AS (PARTITION BY "user", pc ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, event_type = 'click' AND k >= 50 AND ts - ut <= INTERVAL 2880 MINUTE AS arms FROM u),
 l AS (SELECT *, last_value(CASE WHEN arms THEN ts END IGNORE NULLS) OVER w AS art, last_value(CASE WHEN arms THEN event_id END IGNORE NULLS) OVER w AS ai, last_value(CASE WHEN arms THEN ui END IGNORE NULLS) OVER w AS aui FROM b WINDOW w AS (PARTITION BY "user", pc ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, row_number() OVER (PARTITION BY "user", pc, ai ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM l WHERE event_type = 'purchase' AND value > 10 AND ts - art <= INTERVAL 2880 MINUTE)
SELECT 'UEBA-CORR-001' AS rule_id, CAST("user" AS VARCHAR) AS "user", pc AS host, ts AS alert_timestamp, 'T1052,T1567.002' AS techniques, 0.85::DOUBLE AS confidence, aui || ',' || ai || ',' || event_id AS evidence FROM m WHERE n = 1
UNION ALL SELECT CASE WHEN a = 'useradd' THEN 'UEBA-CORR-002' ELSE 'UEBA-CORR-003' END, CAST("user" AS VARCHAR), pc, ts, CASE a WHEN 'useradd' THEN 'T1098' WHEN 'rm' THEN 'T1485' ELSE 'T1489' END, 0.75::DOUBLE, CAST(event_id AS VARCHAR) FROM s WHERE a IN ('useradd', 'rm', 'systemctl stop')""", times=("alert_timestamp",))
def correlated_alerts(spark, sf_dir):
    k = F.col("k")
    kind = F.when(F.col("event_type") == "error", "device").when(F.col("event_type") == "click", "file").when(F.col("event_type") == "purchase", "email").otherwise("process")
    action = F.when(F.col("event_type") == "error", "Connect").when(k % 10 == 0, "useradd").when(k % 10 == 1, "rm").when(k % 10 == 2, "systemctl stop").otherwise("view")
    raw = activity(spark, sf_dir).select("event_id", "user", "timestamp", kind.alias("event_type"), action.alias("action"), F.when(k >= 50, "secret plan").otherwise("x").alias("object"), (F.col("value") > 10).alias("is_external"), F.col("pc").alias("host"))
    got = rules.correlate(raw, "secret", 2880)
    return got.select("rule_id", "user", "host", "alert_timestamp", F.array_join("mitre_technique_ids", ",").alias("techniques"), "confidence", F.array_join("evidence_event_ids", ",").alias("evidence"))


@query("""WITH v AS (SELECT vec_id AS i, CAST(embedding[1:4] AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT a.i, b.i AS j, list_distance(a.x, b.x) AS d FROM v a, v b),
 n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d WHERE i <> j), rad AS (SELECT i, d AS radius FROM n WHERE r = 10),
 den AS (SELECT n.i, 1 / (avg(greatest(n.d, rad.radius)) + 1e-10) AS density FROM n JOIN rad ON rad.i = n.j WHERE r <= 10 GROUP BY n.i), q AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d)
SELECT q.i AS vec_id, round(avg(den.density) * (avg(greatest(q.d, rad.radius)) + 1e-10), 5) AS anomaly FROM q JOIN rad ON rad.i = q.j JOIN den ON den.i = q.j WHERE r <= 10 GROUP BY q.i""")
def lof_of_vectors(spark, sf_dir):
    """LOF in its novelty form, fitted on all vectors."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("v"))
    return detectors.make("lof", neighbours=10).fit(rows, "v", ["vec_id"]).score(rows, "v").select("vec_id", F.round("anomaly", 5).alias("anomaly"))


@query(f"""WITH {SNAPS}, x AS (SELECT o."user", o.day, o.org_peer_key, b.history_days >= 7 AS ready, (p.views - 2) / 2 AS a, (p.clicks - 1) / 1 AS b, (p.ks - 100) / 50 AS c FROM org o JOIN pan p ON p."user" = o."user" AND p.day = o.day JOIN bas b ON b."user" = o."user" AND b.day = o.day),
 y AS (SELECT *, 0.8 - 0.6 * exp(-0.5 * (a * a + b * b + c * c)) - 0.4 * exp(-0.5 * ((a - 1) ** 2 + (b - 1) ** 2 + (c - 1) ** 2)) AS s, sqrt(a * a + b * b + c * c) AS d0, sqrt((a - 1) ** 2 + (b - 1) ** 2 + (c - 1) ** 2) AS d1, sqrt((a - 2) ** 2 + (b - 2) ** 2 + (c - 2) ** 2) AS d2 FROM x),
 z AS (SELECT *, CASE WHEN org_peer_key = 'unknown | unknown' THEN d2 WHEN "user" % 3 = 0 THEN least(d0, d1) WHEN "user" % 2 = 0 THEN d0 ELSE d1 END AS d FROM y),
 w AS (SELECT *, 0.5 + atan((s - 0.4) / 0.4) / pi() AS anomaly, 0.5 + atan((d - 1.5) / 1.5) / pi() AS peer FROM z)
SELECT "user", day, round(CASE WHEN ready THEN anomaly END, 6) AS anomaly_component, round(CASE WHEN ready THEN peer END, 6) AS peer_component, round(CASE WHEN ready THEN 100 * (0.7 * anomaly + 0.3 * peer) END, 6) AS risk_score,
 round(CASE WHEN ready THEN d END, 6) AS peer_distance, CASE WHEN ready THEN CASE WHEN org_peer_key = 'unknown | unknown' THEN 'ldap_role_department' ELSE 'behavioral_cluster' END END AS peer_source FROM w""", days=("day",))
def risk_by_fixed_model(spark, sf_dir):
    """Risk scores by a model whose numbers are given: two centres, one organisation group, a
    one-class SVM of two support vectors."""
    rows = _model_rows(spark, sf_dir)
    return _risk(risk.score(rows, _fixed_model(spark, rows)))


@query(SQL["risk_by_fixed_model"], days=("day",))
def risk_by_saved_model(spark, sf_dir):
    """The same model, saved and loaded again."""
    rows, path = _model_rows(spark, sf_dir), scratch(spark, "model")
    risk.save(_fixed_model(spark, rows), path)
    return _risk(risk.score(rows, risk.load(spark, path)))


def _fixed_model(spark, rows):
    import numpy as np

    scale = {"views": (0.0, 2.0, 2.0), "clicks": (0.0, 1.0, 1.0), "ks": (0.0, 100.0, 50.0)}
    detector = detectors.make("ocsvm")
    detector.model = (np.array([[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]), np.array([0.6, 0.4]), 0.5, 0.8)
    users = rows.select("user").distinct().where("user % 3 <> 0").select("user", F.when(F.col("user") % 2 == 0, 0).otherwise(1).alias("_cluster"))
    groups = spark.createDataFrame([("unknown | unknown", [2.0, 2.0, 2.0])], "org_peer_key string, _centre array<double>")
    return risk.RiskModel(list(scale), list(scale), scale, scale, [[0.0] * 3, [1.0] * 3], users, groups, detector, {"anomaly": (0.0, 0.8), "peer": (0.0, 3.0)}, (0.7, 0.3), {"family": "ocsvm"})


def _risk(got):
    return got.select("user", "day", *[r6(c).alias(c) for c in ("anomaly_component", "peer_component", "risk_score", "peer_distance")], "peer_source")


def _with_vector(rows):
    return rows.withColumn("_x", F.array(*[F.col(c).cast("double") for c in ("views", "clicks", "ks")]))


@query("""SELECT "user", day, round(2 ** -((CASE WHEN views < 1.5 THEN 1 + 2.0 ELSE CASE WHEN ks < 120 THEN 2 + 0.5 ELSE 2 + 1.0 END END + CASE WHEN clicks < 0.5 THEN 3.0 ELSE 1.0 END) / 2 / 2.5), 6) AS anomaly FROM pan""", days=("day",))
def forest_by_fixed_trees(spark, sf_dir):
    """Scores of an isolation forest of two given trees; nodes are (feature, cut, low, high, depth)."""
    import numpy as np

    forest = detectors.make("isolation_forest")
    leaf = lambda depth: (-1, 0.0, -1, -1, depth)
    first = np.array([(0, 1.5, 1, 2, 0.0), leaf(3.0), (2, 120.0, 3, 4, 0.0), leaf(2.5), leaf(3.0)])
    second = np.array([(1, 0.5, 1, 2, 0.0), leaf(3.0), leaf(1.0)])
    forest.model = ([first, second], 2.5)
    return forest.score(_with_vector(dense(spark, sf_dir)), "_x").select("user", "day", r6("anomaly").alias("anomaly"))


@query("""WITH h AS (SELECT *, greatest(0.5 * views - 0.2 * clicks + 0.01 * ks + 0.1, 0) AS a, greatest(-0.1 * views + 0.3 * clicks - 0.02 * ks + 0.2, 0) AS b FROM pan)
SELECT "user", day, round(((0.4 * a + 0.1 * b - views) ** 2 + (0.2 * a - 0.3 * b + 0.5 - clicks) ** 2 + (1.5 * a + 0.7 * b + 1 - ks) ** 2) / 3, 6) AS anomaly FROM h""", days=("day",))
def autoencoder_by_fixed_weights(spark, sf_dir):
    import numpy as np

    net = detectors.make("autoencoder")
    net.model = (np.array([[0.5, -0.1], [-0.2, 0.3], [0.01, -0.02]]), np.array([0.1, 0.2]), np.array([[0.4, 0.2, 1.5], [0.1, -0.3, 0.7]]), np.array([0.0, 0.5, 1.0]))
    return net.score(_with_vector(dense(spark, sf_dir)), "_x").select("user", "day", r6("anomaly").alias("anomaly"))


@query("SELECT * FROM pan WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'", days=("day",))
def period_rows(spark, sf_dir):
    return panel.select_period(dense(spark, sf_dir), date(2024, 1, 5), date(2024, 1, 15))


@query("""WITH i AS (SELECT event_type AS feature, round(avg(value), 4) - 10 AS drop FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY drop DESC, feature) AS n FROM i), t AS (SELECT * FROM r WHERE n <= 4), c AS (SELECT count(*) AS c FROM t WHERE drop > 0)
SELECT feature FROM t, c WHERE CASE WHEN c >= 2 THEN drop > 0 ELSE n <= 2 END""")
def important_features(spark, sf_dir):
    """At least two and at most four features by their importance."""
    table = activity(spark, sf_dir).groupBy(F.col("event_type").alias("feature")).agg((F.round(F.avg("value"), 4) - 10).alias("mean_pr_auc_drop"))
    return spark.createDataFrame([(f,) for f in selection.top_features(table, 2, 4)], "feature string")


def log_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The logs and organisation snapshots as a data set of CSV files."""
    path = scratch(spark, name)
    stamp = F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss")
    for kind in ROLES:
        rows = log(spark, sf_dir, kind).withColumn("date", stamp).drop("timestamp", "day").withColumnsRenamed({"event_id": "id", "user": "user"})
        write_csv(rows, f"{path}/{kind}.csv")
    people = load(spark, sf_dir, "customer").where("c_custkey % 7 > 0")
    for month in ("2024-01", "2024-02", "notes"):
        rows = people.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("u"), "c_custkey", F.lit("@Int.com")).alias("email"), F.concat(F.lit("r"), "c_nationkey").alias("role"), F.concat("c_mktsegment", F.lit(month[-1])).alias("department"), F.lit("t").alias("team"))
        write_csv(rows, f"{path}/LDAP/{month}.csv")
    return path


@query("""WITH l AS (SELECT CASE event_type WHEN 'signup' THEN 'logon' WHEN 'error' THEN 'device' WHEN 'view' THEN 'http' WHEN 'purchase' THEN 'email' ELSE 'file' END AS log, "user", day, off, date_trunc('second', ts) AS ts FROM e)
SELECT log, CAST("user" AS VARCHAR) AS "user", day, count(*) AS n, count(*) FILTER (off) AS n_off, min(ts) AS first, max(ts) AS last FROM l GROUP BY ALL""", days=("day",), times=("first", "last"))
def log_files(spark, sf_dir):
    """The five logs written as CSV files and read through the typed reader."""
    path = log_folder(spark, sf_dir, "logs")
    if not logs.inspect(spark, path).usable:
        raise ValueError(logs.inspect(spark, path).report())
    parts = None
    for kind in ROLES:
        rows = logs.events(spark, f"{path}/{kind}.csv").select(F.lit(kind).alias("log"), "user", "day", "timestamp", off_hours(F.col("timestamp"), 8, 18).alias("off"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("log", "user", "day").agg(F.count("*").alias("n"), F.count_if("off").alias("n_off"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "user", m.d AS snapshot_day, 'r' || c_nationkey AS role, c_mktsegment || m.x AS department, 't' AS team, 'int.com' AS domain
FROM customer, (VALUES (DATE '2024-01-01', '1'), (DATE '2024-02-01', '2')) m(d, x) WHERE c_custkey % 7 > 0""", days=("snapshot_day",))
def snapshot_files(spark, sf_dir):
    """Organisation snapshots read from files named by month; a file of another name is skipped."""
    snaps = logs.snapshots(spark, f"{log_folder(spark, sf_dir, 'snapshots')}/LDAP")
    domains = logs.domain_table(snaps).agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domain"))
    return snaps.crossJoin(F.broadcast(domains)).select("user", "snapshot_day", "role", "department", "team", "domain")  # one row


@query("""SELECT 'logon' AS event_type, CAST(event_id AS VARCHAR) AS event_id, date_trunc('second', ts) AS timestamp, CAST("user" AS VARCHAR) AS "user", 'r4.2' AS release FROM e WHERE event_type = 'error' AND k >= 80
UNION ALL SELECT 'file', CAST(event_id AS VARCHAR), date_trunc('minute', ts), CAST("user" AS VARCHAR), 'r4.2' FROM e WHERE event_type = 'click' AND k >= 90""", times=("timestamp",))
def answer_files(spark, sf_dir):
    """Insider events read from an answer file without a header and one with another order of columns."""
    path = scratch(spark, "answers")
    e = activity(spark, sf_dir)
    write_csv(e.where("event_type = 'error' AND k >= 80").select(F.lit("logon"), "event_id", F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss"), "user"), f"{path}/r4.2-1/a.csv", header=False)
    other = e.where("event_type = 'click' AND k >= 90").select(F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("date"), "user", F.lit("file").alias("type"), F.col("event_id").alias("id"))
    write_csv(other, f"{path}/r4.2-2/b.csv")
    write_csv(other, f"{path}/r5.2-1/c.csv")
    return logs.answers(spark, path).select("event_type", "event_id", "timestamp", "user", "release")


@query("""SELECT CAST(id AS VARCHAR) AS incident_id, CAST("user" AS VARCHAR) AS "user", date_trunc('second', ts) AS attack_start, date_trunc('second', ts + INTERVAL 2 DAY) AS attack_end, 's' AS scenario_id, 'T1' AS technique_id
FROM (SELECT event_id AS id, "user", ts FROM e WHERE event_type = 'error' AND k >= 95)""", times=("attack_start", "attack_end"))
def incident_file(spark, sf_dir):
    path = f"{scratch(spark, 'incidents')}/lab.csv"
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    write_csv(incidents(spark, sf_dir).select("incident_id", "user", stamp("attack_start"), stamp("attack_end"), F.lit("s").alias("scenario_id"), F.lit("T1").alias("technique_id")), path)
    return logs.lab_incidents(spark, path)


@query("""SELECT 'wazuh:' || left(sha256('{"agent":{"name":"' || pc || '"},"data":{"srcip":"10.0.0.1","user":"u' || "user" || '"},"rule":{"description":"seen \\u00e9"},"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}'), 24) AS event_id,
 'u' || "user" AS "user", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM e""")
def alerts_by_content(spark, sf_dir):
    """Alerts without an id are known by a digest of what they hold, whatever the order of their keys."""
    body = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(F.lit("seen \u00e9").alias("description")).alias("rule"),
        F.struct(F.concat(F.lit("u"), "user").alias("user"), F.lit("10.0.0.1").alias("srcip")).alias("data"), F.struct(F.col("pc").alias("name")).alias("agent"),
    )
    got = alert_source.normalise(activity(spark, sf_dir).select(F.to_json(body).alias("json")))
    return got.select("event_id", "user", "timestamp")


@query('SELECT CAST(row_number() OVER (ORDER BY risk DESC, "user", day) AS INT) AS place, "user", day, round(risk, 6) AS risk_score FROM sc QUALIFY place <= 10', days=("day",))
def top_risk_days(spark, sf_dir):
    rows = panel.top_days(scored(spark, sf_dir))
    return rows.select(F.row_number().over(Window.orderBy(F.desc("risk_score"), "user", "day")).alias("place"), "user", "day", r6("risk_score").alias("risk_score"))  # ten rows


@query(SQL["day_metrics"])
def evaluated_by_command(spark, sf_dir):
    """The commands that build labels and evaluate scores, run on files, and the file of metrics that
    they write."""
    from argparse import Namespace

    from . import cli
    from .operators.daily import Terms
    from .sources.settings import Settings

    path = scratch(spark, "commands")
    bad = activity(spark, sf_dir).where("event_type = 'error' AND k >= 80")
    write_csv(bad.select(F.lit("logon"), "event_id", F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss"), "user"), f"{path}/data/answers/r4.2-1/a.csv", header=False)
    scored(spark, sf_dir).withColumn("user", F.col("user").cast("string")).write.parquet(f"{path}/out/scored")
    settings = Settings({"dataset": f"{path}/data", "output": f"{path}/out"}, Terms(8, 18), 14, 7, {})
    cli.run(spark, Namespace(command="build-labels", release="r4.2", early_days=0), settings)
    cli.run(spark, Namespace(command="evaluate", alert_k=50, test_start=None), settings)
    out = spark.read.option("multiLine", True).json(f"{path}/out/metrics.json")
    out = out.toDF(*["_at_".join([c.split("_at_")[0], "positives"]) if c.endswith("_positives") else c for c in out.columns])
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(SQL["alert_normaliser"])
def alert_files(spark, sf_dir):
    """Alerts written as JSON lines, read back and normalised."""
    path = scratch(spark, "alerts")
    alert_json(spark, sf_dir).write.text(path)
    return alert_source.normalise(alert_source.read_alerts(spark, path))


def drained(spark: SparkSession, sf_dir: str, name: str, rows, time: str, end: dict, online):
    """rows written as files in no order of time, streamed through `online` three files at a time until
    they are used up, and what came out. The watermark covers the whole period; a last event, `end`, after
    all others moves it past them."""
    path = scratch(spark, name)
    days = rows.agg(F.datediff(F.max(time), F.min(time))).first()[0] or 0
    rows.repartition(8, F.xxhash64(*rows.columns)).write.parquet(f"{path}/in")
    last = rows.agg((F.max(time) + F.make_dt_interval(F.lit(days + 2))).alias(time)).select(*[F.col(time) if c == time else F.lit(end.get(c)).cast(t).alias(c) for c, t in rows.dtypes])
    last.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream_activity.use_rocksdb(spark)
    stream = online(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/in"), f"{days + 1} days")
    write = lambda batch, n: batch.write.mode("append").parquet(f"{path}/out")
    stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(SQL["page_hinkley"], days=("day",))
def stream_page_hinkley(spark, sf_dir):
    """Page-Hinkley over daily sums as they arrive."""
    daily = activity(spark, sf_dir).groupBy("day").agg(F.round(F.sum("value"), 4).alias("v")).select(F.lit("all").alias("series"), F.col("day").cast("timestamp").alias("day"), "v")
    got = drained(spark, sf_dir, "hinkley", daily, "day", {"series": "end", "v": 0.0}, lambda s, late: stream_activity.page_hinkley(s, "series", "day", "v", 0.005, 20.0, 5, late))
    return got.select("observations_at_detection", F.to_date("drift_time").alias("day"))


@query("""WITH u AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER w AS ut, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS ui FROM e WINDOW w AS (PARTITION BY "user", pc ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, event_type = 'click' AND k >= 50 AND ts - ut <= INTERVAL 2880 MINUTE AS arms FROM u),
 l AS (SELECT *, last_value(CASE WHEN arms THEN ts END IGNORE NULLS) OVER w AS art, last_value(CASE WHEN arms THEN event_id END IGNORE NULLS) OVER w AS ai, last_value(CASE WHEN arms THEN ui END IGNORE NULLS) OVER w AS aui FROM b WINDOW w AS (PARTITION BY "user", pc ORDER BY ts, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, row_number() OVER (PARTITION BY "user", pc, ai ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM l WHERE event_type = 'purchase' AND value > 10 AND ts - art <= INTERVAL 2880 MINUTE)
SELECT CAST("user" AS VARCHAR) AS "user", pc AS host, ts AS alert_timestamp, aui || ',' || ai || ',' || event_id AS evidence FROM m WHERE n = 1""", times=("alert_timestamp",))
def stream_chain_rule(spark, sf_dir):
    """The device, file, e-mail chain by user and host, with state kept between batches."""
    e = activity(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user").cast("string").alias("user"), F.col("pc").alias("host"), F.col("timestamp").cast("timestamp").alias("timestamp"),
        (F.col("event_type") == "error").alias("is_connect"), ((F.col("event_type") == "click") & (F.col("k") >= 50)).alias("is_sensitive"), ((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("is_outside"),
    )
    got = drained(spark, sf_dir, "chains", e, "timestamp", {}, lambda s, late: stream_activity.chains(s, 2880, late))
    return got.select("user", "host", F.col("alert_timestamp").cast("timestamp_ntz").alias("alert_timestamp"), F.array_join("evidence_event_ids", ",").alias("evidence"))
