"""Product metrics, feedback and quotas: conditional counts, ratios, look-back windows, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import register
from ..sources.fixtures import FEEDBACK, METRIC_EVENTS, feedback, metric_events

KINDS = ("scan_started", "scan_completed", "unlock_clicked", "audit_unlocked")


def micros(c):
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _counts(cond=None):
    hit = lambda k: (F.col("event") == k) if cond is None else (F.col("event") == k) & cond
    return [F.count_if(hit(k)).alias(k) for k in KINDS]


def user_metrics(e: DataFrame) -> DataFrame:
    return e.groupBy("email").agg(*_counts())


PERIOD = 86_400_000_000
NUMBERED_AT_ONCE = 50_000


def numbered(values: DataFrame) -> DataFrame:
    """values (v and others, one row each) with `id`: 0, 1, 2, ... without gaps, by buckets of a hash, so that no task orders all."""
    spread = F.greatest(F.lit(1), F.ceil(F.col("_all") / NUMBERED_AT_ONCE))
    x = values.crossJoin(F.broadcast(values.agg(F.count(F.lit(1)).alias("_all")))).withColumn("_bucket", F.pmod(F.xxhash64("v"), spread)).drop("_all")  # one row
    sizes = x.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each bucket of NUMBERED_AT_ONCE values
    base = sizes.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_base"))
    x = x.withColumn("_nth", F.row_number().over(W.partitionBy("_bucket").orderBy("v")))
    return x.join(base, "_bucket").withColumn("id", F.col("_base") + F.col("_nth") - 1).drop("_bucket", "_base", "_nth")


def periods(e: DataFrame) -> DataFrame:
    """e with `period`: how many whole days lie between an event and the last one of the data, whose own clock this is."""
    last = F.broadcast(e.agg(F.max("created_at").alias("as_of")))  # one row
    ago = micros("as_of") - micros("created_at")
    return e.crossJoin(last).withColumn("period", F.greatest(F.lit(0).cast("bigint"), F.ceil(ago / F.lit(PERIOD)) - 1))


def user_bitmaps(e: DataFrame) -> DataFrame:
    """(period, bucket, users): the users of each day as bitmaps over their numbers; they merge by or, exactly.

    A user is one row with the days they came; their number takes no look-up by event.
    """
    users = numbered(periods(e).groupBy(F.col("email").alias("v")).agg(F.collect_set("period").alias("days")))
    # bitmap functions number bits from one
    bit = F.col("id") + 1
    return users.select(F.explode("days").alias("period"), F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("period", "bucket").agg(F.bitmap_construct_agg("at").alias("users"))


def spans(e: DataFrame, days: dict[str, int | None]) -> DataFrame:
    """(span, events, users, counts of each kind) over the last so many days; None is all of them.

    Days are summed up once, counts and bitmaps of users, whatever the number of spans.
    """
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.lit(d).cast("bigint").alias("days")) for n, d in days.items()]))
    into = lambda x: x.withColumn("s", of).where("s.days IS NULL OR period < s.days").withColumn("span", F.col("s.span"))
    counts = periods(e).groupBy("period").agg(F.count(F.lit(1)).alias("events"), *_counts())
    counts = into(counts).groupBy("span").agg(*[F.sum(c).alias(c) for c in ("events", *KINDS)])
    users = into(user_bitmaps(e)).groupBy("span", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n")).groupBy("span").agg(F.sum("n").alias("users"))
    return counts.join(users, "span").select("span", "events", "users", *KINDS)


def cohort(e: DataFrame, days: int | None = None) -> DataFrame:
    """Totals over the events of the last days."""
    return spans(e, {"x": days}).drop("span")


def ratio(a, b):
    """A percentage to two places, halves to even; 0 without a base."""
    return F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b) * 100, 2)).otherwise(F.lit(0.0))


def windows(e: DataFrame) -> DataFrame:
    """All, last day and last week, with their ratios."""
    out = spans(e, {"all": None, "day": 1, "week": 7})
    return out.select("*", ratio("scan_completed", "scan_started").alias("completion"), ratio("unlock_clicked", "scan_completed").alias("click_through"), ratio("audit_unlocked", "unlock_clicked").alias("conversion"))


_C = ", ".join(f"count(*) FILTER (event = '{k}') AS {k}" for k in KINDS)
_WINDOWS = f"""s AS (SELECT 'all' AS span, NULL AS h UNION ALL SELECT 'day', 24 UNION ALL SELECT 'week', 168), t AS (SELECT max(created_at) AS as_of FROM metric_events),
v AS (SELECT span, count(*) AS events, count(DISTINCT email) AS users, {_C} FROM metric_events, s, t WHERE h IS NULL OR created_at >= as_of - to_hours(h) GROUP BY 1)"""
_RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN round_even(({a} / {b} * 100)::DOUBLE, 2) ELSE 0.0::DOUBLE END"
_RATIOS = f"{_RATIO('scan_completed', 'scan_started')} AS completion, {_RATIO('unlock_clicked', 'scan_completed')} AS click_through, {_RATIO('audit_unlocked', 'unlock_clicked')} AS conversion"


# fixed values: the columns of the two exports
SUMMARY = ("generated_at", "total_events", "unique_users", "scans_started", "scans_completed", "unlock_clicked", "audit_unlocked", "events_24h", "events_7d", "scans_started_24h", "scans_started_7d", "scans_completed_24h", "scans_completed_7d",
           "completion_rate", "completion_rate_24h", "completion_rate_7d", "unlock_click_through_rate", "unlock_click_through_rate_24h", "unlock_click_through_rate_7d", "unlock_conversion_rate", "unlock_conversion_rate_24h", "unlock_conversion_rate_7d")
ITEM = ("feedback_id", "email", "scan_id", "rating", "category", "comment", "issue_id", "created_at")


def iso(c: str) -> Column:
    """A time as text: microseconds only where there are some, and the offset of UTC."""
    part = F.pmod(micros(c), F.lit(1_000_000))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("+00:00"))


def csv_field(c: Column) -> Column:
    """A value as a field of a line: quoted, with its quotes doubled, where it holds a comma, a quote or a line's end."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.rlike(text, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def summary(e: DataFrame) -> DataFrame:
    """One row: totals, the last day's and the last week's, and three ratios of each; the time is that of the last event."""
    w = windows(e)
    pick = lambda c, span: F.max(F.when(F.col("span") == span, F.col(c)))
    of = {"": "all", "_24h": "day", "_7d": "week"}
    named = {"total_events": pick("events", "all"), "unique_users": pick("users", "all"), "unlock_clicked": pick("unlock_clicked", "all"), "audit_unlocked": pick("audit_unlocked", "all"), "events_24h": pick("events", "day"), "events_7d": pick("events", "week")}
    for end, span in of.items():
        named |= {f"scans_started{end}": pick("scan_started", span), f"scans_completed{end}": pick("scan_completed", span)}
        named |= {f"{n}{end}": F.coalesce(pick(c, span), F.lit(0.0)) for n, c in (("completion_rate", "completion"), ("unlock_click_through_rate", "click_through"), ("unlock_conversion_rate", "conversion"))}
    x = w.agg(*[(c if "rate" in n else F.coalesce(c, F.lit(0))).alias(n) for n, c in named.items()])
    return x.crossJoin(F.broadcast(e.agg(F.max("created_at").alias("_at")))).withColumn("generated_at", iso("_at")).select(*SUMMARY)  # one row


def csv_lines(x: DataFrame, columns: tuple[str, ...], *keys: str) -> DataFrame:
    """The lines of an export, the header's with null keys."""
    header = x.sparkSession.range(1).select(*[F.lit(None).cast(dict(x.dtypes)[k]).alias(k) for k in keys], F.lit(",".join(columns)).alias("line"))
    field = lambda c: F.format_string("%.2f", c) if c.split("_24h")[0].split("_7d")[0].endswith("_rate") else csv_field(F.col(c))
    return header.unionByName(x.select(*keys, F.concat_ws(",", *[field(c) for c in columns]).alias("line")))


def feedback_lines(f: DataFrame) -> DataFrame:
    """(feedback_id, line) of the export of feedback, all columns of each item."""
    return csv_lines(f.withColumn("created_at", iso("created_at")), ITEM, "feedback_id")


def _m(name, fn, sql):
    register(name, lambda spark, d: fn(metric_events(spark, d)), f"WITH {METRIC_EVENTS}{sql}")


def _f(name, fn, sql):
    register(name, lambda spark, d: fn(feedback(spark, d)), f"WITH {FEEDBACK}{sql}")


_m("a8_user_metrics", user_metrics, f"\nSELECT email, {_C} FROM metric_events GROUP BY 1")
_m("a9_cohort_metrics", lambda e: cohort(e, 1), f"\nSELECT count(*) AS events, count(DISTINCT email) AS users, {_C} FROM metric_events WHERE created_at >= (SELECT max(created_at) FROM metric_events) - INTERVAL 24 HOURS")
_m("a10_window_summary", windows, f", {_WINDOWS} SELECT *, {_RATIOS} FROM v")
_m("a18_quota_counts", lambda e: e.where(F.col("event") == "scan_started").groupBy("email", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("over_quota", F.col("n") > 3), "\nSELECT email, created_at::DATE AS day, count(*) AS n, count(*) > 3 AS over_quota FROM metric_events WHERE event = 'scan_started' GROUP BY 1, 2")
_m("u4_supported_events", lambda e: e.where(F.col("event").isin("scan_started", "audit_unlocked")).select("event_id"), "\nSELECT event_id FROM metric_events WHERE event IN ('scan_started', 'audit_unlocked')")
_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us({0}) % 1000000)::VARCHAR, 6, '0') END || '+00:00'"
_ROW = ", ".join(f"any_value({c}) FILTER (span = '{s}')" if "rate" not in n else f"printf('%.2f', any_value({c}) FILTER (span = '{s}'))" for n, c, s in (
    ("", "events", "all"), ("", "users", "all"), ("", "scan_started", "all"), ("", "scan_completed", "all"), ("", "unlock_clicked", "all"), ("", "audit_unlocked", "all"), ("", "events", "day"), ("", "events", "week"),
    ("", "scan_started", "day"), ("", "scan_started", "week"), ("", "scan_completed", "day"), ("", "scan_completed", "week"), *(("rate", c, s) for c in ("completion", "click_through", "conversion") for s in ("all", "day", "week"))))
_m("n1_metrics_csv", lambda e: csv_lines(summary(e), SUMMARY), f", {_WINDOWS}, r AS (SELECT *, {_RATIOS} FROM v) SELECT '{','.join(SUMMARY)}' AS line UNION ALL SELECT concat_ws(',', (SELECT {_AT.format('as_of')} FROM t), {_ROW}) FROM r")
_m("n4_upsert_latest", lambda e: e.withColumn("nth", F.row_number().over(W.partitionBy("email").orderBy(F.desc("created_at"), F.desc("event_id")))).where("nth = 1").select("email", "event", "event_id"), "\nSELECT email, event, event_id FROM metric_events QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at DESC, event_id DESC) = 1")

def upserted(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row a key: keep columns of its first row, the others of its last."""
    rest = [c for c in rows.columns if c != key and c not in keep]
    at = F.struct(*order)
    g = rows.groupBy(key).agg(F.min_by(F.struct(*keep), at).alias("_f"), F.max_by(F.struct(*rest), at).alias("_l"))
    return g.select(key, "_f.*", "_l.*")


def first_only(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; later ones are ignored."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


_m("n4_conflict_update", lambda e: upserted(e.select("email", "event", "event_id", "created_at"), "email", ["event_id"], ["created_at"]).select("email", "created_at", "event", "event_id"), "\nSELECT a.email, a.created_at, b.event, b.event_id FROM metric_events a JOIN metric_events b USING (email) WHERE a.event_id = (SELECT min(event_id) FROM metric_events x WHERE x.email = a.email) AND b.event_id = (SELECT max(event_id) FROM metric_events x WHERE x.email = a.email)")
_m("n4_insert_ignore", lambda e: first_only(e.where("event = 'audit_unlocked'").select("email", "scan_id", "event_id", "created_at"), ["email", "scan_id"], ["event_id"]), "\nSELECT email, scan_id, event_id, created_at FROM metric_events WHERE event = 'audit_unlocked' QUALIFY row_number() OVER (PARTITION BY email, scan_id ORDER BY event_id) = 1")
_m("s13_unlocks", lambda e: e.where("event = 'audit_unlocked'").select("email", "scan_id").distinct(), "\nSELECT email, scan_id FROM metric_events WHERE event = 'audit_unlocked' GROUP BY ALL")
_m("s13_revoked", lambda e: e.join(e.where("event = 'scan_failed'").select("email", "scan_id").distinct(), ["email", "scan_id"], "left_semi").select("event_id"), "\nSELECT event_id FROM metric_events m WHERE EXISTS (FROM metric_events x WHERE x.event = 'scan_failed' AND x.email = m.email AND x.scan_id = m.scan_id)")
_m("s13_user_scans", lambda e: e.where("event = 'scan_completed'").withColumn("nth", F.row_number().over(W.partitionBy("email").orderBy(F.desc("created_at"), F.desc("event_id")))).where("nth <= 50").select("email", "scan_id", "created_at", "nth"), "\nSELECT email, scan_id, created_at, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, event_id DESC) AS nth FROM metric_events WHERE event = 'scan_completed' QUALIFY nth <= 50")
_m("s13_range_reads", lambda e: e.where("email = 'u7@example.com' AND created_at >= timestamp'2024-01-15'").orderBy(F.desc("created_at")).select("event_id", "event", "created_at"), "\nSELECT event_id, event, created_at FROM metric_events WHERE email = 'u7@example.com' AND created_at >= TIMESTAMP '2024-01-15'")
_m("o5_history_page", lambda e: e.where("event = 'scan_completed'").orderBy(F.desc("created_at"), F.desc("event_id")).limit(50).select("event_id", "created_at"), "\nSELECT event_id, created_at FROM metric_events WHERE event = 'scan_completed' ORDER BY created_at DESC, event_id DESC LIMIT 50")


def filtered(f: DataFrame, email=None, scan_id=None, category=None, rating_min=None, rating_max=None, issue=None, since=None, until=None) -> DataFrame:
    """Every predicate is optional; those given are all required, time bounds included."""
    for cond, value in ((F.col("email") == email, email), (F.col("scan_id") == scan_id, scan_id), (F.col("category") == category, category), (F.col("rating") >= rating_min, rating_min), (F.col("rating") <= rating_max, rating_max), (F.col("issue_id") == issue, issue), (F.col("created_at") >= F.lit(since).cast("timestamp"), since), (F.col("created_at") <= F.lit(until).cast("timestamp"), until)):
        if value is not None:
            f = f.where(cond)
    return f


_f("f16_feedback_filter", lambda f: filtered(f, category="bug", rating_min=2, rating_max=4, since="2024-01-05 00:00:00", until="2024-01-20 00:00:00").select("feedback_id", "rating"), "\nSELECT feedback_id, rating FROM feedback WHERE category = 'bug' AND rating BETWEEN 2 AND 4 AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
_f("o4_feedback_page", lambda f: f.orderBy(F.desc("created_at"), F.desc("feedback_id")).offset(20).limit(20).select("feedback_id"), "\nSELECT feedback_id FROM feedback ORDER BY created_at DESC, feedback_id DESC LIMIT 20 OFFSET 20")
_f("w3_latest_feedback", lambda f: f.groupBy("email").agg(F.max_by("feedback_id", F.struct("created_at", "feedback_id")).alias("feedback_id")), "\nSELECT email, feedback_id FROM feedback QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at DESC, feedback_id DESC) = 1")


def gaps(f: DataFrame) -> DataFrame:
    """Whole seconds since a user's previous item, and whether that is too soon."""
    before = F.lag("created_at").over(W.partitionBy("email").orderBy("created_at", "feedback_id"))
    return f.withColumn("gap", (micros("created_at") - micros(before)) / 1e6).withColumn("too_soon", F.coalesce(F.col("gap") < 5, F.lit(False)))


def trailing_day(f: DataFrame) -> DataFrame:
    w = W.partitionBy("email").orderBy(micros("created_at")).rangeBetween(-86_400_000_000, 0)
    return f.withColumn("in_day", F.count(F.lit(1)).over(w)).withColumn("over_limit", F.col("in_day") > 30)


def near_duplicates(f: DataFrame) -> DataFrame:
    """The same scan, category, rating and comment within 600 s, among a user's last 20 items."""
    mine = W.partitionBy("email").orderBy("created_at", "feedback_id")
    key = ["email", "scan_id", "category", "rating", F.lower(F.trim("comment"))]
    same = W.partitionBy(*key).orderBy("created_at", "feedback_id")
    n = f.withColumn("nth", F.row_number().over(mine))
    n = n.withColumn("_ts", F.lag("created_at").over(same)).withColumn("_nth", F.lag("nth").over(same))
    return n.withColumn("repeated", F.coalesce((micros("created_at") - micros("_ts") <= 600_000_000) & (F.col("nth") - F.col("_nth") <= 20), F.lit(False)))


_f("w4_submission_gap", lambda f: gaps(f).select("feedback_id", "gap", "too_soon"), "\nSELECT feedback_id, (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 1e6 AS gap, coalesce((epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 1e6 < 5, false) AS too_soon FROM feedback WINDOW w AS (PARTITION BY email ORDER BY created_at, feedback_id)")
_f("w5_trailing_count", lambda f: trailing_day(f).select("feedback_id", "in_day", "over_limit"), "\nSELECT feedback_id, count(*) OVER w AS in_day, count(*) OVER w > 30 AS over_limit FROM feedback WINDOW w AS (PARTITION BY email ORDER BY created_at RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)")
_f("w6_near_duplicate", lambda f: near_duplicates(f).select("feedback_id", "repeated"), "\n, n AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at, feedback_id) AS nth FROM feedback) SELECT feedback_id, coalesce(epoch_us(created_at) - epoch_us(lag(created_at) OVER w) <= 600000000 AND nth - lag(nth) OVER w <= 20, false) AS repeated FROM n WINDOW w AS (PARTITION BY email, scan_id, category, rating, lower(trim(comment)) ORDER BY created_at, feedback_id)")
# comments with all that has to be quoted
_SAID = "concat(comment, CASE feedback_id % 5 WHEN 0 THEN ', and more' WHEN 1 THEN concat(' so ', chr(34), 'called', chr(34)) WHEN 2 THEN concat('two', chr(10), 'lines') WHEN 3 THEN chr(13) ELSE '' END)"
_IN_QUOTES = "CASE WHEN regexp_matches({0}, '[,\"\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_f("n2_feedback_csv", lambda f: feedback_lines(f.withColumn("comment", F.expr(_SAID))), f"\n, c AS (SELECT * REPLACE ({_SAID} AS comment) FROM feedback) SELECT NULL AS feedback_id, '{','.join(ITEM)}' AS line UNION ALL SELECT feedback_id, concat_ws(',', feedback_id, email, scan_id, rating, category, {_IN_QUOTES.format('comment')}, coalesce(issue_id, ''), {_AT.format('created_at')}) FROM c")
_f("k7_fixed_window_limit", lambda f: f.groupBy("email", F.window("created_at", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("email", F.col("w.start").alias("start"), "n", (F.col("n") > 10).alias("limited")), "\nSELECT email, time_bucket(INTERVAL 15 MINUTES, created_at) AS start, count(*) AS n, count(*) > 10 AS limited FROM feedback GROUP BY 1, 2")
_f("x14_email_key", lambda f: _emails(f), "\n, v AS (SELECT DISTINCT lower(trim(' ' || replace(email, 'u1', 'A.b+u1') || ' ')) AS email FROM feedback), g AS (SELECT replace(email, 'example.com', 'gmail.com') AS e FROM v UNION SELECT email FROM v) SELECT e AS email, CASE WHEN right(e, 10) = '@gmail.com' THEN replace(split_part(split_part(e, '@', 1), '+', 1), '.', '') || '@gmail.com' ELSE e END AS key FROM g")


def email_key(e: str) -> str:
    return f"CASE WHEN right({e}, 10) = '@gmail.com' THEN replace(split_part(split_part({e}, '@', 1), '+', 1), '.', '') || '@gmail.com' ELSE {e} END"


def _emails(f: DataFrame) -> DataFrame:
    v = f.select(F.lower(F.trim(F.concat(F.lit(" "), F.replace("email", F.lit("u1"), F.lit("A.b+u1")), F.lit(" ")))).alias("email")).distinct()
    g = v.select(F.replace("email", F.lit("example.com"), F.lit("gmail.com")).alias("email")).union(v).distinct()
    return g.select("email", F.expr(email_key("email")).alias("key"))
