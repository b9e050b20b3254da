"""Audits: comparison of windows, latency, coverage, deliveries, inventories, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import vec
from gridlark.operators import ranks


def compare(left: DataFrame, right: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row: vectors, complete pairs, exact vectors, mask disagreements and differences, value by value."""
    met = left.select(*keys, F.col(vector).alias("a")).join(right.select(*keys, F.col(vector).alias("b")), keys)
    pairs = F.zip_with("a", "b", lambda x, y: F.struct(vec.is_finite(x).alias("fa"), vec.is_finite(y).alias("fb"), F.abs(x.cast("double") - y.cast("double")).alias("d")))
    rows = met.select((vec.complete(F.col("a")) & vec.complete(F.col("b"))).alias("pair"), pairs.alias("p"))
    count = lambda test: F.size(F.filter("p", test))
    both = F.transform(F.filter("p", lambda s: s["fa"] & s["fb"]), lambda s: s["d"])
    rows = rows.select(
        "pair",
        (F.col("pair") & F.forall("p", lambda s: s["d"] == 0)).alias("exact"),
        count(lambda s: s["fa"] != s["fb"]).alias("mask"),
        F.size(both).alias("n"),
        F.array_max(both).alias("hi"),
        F.aggregate(both, F.lit(0.0), lambda s, x: s + x).alias("sum"),
    )
    return rows.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if("pair").alias("n_complete"), F.count_if("exact").alias("n_exact"), F.coalesce(F.sum("mask"), F.lit(0)).cast("long").alias("mask_disagreements"), F.max("hi").alias("max_difference"), (F.sum("sum") / F.sum("n")).alias("mean_difference"))


def spot_check(local: DataFrame, native: DataFrame, foreign: DataFrame, keys: list[str], window: str, vector: str = "embedding") -> DataFrame:
    """window and outcome of each window of local pixels against the native source and those of other zones.

    local holds window, keys, vector; native and foreign (any number of sources) hold keys and vector. Without a complete
    local or native pixel nothing can be said; else either all pixels agree, or a pixel that differs
    equals one of another zone's source, or the difference stays unresolved.
    """
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    met = local.select(window, *keys, F.col(vector).alias("__a")).join(native.select(*keys, F.col(vector).alias("__b")), keys, "left")
    others = foreign.select(*keys, F.col(vector).alias("__c"))
    held = vec.complete(a)
    differs = ~F.coalesce(vec.complete(b) & (a == b), F.lit(False))
    crossed = met.where(held & differs).join(others, keys).where(a == c).select(window).distinct().withColumn("__crossed", F.lit(True))
    seen = met.groupBy(window).agg(F.bool_or(held).alias("__local"), F.bool_or(vec.complete(b)).alias("__native"), F.bool_and(a.eqNullSafe(b)).alias("__same"))
    outcome = (
        F.when(~F.col("__local"), "inconclusive_local_nodata")
        .when(~F.col("__native"), "inconclusive_native_nodata")
        .when(F.col("__same"), "sample_native_match")
        .when(F.col("__crossed"), "cross_utm_source_match_at_differing_pixels")
        .otherwise("unresolved_difference_not_automatically_resampling")
    )
    return seen.join(crossed, window, "left").select(window, outcome.alias("outcome"))


def latency(log: DataFrame, event: str = "event", value: str = "latency") -> DataFrame:
    """Count, p50, p95 (linear interpolation) and maximum by event."""
    one = log.groupBy(event).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max"))
    return ranks.joined(one, ranks.percentiles(log, [event], value, {"p50": 0.5, "p95": 0.95}), [event]).select(event, "n", "p50", "p95", "max")


def benchmark_summary(calls: DataFrame, by: str, value: str, payload: str) -> DataFrame:
    """Calls, total, mean, median, p95, extremes and payload per second."""
    one = calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(payload) / F.sum(value)).alias("rate"))
    return ranks.joined(one, ranks.percentiles(calls, [by], value, {"median": 0.5, "p95": 0.95}), [by]).select(by, "calls", "total", "mean", "median", "p95", "min", "max", "rate")


def coverage(df: DataFrame, area: str, ok: Column, by: list[str]) -> DataFrame:
    """Total, valid and missing area with percentages; null where the total is not positive."""
    out = df.groupBy(*by).agg(F.sum(area).alias("total"), F.sum(F.when(ok, F.col(area)).otherwise(0.0)).alias("valid"))
    out = out.withColumn("missing", F.col("total") - F.col("valid"))
    pct = lambda c: F.when(F.col("total") > 0, F.col(c) * 100 / F.col("total"))
    return out.withColumn("valid_percent", pct("valid")).withColumn("missing_percent", pct("missing"))


def delivery_check(expected: DataFrame, actual: DataFrame, key: str, status: Column) -> DataFrame:
    """One row of counts: expected, delivered, missing, unexpected and incomplete ids."""
    e, a = expected.select(F.col(key).alias("k")).distinct().withColumn("e", F.lit(True)), actual.groupBy(F.col(key).alias("k")).agg(F.bool_and(status).alias("done"))
    met = e.join(a, "k", "full")
    return met.agg(F.count_if("e").alias("n_expected"), F.count_if(F.col("done").isNotNull()).alias("n_delivered"), F.count_if(F.col("e") & F.col("done").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_unexpected"), F.count_if(~F.col("done")).alias("n_incomplete"))


#: What is redacted, and with what.
REDACTIONS = (
    (r"(?i)(authorization\s*:\s*bearer\s+)[^\s,;]+", "$1<redacted>"),
    (r"(?i)((?:refresh_token|access_token|client_secret|id_token)\s*[=:]\s*)['\"]?[^\s,'\"}]+", "$1<redacted>"),
    (r"(?i)\bgee-[a-z0-9][a-z0-9-]{4,}\b", "<redacted-project>"),
)


def redact(c: Column) -> Column:
    """Text without bearer tokens, named credentials and project ids."""
    for pattern, put in REDACTIONS:
        c = F.regexp_replace(c, pattern, put)
    return c


#: Status codes, exception names and phrases by which a failed request is told retryable or permanent.
TIMEOUT_PHRASES = ("timed out", "deadline exceeded")
RETRY_STATUS = (408, 409, 425, 429)
PERMANENT_STATUS = (400, 401, 403, 404)
PERMANENT_PHRASES = ("authentication", "authenticate", "invalid credential", "permission denied", "not authorized", "unauthorized", "invalid argument", "unknown band", "schema", "not found", "certificate verify failed", "hostname mismatch")
RETRY_KINDS = ("chunkedencodingerror", "connectionerror", "incompleteread", "protocolerror", "readtimeouterror", "remotedisconnected", "responsevalidationerror", "ssleoferror", "earthengineresponseerror", "connectionreseterror", "connectionabortederror", "connectionrefusederror", "brokenpipeerror")
RETRY_PHRASES = ("connection reset", "connection aborted", "connection refused", "temporarily unavailable", "internal error", "backend error", "rate limit", "too many requests", "quota exceeded", "service unavailable", "remote end closed", "connection broken", "eof occurred in violation of protocol", "incomplete read", "peer closed connection", "response ended prematurely", "tls/ssl connection has been closed", "unexpected eof while reading")


def error_class(status: Column, message: Column, kind: Column | None = None) -> Column:
    """timeout, retryable or permanent, of a request's status code, message and exception name; what is unknown is permanent."""
    text, name = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(kind if kind is not None else F.lit(""), F.lit("")))
    has = lambda c, phrases: F.exists(F.array(*map(F.lit, phrases)), lambda x: F.contains(c, x))
    code = F.coalesce(status.cast("int"), F.lit(0))
    rules = [
        ("timeout", F.contains(name, F.lit("timeout")) | has(text, TIMEOUT_PHRASES)),
        ("retryable", code.isin(*RETRY_STATUS) | code.between(500, 599)),
        ("permanent", code.isin(*PERMANENT_STATUS) | has(text, PERMANENT_PHRASES)),
        ("retryable", has(name, RETRY_KINDS) | has(text, RETRY_PHRASES)),
    ]
    return F.coalesce(*[F.when(test, F.lit(label)) for label, test in rules], F.lit("permanent"))


def progress(log: DataFrame, by: str, order: list[str], event: str = "event") -> DataFrame:
    """Events and the last one by key."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n_events"), F.max(F.struct(*order, event))[event].alias("last_event"))


def raw_gib(height: Column, width: Column, years: int) -> Column:
    """Size of a grid's float32 vectors in GiB."""
    return height.cast("bigint") * width.cast("bigint") * (years * vec.BANDS * 4) / float(1 << 30)


def signature_of(rows: DataFrame, text: Column) -> DataFrame:
    """n_rows and signature of a table by a text of each row, whatever the rows' order.

    Row digests are sorted and hashed in 65,536 buckets of their first digits, these in 256, these
    at last in one: hashes of sorted hashes. A digest of one ordered stream would take a single task.
    """
    digest = rows.select(F.sha2(text.cast("binary"), 256).alias("h"))
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ",").cast("binary"), 256)
    low = digest.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.count(F.lit(1)).alias("n"), fold("h").alias("h"))
    mid = low.groupBy(F.substring("b", 1, 2).alias("c")).agg(F.sum("n").alias("n"), fold(F.concat("b", "h")).alias("h"))
    return mid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), fold(F.concat("c", "h")).alias("signature"))


def sample_signature(df: DataFrame, key: str = "sample_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Signature of a table's ids and coordinates (ten decimals)."""
    return signature_of(df, F.concat_ws("\t", F.col(key).cast("string"), F.format_string("%.10f", F.col(lon)), F.format_string("%.10f", F.col(lat))))


def content_signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signature of whole rows, as JSON arrays of their values' texts; null and NaN are null."""
    value = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "NaN"), F.col(c).cast("string"))
    return signature_of(df, F.to_json(F.array(*[value(c) for c in columns])))


def parse_log(lines: DataFrame, marker: str, schema: str, column: str = "value") -> DataFrame:
    """Events of an append-only log: lines of the form `marker {json}`; other lines are left out."""
    hit = F.col(column).startswith(marker + " ")
    return lines.where(hit).select(F.from_json(F.substring(column, len(marker) + 2, 1 << 30), schema).alias("e")).select("e.*")


def report_summary(reports: DataFrame, peak: str, workflow: str, ready: list[Column]) -> DataFrame:
    """One row: reports, distinct workflows, median and largest peak, and whether each kind in `ready` was seen."""
    seen = F.lit(True)
    for r in ready:
        seen = seen & F.coalesce(F.bool_or(r), F.lit(False))
    one = reports.agg(F.count(F.lit(1)).alias("n_reports"), F.countDistinct(workflow).alias("n_workflows"), F.max(peak).alias("max_peak"), seen.alias("calibration_ready"))
    return ranks.joined(one, ranks.percentiles(reports, [], peak, {"median_peak": 0.5}), []).select("n_reports", "n_workflows", "median_peak", "max_peak", "calibration_ready")


def probes_pass(probes: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """by, probes and whether each probe holds a finite value."""
    finite = F.exists(vector, vec.is_finite)
    return probes.groupBy(by).agg(F.count(F.lit(1)).alias("n_probes"), F.bool_and(F.coalesce(finite, F.lit(False))).alias("passed"))
