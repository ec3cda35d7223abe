"""Queries over the scalar and service rules; their inputs are made of the sample tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import scalars as sc
from vellum.operators import service
from vellum.plans.catalogue import LINES, query
from vellum.sources import table


def _pick(values: list[str | None], by: str) -> str:
    """A value by a whole number, in both dialects: CASE over the remainder."""
    whens = " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values))
    return f"CASE {by} % {len(values)} {whens} END"


# --- scalar rules ------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def visible_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(sc.visible_text(F.col("text")), 256).alias("digest"))


_SQUEEZED = r"trim(regexp_replace(nfc_normalize({}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(
    f"""WITH {LINES}, e AS (SELECT doc_id, line_no, line, CAST(length(line) // 4 AS INTEGER) AS s, CAST(length(line) // 2 AS INTEGER) AS t FROM lines WHERE line_no % 5 = 0)
SELECT doc_id, line_no, CASE WHEN trim(regexp_replace(substring(line, s + 1, t - s), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> '' THEN
sha256({_SQUEEZED.format("substring(line, 1, s)")} || chr(0) || {_SQUEEZED.format("substring(line, s + 1, t - s)")} || chr(0) || {_SQUEEZED.format("substring(line, t + 1, length(line))")}) END AS id FROM e"""
)
def emphasis_ids(spark, sf):
    """The second quarter of every fifth line as an emphasised range."""
    own = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line_no % 5 = 0")
    own = own.withColumn("s", F.expr("cast(length(line) div 4 AS int)")).withColumn("t", F.expr("cast(length(line) div 2 AS int)"))
    return own.select("doc_id", "line_no", sc.emphasis_id(F.col("line"), F.col("s"), F.col("t")).alias("id"))


_MARKED = "CASE line_no % 6 WHEN 0 THEN '## ' || line WHEN 1 THEN '- ' || line WHEN 2 THEN '12) ' || line WHEN 3 THEN '[7] ' || line WHEN 4 THEN line ELSE '  * ' || line END"
_KIND = "CASE line_no % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'reference' WHEN 3 THEN 'reference' WHEN 4 THEN 'paragraph' ELSE 'list' END"


@query(
    rf"""WITH {LINES}, m AS (SELECT doc_id, line_no, {_MARKED} AS raw, {_KIND} AS kind FROM lines)
SELECT doc_id, line_no, kind, CAST(CASE kind WHEN 'heading' THEN strlen(regexp_extract(raw, '^ {{0,3}}#{{1,6}}[ \t]+')) WHEN 'list' THEN strlen(regexp_extract(raw, '^\s*(?:[-+*]|\d+[.)])[ \t]+'))
WHEN 'reference' THEN strlen(regexp_extract(raw, '^\s*(?:\[\d{{1,4}}\]|\d{{1,4}}[.)])[ \t]+')) ELSE 0 END AS BIGINT) AS content_start FROM m"""
)
def content_starts(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = own.select("doc_id", "line_no", F.expr(_MARKED).alias("raw"), F.expr(_KIND).alias("kind"))
    return own.select("doc_id", "line_no", "kind", sc.content_start(F.col("raw"), F.col("kind")).alias("content_start"))


_LISTED = "CASE line_no % 4 WHEN 0 THEN '3. ' || line WHEN 1 THEN '* ' || line WHEN 2 THEN '17 ' || line ELSE line END"
_TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"


@query(
    rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, regexp_extract_all({_LISTED}, '{_TOKEN}') AS t FROM lines),
d AS (SELECT *, CASE WHEN regexp_full_match(t[1], '[0-9]+') THEN CASE WHEN t[2] IN ('.', ')') THEN 2 ELSE 1 END WHEN t[1] IN ('-', '+', '*') THEN 1 ELSE 0 END AS k FROM t)
SELECT doc_id, line_no, CAST(len(t) - coalesce(k, 0) AS BIGINT) AS n, coalesce(t[coalesce(k, 0) + 1], '') AS first FROM d"""
)
def content_token_runs(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("raw", F.expr(_LISTED))
    own = own.select("doc_id", "line_no", sc.content_tokens(F.col("raw"), F.lit("list")).alias("t"))
    return own.select("doc_id", "line_no", F.size("t").cast("long").alias("n"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


_WORDS = ["merge", "Extract", " ON ", "", "bogus", None, "extraction_and_merge", "0", "full", "none"]
_NAMES = ["a.pdf", "b.PDF", "pdf", "c.pdf.txt", "d.", None, "x.y.pdf"]
_IDS = ["7d444840-9dc0-11d1-b245-5ffdce74fad2", "7D4448409DC011D1B2455FFDCE74FAD2", "{7d444840-9dc0-11d1-b245-5ffdce74fad2}", "no-id", "", None]


@query(
    f"""WITH r AS (SELECT event_id, {_pick(_WORDS, "event_id")} AS scope, event_id % 3 = 0 AS everything, {_pick(_NAMES, "event_id")} AS name, {_pick(_IDS, "event_id")} AS pid, {_pick(["true", "Yes", "0", None], "event_id")} AS flag, {_pick(["a, b,,c", "", None, " x "], "event_id")} AS csv FROM events),
s AS (SELECT *, lower(trim(coalesce(scope, ''))) AS w FROM r),
a AS (SELECT *, CASE w WHEN 'false' THEN 'none' WHEN '0' THEN 'none' WHEN 'off' THEN 'none' WHEN 'true' THEN 'all' WHEN '1' THEN 'all' WHEN 'on' THEN 'all' WHEN 'full' THEN 'all' WHEN 'extract' THEN 'extraction' WHEN 'extraction_and_merge' THEN 'extraction' ELSE w END AS n FROM s)
SELECT event_id, CASE WHEN n = '' THEN CASE WHEN everything THEN 'all' ELSE 'none' END WHEN everything AND n = 'none' THEN 'all' WHEN n IN ('none', 'merge', 'extraction', 'all') THEN n END AS scope,
coalesce(contains(name, '.') AND lower(list_last(string_split(name, '.'))) = 'pdf', false) AS pdf, coalesce(regexp_full_match(lower(regexp_replace(trim(pid), '^urn:uuid:|[{{}}-]', '', 'g')), '[0-9a-f]{{32}}'), false) AS uuid,
CASE WHEN flag IS NULL THEN true ELSE lower(trim(flag)) IN ('true', '1', 'yes', 'on') END AS flag, CAST(len(list_filter(list_transform(string_split(coalesce(csv, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_csv FROM a"""
)
def request_rules(spark, sf):
    """Scope, file name, id, switch and list of a request, from texts that the event's number picks."""
    e = table(spark, sf, "events").select("event_id", *(F.expr(_pick(v, "event_id")).alias(n) for v, n in ((_WORDS, "scope"), (_NAMES, "name"), (_IDS, "pid"), (["true", "Yes", "0", None], "flag"), (["a, b,,c", "", None, " x "], "csv"))))
    return e.select("event_id", sc.purge_scope(F.col("scope"), F.col("event_id") % 3 == 0).alias("scope"), sc.is_pdf_name(F.col("name")).alias("pdf"), sc.is_uuid(F.col("pid")).alias("uuid"), sc.truth(F.col("flag"), True).alias("flag"), F.size(sc.csv_values(F.col("csv"))).cast("long").alias("n_csv"))


_SCALARS = ["12", "0", "-4", "true", "3.0", None, "007", "99999999999999999999", "NaN", "Infinity", "x"]


@query(
    f"""WITH r AS (SELECT event_id, {_pick(_SCALARS, "event_id")} AS v, {_pick(["ModelRefusalError", "ReadTimeout", "ValueError", "TimeoutError"], "event_id")} AS kind, value FROM events)
SELECT event_id, CASE WHEN regexp_full_match(v, '[0-9]+') THEN coalesce(TRY_CAST(v AS BIGINT), 0) ELSE 0 END AS n, CASE WHEN TRY_CAST(v AS DOUBLE) >= 0 AND isfinite(TRY_CAST(v AS DOUBLE)) THEN TRY_CAST(v AS DOUBLE) END AS metric,
CASE WHEN contains(lower(kind), 'refusal') THEN 'terra_refusal' WHEN contains(lower(kind), 'timeout') THEN 'terra_timeout' ELSE 'no_valid_terra_selection' END AS first,
CASE WHEN contains(lower(kind), 'refusal') THEN 'sol_refusal' WHEN contains(lower(kind), 'timeout') THEN 'sol_timeout' ELSE 'no_valid_sol_selection' END AS second,
round(CAST(event_id AS DOUBLE) / 8, 2) AS x0 FROM r"""
)
def coerced_scalars(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_pick(_SCALARS, "event_id")).alias("v"), F.expr(_pick(["ModelRefusalError", "ReadTimeout", "ValueError", "TimeoutError"], "event_id")).alias("kind"))
    box = sc.rounded_box(F.array(F.col("event_id").cast("double") / 8, F.lit(1.0)))
    return e.select("event_id", sc.positive_int(F.col("v")).alias("n"), sc.metric_value(F.col("v")).alias("metric"), sc.failure_reason(F.col("kind")).alias("first"), sc.failure_reason(F.col("kind"), 2).alias("second"), box[0].alias("x0"))


@query("""SELECT event_id, 'Event ' || event_id || ' of ' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '{user}' END || ' is {a {kind}' || CASE WHEN event_id % 5 = 0 THEN ' {user}' ELSE '' END AS rendered FROM events""")
def rendered_templates(spark, sf):
    """A name without a value stays, a value that looks like a name is not looked up again."""
    e = table(spark, sf, "events")
    values = F.map_concat(F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("more"), F.when(F.col("event_id") % 5 == 0, " {user}").otherwise("")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    return e.select("event_id", sc.rendered(F.lit("Event {id} of {user} is {a {kind}{more}"), values).alias("rendered"))


# --- replies, queues and caches ----------------------------------------------------------------------------

_STATES = ["submitting", "queued", "running", "succeeded", "failed", "cancelled", None, "weird"]


@query(
    f"""WITH r AS (SELECT event_id AS process_id, {_pick(_STATES, "event_id")} AS status, CASE WHEN event_id % 4 = 0 THEN 'E' || event_id % 10 END AS error_code, CASE WHEN event_id % 3 = 0 THEN repeat('abcde', CAST(event_id % 1000 AS INTEGER)) END AS error_message FROM events)
SELECT process_id, CASE coalesce(status, 'pending') WHEN 'submitting' THEN 'pending' WHEN 'queued' THEN 'pending' WHEN 'running' THEN 'started' WHEN 'succeeded' THEN 'complete' ELSE coalesce(status, 'pending') END AS status,
CASE WHEN status IN ('succeeded', 'failed', 'cancelled') THEN 200 ELSE 202 END AS code, error_code, CASE WHEN error_message <> '' THEN CASE WHEN length(error_message) <= 4000 THEN error_message ELSE substring(error_message, 1, 4000) || '... [' || (length(error_message) - 4000) || ' characters omitted]' END END AS error FROM r"""
)
def submission_replies(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS process_id", f"{_pick(_STATES, 'event_id')} AS status", "CASE WHEN event_id % 4 = 0 THEN concat('E', event_id % 10) END AS error_code", "CASE WHEN event_id % 3 = 0 THEN repeat('abcde', cast(event_id % 1000 AS int)) END AS error_message")
    return service.replies(e)


_CODE = "CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 503 WHEN 1 THEN 422 ELSE NULL END WHEN 'purchase' THEN 202 WHEN 'click' THEN 502 ELSE NULL END"


@query(
    f"""WITH a AS (SELECT user_id AS job_id, event_id AS seq, {_CODE} AS code, 'reply ' || event_id AS detail FROM events), v AS (SELECT *, CASE WHEN code BETWEEN 200 AND 299 THEN 'accepted' WHEN code IN (400, 401, 403, 413, 415, 422) THEN 'failed' END AS verdict FROM a),
f AS (SELECT job_id, min(seq) FILTER (WHERE verdict IS NOT NULL) AS stop FROM v GROUP BY job_id)
SELECT job_id, count(*) FILTER (WHERE stop IS NULL OR seq <= stop) AS n_attempts, coalesce(max(verdict) FILTER (WHERE seq = stop), 'queued') AS outcome, max(detail) FILTER (WHERE seq = stop AND verdict = 'failed') AS detail FROM v JOIN f USING (job_id) GROUP BY job_id"""
)
def handoff_outcomes(spark, sf):
    return service.handoff(table(spark, sf, "events").selectExpr("user_id AS job_id", "event_id AS seq", f"{_CODE} AS code", "concat('reply ', event_id) AS detail"))


_MESSAGES = ["Read timed out", "HTTP 503 from host", "bad input", "Connection reset by peer", "empty output", None]


@query(
    f"""WITH a AS (SELECT o_custkey AS process_id, {_pick(["grobid", "docling", "marker"], "o_orderkey")} AS source, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS attempt, o_orderkey % 5 IN (0, 3) AS ok, {_pick(_MESSAGES, "o_orderkey")} AS message, CAST(o_orderkey % 7 * 100 AS DOUBLE) AS left_ FROM orders),
p AS (SELECT process_id, source, coalesce(bool_or(ok) FILTER (WHERE attempt = 1), false) AS a, coalesce(bool_or(NOT ok AND regexp_matches(lower(coalesce(message, '')), 'timed out|timeout|temporarily unavailable|connection reset|connection refused|service unavailable|worker_not_ready|http 502|http 503|http 504') AND left_ > 300) FILTER (WHERE attempt = 1), false) AS m,
coalesce(bool_or(ok) FILTER (WHERE attempt = 2), false) AS b FROM a GROUP BY ALL), q AS (SELECT process_id, count(*) AS n, count(*) FILTER (WHERE a OR (m AND b)) AS n_ok, count(*) FILTER (WHERE m) AS n_retried FROM p GROUP BY process_id)
SELECT process_id, n_ok, n_retried, CASE WHEN n_ok = n THEN 'complete' WHEN n_ok > 0 THEN 'partial' ELSE 'emergency' END AS outcome FROM q"""
)
def extraction_outcomes(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey AS process_id", f"{_pick(['grobid', 'docling', 'marker'], 'o_orderkey')} AS source", "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS attempt", "o_orderkey % 5 IN (0, 3) AS ok", f"{_pick(_MESSAGES, 'o_orderkey')} AS message", "cast(o_orderkey % 7 * 100 AS double) AS seconds_left")
    return service.extraction_outcomes(o)


@query(
    """WITH a AS (SELECT l_orderkey AS process_id, CASE l_returnflag WHEN 'A' THEN 'merged' WHEN 'R' THEN 'audit' ELSE 'images' END AS kind, CASE WHEN l_linenumber % 6 = 0 THEN '' ELSE 'runs/' || l_partkey END AS key, l_linenumber AS seq FROM lineitem),
k AS (SELECT process_id, kind, max(struct_pack(seq := seq, key := key)).key AS key FROM a WHERE key <> '' GROUP BY ALL)
SELECT process_id, string_agg(kind || '=' || key, ',' ORDER BY kind) AS artifacts FROM k GROUP BY process_id"""
)
def artifact_maps(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "merged").when(F.col("l_returnflag") == "R", "audit").otherwise("images")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("process_id"), kind.alias("kind"), F.when(F.col("l_linenumber") % 6 == 0, "").otherwise(F.concat(F.lit("runs/"), F.col("l_partkey").cast("string"))).alias("key"), F.col("l_linenumber").alias("seq"))
    return service.artifact_map(rows).select("process_id", F.array_join(F.transform(F.map_entries("artifacts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("artifacts"))


_FILES = ["merged.md", "grobid_marker_merged.md", "grobid_consensus_metrics.json", "x_audit.json", "grobid.md", "docling.md.page-coverage.json", "marker.md.native.json", "marker.md.tmp", "images.json"]


@query(
    f"""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS hash, 'v4_' || l_orderkey || '_' || {_pick(_FILES, "(l_partkey + l_linenumber)")} AS name FROM lineitem), q AS (SELECT CAST(o_orderkey AS VARCHAR) AS hash, {_pick(["none", "merge", "extraction", "all"], "o_custkey")} AS scope FROM orders),
j AS (SELECT hash, name, scope, regexp_extract(name, '^v[0-9]+_[^_]+_(.*)$', 1) AS rest FROM c JOIN q USING (hash))
SELECT DISTINCT hash, name FROM j WHERE scope = 'all' OR (scope IN ('merge', 'extraction') AND regexp_full_match(rest, 'merged\\.md|.*_merged\\.md|.*_consensus_metrics\\.json|.*_audit\\.json')) OR (scope = 'extraction' AND regexp_full_match(rest, '(?:grobid|docling|marker)\\.md(?:\\.page-coverage\\.json|\\.native\\..*)?'))"""
)
def purge_sets(spark, sf):
    files = table(spark, sf, "lineitem").selectExpr("cast(l_orderkey AS string) AS hash", f"concat('v4_', l_orderkey, '_', {_pick(_FILES, '(l_partkey + l_linenumber)')}) AS name")
    asked = table(spark, sf, "orders").selectExpr("cast(o_orderkey AS string) AS hash", f"{_pick(['none', 'merge', 'extraction', 'all'], 'o_custkey')} AS scope")
    return service.purged(files, asked)


@query(
    f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS hash, {_pick(["grobid", "docling", "marker"], "doc_id")} AS source, CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS text, doc_id % 5 <> 0 AS native, doc_id % 2 = 0 AS wants, doc_id % 4 = 0 AS has FROM documents)
SELECT hash, source, regexp_matches(text, '\\S') AND native AND (source <> 'marker' OR NOT wants OR has) AS usable, NOT regexp_matches(text, '\\S') AS discard FROM c"""
)
def cache_validity(spark, sf):
    c = table(spark, sf, "documents").selectExpr("cast(doc_id AS string) AS hash", f"{_pick(['grobid', 'docling', 'marker'], 'doc_id')} AS source", "CASE WHEN doc_id % 11 = 0 THEN concat(' ', char(10)) ELSE text END AS text", "doc_id % 5 <> 0 AS native_valid", "doc_id % 2 = 0 AS wants_images", "doc_id % 4 = 0 AS has_manifest")
    return service.usable_cache(c)


@query(
    f"""WITH c AS (SELECT user_id AS process_id, {_pick(["object", "file", "bundle", "other"], "event_id")} AS origin, 'k' || event_id AS key, event_id % 8 = 2 AS verified FROM events),
r AS (SELECT *, CASE WHEN origin = 'bundle' AND verified THEN 1 WHEN origin = 'file' THEN 2 WHEN origin = 'object' THEN 3 END AS rank FROM c)
SELECT process_id, origin, key FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY rank, key) = 1"""
)
def download_sources(spark, sf):
    c = table(spark, sf, "events").selectExpr("user_id AS process_id", f"{_pick(['object', 'file', 'bundle', 'other'], 'event_id')} AS origin", "concat('k', event_id) AS key", "event_id % 8 = 2 AS verified")
    return service.download_source(c)


_PAYLOADS = ['{"status": " Pending ", "process_id": "a"}', '{"status": "pending", "eta": 3}', '{"status": "complete"}', '{"status": "Canceled", "message": "x"}', '{"status": "FAILURE"}', "{}", "[1]", None, '{"images": [1, 2], "status": "success"}', '{"artifacts_json": {"images": [{"a": 1}]}}']
_CHECKS = ['{"fresh_active_runs": 2, "broker_queued": 5}', '{"queued_runs": true, "broker_unacked": 1}', '{"broker_queued": "unknown"}', "{}", None, '{"fresh_active_runs": -3, "queued_runs": 0}']


def _keys(json: str) -> str:
    return f"CASE WHEN json_type({json}) = 'OBJECT' THEN json_keys({json}) END"


@query(
    f"""WITH r AS (SELECT event_id, {_pick(_PAYLOADS, "event_id")} AS p, {_pick(_CHECKS, "event_id")} AS c, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 END AS b FROM events),
k AS (SELECT *, lower(trim(p ->> '$.status')) AS s, {_keys("p")} AS ks FROM r)
SELECT event_id, coalesce(s = 'pending' AND len(list_filter(ks, lambda x: x NOT IN ('process_id', 'status'))) = 0, false) AS bare, CASE WHEN s IN ('complete', 'completed', 'succeeded', 'success') THEN 'complete' WHEN s IN ('cancelled', 'canceled') THEN 'cancelled' WHEN s IN ('failed', 'failure', 'error') THEN 'failed' END AS event,
CAST(coalesce(CASE WHEN json_type(p, '$.images') = 'ARRAY' THEN json_array_length(p, '$.images') END, CASE WHEN json_type(p, '$.artifacts_json.images') = 'ARRAY' THEN json_array_length(p, '$.artifacts_json.images') END, 0) AS BIGINT) AS images,
CAST(list_max(list_transform(['fresh_active_runs', 'queued_runs', 'broker_queued', 'broker_unacked'], lambda n: CASE WHEN json_type(c, '$.' || n) IN ('UBIGINT', 'BIGINT') THEN greatest(CAST(c ->> ('$.' || n) AS BIGINT), 0) ELSE 0 END)) AS BIGINT) AS active,
CASE WHEN greatest(a, b) IS NULL OR ((a IS NULL OR b IS NULL) AND greatest(a, b) = 0) THEN 'unknown' ELSE CAST(greatest(a, b) AS VARCHAR) END AS depth,
CASE WHEN event_id % 9 = 0 THEN 'disabled' WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'loading' WHEN len(ks) > 0 THEN 'ok' ELSE 'missing' END AS ready FROM k"""
)
def reply_rules(spark, sf):
    """What single replies and health checks say."""
    e = table(spark, sf, "events").select("event_id", F.expr(_pick(_PAYLOADS, "event_id")).alias("p"), F.expr(_pick(_CHECKS, "event_id")).alias("c"))
    n = F.col("event_id")
    a, b = F.when(n % 4 != 0, n % 3), F.when(n % 5 != 0, n % 7)
    ready = service.readiness(n % 9 != 0, F.when(n % 7 != 0, F.lit("/ready")), n % 5 != 0, F.col("p"))
    return e.select(
        "event_id", service.bare_pending(F.col("p")).alias("bare"), service.terminal_event(F.get_json_object("p", "$.status")).alias("event"), service.image_count(F.col("p")).alias("images"),
        service.active_jobs(F.col("c")).alias("active"), service.broker_depth(a, b).alias("depth"), ready.alias("ready"),
    )


@query(
    """WITH r AS (SELECT o_orderkey AS job_id, o_orderdate < TIMESTAMP '1996-01-01' AS expired FROM orders), p AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
SELECT job_id, expired FROM r WHERE expired AND job_id IN (SELECT l_orderkey FROM p)"""
)
def removable_records(spark, sf):
    records = table(spark, sf, "orders").selectExpr("o_orderkey AS job_id", "o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00' AS expired")
    return service.removable(records, table(spark, sf, "lineitem").where("l_linestatus = 'F'").selectExpr("l_orderkey AS process_id"))


_ACTIVITIES = ["Desired capacity changed from 2 to 0", "shrinking the capacity from 1 to 0", "desired capacity. from 2 to 0", "Launching", "Desired capacity from 0 to 3"]


@query(
    f"""WITH a AS (SELECT user_id AS grp, ts AS started, {_pick(_ACTIVITIES, "event_id")} AS d, CASE WHEN event_id % 3 = 0 THEN 'Failed' ELSE 'Successful' END AS code FROM events)
SELECT grp, max(started) FILTER (WHERE code = 'Successful' AND started > TIMESTAMP '2024-01-10' AND (regexp_matches(lower(d), 'desired capacity[^.]*from \\d+ to 0') OR regexp_matches(lower(d), 'shrinking[^.]*capacity from \\d+ to 0'))) AS latest FROM a GROUP BY grp"""
)
def scale_to_zero(spark, sf):
    a = table(spark, sf, "events").selectExpr("user_id AS grp", "ts AS started", f"{_pick(_ACTIVITIES, 'event_id')} AS description", "CASE WHEN event_id % 3 = 0 THEN 'Failed' ELSE 'Successful' END AS code")
    return service.latest_scale_to_zero(a, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))


@query(
    """WITH i AS (SELECT user_id AS grp, ts AS launched, CASE event_id % 4 WHEN 0 THEN 'terminated' WHEN 1 THEN 'shutting-down' ELSE 'running' END AS state FROM events), p AS (SELECT grp, min(launched) FILTER (WHERE state = 'running') AS earliest FROM i GROUP BY grp)
SELECT grp, coalesce((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(earliest)) / 60000000, 0.0) AS oldest_minutes, earliest FROM p"""
)
def instance_ages(spark, sf):
    i = table(spark, sf, "events").selectExpr("user_id AS grp", "ts AS launched", "CASE event_id % 4 WHEN 0 THEN 'terminated' WHEN 1 THEN 'shutting-down' ELSE 'running' END AS state")
    return service.launch_ages(i, F.expr("TIMESTAMP '2024-02-01 00:00:00'"))


@query("SELECT event_id AS job_id, event_id * 7 % 10007 AS seq FROM events WHERE event_type = 'error' ORDER BY seq DESC, job_id DESC LIMIT 100")
def cancelled_cache(spark, sf):
    return service.bounded_cache(table(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id AS job_id", "event_id * 7 % 10007 AS seq"), 100)


@query("SELECT doc_id AS id, CASE WHEN coalesce(d, 0) > 4000 OR strlen(text) > 4000 THEN 413 WHEN strlen(text) = 0 THEN 400 ELSE 202 END AS code FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS d FROM documents)")
def upload_admission(spark, sf):
    u = table(spark, sf, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 3 = 0 THEN n_chars END AS declared", "octet_length(text) AS counted")
    return service.admitted(u, 4000)


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'read write' WHEN 1 THEN 'admin' WHEN 2 THEN 'read' END AS token, 'c' || event_id % 5 AS client FROM events)
SELECT event_id, coalesce(len(list_intersect(string_split(token, ' '), ['write', 'admin'])) > 0, false) AND list_contains(['c1', 'c2', 'c4'], client) AS allowed FROM t"""
)
def scope_checks(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'read write' WHEN 1 THEN 'admin' WHEN 2 THEN 'read' END AS token", "concat('c', event_id % 5) AS client")
    return e.select("event_id", sc.scopes_allow(F.col("token"), F.array(F.lit("write"), F.lit("admin")), F.col("client"), F.array(*(F.lit(x) for x in ("c1", "c2", "c4")))).alias("allowed"))


_ARTIFACTS = """CASE event_id % 5 WHEN 0 THEN '{"merged": "runs/a.md", "n": 3}' WHEN 1 THEN '{"images": [{"filename": "f1", "s3_key": "i/1"}, {"filename": "f2", "s3_key": ""}, {"filename": "f3"}], "audit": "none"}' WHEN 2 THEN '{"images": "none"}' WHEN 3 THEN '["x/y", {"k": ["p/q"]}]' END"""


@query(
    f"""WITH r AS (SELECT event_id, {_ARTIFACTS} AS a FROM events), i AS (SELECT event_id, unnest(from_json(json_extract(a, '$.images'), '[{{"filename":"VARCHAR","s3_key":"VARCHAR"}}]')) AS i FROM r WHERE json_type(a, '$.images') = 'ARRAY')
SELECT event_id AS process_id, i.filename AS filename, i.s3_key AS key FROM i WHERE i.s3_key <> ''"""
)
def image_keys(spark, sf):
    return service.image_keys(table(spark, sf, "events").selectExpr("event_id AS process_id", f"{_ARTIFACTS} AS artifacts"))


@query(
    f"""WITH r AS (SELECT event_id AS id, {_ARTIFACTS} AS a FROM events), t AS (SELECT r.id AS id, j.fullkey AS path, j.atom ->> '$' AS value FROM r, json_tree(CAST(a AS JSON)) j WHERE a IS NOT NULL AND j.type = 'VARCHAR')
SELECT id, path, value FROM t WHERE contains(value, '/')"""
)
def flattened_keys(spark, sf):
    return service.flattened_keys(table(spark, sf, "events").selectExpr("event_id AS id", f"{_ARTIFACTS} AS payload"))


# --- receipts and contracts --------------------------------------------------------------------------------

_HEX = "repeat('ab', 32)"
_EVIDENCE = f"""event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE 'd' END AS digest, 'd' AS artifact_digest, event_id % 17 <> 0 AS succeeded, event_id % 19 <> 0 AS complete, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS expected,
CASE WHEN event_id % 4 < 3 AND event_id % 2 = 0 THEN (event_id + event_id % 3) % 5 END AS covered, CASE WHEN event_id % 3 = 0 THEN 'page_coverage' ELSE 'synchronous_return' END AS basis, CASE WHEN event_id % 6 = 0 THEN {_HEX} END AS pdf_digest, CASE WHEN event_id % 6 = 0 THEN 'pages' END AS method, CASE WHEN event_id % 12 = 0 THEN {_HEX} WHEN event_id % 6 = 0 THEN 'short' END AS proof"""


@query(
    f"""WITH e AS (SELECT {_EVIDENCE} FROM events), f AS (SELECT *, basis = 'page_coverage' AS paged, (expected IS NULL) <> (covered IS NULL) AS odd,
coalesce(expected IS NOT NULL AND covered = expected AND pdf_digest IS NOT NULL AND method IS NOT NULL AND proof IS NOT NULL AND regexp_full_match(pdf_digest, '[0-9a-f]{{64}}') AND regexp_full_match(proof, '[0-9a-f]{{64}}'), false) AS sound FROM e)
SELECT id, array_to_string(list_filter([CASE WHEN digest <> artifact_digest THEN 'completion_evidence_digest_mismatch' END, CASE WHEN NOT succeeded THEN 'extractor_did_not_succeed' END, CASE WHEN NOT complete THEN 'extractor_did_not_confirm_complete_artifact' END,
CASE WHEN odd THEN 'incomplete_page_coverage_evidence' WHEN expected IS NOT NULL AND (expected < 1 OR covered < expected) THEN 'incomplete_page_coverage' END,
CASE WHEN paged AND NOT sound THEN 'invalid_page_coverage_proof' WHEN NOT paged AND (pdf_digest IS NOT NULL OR method IS NOT NULL OR proof IS NOT NULL OR expected IS NOT NULL OR covered IS NOT NULL) THEN 'page_coverage_basis_mismatch' END], lambda x: x IS NOT NULL), '+') AS reasons FROM f"""
)
def completion_reasons(spark, sf):
    e = table(spark, sf, "events").selectExpr(*_split(_EVIDENCE))
    return e.select("id", service.completion_reasons().alias("reasons"))


def _split(columns: str) -> list[str]:
    """The columns of a select list, cut at the commas outside of brackets."""
    out, depth, now = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


_POLICY = {"select": ("medium", "low"), "review": ("large", "high")}


@query(
    f"""WITH r AS (SELECT {_pick(["select", "review", "other"], "event_id")} AS role, {_pick(["medium", "large", "tiny", None], "event_id")} AS model, {_pick(["low", "high", "max"], "(event_id // 3)")} AS effort FROM events),
f AS (SELECT *, CASE WHEN role = 'other' THEN 'unknown_role' WHEN coalesce(model, '') NOT IN ('large', 'medium') THEN 'disallowed_model' WHEN model <> CASE role WHEN 'select' THEN 'medium' ELSE 'large' END THEN 'wrong_model'
WHEN effort NOT IN ('low', 'medium', 'high') THEN 'invalid_effort' WHEN effort <> CASE role WHEN 'select' THEN 'low' ELSE 'high' END THEN 'wrong_effort' END AS fault FROM r)
SELECT role, model, effort, fault, count(*) AS n FROM f GROUP BY ALL"""
)
def model_faults(spark, sf):
    r = table(spark, sf, "events").selectExpr(f"{_pick(['select', 'review', 'other'], 'event_id')} AS role", f"{_pick(['medium', 'large', 'tiny', None], 'event_id')} AS model", f"{_pick(['low', 'high', 'max'], '(event_id div 3)')} AS effort")
    return service.model_faults(r, _POLICY, ("low", "medium", "high")).groupBy("role", "model", "effort", "fault").agg(F.count("*").alias("n"))


_OPTIONS = ['{"ocr": true, "pages": 1, "mode": "fast"}', '{"ocr": 1, "pages": 1, "mode": "fast"}', '{"ocr": true, "pages": "1"}', '{"ocr": true, "pages": 1.0, "mode": null}', "[]", None, "broken"]


@query(
    f"""WITH o AS (SELECT event_id, {_pick(_OPTIONS, "event_id")} AS o FROM events), j AS (SELECT event_id, CASE WHEN json_valid(o) THEN CAST(o AS JSON) END AS o FROM o)
SELECT event_id, array_to_string(list_filter([CASE WHEN coalesce(CAST(json_extract(o, '$.mode') AS VARCHAR) = '"fast"', false) THEN NULL ELSE 'mode' END, CASE WHEN coalesce(CAST(json_extract(o, '$.ocr') AS VARCHAR) = 'true', false) THEN NULL ELSE 'ocr' END,
CASE WHEN coalesce(CAST(json_extract(o, '$.pages') AS VARCHAR) = '1', false) THEN NULL ELSE 'pages' END], lambda x: x IS NOT NULL), ',') AS missing FROM j"""
)
def option_checks(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_pick(_OPTIONS, "event_id")).alias("o"))
    return e.select("event_id", service.missing_options(F.col("o"), {"ocr": True, "pages": 1, "mode": "fast"}).alias("missing"))


@query("""SELECT event_id, '{"schema":"native-style","contract_version":1,"source":"s' || event_id % 3 || '","status":"unavailable","pages":[]}' AS record FROM events""")
def unavailable_styles(spark, sf):
    return table(spark, sf, "events").select("event_id", service.unavailable_style(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")), "native-style", 1).alias("record"))


_USAGE = ['{"breakdown": {"a": {"calls": 3}, "b": {"calls": true}, "c": {"calls": 4}}}', '{"breakdown": {"a": {"calls": -2}, "b": {"calls": "5"}, "c": {"calls": 1.5}, "d": {}}}', '{"breakdown": []}', "{}", None, '{"breakdown": {"x": {"calls": 0}, "y": {"calls": 12}}}']


@query(f"SELECT event_id, CAST(CASE event_id % {len(_USAGE)} WHEN 0 THEN 7 WHEN 5 THEN 12 ELSE 0 END AS BIGINT) AS calls FROM events")
def model_call_counts(spark, sf):
    return table(spark, sf, "events").select("event_id", service.model_calls(F.expr(_pick(_USAGE, "event_id"))).alias("calls"))


_LABELS = ["scientific_figure", "logo", None, "unknown", "cover_art"]


@query(
    f"""WITH r AS (SELECT event_id, {_pick(_LABELS, "event_id")} AS label, CASE WHEN event_id % 7 < 6 THEN (event_id % 7 - 1) / 4 END AS c FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN label IN ('scientific_figure', 'table_or_equation', 'publisher_logo', 'badge_or_ui', 'cover_art', 'decorative', 'unknown') THEN NULL ELSE 'label' END, CASE WHEN c BETWEEN 0 AND 1 THEN NULL ELSE 'confidence' END], lambda x: x IS NOT NULL), ',') AS faults FROM r"""
)
def review_faults(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_pick(_LABELS, "event_id")).alias("label"), F.expr("CASE WHEN event_id % 7 < 6 THEN (event_id % 7 - 1) / 4 END").alias("c"))
    return e.select("event_id", service.review_faults(F.col("label"), F.col("c"), sc.IMAGE_CLASSES).alias("faults"))


@query(
    """WITH a AS (SELECT o_orderkey AS process_id, unnest(['merged', 'audit']) AS kind, unnest(['m/' || o_custkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'a/' || o_custkey END]) AS key FROM orders)
SELECT process_id, kind, CASE WHEN key <> '' THEN 'store://' || key END AS url, CASE WHEN key = '' THEN 'missing_key' END AS error FROM a"""
)
def artifact_urls(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS process_id", "map('merged', concat('m/', o_custkey), 'audit', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('a/', o_custkey) END) AS artifacts")
    return service.url_rows(o, "store://")


@query(
    """WITH e AS (SELECT user_id AS process_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events)
SELECT process_id, max_by(status, seq) AS status, min(seq) AS first_seen, min_by(status, seq) = 'running' AS new_work FROM e GROUP BY process_id"""
)
def run_trackers(spark, sf):
    return service.trackers(table(spark, sf, "events").selectExpr("user_id AS process_id", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS status"))
