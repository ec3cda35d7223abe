"""Rules of a job service over tables: replies, queues, caches, artifacts, readiness and receipts.

Every rule is a frame -> frame function of built-in expressions. Groups are folded by partial aggregation; none
is collected into one task.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.scalars import positive_int
from vellum.functions.text import summarised_error

#: Replies that no retry mends (fixed values).
PERMANENT = (400, 401, 403, 413, 415, 422)
TERMINAL = ("succeeded", "failed", "cancelled")
#: Words of a message that make a failure worth one retry (fixed values).
TRANSIENT = (
    "timed out", "timeout", "temporarily unavailable", "connection reset", "connection refused", "service unavailable", "worker_not_ready", "http 502", "http 503", "http 504",
)
DONE = ("complete", "completed", "succeeded", "success")
CANCELLED, FAILED = ("cancelled", "canceled"), ("failed", "failure", "error")
#: Names of a cached generation by purge scope: suffixes after the file's hash (fixed values).
MERGED = r"(?:merged\.md|.*_merged\.md|.*_consensus_metrics\.json|.*_audit\.json)"
EXTRACTED = r"(?:grobid|docling|marker)\.md(?:\.page-coverage\.json|\.native\..*)?"


def replies(runs: DataFrame) -> DataFrame:
    """The reply to a repeated submission (process_id, status, error_code, error_message): mapped status, HTTP code, bounded error."""
    status = F.coalesce("status", F.lit("pending"))
    mapped = F.when(status.isin("submitting", "queued"), "pending").when(status == "running", "started").when(status == "succeeded", "complete").otherwise(status)
    error = F.when(F.col("error_message") != "", summarised_error(F.col("error_message")))
    return runs.select("process_id", mapped.alias("status"), F.when(status.isin(*TERMINAL), 200).otherwise(202).alias("code"), F.when(F.col("error_code") != "", F.col("error_code")).alias("error_code"), error.alias("error"))


def handoff(attempts: DataFrame) -> DataFrame:
    """job_id, n_attempts, outcome, detail of hand-over attempts (job_id, seq, code, detail; code null: interrupted).

    The first reply that is a success or a permanent refusal decides; until then the job stays queued.
    """
    verdict = F.when(F.col("code").between(200, 299), "accepted").when(F.col("code").isin(*PERMANENT), "failed")
    ruled = attempts.withColumn("verdict", verdict)
    first = F.min(F.when(F.col("verdict").isNotNull(), F.struct("seq", "verdict", "detail")))
    per = ruled.groupBy("job_id").agg(first.alias("d"), F.count("*").alias("n"), F.min(F.when(F.col("verdict").isNotNull(), F.col("seq"))).alias("at"))
    tried = ruled.join(per.select("job_id", "at"), "job_id").groupBy("job_id").agg(F.count_if(F.col("at").isNull() | (F.col("seq") <= F.col("at"))).alias("n_attempts"))
    return per.join(tried, "job_id").select("job_id", "n_attempts", F.coalesce("d.verdict", F.lit("queued")).alias("outcome"), F.when(F.col("d.verdict") == "failed", F.col("d.detail")).alias("detail"))


def extraction_outcomes(attempts: DataFrame, reserve: float = 300.0) -> DataFrame:
    """process_id, n_ok, outcome of attempts (process_id, source, attempt, ok, message, seconds_left), one or two a source.

    A second attempt counts only after a transient failure with time in reserve. All sources ok: complete; some:
    partial; none: emergency.
    """
    transient = F.lower(F.coalesce("message", F.lit(""))).rlike("|".join(TRANSIENT))
    may = F.max(F.when(F.col("attempt") == 1, ~F.col("ok") & transient & (F.col("seconds_left") > reserve)))
    first = F.max(F.when(F.col("attempt") == 1, F.col("ok")))
    second = F.max(F.when(F.col("attempt") == 2, F.col("ok")))
    per = attempts.groupBy("process_id", "source").agg(F.coalesce(first, F.lit(False)).alias("a"), F.coalesce(may, F.lit(False)).alias("m"), F.coalesce(second, F.lit(False)).alias("b"))
    ok = F.col("a") | (F.col("m") & F.col("b"))
    out = per.groupBy("process_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("m")).alias("n_retried"))
    return out.select("process_id", "n_ok", "n_retried", F.when(F.col("n_ok") == F.col("n"), "complete").when(F.col("n_ok") > 0, "partial").otherwise("emergency").alias("outcome"))


def artifact_map(artifacts: DataFrame) -> DataFrame:
    """process_id and a map of kind -> key of uploads (process_id, kind, key, seq): the last of a kind, empty keys left out."""
    last = artifacts.where("key <> ''").groupBy("process_id", "kind").agg(F.max(F.struct("seq", "key")).alias("k"))
    return last.groupBy("process_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "k.key")))).alias("artifacts"))


def purged(catalogue: DataFrame, requests: DataFrame) -> DataFrame:
    """Names of catalogue rows (hash, name) that a purge (hash, scope) removes; name is v<n>_<hash>_<rest>."""
    rest = F.regexp_extract("name", r"^v[0-9]+_[^_]+_(.*)$", 1)
    merged, extracted = rest.rlike(f"^{MERGED}$"), rest.rlike(f"^{EXTRACTED}$")
    hit = (F.col("scope") == "all") | (F.col("scope").isin("merge", "extraction") & merged) | ((F.col("scope") == "extraction") & extracted)
    return catalogue.join(requests, "hash").where(hit).select("hash", "name").distinct()


def usable_cache(catalogue: DataFrame) -> DataFrame:
    """hash, source, usable, discard of cached outputs (hash, source, text, native_valid, wants_images, has_manifest).

    Usable: text with more than white space, a valid native record and, for images of one source, their manifest.
    What has no usable text is discarded with all of its generation.
    """
    text = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    images = (F.col("source") != "marker") | ~F.col("wants_images") | F.col("has_manifest")
    return catalogue.select("hash", "source", (text & F.col("native_valid") & images).alias("usable"), (~text).alias("discard"))


def download_source(candidates: DataFrame) -> DataFrame:
    """process_id, origin, key: a verified local bundle before a local file before a durable object."""
    rank = F.when((F.col("origin") == "bundle") & F.col("verified"), 1).when(F.col("origin") == "file", 2).when(F.col("origin") == "object", 3)
    return candidates.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("process_id").agg(F.min(F.struct("rank", "key", "origin")).alias("b")).select("process_id", "b.origin", "b.key")


def readiness(required: Column, path: Column, exists: Column, payload: Column) -> Column:
    """disabled, ok, loading (no file yet) or missing (not configured, or not an object with an entry)."""
    entries = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.when(~required, "disabled").when(F.coalesce(path, F.lit("")) == "", "missing").when(~exists, "loading").when(F.size(entries) > 0, "ok").otherwise("missing")


def broker_depth(first: Column, second: Column) -> Column:
    """The greater of two counts as text; unknown if both are, or if one is and the other is 0."""
    high = F.greatest(first, second)
    return F.when(high.isNull() | ((first.isNull() | second.isNull()) & (high == 0)), "unknown").otherwise(high.cast("string"))


def active_jobs(checks: Column) -> Column:
    """The greatest of four counts of a JSON object, which have to be positive whole numbers."""
    names = ("fresh_active_runs", "queued_runs", "broker_queued", "broker_unacked")
    return F.greatest(*(positive_int(F.get_json_object(checks, f"$.{n}")) for n in names))


def bare_pending(payload: Column) -> Column:
    """A reply of no more than an id and the status pending says nothing about the job."""
    keys = F.json_object_keys(payload)
    only = F.size(F.array_except(keys, F.array(F.lit("process_id"), F.lit("status")))) == 0
    return F.coalesce(only & (F.lower(F.trim(F.get_json_object(payload, "$.status"))) == "pending"), F.lit(False))


def terminal_event(status: Column) -> Column:
    name = F.lower(F.trim(status))
    return F.when(name.isin(*DONE), "complete").when(name.isin(*CANCELLED), "cancelled").when(name.isin(*FAILED), "failed")


def removable(records: DataFrame, proofs: DataFrame) -> DataFrame:
    """Expired records (job_id, expired) for which a terminal state (process_id) is on record."""
    return records.where("expired").join(proofs.select(F.col("process_id").alias("job_id")).distinct(), "job_id", "left_semi")


def scaled_to_zero(description: Column, code: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    return (code == "Successful") & (text.rlike(r"desired capacity[^.]*from \d+ to 0") | text.rlike(r"shrinking[^.]*capacity from \d+ to 0"))


def latest_scale_to_zero(activities: DataFrame, after: Column) -> DataFrame:
    """group, latest start after a time of a successful step down to nothing; null where there is none."""
    hit = scaled_to_zero(F.col("description"), F.col("code")) & (F.col("started") > after)
    return activities.groupBy("grp").agg(F.max(F.when(hit, F.col("started"))).alias("latest"))


def launch_ages(instances: DataFrame, now: Column) -> DataFrame:
    """grp, age in minutes of the oldest and launch time of the earliest instance that is not on its way out."""
    live = instances.where(~F.col("state").isin("shutting-down", "terminated") & F.col("launched").isNotNull())
    per = live.groupBy("grp").agg(F.min("launched").alias("earliest"))
    return instances.select("grp").distinct().join(per, "grp", "left").select("grp", F.coalesce((F.unix_micros(now) - F.unix_micros(F.col("earliest").cast("timestamp"))) / 60_000_000, F.lit(0.0)).alias("oldest_minutes"), "earliest")


def bounded_cache(entries: DataFrame, size: int) -> DataFrame:
    """The latest `size` entries (job_id, seq): a top-k, not a window over the whole table."""
    return entries.orderBy(F.desc("seq"), F.desc("job_id")).limit(size)


def admitted(uploads: DataFrame, limit: int) -> DataFrame:
    """id, code: 413 for more bytes than the limit, declared or counted; 400 for none; else 202."""
    declared, counted = F.coalesce("declared", F.lit(0)), F.coalesce("counted", F.lit(0))
    return uploads.select("id", F.when((declared > limit) | (counted > limit), 413).when(counted == 0, 400).otherwise(202).alias("code"))


def flattened_keys(documents: DataFrame) -> DataFrame:
    """id, path, value of all strings with a slash in a JSON text (id, payload), by their place; no rows for invalid JSON."""

    def walk(value, path):
        if isinstance(value, str):
            if "/" in value:
                yield path, value
        elif isinstance(value, dict):
            for key, inner in value.items():
                yield from walk(inner, f"{path}.{key}")
        elif isinstance(value, list):
            for k, inner in enumerate(value):
                yield from walk(inner, f"{path}[{k}]")

    def kernel(frames):
        for frame in frames:
            rows = []
            for key, payload in frame.itertuples(index=False):
                try:
                    rows += [(key, p, v) for p, v in walk(json.loads(payload or "null"), "$")]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["id", "path", "value"])

    return documents.select("id", "payload").mapInPandas(kernel, "id long, path string, value string")


def canonical_json(documents: DataFrame) -> DataFrame:
    """id, payload: JSON with sorted keys, without nulls in objects and without blanks; null where it is not JSON."""

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if v is not None}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(payload):
        try:
            return json.dumps(clean(json.loads(payload)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, TypeError):
            return None

    def kernel(frames):
        for frame in frames:
            yield frame.assign(payload=frame["payload"].map(one))

    return documents.select("id", "payload").mapInPandas(kernel, "id long, payload string")


def image_keys(runs: DataFrame) -> DataFrame:
    """process_id, filename, key of every image entry with a key of an artifacts object; entries may be bare names without one."""
    listed = F.from_json(F.get_json_object("artifacts", "$.images"), "array<struct<filename:string,s3_key:string>>")
    return runs.select("process_id", F.explode(listed).alias("i")).where("i.s3_key <> ''").select("process_id", F.col("i.filename").alias("filename"), F.col("i.s3_key").alias("key"))


def image_count(payload: Column) -> Column:
    """Entries of the images array of a reply, or else of its artifacts object; 0 where neither is an array."""
    own, inner = (F.json_array_length(F.get_json_object(payload, p)) for p in ("$.images", "$.artifacts_json.images"))
    return F.coalesce(own, inner, F.lit(0)).cast("long")


def completion_reasons(e: str = "") -> Column:
    """Why evidence of completion is refused (columns digest, artifact_digest, succeeded, complete, expected, covered, basis, pdf_digest, method, proof)."""
    c = lambda n: F.col(f"{e}{n}")
    one_sided = c("expected").isNull() != c("covered").isNull()
    short = c("expected").isNotNull() & ((c("expected") < 1) | (c("covered") < c("expected")))
    fields = [c(n) for n in ("pdf_digest", "method", "proof")]
    hexes = [F.coalesce(c(n).rlike("^[0-9a-f]{64}$"), F.lit(False)) for n in ("pdf_digest", "proof")]
    sound = c("expected").isNotNull() & F.coalesce(c("covered") == c("expected"), F.lit(False)) & fields[0].isNotNull() & fields[1].isNotNull() & fields[2].isNotNull() & hexes[0] & hexes[1]
    stray = fields[0].isNotNull() | fields[1].isNotNull() | fields[2].isNotNull() | c("expected").isNotNull() | c("covered").isNotNull()
    paged = c("basis") == "page_coverage"
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(c("digest") != c("artifact_digest"), F.lit("completion_evidence_digest_mismatch")),
                F.when(~c("succeeded"), F.lit("extractor_did_not_succeed")),
                F.when(~c("complete"), F.lit("extractor_did_not_confirm_complete_artifact")),
                F.when(one_sided, F.lit("incomplete_page_coverage_evidence")).when(short, F.lit("incomplete_page_coverage")),
                F.when(paged & ~sound, F.lit("invalid_page_coverage_proof")).when(~paged & stray, F.lit("page_coverage_basis_mismatch")),
            )
        ),
        "+",
    )


def style_faults(pages: DataFrame) -> DataFrame:
    """doc_id, rule of style pages (doc_id, ord, page_no, lines: array of native_id, text, spans of start and end).

    Pages have rising numbers from 1 on, lines a name, spans rise without overlap inside of their text.
    """
    before = F.coalesce(F.expr("lag(page_no) OVER (PARTITION BY doc_id ORDER BY ord)"), F.lit(0))
    ruled = pages.withColumn("before", before).select("doc_id", F.coalesce(F.col("page_no") > F.col("before"), F.lit(False)).alias("in_order"), "lines")
    named = F.forall("lines", lambda x: F.coalesce(x["native_id"] != "", F.lit(False)) & x["text"].isNotNull())

    def sound(x: Column) -> Column:
        # the end of the span before, or -1 after a fault
        last = F.aggregate(x["spans"], F.lit(0), lambda a, s: F.when((a >= 0) & (a <= s["start"]) & (s["start"] < s["end"]) & (s["end"] <= F.length(x["text"])), s["end"]).otherwise(F.lit(-1)))
        return F.coalesce(last >= 0, F.lit(False))

    rules = F.array(F.when(~F.col("in_order"), F.lit("page_order")), F.when(~named, F.lit("line_identity")), F.when(~F.forall("lines", sound), F.lit("span")))
    return ruled.select("doc_id", F.explode(F.array_compact(rules)).alias("rule")).distinct()


def model_faults(roles: DataFrame, policy: dict[str, tuple[str, str]], efforts: tuple[str, ...]) -> DataFrame:
    """role, fault (or null) of resolved roles (role, model, effort) under a fixed policy of role -> (model, effort)."""
    models = F.create_map(*(F.lit(x) for k, (m, _) in policy.items() for x in (k, m)))[F.col("role")]
    wanted = F.create_map(*(F.lit(x) for k, (_, e) in policy.items() for x in (k, e)))[F.col("role")]
    allowed = sorted({m for m, _ in policy.values()})
    model, effort = F.coalesce("model", F.lit("")), F.coalesce("effort", F.lit(""))
    fault = F.when(models.isNull(), "unknown_role").when(~model.isin(*allowed), "disallowed_model").when(model != models, "wrong_model").when(~effort.isin(*efforts), "invalid_effort").when(effort != wanted, "wrong_effort")
    return roles.select("role", "model", "effort", fault.alias("fault"))


def receipt_rules() -> dict[str, Column]:
    """The sums that an emphasis receipt has to satisfy, by name, over columns of its counters and outcome maps."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v)
    c = F.col
    counters = (
        "body", "mapped_body", "retained", "excluded", "style", "mapped_style", "unmapped_style", "auxiliary", "intervals", "existing_intervals", "new_intervals",
        "direct_retained", "deterministic", "model_selected", "ties", "numbered_ties", "model_calls",
    )
    whole = F.lit(True)
    for name in counters:
        whole = whole & F.coalesce(c(name) >= 0, F.lit(False))
    outcomes = F.forall(F.map_keys("selection_outcomes"), lambda k: k.isin("selected", "none", "unavailable", "not_run"))
    sizes = F.forall(F.map_keys("selection_sizes"), lambda k: k.rlike("^[1-9][0-9]*$"))
    return {
        "counters": whole,
        "exclusion_reasons": total("exclusion_reasons") == c("excluded"),
        "auxiliary_outcomes": total("auxiliary_outcomes") == c("auxiliary"),
        "mapped_within_body": c("mapped_body") <= c("body"),
        "style_parts": c("style") == c("mapped_style") + c("unmapped_style"),
        "retained_and_excluded": c("retained") + c("excluded") == c("body"),
        "evidence_ready": c("evidence_ready") == (F.size("evidence_failures") == 0),
        "all_retained": c("all_retained") == (c("retained") == c("body")),
        "protected_outcomes": total("protected_outcomes") == c("body"),
        "unresolved_is_excluded": F.coalesce(F.try_element_at("protected_outcomes", F.lit("unresolved")), F.lit(0)) == c("excluded"),
        "interval_parts": c("intervals") == c("existing_intervals") + c("new_intervals"),
        "interval_targets": c("deterministic") + c("model_selected") == c("intervals"),
        "calls_within_ties": c("model_calls") <= c("ties"),
        "numbered_within_ties": c("numbered_ties") <= c("ties"),
        "selection_outcomes": outcomes & (total("selection_outcomes") == c("ties")),
        "selection_sizes": sizes & (total("selection_sizes") == c("ties")),
        "direct_within_retained": c("direct_retained") <= c("retained"),
        "claims_digest": F.length("claims_digest") == 64,
    }


def typed_value(payload: Column, name: str) -> Column:
    """A member of a JSON object as JSON text, so that true, 1 and "1" are three values; null where there is none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))


def missing_options(payload: Column, required: dict[str, object]) -> Column:
    """Names of required options that an object lacks or has with another value or type, joined by commas."""
    # the parsed value tells texts from numbers, the text as written tells 1.0 from 1
    same = lambda n, v: (typed_value(payload, n) == json.dumps(v)) & (F.get_json_object(payload, f"$.{n}") == (v if isinstance(v, str) else json.dumps(v)))
    wrong = (F.when(~F.coalesce(same(n, v), F.lit(False)), F.lit(n)) for n, v in sorted(required.items()))
    return F.array_join(F.array_compact(F.array(*wrong)), ",")


def unavailable_style(source: Column, schema: str, version: int) -> Column:
    """A valid style record that claims nothing, as JSON."""
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(version).alias("contract_version"), source.alias("source"), F.lit("unavailable").alias("status"), none.alias("pages")))


def model_calls(usage: Column) -> Column:
    """The sum of whole, non-negative counts of calls in a usage breakdown; true, texts and fractions count nothing."""
    entries = F.from_json(F.get_json_object(usage, "$.breakdown"), "map<string,string>")
    calls = lambda v: F.regexp_extract(F.coalesce(typed_value(v, "calls"), F.lit("")), "^([0-9]+)$", 1)
    return F.coalesce(F.aggregate(F.map_values(entries), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(F.nullif(calls(v), F.lit("")).try_cast("long"), F.lit(0))), F.lit(0).cast("long"))


def review_faults(label: Column, confidence: Column, names: tuple[str, ...]) -> Column:
    """What is wrong with an image review: a label outside of the closed list, a confidence outside of [0, 1]."""
    return F.concat_ws(",", F.when(~F.coalesce(label.isin(*names), F.lit(False)), F.lit("label")), F.when(~F.coalesce(confidence.between(0, 1), F.lit(False)), F.lit("confidence")))


def url_rows(runs: DataFrame, base: str) -> DataFrame:
    """process_id, kind, url, error: one row for each artifact of a map (process_id, artifacts); an empty key is an error row."""
    rows = runs.select("process_id", F.explode("artifacts").alias("kind", "key"))
    has = F.coalesce(F.col("key") != "", F.lit(False))
    return rows.select("process_id", "kind", F.when(has, F.concat(F.lit(base), "key")).alias("url"), F.when(~has, F.lit("missing_key")).alias("error"))


def trackers(events: DataFrame) -> DataFrame:
    """process_id, status, first_seen, new_work of events (process_id, seq, status): the last status; a run that begins at its end is no new work."""
    last, first = F.max(F.struct("seq", "status")), F.min(F.struct("seq", "status"))
    per = events.groupBy("process_id").agg(last.alias("l"), first.alias("f"))
    return per.select("process_id", F.col("l.status").alias("status"), F.col("f.seq").alias("first_seen"), terminal_event(F.col("f.status")).isNull().alias("new_work"))
