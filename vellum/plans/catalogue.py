"""Registry of the engine's queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.config import SOURCE_RANK
from vellum.functions import text as tx
from vellum.operators import alignment, consensus, lexing, markup, queue, repetition, rules, runs, spans, usage
from vellum.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


GAPS = r"[ \t\n\x0B\f\r]+"
KEY = rf"lower(trim(regexp_replace(line, '{GAPS}', ' ', 'g')))"
LINES = "lines AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
BLOCKS = rf"""blocks AS (SELECT doc_id, sha256(key) AS fingerprint FROM (SELECT doc_id, {KEY} AS key FROM lines)
WHERE length(key) >= 80 AND len(regexp_extract_all(key, '[^ \t\n\x0B\f\r]+')) >= 8)"""


#: A line with a mark of its type before it, by its number; reads the same in both dialects.
MARKS = ["## ", "1234. ", "      - ", "[12] ", "[^3]: ", "Supplementary Figure S1 ", "Fig. A2 ", "Table 1 shows ", "| a | b ", "$$ x ", "", "", "", "#no heading ", "a | b | c ", "**Figure 3** "]
MARKED = "concat(CASE line_no % 16 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MARKS)) + " END, line)"
LISTED = r"regexp_matches(line, '^\s*(?:[-+*]|\d+[.)]|\[\d{1,4}\])\s+')"
LINE_TYPE = rf"""CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}(?:[ \t]+|$)') THEN 'heading' WHEN regexp_matches(line, '^\s*(?:\$\$|\\\[)') THEN 'equation'
WHEN regexp_matches(line, '^\s*\|') OR (len(regexp_extract_all(line, '\|')) >= 2 AND NOT {LISTED}) THEN 'table'
WHEN regexp_matches(line, '(?i)^\s*(?:\*{{1,2}})?(?:(?:supplementary|extended\s+data)\s+)?(?:figure|fig\.)\s*[A-Za-z0-9]+') THEN 'figure_caption'
WHEN {LISTED} OR regexp_matches(line, '^\s*\[\^\d+\]:\s+') THEN 'list' ELSE 'paragraph' END"""


# --- texts -------------------------------------------------------------------------------------------------


@query(
    f"""WITH {LINES}, {BLOCKS}, c AS (SELECT doc_id, fingerprint, count(*) AS n FROM blocks GROUP BY ALL),
p AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS unique_blocks, CAST(sum(n - 1) AS BIGINT) AS excess FROM c GROUP BY doc_id)
SELECT doc_id, blocks, unique_blocks, excess, CAST(excess * 1000000 // blocks AS BIGINT) AS excess_ppm,
blocks >= 20 AND excess >= 8 AND excess * 1000000 // blocks >= 300000 AS repeated FROM p"""
)
def repetition_profile(spark, sf):
    """Lines as paragraphs: a blank line goes between them."""
    return repetition.repetition_profile(_spaced(table(spark, sf, "documents")))


def _spaced(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id, line_no, line, CAST(strlen(line) AS BIGINT) AS n FROM lines)
SELECT doc_id, line_no, CAST(sum(n + 1) OVER w - n - 1 AS BIGINT) AS byte_start, CAST(sum(n + 1) OVER w - 1 AS BIGINT) AS byte_end
FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"""
)
def line_spans(spark, sf):
    return lexing.line_spans(table(spark, sf, "documents")).drop("line")


@query(
    rf"""WITH {LINES}, t AS (SELECT {LINE_TYPE} AS unit_type, strlen(line) AS n FROM (SELECT {MARKED} AS line FROM lines))
SELECT unit_type, count(*) AS units, CAST(sum(n) AS BIGINT) AS bytes FROM t GROUP BY unit_type"""
)
def unit_type_counts(spark, sf):
    """Lines of all types: a mark goes before some of them."""
    own = lexing.lines(table(spark, sf, "documents")).select("doc_id", F.expr(MARKED).alias("line"))
    return own.groupBy(tx.line_type(F.col("line")).alias("unit_type")).agg(F.count("*").alias("units"), F.sum(F.octet_length("line").cast("long")).alias("bytes"))


def _shingle_sql(name: str, key: str) -> str:
    return rf"""{name} AS (SELECT DISTINCT {key}, array_to_string(t[i:i + 11], ' ') AS shingle FROM (SELECT {key}, t, unnest(range(1, len(t) - 10)) AS i
FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM {"documents" if key == "doc_id" else "benchmark"})) WHERE length(array_to_string(t[i:i + 11], ' ')) >= 48)"""


@query(f"WITH {_shingle_sql('a', 'doc_id')}, {_shingle_sql('b', 'item_id')} SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (shingle) GROUP BY ALL")
def reference_overlap(spark, sf):
    return repetition.reference_overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    f"""WITH {LINES}, {BLOCKS}, made AS (SELECT doc_id, fingerprint, count(*) AS output_count FROM blocks GROUP BY ALL HAVING count(*) > 1),
known AS (SELECT doc_id, fingerprint, 1 AS n FROM blocks GROUP BY ALL)
SELECT doc_id, fingerprint, output_count, CAST(n AS BIGINT) AS source_count FROM made JOIN known USING (doc_id, fingerprint) WHERE output_count > n"""
)
def excess_repetition(spark, sf):
    """The text as output against a view of it in which each line comes once."""
    docs = table(spark, sf, "documents")
    once = docs.select("doc_id", F.lit("docling").alias("source"), F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("text"))
    keyed = once.select("doc_id", "source", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: tx.comparison_key(x)))).alias("text"))
    return repetition.excess_repetition(_spaced(docs), _spaced(keyed.groupBy("doc_id", "source").agg(F.array_join(F.collect_set("text"), "\n").alias("text"))))


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
ANCHORS = f"list_sort(list_distinct(list_filter({TOKENS}, lambda t: length(t) >= 4 OR regexp_matches(t, '[0-9]'))))"


@query(f"SELECT doc_id, CAST(len({ANCHORS}) AS BIGINT) AS n_anchors, sha256(array_to_string({ANCHORS}, ' ')) AS digest FROM documents")
def anchor_tokens(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", tx.anchor_tokens(F.col("text")).alias("a"))
    return own.select("doc_id", F.size("a").cast("long").alias("n_anchors"), F.sha2(F.array_join("a", " "), 256).alias("digest"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token FROM documents), r AS (SELECT token FROM t GROUP BY token HAVING count(*) BETWEEN 2 AND 8)
SELECT doc_id, count(*) AS rare_tokens FROM t JOIN r USING (token) GROUP BY doc_id"""
)
def rare_token_blocks(spark, sf):
    """Texts by the number of their tokens that two to eight texts share."""
    own = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    rare = own.groupBy("token").agg(F.count("*").alias("n")).where("n between 2 and 8").select("token")
    return own.join(rare, "token").groupBy("doc_id").agg(F.count("*").alias("rare_tokens"))


@query(
    f"""WITH {LINES}, k AS (SELECT doc_id, line_no AS no, {KEY} AS key FROM lines), a AS (SELECT doc_id, key, min(no) AS left_no FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) = 1),
b AS (SELECT doc_id, key, min(no) AS right_no FROM k WHERE key <> '' AND no % 7 <> 6 GROUP BY ALL HAVING count(*) = 1) SELECT doc_id, left_no, right_no FROM a JOIN b USING (doc_id, key)"""
)
def unique_anchor_pairs(spark, sf):
    own = lexing.lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").alias("no"), tx.comparison_key(F.col("line")).alias("key")).where("key <> ''")
    return consensus.unique_anchor_pairs(own, own.where("no % 7 <> 6"))


@query(
    rf"""WITH v AS (SELECT doc_id, {TOKENS} AS a, regexp_extract_all(lower(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 7 <> 0), chr(10))), '[\p{{L}}\p{{N}}]+') AS b FROM documents),
a AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(a) AS t FROM v) GROUP BY ALL), b AS (SELECT doc_id, t, count(*) AS m FROM (SELECT doc_id, unnest(b) AS t FROM v) GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS reference_tokens, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS found, CAST(sum(least(n, coalesce(m, 0))) * 1000000 // sum(n) AS BIGINT) AS recall_ppm FROM a LEFT JOIN b USING (doc_id, t) GROUP BY doc_id"""
)
def token_recall(spark, sf):
    """How much of a text's tokens a view of it without every seventh line still has."""
    docs = table(spark, sf, "documents")
    fewer = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: (i + 1) % 7 != 0), "\n")
    return repetition.token_recall(docs.select("doc_id", tx.tokens(F.col("text")).alias("tokens")), docs.select("doc_id", tx.tokens(fewer).alias("tokens")), "doc_id")


@query(
    r"""WITH t AS (SELECT conv_id, turn, sha256(lower(text)) AS d FROM conversations), k AS (SELECT conv_id, turn, d, row_number() OVER (PARTITION BY d ORDER BY conv_id, turn) AS k FROM t),
r AS (SELECT conv_id, turn, k, max(k) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k)
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE reach IS NOT NULL AND k <= reach) AS reordered FROM r GROUP BY conv_id"""
)
def turn_reorder(spark, sf):
    """Turns whose k-th occurrence does not come after all before it."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.lower("text"), 256).alias("d"))
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("conv_id", "turn")))
    reach = F.max("k").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("reach", reach).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("reach").isNotNull() & (F.col("k") <= F.col("reach"))).alias("reordered"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}\p{Cf}]')) AS BIGINT) AS unsafe FROM documents")
def unsafe_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.unsafe_count(F.col("text")).alias("unsafe"))


@query(
    r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[+-]?(?:[0-9]+(?:[.,:/][0-9]+)*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[%‰]?') AS n FROM documents)
SELECT doc_id, CAST(len(n) AS BIGINT) AS n_numbers, array_to_string(list_sort(list_distinct(n)), '|') AS numbers FROM n"""
)
def numeric_payload_ascii(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", tx.numbers(F.col("text")).alias("n"))
    return own.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join(F.array_sort(F.array_distinct("n")), "|").alias("numbers"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS words, CAST(strlen(regexp_replace(text, '{GAPS}', '', 'g')) AS BIGINT) AS bytes FROM documents")
def text_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.non_space_bytes(F.col("text")).alias("bytes"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\*[^*\n]+\*')) AS BIGINT) AS emphasis, CAST(len(regexp_extract_all(text, '(?m)^#{1,6} ')) AS BIGINT) AS headings FROM documents")
def emphasis_pairs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\*[^*\n]+\*")).cast("long").alias("emphasis"), F.regexp_count("text", F.lit("(?m)^#{1,6} ")).cast("long").alias("headings"))


@query(
    r"""WITH n AS (SELECT page_id, 'doc_page_' || page_id % 9 || CASE WHEN page_id % 2 = 0 THEN '_Figure_' ELSE '_Table_' END || page_id % 4 || CASE WHEN page_id % 5 = 0 THEN '.gif' ELSE '.jpeg' END AS name FROM pages)
SELECT page_id, name, regexp_extract(name, '_page_([0-9]+)_([A-Za-z]+)_([0-9]+)\.(?:jpeg|jpg|png)$', 1) AS page, regexp_extract(name, '_page_([0-9]+)_([A-Za-z]+)_([0-9]+)\.(?:jpeg|jpg|png)$', 2) AS kind,
regexp_extract(name, '_page_([0-9]+)_([A-Za-z]+)_([0-9]+)\.(?:jpeg|jpg|png)$', 3) AS index FROM n"""
)
def image_names(spark, sf):
    kind, ending = F.when(F.col("page_id") % 2 == 0, "_Figure_").otherwise("_Table_"), F.when(F.col("page_id") % 5 == 0, ".gif").otherwise(".jpeg")
    name = F.concat(F.lit("doc_page_"), F.col("page_id") % 9, kind, F.col("page_id") % 4, ending)
    return table(spark, sf, "pages").select("page_id", name.alias("name")).select("page_id", "name", tx.page_of_name(F.col("name")).alias("p")).select("page_id", "name", "p.*")


@query(
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '</?span[^>]*>', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\(https?://[^)]*\)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS cleaned
FROM (SELECT page_id, '<span id="x">' || '![f](a.png)' || '[text](http://q/' || page_id || ')' || chr(10) || chr(10) || chr(10) || chr(10) || html || '</span>' AS h FROM pages)"""
)
def clean_markdown(spark, sf):
    made = F.concat(F.lit('<span id="x">![f](a.png)[text](http://q/'), F.col("page_id"), F.lit(")\n\n\n\n"), F.col("html"), F.lit("</span>"))
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean_markdown(made)).alias("cleaned"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 4000 THEN text ELSE substr(text, 1, 4000) || '... [' || (length(text) - 4000) || ' characters omitted]' END) AS summary FROM documents")
def error_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.summarised_error(F.col("text"))).alias("summary"))


@query(r"SELECT doc_id, sha256(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS identity, sha256(source || chr(0) || lang) AS origin FROM documents")
def identity_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.semantic_identity(F.col("text")), 256).alias("identity"), tx.digest(F.col("source"), F.col("lang")).alias("origin"))


# --- several versions of one text --------------------------------------------------------------------------

#: Version A is the text, B its lines squeezed, C the text without every seventh line.
VERSIONS = rf"""v AS (SELECT doc_id, 'marker' AS source, text FROM documents UNION ALL
SELECT doc_id, 'docling', array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{GAPS}', ' ', 'g'))), chr(10)) FROM documents UNION ALL
SELECT doc_id, 'grobid', array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 7 <> 0), chr(10)) FROM documents)"""


def versions(docs: DataFrame) -> DataFrame:
    lines = F.split("text", "\n")
    three = F.array(
        F.struct(F.lit("marker").alias("source"), F.col("text").alias("text")),
        F.struct(F.lit("docling").alias("source"), F.array_join(F.transform(lines, tx.squeezed), "\n").alias("text")),
        F.struct(F.lit("grobid").alias("source"), F.array_join(F.filter(lines, lambda x, i: (i + 1) % 7 != 0), "\n").alias("text")),
    )
    return docs.select("doc_id", F.explode(three).alias("v")).select("doc_id", "v.*")


RANK = "CASE source WHEN 'grobid' THEN 3 WHEN 'docling' THEN 2 ELSE 1 END"


@query(
    rf"""WITH {VERSIONS}, f AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS words, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS units,
CAST(strlen(regexp_replace(text, '{GAPS}', '', 'g')) AS BIGINT) AS bytes FROM v),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN words < 40 THEN 'words' END, CASE WHEN units < 3 THEN 'units' END, CASE WHEN bytes < 200 THEN 'bytes' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f),
b AS (SELECT *, max(CASE WHEN reasons = '' THEN bytes END) OVER (PARTITION BY doc_id) AS tb, max(CASE WHEN reasons = '' THEN units END) OVER (PARTITION BY doc_id) AS tu FROM r),
n AS (SELECT *, reasons = '' AS passed, coalesce(bytes * 100 >= tb * 60 AND units * 100 >= tu * 60, false) AS near, CASE WHEN reasons = '' THEN least(bytes * 1000000 // tb, units * 1000000 // tu) END AS coverage_ppm FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, passed AND near ORDER BY coverage_ppm DESC NULLS LAST, units DESC, bytes DESC, {RANK} DESC) AS k FROM n)
SELECT doc_id, source, words, units, bytes, reasons, CAST(coverage_ppm AS BIGINT) AS coverage_ppm, CASE WHEN NOT passed THEN 'rejected' WHEN NOT near THEN 'relative' WHEN k = 1 THEN 'selected' ELSE 'eligible' END AS outcome FROM o"""
)
def baseline_pick(spark, sf):
    return consensus.baseline_pick(versions(table(spark, sf, "documents")), SOURCE_RANK)


@query(
    f"""WITH {VERSIONS}, u AS (SELECT doc_id, source, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS region, unnest(p) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM v)),
k AS (SELECT doc_id, source, region, line, {KEY} AS key, {RANK} AS pr FROM u), g AS (SELECT doc_id, region, line, key, count(*) AS n, max(pr) AS best, max_by(source, pr) AS who FROM k GROUP BY ALL),
p AS (SELECT doc_id, region, CAST(sum(n) AS BIGINT) AS n_sources, count(*) AS n_raw, count(DISTINCT key) AS n_key, max(n) AS most, max_by(who, n * 10 + best) AS majority, max_by(who, best) AS leader FROM g GROUP BY ALL),
o AS (SELECT *, CASE WHEN n_sources < 2 THEN 'single' WHEN n_raw = 1 THEN 'exact_agreement' WHEN n_key = 1 THEN 'near_agreement' WHEN most >= 2 THEN 'exact_majority' ELSE 'unresolved' END AS outcome FROM p)
SELECT doc_id, region, n_sources, outcome, CASE WHEN outcome = 'exact_majority' THEN majority ELSE leader END AS winner FROM o"""
)
def vote_regions(spark, sf):
    own = versions(table(spark, sf, "documents")).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("region", "raw"))
    return consensus.vote(own, SOURCE_RANK)


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 1 THEN '> ' || line ELSE line END || chr(10) AS piece FROM lines)
SELECT doc_id, sha256(string_agg(piece, '' ORDER BY line_no)) AS digest, count(*) AS n_pieces FROM p GROUP BY doc_id"""
)
def splice_text(spark, sf):
    own = lexing.lines(table(spark, sf, "documents"))
    piece = F.concat(F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("> "), "line")).otherwise(F.col("line")), F.lit("\n"))
    return spans.splice(own.select("doc_id", F.col("line_no").alias("ord"), piece.alias("piece"))).select("doc_id", F.sha2("text", 256).alias("digest"), "n_pieces")


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id, line_no, CAST(strlen(line) AS BIGINT) + 1 AS n FROM lines)
SELECT doc_id, line_no AS ord, CAST(sum(n) OVER w AS BIGINT) AS out_end, CAST(sum(n) OVER w - n AS BIGINT) AS out_start FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""
)
def splice_offsets(spark, sf):
    own = lexing.lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").alias("ord"), F.concat("line", F.lit("\n")).alias("piece"))
    return spans.output_offsets(own).drop("piece")


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id, line_no, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS e, strlen(line) + 1 AS n FROM lines),
r AS (SELECT doc_id, e - n AS st, e FROM s WHERE NOT (doc_id % 10 = 3 AND line_no = 1)), x AS (SELECT doc_id, st, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY st, e) AS want FROM r),
p AS (SELECT doc_id, count(*) AS n_ranges, count(*) FILTER (WHERE st <> want) AS breaks, max(e) AS last FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_ranges, 0) AS n_ranges, CAST(coalesce(breaks, 0) + CASE WHEN coalesce(last, 0) <> strlen(text) + 1 THEN 1 ELSE 0 END AS BIGINT) AS faults FROM documents d LEFT JOIN p USING (doc_id)"""
)
def provenance_partition_check(spark, sf):
    """Line ranges that should partition each text; of every tenth text one range has been taken out."""
    docs = table(spark, sf, "documents")
    ranges = lexing.line_spans(docs).where("NOT (doc_id % 10 = 3 AND line_no = 1)").select("doc_id", F.col("byte_start").alias("start"), (F.col("byte_end") + 1).alias("end"))
    return spans.partition_faults(ranges, docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size")))


@query(
    """WITH r AS (SELECT l_partkey, CAST(l_orderkey * 10 AS BIGINT) AS s, CAST(l_orderkey * 10 + l_quantity * 40 AS BIGINT) AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_partkey, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY l_partkey, island"""
)
def interval_union(spark, sf):
    start = (F.col("l_orderkey") * 10).cast("long")
    rows = table(spark, sf, "lineitem").select("l_partkey", start.alias("start"), (start + F.col("l_quantity") * 40).cast("long").alias("end"))
    return spans.union_ranges(rows, "l_partkey")


@query(
    """WITH a AS (SELECT l_suppkey AS k, l_orderkey * 8 + l_linenumber AS no, l_orderkey AS s, CAST(l_orderkey + l_quantity AS BIGINT) AS e FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_suppkey AS k, l_orderkey * 8 + l_linenumber AS no, l_orderkey AS s, CAST(l_orderkey + l_quantity AS BIGINT) AS e FROM lineitem WHERE l_returnflag = 'R')
SELECT a.k, count(*) AS overlaps, CAST(sum((a.no * 31 + b.no) % 1000003) AS BIGINT) AS checksum FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e GROUP BY a.k"""
)
def interval_join(spark, sf):
    start = F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("no"), start.alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"), "l_returnflag")
    pairs = spans.interval_join(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), "k", 64)
    return pairs.groupBy("k").agg(F.count("*").alias("overlaps"), F.sum((F.col("l_no") * 31 + F.col("r_no")) % 1000003).alias("checksum"))


# --- pages -------------------------------------------------------------------------------------------------


def _inner(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '{GAPS}', ' ', 'g'))"


def _elements_sql(tag: str) -> str:
    return rf"""SELECT page_id, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS no, {_inner('unnest(r)')} AS text FROM (SELECT page_id, regexp_extract_all(html, '(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1) AS r FROM pages)"""


@query(_elements_sql("h1"))
def html_headings(spark, sf):
    return markup.elements(table(spark, sf, "pages"), "h1")


@query(_elements_sql("li"))
def html_list_items(spark, sf):
    return markup.elements(table(spark, sf, "pages"), "li")


@query(f"SELECT page_id, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({_elements_sql('p')}) GROUP BY page_id")
def html_paragraphs(spark, sf):
    return markup.elements(table(spark, sf, "pages"), "p").groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query(
    f"""WITH x AS (SELECT page_id, {_inner("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {_inner("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading FROM pages)
SELECT page_id, title, heading, title <> '' AND title = heading AS proven FROM x"""
)
def title_proof(spark, sf):
    return markup.title_proof(table(spark, sf, "pages"))


@query(
    """WITH n AS (SELECT source, doc_id % 12 + 1 AS page FROM documents WHERE doc_id % 17 <> 5), p AS (SELECT source, list_sort(list_distinct(list(page))) AS pages FROM n GROUP BY source)
SELECT source, array_to_string(pages, ',') AS pages, CAST(len(pages) AS BIGINT) AS n_pages, pages = range(1, 13) AS complete FROM p"""
)
def page_coverage(spark, sf):
    native = table(spark, sf, "documents").where("doc_id % 17 <> 5").select("source", (F.col("doc_id") % 12 + 1).alias("page"), F.lit(12).cast("long").alias("expected"))
    return markup.covered_pages(native)


# --- runs --------------------------------------------------------------------------------------------------

RUNS = """e AS (SELECT user_id AS process_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status, value FROM events)"""
TERMINALS = f"""{RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY ts, seq) AS k FROM e),
t AS (SELECT process_id, min_by(status, k) FILTER (WHERE status IN ('succeeded', 'failed', 'cancelled')) AS ft, max_by(status, k) AS last, count(*) AS n_events FROM o GROUP BY process_id),
terminal AS (SELECT process_id, coalesce(ft, last) AS status, ft IS NOT NULL AS terminal, n_events FROM t)"""


def _runs(spark, sf) -> DataFrame:
    return runs.run_events(table(spark, sf, "events"))


@query(f"WITH {TERMINALS} SELECT * FROM terminal")
def run_terminal_state(spark, sf):
    return runs.terminal_state(_runs(spark, sf))


@query(f"WITH {TERMINALS} SELECT status, count(*) AS runs, CAST(sum(n_events) AS BIGINT) AS events FROM terminal GROUP BY status")
def run_status_counts(spark, sf):
    return runs.terminal_state(_runs(spark, sf)).groupBy("status").agg(F.count("*").alias("runs"), F.sum("n_events").alias("events"))


LATEST = f"""{RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY ts, seq) AS k FROM e),
latest AS (SELECT process_id, min(ts) AS started_at, max(ts) AS ended_at, max_by(value, k) FILTER (WHERE value IS NOT NULL) AS latest_value FROM o GROUP BY process_id)"""


@query(f"WITH {LATEST} SELECT * FROM latest")
def run_latest_values(spark, sf):
    return runs.latest_values(_runs(spark, sf))


@query(f"WITH {LATEST} SELECT process_id, started_at FROM latest ORDER BY started_at DESC NULLS FIRST, process_id LIMIT 50 OFFSET 10")
def run_list_page(spark, sf):
    return runs.list_page(runs.latest_values(_runs(spark, sf)), 50, 10).select("process_id", "started_at")


@query(
    f"""WITH {RUNS}, d AS (SELECT process_id, list_sort(list_distinct(list(status))) AS done FROM e WHERE status IN ('queued', 'running', 'progress', 'succeeded') GROUP BY process_id)
SELECT process_id, array_to_string(done, ',') AS completed, array_to_string(list_filter(['progress', 'queued', 'running', 'succeeded'], lambda s: NOT list_contains(done, s)), ',') AS pending, CAST(len(done) * 25 AS BIGINT) AS percent FROM d"""
)
def run_progress(spark, sf):
    return runs.progress(_runs(spark, sf), ("queued", "running", "progress", "succeeded"))


ISLANDS = f"""{RUNS}, b AS (SELECT *, status IN ('running', 'progress') AS busy FROM e), l AS (SELECT *, lag(busy) OVER (PARTITION BY process_id ORDER BY ts, seq) AS p FROM b),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> busy THEN 1 ELSE 0 END) OVER (PARTITION BY process_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM l)"""


@query(f"WITH {ISLANDS} SELECT process_id, CAST(island AS BIGINT) AS island, busy AS value, min(ts) AS since, max(ts) AS until, count(*) AS n FROM i GROUP BY process_id, island, busy")
def idle_islands(spark, sf):
    return runs.islands(_runs(spark, sf).withColumn("busy", F.col("status").isin("running", "progress")), "busy")


@query(
    f"""WITH {RUNS}, l AS (SELECT *, lag(ts) OVER (PARTITION BY process_id ORDER BY ts, seq) AS p FROM e),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY process_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT process_id, min(ts) AS since, max(ts) AS until, count(*) AS n FROM i GROUP BY process_id, island"""
)
def session_inactivity(spark, sf):
    return runs.sessions(_runs(spark, sf), 7200)


@query(
    f"""WITH {RUNS}, l AS (SELECT *, lag(status) OVER (PARTITION BY process_id ORDER BY ts, seq) AS p FROM e),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> status THEN 1 ELSE 0 END) OVER (PARTITION BY process_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM l),
c AS (SELECT process_id, island, count(*) AS n FROM i WHERE status = 'failed' GROUP BY ALL) SELECT process_id, max(n) AS longest FROM c GROUP BY process_id"""
)
def failure_canary(spark, sf):
    return runs.consecutive_failures(_runs(spark, sf))


@query(
    f"""WITH {RUNS}, l AS (SELECT process_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY process_id ORDER BY ts, seq)) AS pause FROM e)
SELECT process_id, count(*) FILTER (WHERE pause IS NULL) AS claims, count(*) FILTER (WHERE pause >= 86400000000) AS reclaims FROM l GROUP BY process_id"""
)
def claim_reclaims(spark, sf):
    return runs.claims(_runs(spark, sf), 86_400)


@query(
    f"""WITH {RUNS}, l AS (SELECT process_id, status, epoch_us(lead(ts) OVER (PARTITION BY process_id ORDER BY ts, seq)) - epoch_us(ts) AS d FROM e)
SELECT status, count(d) AS steps, CAST(sum(d) AS BIGINT) AS total_us, round(sum(d) / 1000000.0 / count(d), 3) AS mean_s FROM l GROUP BY status"""
)
def stage_durations(spark, sf):
    order = Window.partitionBy("process_id").orderBy("ts", "seq")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = _runs(spark, sf).select("process_id", "status", (F.lead(at).over(order) - at).alias("d"))
    return own.groupBy("status").agg(F.count("d").alias("steps"), F.sum("d").alias("total_us"), F.round(F.sum("d") / 1_000_000.0 / F.count("d"), 3).alias("mean_s"))


@query("SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 10 AS accepted FROM orders WHERE o_orderstatus = 'O'")
def fifo_queue(spark, sf):
    """All open orders as queued jobs; ten are accepted."""
    jobs = table(spark, sf, "orders").where("o_orderstatus = 'O'").selectExpr("o_orderkey AS job_id", "o_orderdate AS queued_at")
    return queue.oldest_first(jobs, 10)


@query(
    """SELECT event_type, CASE WHEN regexp_matches(lower(m), 'timeout|timed out|connection|temporar|unavailable|throttl|rate limit|reset') THEN 'transient' ELSE 'permanent' END AS class, count(*) AS n
FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'Connection reset' WHEN event_id % 3 = 1 THEN 'bad input' ELSE props END AS m FROM events) GROUP BY ALL"""
)
def error_classes(spark, sf):
    message = F.when(F.col("event_id") % 3 == 0, "Connection reset").when(F.col("event_id") % 3 == 1, "bad input").otherwise(F.col("props"))
    return table(spark, sf, "events").groupBy("event_type", tx.error_class(message).alias("class")).agg(F.count("*").alias("n"))


# --- usage and corpus --------------------------------------------------------------------------------------

LEDGER = """r AS (SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'A' THEN 'select' WHEN 'N' THEN 'review' ELSE 'title' END AS call_type, CASE l_linestatus WHEN 'O' THEN 'large' ELSE 'small' END AS model,
CAST(l_quantity AS BIGINT) * 100 AS prompt, CAST(l_linenumber * 10 AS BIGINT) AS completion, CAST(floor(l_discount * 100) AS BIGINT) AS cached FROM lineitem)"""
SUMS = "CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(cached) AS BIGINT) AS cached"
UNITS = "CAST(greatest(0, prompt - cached) * CASE model WHEN 'large' THEN 50000 ELSE 10000 END + cached * CASE model WHEN 'large' THEN 5000 ELSE 1000 END + completion * CASE model WHEN 'large' THEN 300000 ELSE 60000 END AS BIGINT)"


@query(f"WITH {LEDGER}, s AS (SELECT call_type, model, count(*) AS calls, {SUMS} FROM r GROUP BY ALL) SELECT *, CAST({UNITS} AS DOUBLE) / 1e10 AS cost_usd FROM s")
def usage_ledger(spark, sf):
    return usage.ledger(usage.ledger_rows(table(spark, sf, "lineitem")))


@query(f"WITH {LEDGER} SELECT call_type, model, CAST(grouping(call_type, model) AS BIGINT) AS level, count(*) AS calls, {SUMS} FROM r GROUP BY ROLLUP (call_type, model)")
def usage_rollup(spark, sf):
    return usage.rollup(usage.ledger_rows(table(spark, sf, "lineitem")))


@query(f"WITH {LEDGER} SELECT call_type, model, CAST(grouping(call_type, model) AS BIGINT) AS level, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt FROM r GROUP BY CUBE (call_type, model)")
def usage_cube(spark, sf):
    return usage.cube(usage.ledger_rows(table(spark, sf, "lineitem")))


CASES = f"""{LEDGER}, s AS (SELECT case_id, model, count(*) AS calls, {SUMS} FROM r GROUP BY ALL), p AS (SELECT case_id, calls, {UNITS} AS c FROM s),
cases AS (SELECT case_id, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(c) AS BIGINT) AS units, CAST(sum(c) AS DOUBLE) / 1e10 AS cost_usd FROM p GROUP BY case_id)"""


@query(f"WITH {CASES} SELECT *, cost_usd >= 2.0 AS alert FROM cases")
def case_costs(spark, sf):
    return usage.case_costs(usage.ledger_rows(table(spark, sf, "lineitem")))


@query(f"WITH {CASES} SELECT count(*) AS cases, CAST(sum(units) AS DOUBLE) / 1e10 AS total, CAST(sum(units) AS DOUBLE) / 1e10 / count(*) AS mean, median(cost_usd) AS median, min(cost_usd) AS least, max(cost_usd) AS most FROM cases")
def cost_distribution(spark, sf):
    return usage.cost_distribution(usage.case_costs(usage.ledger_rows(table(spark, sf, "lineitem"))))


@query("SELECT event_type AS name, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def counter_merge(spark, sf):
    """Per-user counter maps, merged over all users."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counters"))
    return usage.counter_merge(maps, "user_id", "counters")


@query(
    """SELECT count(*) AS documents, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, count(*) FILTER (WHERE lang = 'en') AS english,
count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, round(avg(n_chars), 3) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id)"""
)
def corpus_summary(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.agg(
        F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_if(F.col("lang") == "en").alias("english"),
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.round(F.avg("n_chars"), 3).alias("mean_chars"),
    )


@query(
    """WITH x AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(quality <> 1, true) THEN 'validator' END, CASE WHEN coalesce(toxic <> 0, true) THEN 'safety' END, CASE WHEN n_chars < 200 THEN 'coverage' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, reasons, CASE WHEN reasons = '' THEN 'qualified' ELSE 'failsafe' END AS verdict FROM x"""
)
def qualification(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rules.qualification(both, "doc_id", {"validator": F.col("quality") != 1, "safety": F.col("toxic") != 0, "coverage": F.col("n_chars") < 200})


@query(
    """SELECT l_orderkey, rule FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN NOT (l_quantity <= 45) THEN 'quantity' END, CASE WHEN NOT (l_discount < 0.09) THEN 'discount' END, CASE WHEN NOT (l_tax * 100 = round(l_tax * 100)) THEN 'tax' END], lambda r: r IS NOT NULL)) AS rule FROM lineitem)"""
)
def rule_violations(spark, sf):
    return rules.violations(table(spark, sf, "lineitem"), "l_orderkey", {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.09, "tax": F.col("l_tax") * 100 == F.round(F.col("l_tax") * 100)})


@query(
    """WITH c AS (SELECT s_name AS component, CASE WHEN s_acctbal < 0 THEN 'down' ELSE 'ok' END AS state, s_nationkey % 5 = 0 AS required FROM supplier)
SELECT CASE max(CASE WHEN state <> 'ok' AND required THEN 2 WHEN state <> 'ok' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status, count(*) AS components, count(*) FILTER (WHERE state <> 'ok') AS faults FROM c"""
)
def health_rollup(spark, sf):
    return rules.health(table(spark, sf, "supplier").select(F.col("s_name").alias("component"), F.when(F.col("s_acctbal") < 0, "down").otherwise("ok").alias("state"), (F.col("s_nationkey") % 5 == 0).alias("required")))


@query(
    """WITH l AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, no, CASE WHEN length(line) < 30 THEN md5(line) END AS head FROM l), k AS (SELECT doc_id, no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS section FROM s)
SELECT doc_id, coalesce(section, 'front') AS section, count(*) AS lines FROM k GROUP BY ALL"""
)
def sticky_sections(spark, sf):
    """Lines by the last short line before them, as sections by headings."""
    own = lexing.lines(table(spark, sf, "documents")).withColumn("head", F.when(F.length("line") < 30, F.md5("line")))
    carried = lexing.sticky(own, "head", "doc_id", "line_no", "section")
    return carried.groupBy("doc_id", F.coalesce("section", F.lit("front")).alias("section")).agg(F.count("*").alias("lines"))


@query(
    """SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'F' GROUP BY ALL"""
)
def run_metadata_join(spark, sf):
    customers = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    both = table(spark, sf, "orders").where("o_orderstatus <> 'F'").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- sequential kernels (no SQL form; held against brute force in the tests) ---------------------------------


def _marked(docs: DataFrame) -> DataFrame:
    """Texts as Markdown: the first line a heading, every fifth line a table row, every seventh an item."""
    shaped = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 5 == 4, F.concat(F.lit("| "), x, F.lit(" | 1 |"))).when(i % 7 == 6, F.concat(F.lit("- "), x)).otherwise(x))
    return docs.select("doc_id", F.array_join(shaped, "\n").alias("text"))


#: The lines of `_marked` texts, in SQL.
MARKDOWN = """md AS (SELECT doc_id, line_no, CASE WHEN line_no = 0 THEN '# ' || line WHEN line_no % 5 = 4 THEN '| ' || line || ' | 1 |' WHEN line_no % 7 = 6 THEN '- ' || line ELSE line END AS line FROM lines)"""


@query(
    f"""WITH {LINES}, {MARKDOWN}, t AS (SELECT doc_id, line_no, {LINE_TYPE} AS unit_type, trim(line) = '' AS blank, CAST(strlen(line) AS BIGINT) AS n FROM md),
p AS (SELECT *, sum(n + 1) OVER w - n - 1 AS s, lag(unit_type) OVER w AS pt, lag(blank) OVER w AS pb FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
i AS (SELECT *, sum(CASE WHEN unit_type IN ('heading', 'table', 'list') OR pt IS NULL OR pt <> unit_type OR pb THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM p),
u AS (SELECT doc_id, unit_type, island, min(s) AS byte_start, max(s + n) AS byte_end FROM i WHERE NOT blank GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY byte_start) - 1 AS INTEGER) AS ord, unit_type, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM u"""
)
def structural_units(spark, sf):
    return alignment.structural_units(_marked(table(spark, sf, "documents")))


@query(
    f"""WITH {LINES}, {MARKDOWN}, c AS (SELECT doc_id, line_no, string_split(line, '|') AS c FROM md WHERE starts_with(line, '|')),
d AS (SELECT doc_id, line_no, list_slice(c, CASE WHEN trim(c[1]) = '' THEN 2 ELSE 1 END, CASE WHEN trim(c[-1]) = '' THEN len(c) - 1 ELSE len(c) END) AS c FROM c)
SELECT doc_id, CAST(line_no AS BIGINT) AS row_no, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS cell_no, trim(unnest(c)) AS cell FROM d WHERE len(c) <= 256"""
)
def table_cells(spark, sf):
    own = lexing.lines(_marked(table(spark, sf, "documents"))).where(F.col("line").startswith("|"))
    return alignment.cells(own.select("doc_id", F.col("line_no").cast("long").alias("row_no"), "line"))


@query()
def aligned_units(spark, sf):
    """Lines of each text against those of a view of it that lacks every seventh line and a letter here and there."""
    own = lexing.lines(table(spark, sf, "documents")).where("line <> ''").select("doc_id", F.col("line_no").cast("long").alias("no"), F.lit("paragraph").alias("unit_type"), F.col("line").alias("raw"))
    return alignment.aligned_units(own, own.where("no % 7 <> 6").withColumn("raw", F.regexp_replace("raw", "th", "h")))


@query(
    f"""WITH RECURSIVE {LINES}, r AS (SELECT doc_id, CAST(line_no AS BIGINT) AS region, length(line) % 5 + 1 AS c, CAST(strlen(line) * 200 AS BIGINT) AS b FROM lines),
o AS (SELECT *, c > 128 OR b > 131072 AS over FROM r),
s AS (SELECT doc_id, region, CASE WHEN over THEN -1 ELSE 0 END AS batch, 0 AS open, CASE WHEN over THEN 0 ELSE 1 END AS n, CASE WHEN over THEN 0 ELSE c END AS tc, CASE WHEN over THEN 0 ELSE b END AS tb FROM o WHERE region = 0
UNION ALL SELECT o.doc_id, o.region, CASE WHEN over THEN -1 ELSE open + f END, CASE WHEN over THEN open ELSE open + f END, CASE WHEN over THEN n WHEN f = 1 THEN 1 ELSE n + 1 END, CASE WHEN over THEN tc WHEN f = 1 THEN o.c ELSE tc + o.c END, CASE WHEN over THEN tb WHEN f = 1 THEN o.b ELSE tb + o.b END
FROM (SELECT s.*, o2.c AS nc, o2.b AS nb, CASE WHEN n > 0 AND (n + 1 > 8 OR tc + o2.c > 128 OR tb + o2.b > 131072) THEN 1 ELSE 0 END AS f FROM s JOIN o o2 ON o2.doc_id = s.doc_id AND o2.region = s.region + 1) s JOIN o ON o.doc_id = s.doc_id AND o.region = s.region + 1)
SELECT doc_id, region, CAST(batch AS INTEGER) AS batch FROM s"""
)
def selection_batches(spark, sf):
    sized = lexing.lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").cast("long").alias("region"), (F.length("line") % 5 + 1).cast("long").alias("candidates"), (F.octet_length("line") * 200).cast("long").alias("bytes"))
    return alignment.batches(sized)
