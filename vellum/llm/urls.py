"""URL filter: host and path rules first, then a weighted vocabulary searched by one automaton.

A rule (host, path prefix) fits its host and all subdomains; the longest that fits decides. Where none
fits, an Aho-Corasick automaton finds the terms of a URL in one pass; a find counts where the characters
on both sides are no letters or digits. One strict term blocks, and so do several distinct soft terms whose
weights come to `soft_limit`. The vocabulary is a table of terms with weights; a weight of `STRICT_WEIGHT` or
more makes a term strict. It travels to every task, so it is bounded by `MOST_TERMS`.

A null URL, or one without ://, has an empty host and path, no rule and no terms, and is allowed.
Repeated rows each come out; ids are only carried.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
STRICT_WEIGHT, SOFT_LIMIT, MOST_TERMS = 10, 2.0, 1_000_000
#: term -> weight, in ASCII lower case; the terms of one weight stand together
VOCABULARY = {
    **dict.fromkeys(("casino", "porn", "xxx", "viagra", "escort", "jackpot", "cialis", "camgirl", "hentai", "milf", "sexcam", "warez", "keygen"), 10.0),
    **dict.fromkeys(("betting", "gambling", "slots", "roulette", "payday", "replica", "torrent", "cracked", "nude", "adult", "dating"), 1.5),
    **dict.fromkeys(("ads", "bet", "cheap", "click", "deal", "free", "loan", "pills", "poker", "prize", "track", "tracker", "win"), 1.0),
    **dict.fromkeys(("banner", "bonus", "coupon", "discount", "download", "promo", "sale", "sponsor", "affiliate", "popup"), 0.5),
}


def vocabulary_of(terms: DataFrame) -> dict[str, float]:
    """A vocabulary from a table (term, weight): lower-cased, the greatest weight of a term; nulls and empty terms are left out."""
    rows = terms.where("term <> '' AND weight IS NOT NULL").groupBy(ascii_lower(F.col("term")).alias("term")).agg(F.max(F.col("weight").cast("double")).alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r.term: r.weight for r in rows}


def split_url(url):
    """(host, path) columns of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", -1))
    # substring_index from the right would cut at a later ://, so the text after the first one is taken by position
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_columns(rules=RULES):
    """(text of the longest rule that fits, its verdict), null where none does; over columns host and path."""
    named, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        named, said = F.when(fits, F.lit(host + path)).otherwise(named), F.when(fits, F.lit(verdict)).otherwise(said)
    return named, said


def automaton(vocabulary: dict[str, float] = VOCABULARY):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in vocabulary:
        found.add_word(term, term)
    found.make_automaton()
    return found


def count_terms(machine, vocabulary: dict[str, float], url: str) -> tuple[int, int, float]:
    """(strict finds, distinct soft terms, their weight) of a lower-cased URL, whole terms only."""
    strict, soft = 0, set()
    for end, term in machine.iter(url) if len(machine) else ():
        before = end - len(term)
        if (before >= 0 and url[before].isascii() and url[before].isalnum()) or (end + 1 < len(url) and url[end + 1].isascii() and url[end + 1].isalnum()):
            continue
        if vocabulary[term] >= STRICT_WEIGHT:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft), float(sum(sorted(vocabulary[t] for t in soft)))


def filter_urls(pages: DataFrame, rules=RULES, vocabulary: dict[str, float] = VOCABULARY, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight of every row."""

    def kernel(batches):
        machine = automaton(vocabulary)
        for batch in batches:
            found = [count_terms(machine, vocabulary, u or "") for u in batch.column(3).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["page_id", "host", "path", "strict_hits", "soft_hits", "soft_weight"])

    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))
    host, path = split_url(F.col("url"))
    parts = url.select("page_id", host.alias("host"), path.alias("path"), F.when(F.instr("url", "://") > 0, ascii_lower(F.col("url"))).alias("low"))
    counted = parts.mapInArrow(kernel, "page_id long, host string, path string, strict_hits long, soft_hits long, soft_weight double")
    named, said = rule_columns(rules)
    method = F.when((F.col("strict_hits") > 0) | ((F.col("soft_hits") > 1) & (F.col("soft_weight") >= soft_limit)), F.lit("block")).otherwise(F.lit("allow"))
    return counted.select("page_id", "host", "path", named.alias("rule"), F.coalesce(said, method).alias("verdict"), "strict_hits", "soft_hits", "soft_weight")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same in DuckDB, terms by regular expression."""

    def hit(term: str) -> str:
        return f"(CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){re.escape(term)}($|[^a-z0-9])') THEN 1 ELSE 0 END)"

    def many(term: str) -> str:
        # finds of one term: a boundary character serves two neighbours, so boundaries are doubled first
        return f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){re.escape(term)}($|[^a-z0-9])'))"

    strict = [t for t, w in VOCABULARY.items() if w >= STRICT_WEIGHT]
    soft = {t: w for t, w in VOCABULARY.items() if w < STRICT_WEIGHT}
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = {h + p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))" for _, h, p in cases}
    rule = "CASE " + " ".join(f"WHEN {fits[h + p]} THEN '{h + p}'" for _, h, p in cases) + " END"
    said = "CASE " + " ".join(f"WHEN {fits[h + p]} THEN '{v}'" for v, h, p in cases) + " END"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url END AS url FROM pages),
b AS (SELECT page_id, coalesce(substr(url, strpos(url, '://') + 3), '') AS rest, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low FROM a),
c AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT page_id, host, path, CAST({" + ".join(map(many, strict))} AS BIGINT) AS strict_hits, CAST({" + ".join(map(hit, soft))} AS BIGINT) AS soft_hits,
CAST({" + ".join(f"{w!r} * {hit(t)}" for t, w in soft.items())} AS DOUBLE) AS soft_weight FROM c)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN strict_hits > 0 OR (soft_hits > 1 AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits, soft_weight FROM d
"""
