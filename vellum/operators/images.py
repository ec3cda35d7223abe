"""Image manifests: references in Markdown, provenance, diagnostics, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import page_of_name


def image_references(texts: DataFrame, near: int = 1000) -> DataFrame:
    """doc_id, name, alt, nearby: image links with the text after them up to the next one; the last of a name wins.

    The text is split at the links, so every link has its own following part; nothing is shuffled but names.
    """
    link = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    parts = F.split("text", link)
    found = F.regexp_extract_all("text", F.lit(link), F.lit(0))
    rows = texts.select("doc_id", parts.alias("parts"), F.posexplode(found).alias("no", "link"))
    after = F.element_at("parts", F.col("no") + 2)
    target = F.regexp_extract("link", link, 2)
    rows = rows.select("doc_id", "no", F.regexp_extract("link", link, 1).alias("alt"), F.substring_index(target, "/", -1).alias("name"), nearby(after, near).alias("nearby"))
    last = rows.groupBy("doc_id", "name").agg(F.max_by(F.struct("alt", "nearby"), "no").alias("r"))
    return last.select("doc_id", "name", "r.alt", "r.nearby")


def nearby(text, most: int = 1000):
    """The first characters of a text, null where it is blank."""
    return F.when(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) == "", F.lit(None).cast("string")).otherwise(F.substring(text, 1, most))


def manifest(entries: DataFrame) -> DataFrame:
    """doc_id, name, page, kind, index, caption of entries (doc_id, entry JSON): an object, or in old manifests a string."""
    parsed = F.from_json("entry", "filename string, page int, caption string")
    legacy = F.from_json(F.concat(F.lit('{"v":'), F.col("entry"), F.lit("}")), "v string")["v"]
    name = F.coalesce(parsed["filename"], F.when(F.col("entry").startswith('"'), legacy))
    rows = entries.select("doc_id", name.alias("name"), parsed["page"].alias("given"), parsed["caption"].alias("caption")).where("name is not null")
    said = rows.withColumn("p", page_of_name(F.col("name")))
    return said.select("doc_id", "name", F.coalesce("given", F.expr("try_cast(p.page AS int)")).alias("page"), F.expr("nullif(p.kind, '')").alias("kind"), F.expr("try_cast(p.index AS int)").alias("index"), "caption")


def diagnostics(images: DataFrame, least: int = 32) -> DataFrame:
    """doc_id, name, flags, useful of images with width, height and bytes."""
    flags = F.array_compact(
        F.array(
            F.when((F.col("width") < least) | (F.col("height") < least), "tiny"),
            F.when(F.greatest("width", "height") > 20 * F.least("width", "height"), "strip"),
            F.when(F.col("bytes") * 50 < F.col("width") * F.col("height"), "blank"),
        )
    )
    return images.select("doc_id", "name", F.array_join(flags, ",").alias("flags"), (F.size(flags) == 0).alias("useful"))


def with_reviews(images: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review's label and text over the image's own; errors are kept beside and change nothing."""
    both = images.join(reviews.select("doc_id", "name", F.col("label").alias("seen"), F.col("text").alias("read"), "error"), ["doc_id", "name"], "left")
    ok = F.col("error").isNull()
    return both.withColumn("label", F.when(ok, F.coalesce("seen", "label")).otherwise(F.col("label"))).withColumn("text", F.when(ok, F.coalesce("read", "text")).otherwise(F.col("text"))).drop("seen", "read")


def grouped_captions(blocks: DataFrame) -> DataFrame:
    """doc_id, group, image, caption: image blocks with all captions of their group, in order, joined by line feeds."""
    own = blocks.where("kind = 'caption'").groupBy("doc_id", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "\n").alias("caption"))
    return blocks.where("kind = 'image'").select("doc_id", "group", F.col("text").alias("image")).join(own, ["doc_id", "group"], "left")


def flags(requests: DataFrame) -> DataFrame:
    """extract and review as they take effect: review follows extract unless said, and needs it."""
    review = F.coalesce("review", "extract", F.lit(False))
    return requests.withColumn("review", review).withColumn("extract", F.coalesce("extract", F.lit(False)) | review)
