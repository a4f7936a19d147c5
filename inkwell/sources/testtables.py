"""The supplied tables seen as an archive, as landed API pages and as a search log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fields
from inkwell.functions.fields import DOCUMENT_COLUMNS

SITE = "https://blog.example.org"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(number: Column) -> Column:
    return F.date_add(F.lit("2022-01-01").cast("date"), F.pmod(number * 37, F.lit(1461)).cast("int")).cast("string")


def _published(number: Column) -> Column:
    return F.concat(_day(number), F.lit("T00:00:00.000Z"))


def _updated(number: Column) -> Column:
    hour = F.lpad(F.pmod(number, F.lit(24)).cast("string"), 2, "0")
    return F.concat(_day(number), F.lit("T"), hour, F.lit(":00:00.000Z"))


def raw_posts(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """Posts before cleaning: the title may be empty, the status unknown. `also` names columns of the tables to keep."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    quality, toxic = F.col("quality"), F.col("toxic")
    status = (
        F.when((quality == 0) & (toxic == 0), "draft")
        .when((quality == 0) & (toxic == 1), "scheduled")
        .when((quality == 1) & (toxic == 1), "sent")
        .otherwise("published")
    )
    body = F.when(
        F.instr("text", "\n") > 0, F.substring(F.col("text"), F.instr("text", "\n") + 1, F.char_length("text"))
    ).otherwise("")
    n = F.col("doc_id")
    posts = docs.join(labels, "doc_id", "left").select(
        n,
        F.concat(F.lit("d"), n.cast("string")).alias("id"),
        status.alias("status"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        body.alias("plaintext"),
        F.array("lang", "source").alias("tags"),
        _published(n).alias("published_at"),
        _updated(n).alias("updated_at"),
        *also,
    )
    dated = F.col("status") != "draft"
    return posts.select(
        "doc_id", "id", "status", "title", "plaintext", "tags",
        F.when(dated, F.col("published_at")).alias("published_at"),
        "updated_at",
        F.when(dated, F.concat(F.lit(f"{SITE}/"), "id", F.lit("/"))).alias("url"),
        *also,
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        raw_posts(spark, sf_dir)
        .withColumns(
            {
                "type": F.lit("post"),
                "slug": F.col("id"),
                "title": fields.clean_title(F.col("title")),
                "editor_url": fields.editor_link(SITE, F.lit("post"), F.col("id")),
            }
        )
        .select(*DOCUMENT_COLUMNS)
    )


def pages(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    n, html = F.col("page_id"), F.col("html")
    no_code = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    no_notes = F.regexp_replace(no_code, r"(?s)<!--.*?-->", " ")
    page_id = F.concat(F.lit("p"), n.cast("string"))
    return table(spark, sf_dir, "pages").select(
        page_id.alias("id"),
        F.lit("page").alias("type"),
        F.lit("published").alias("status"),
        fields.clean_title(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        page_id.alias("slug"),
        F.col("url"),
        fields.editor_link(SITE, F.lit("page"), page_id).alias("editor_url"),
        F.regexp_replace(no_notes, r"<[^>]*>", " ").alias("plaintext"),
        F.array().cast("array<string>").alias("tags"),
        _published(n).alias("published_at"),
        _updated(n).alias("updated_at"),
        *also,
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).unionByName(pages(spark, sf_dir))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten search strings per benchmark item, one of each form, from words of all its lines."""
    whole = F.translate("text", "\n", " ")
    w = F.col("w")
    forms = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("form")
    items = table(spark, sf_dir, "benchmark").select("*", forms).select(
        (F.col("item_id") * 10 + F.col("form")).alias("query_id"),
        "form",
        F.filter(F.split(F.regexp_replace(whole, '[":]', " "), " +"), lambda x: x != "").alias("w"),
        F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "ES"))), (F.pmod("item_id", F.lit(4)) + 1).cast("int")).alias("lang"),
        F.pmod(F.col("item_id"), F.lit(3)).alias("y"),
    )
    # Each form starts a tenth of the text further on.
    start = F.floor(F.size(w) * F.col("form") / 10).cast("int")
    word = lambda i: F.coalesce(F.get(w, start + i), F.lit("the"))
    year = lambda base: (F.col("y") + base).cast("string")
    text = (
        F.when(F.col("form") == 0, F.concat_ws(" ", word(0), word(1)))
        .when(F.col("form") == 1, F.concat(F.lit('"'), F.concat_ws(" ", word(0), word(1), word(2)), F.lit('"')))
        .when(F.col("form") == 2, F.concat(word(0), F.lit(" -"), word(3)))
        .when(F.col("form") == 3, F.concat(F.lit("title:"), word(0)))
        .when(F.col("form") == 4, F.concat(word(2), F.lit(" tag:"), F.col("lang")))
        .when(F.col("form") == 5, F.concat(word(1), F.lit(" after:"), year(2022), F.lit("-03 before:"), year(2023)))
        .when(F.col("form") == 6, F.concat(word(1), F.lit(" status:sent")))
        .when(F.col("form") == 7, F.concat(F.lit("tag:"), F.col("lang"), F.lit(" type:post before:"), year(2023)))
        .when(F.col("form") == 8, F.concat(word(0), F.lit(" "), F.substring(word(1), 1, 4)))
        .otherwise(F.concat(F.lit('-'), word(0), F.lit(" TYPE:page "), F.lit('"'), word(4), F.lit(" "), word(5)))
    )
    return items.select("query_id", text.alias("raw"), (F.col("form") >= 8).alias("prefix_last"))


def raw_json_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as an API would send them: fields may be missing, unknown or of another type."""
    quality, toxic = F.col("quality"), F.col("toxic")
    posts = raw_posts(spark, sf_dir, "quality", "toxic", "lang", "source", "n_chars")
    status = (
        F.when((quality == 0) & (toxic == 0), "archived")
        .when((quality == 0) & (toxic == 1), "scheduled")
        .when((quality == 1) & (toxic == 1), "sent")
        .when(quality == 1, "published")
    )
    tags = F.array(
        F.struct(F.lit("Language").alias("name"), F.when(F.col("lang") != "de", F.col("lang")).otherwise("").alias("slug")),
        F.struct(F.lit("Source").alias("name"), F.col("source").alias("slug")),
        F.struct(F.lit("No slug").alias("name"), F.lit(None).cast("string").alias("slug")),
    )
    return posts.withColumns({"status": status, "tags": tags}).select(
        F.col("doc_id").alias("n"),
        F.struct(
            "id",
            F.concat(F.lit("u-"), "id").alias("uuid"),
            "title",
            F.col("id").alias("slug"),
            "status",
            "url",
            F.when(F.col("plaintext") != "", F.col("plaintext")).alias("plaintext"),
            "published_at",
            "updated_at",
            F.col("n_chars").alias("reading_size"),
            "tags",
        ).alias("record"),
    )


def raw_json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an API would send them: no tags at all, the status as a number."""
    return pages(spark, sf_dir, "page_id").select(
        F.col("page_id").alias("n"),
        F.struct("id", "title", "slug", F.lit(1).alias("status"), "url", "plaintext", "published_at", "updated_at").alias("record"),
    )


PAGE_SIZE = 100


def landed_pages(records: DataFrame, collection: str, path: str) -> None:
    """Write records as response bodies of up to a hundred records, one file each.

    Records are shuffled by page before they are collected: collecting takes no byte off them, and within the partitions
    of the input it would sort, and spill, everything a second time.
    """
    page = (F.floor(F.col("n") / PAGE_SIZE) + 1).cast("long")
    bodies = records.withColumn("page", page).repartition("page").groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct("n", "record"))).alias("items")
    )
    last = records.agg((F.floor(F.max("n") / PAGE_SIZE) + 1).cast("long").alias("pages")).scalar()
    total = records.agg(F.count("*").alias("total")).scalar()
    body = F.to_json(
        F.struct(
            F.transform("items", lambda x: x["record"]).alias(collection),
            F.struct(
                F.struct(F.col("page"), F.lit(PAGE_SIZE).alias("limit"), last.alias("pages"), total.alias("total")).alias("pagination")
            ).alias("meta"),
        )
    )
    bodies.select("page", body.alias("value")).write.partitionBy("page").text(f"{path}/{collection}")
