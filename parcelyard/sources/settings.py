"""Settings files: one JSON text per tenant and kind, flattened to typed rows.

The readers give (tenant_id, body); every flattening function takes that frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions.values import number_or_null
from parcelyard.operators.joins import tenant_of_employee
from parcelyard.schemas import TENANT

PRICE = (
    "array<struct<id:bigint,region:string,"
    "tiers:array<struct<id:bigint,price:string,quantity:string>>,"
    "additional:array<struct<id:bigint,range:string,rate:string>>>>"
)
PROMOTION = "array<struct<id:bigint,name:string,discount:string>>"
WAREHOUSE = (
    "struct<shelves:array<struct<id:bigint,name:string>>,"
    "productCategories:array<struct<id:bigint,category:string,product:string>>,"
    "boxSizes:array<struct<id:bigint,name:string,width:string,length:string,height:string>>>"
)
DROPDOWN = "struct<channels:array<string>,categories:array<string>,levels:array<string>>"
COMPANY = (
    "struct<companyId:string,companyName:string,taxId:string,address:string,"
    "phone:string,email:string,photo:string>"
)
DROPDOWN_LISTS = ("channels", "categories", "levels")


def read_settings(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Files ``root/<tenant>/<kind>.json``; a missing file is a tenant without rows."""
    path = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    tenant = F.url_decode(F.element_at(F.split(path, "/"), -2))
    # Unlike a path with a wildcard, a root that holds no such file is no error.
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{kind}.json")
    return files.text(root, wholetext=True).select(
        tenant.alias(TENANT), F.col("value").alias("body")
    )


def read_stored_settings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"value string, {TENANT} string").text(path, wholetext=True)
    # The writer ends each text with a line feed.
    return rows.select(TENANT, F.regexp_replace("value", r"\n\z", "").alias("body"))


def write_settings(files: DataFrame, path: str) -> None:
    """Replace the files of the tenants present, leaving the others alone."""
    (
        files.select(TENANT, F.col("body").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(TENANT)
        .text(path)
    )


def _entries(files: DataFrame, schema: str) -> DataFrame:
    """One row per entry of a file whose body is an array; other bodies have none."""
    is_array = F.startswith(F.ltrim("body"), F.lit("["))
    return files.filter(is_array).select(
        TENANT, F.explode(F.from_json("body", schema)).alias("e")
    )


def _object(files: DataFrame, schema: str) -> DataFrame:
    return files.select(TENANT, F.from_json("body", schema).alias("o"))


def price_tiers(files: DataFrame) -> DataFrame:
    return (
        _entries(files, PRICE)
        .select(TENANT, "e.id", "e.region", F.explode("e.tiers").alias("t"))
        .select(
            TENANT,
            F.col("id").alias("region_id"),
            "region",
            F.col("t.id").alias("tier_id"),
            number_or_null(F.col("t.quantity")).alias("quantity"),
            number_or_null(F.col("t.price")).alias("price"),
        )
    )


def price_additional(files: DataFrame) -> DataFrame:
    bounds = r"^\s*([0-9.]+)\s*-\s*([0-9.]+)\s*$"
    return (
        _entries(files, PRICE)
        .select(TENANT, "e.id", "e.region", F.explode("e.additional").alias("a"))
        .select(
            TENANT,
            F.col("id").alias("region_id"),
            "region",
            F.col("a.id").alias("additional_id"),
            F.col("a.range").alias("range"),
            number_or_null(F.regexp_extract("a.range", bounds, 1)).alias("range_low"),
            number_or_null(F.regexp_extract("a.range", bounds, 2)).alias("range_high"),
            number_or_null(F.col("a.rate")).alias("rate"),
        )
    )


def promotions(files: DataFrame) -> DataFrame:
    """Discounts are amounts, or percentages when they end in '%'."""
    text = F.trim(F.col("e.discount"))
    percent = text.endswith("%")
    return _entries(files, PROMOTION).select(
        TENANT,
        F.col("e.id").alias("promotion_id"),
        F.col("e.name").alias("name"),
        F.col("e.discount").alias("discount"),
        F.when(~percent, number_or_null(text)).alias("amount"),
        F.when(percent, number_or_null(F.regexp_replace(text, "%$", ""))).alias("percent"),
    )


def warehouse_shelves(files: DataFrame) -> DataFrame:
    rows = _object(files, WAREHOUSE).select(TENANT, F.explode("o.shelves").alias("s"))
    return rows.select(TENANT, F.col("s.id").alias("shelf_id"), F.col("s.name").alias("name"))


def warehouse_categories(files: DataFrame) -> DataFrame:
    rows = _object(files, WAREHOUSE).select(TENANT, F.explode("o.productCategories").alias("c"))
    return rows.select(TENANT, F.col("c.id").alias("category_id"), "c.category", "c.product")


def warehouse_box_sizes(files: DataFrame) -> DataFrame:
    rows = _object(files, WAREHOUSE).select(TENANT, F.explode("o.boxSizes").alias("b"))
    return rows.select(
        TENANT,
        F.col("b.id").alias("size_id"),
        F.col("b.name").alias("name"),
        *[number_or_null(F.col(f"b.{c}")).alias(c) for c in ("width", "length", "height")],
    )


def dropdown_values(files: DataFrame) -> DataFrame:
    """(tenant, list, pos, value), positions from 0."""
    lists = F.create_map(
        *[c for name in DROPDOWN_LISTS for c in (F.lit(name), F.col(f"o.{name}"))]
    )
    return (
        _object(files, DROPDOWN)
        .select(TENANT, F.explode(lists).alias("list", "values"))
        .select(TENANT, "list", F.posexplode("values").alias("pos", "value"))
    )


def company_info(files: DataFrame) -> DataFrame:
    return _object(files, COMPANY).select(TENANT, "o.*")


def dropdown_body(submissions: DataFrame) -> DataFrame:
    """Body of a submitted dropdown: the names of each list, first occurrence kept."""
    lists = [
        F.array_distinct(F.transform(F.col(name), lambda e: e["name"])).alias(name)
        for name in DROPDOWN_LISTS
    ]
    return submissions.withColumn("body", F.to_json(F.struct(*lists))).drop(*DROPDOWN_LISTS)


def warehouse_body(submissions: DataFrame) -> DataFrame:
    """Body of a submitted warehouse form without the sender's id.

    Every other field is kept, whatever it is called and however deep it lies, with its
    kind of value: a number stays a number. Fields of inner objects come sorted by name.
    A body that is no JSON is refused, like a request that cannot be read.
    """
    fields = F.from_json("body", "map<string,variant>")
    kept = F.to_json(F.map_filter(fields, lambda name, _: name != "emp_id"))
    # An array has no fields, and nothing to take out.
    body = F.coalesce(kept, F.to_json(F.try_parse_json("body")))
    return submissions.withColumn("body", body).filter(F.col("body").isNotNull())


def replace_settings(
    current: DataFrame, submissions: DataFrame, employee: DataFrame
) -> DataFrame:
    """New (tenant_id, body) rows: the last submission of each company wins.

    ``submissions`` holds seq, emp_id and body; the sender's company is the tenant.
    """
    sent = tenant_of_employee(submissions, employee).select(
        F.col("company_name").alias(TENANT), "body", "seq"
    )
    # Stored files rank below every submission, so one aggregate replaces them.
    unsent = F.lit(None).cast(sent.schema["seq"].dataType).alias("seq")
    stored = current.select(TENANT, "body", unsent)
    return (
        stored.unionByName(sent)
        .groupBy(TENANT)
        .agg(F.max_by("body", F.struct(F.col("seq").isNotNull(), "seq")).alias("body"))
    )
