"""The driver's tables read as the engine's relations, each with its SQL.

Snapshots leave out other rows in base and head and alter some in the head; the graph runs from customers over
orders to parts and suppliers; events are recordings; all is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def versions(df: DataFrame, key: str, body: str, definition: str) -> tuple[DataFrame, DataFrame]:
    """Base and head symbols (id, body_hash, definition_hash) of a table."""
    k = F.col(key)
    base = df.where(k % 97 != 5).select(k.alias("id"), F.md5(body).alias("body_hash"), F.md5(definition).alias("definition_hash"))
    new_body = F.when(k % 101 == 3, F.concat(F.upper(body), F.lit("!"))).otherwise(F.col(body))
    new_definition = F.when(k % 151 == 11, F.concat(F.col(definition), F.lit("x"))).otherwise(F.col(definition))
    return base, df.where(k % 89 != 7).select(k.alias("id"), F.md5(new_body).alias("body_hash"), F.md5(new_definition).alias("definition_hash"))


def versions_sql(table: str, key: str, body: str, definition: str) -> str:
    return f"""base AS (SELECT {key} AS id, md5({body}) AS body_hash, md5({definition}) AS definition_hash FROM {table} WHERE {key} % 97 <> 5),
head AS (SELECT {key} AS id, md5(CASE WHEN {key} % 101 = 3 THEN upper({body}) || '!' ELSE {body} END) AS body_hash, md5(CASE WHEN {key} % 151 = 11 THEN {definition} || 'x' ELSE {definition} END) AS definition_hash FROM {table} WHERE {key} % 89 <> 7),
j AS (SELECT coalesce(b.id, h.id) AS id, b.id IS NULL AS added, h.id IS NULL AS deleted, b.body_hash IS DISTINCT FROM h.body_hash AS body, b.definition_hash IS DISTINCT FROM h.definition_hash AS def FROM base b FULL JOIN head h ON b.id = h.id)"""


PART = ("part", "p_partkey", "p_name", "p_brand")
PART_SQL = versions_sql(*PART)


def node(letter: str, column: str):
    return F.concat(F.lit(f"{letter}:"), F.col(column).cast("string"))


def references(t: Tables, suppliers: bool = True, customers: bool = True, distinct: bool = True) -> DataFrame:
    """Distinct (source, target, kind, detail): customers to orders, orders to parts and suppliers.

    Without ``distinct`` an edge to a part comes once for each item, for users to whom that is the same.
    """
    row = lambda df, a, b, x, y: df.select(node(a, x).alias("source"), node(b, y).alias("target"), F.lit("references").alias("kind"), F.lit("").alias("detail"))
    items = t.lineitem
    to_part = items.select("l_orderkey", "l_partkey")
    out = row(to_part.distinct() if distinct else to_part, "o", "p", "l_orderkey", "l_partkey")
    if customers:
        out = row(t.orders, "c", "o", "o_custkey", "o_orderkey").unionByName(out)
    if suppliers:  # the least flag is R where none is less and one is R: unlike a least string, that is counted without sorting
        least = F.bool_and(F.col("l_returnflag") >= "R") & F.bool_or(F.col("l_returnflag") == "R")
        to_supplier = items.groupBy("l_orderkey", "l_suppkey").agg(least.alias("r")).select(node("o", "l_orderkey").alias("source"), node("s", "l_suppkey").alias("target"), F.lit("references").alias("kind"), F.when(F.col("r"), "writes").otherwise("").alias("detail"))
        out = out.unionByName(to_supplier)
    return out


def containers(t: Tables) -> DataFrame:
    """defined_in edges: nations in regions, customers and suppliers in nations."""
    row = lambda df, a, b, x, y: df.select(node(a, x).alias("source"), node(b, y).alias("target"), F.lit("defined_in").alias("kind"), F.lit("").alias("detail"))
    return row(t.nation, "n", "r", "n_nationkey", "n_regionkey").unionByName(row(t.customer, "c", "n", "c_custkey", "c_nationkey")).unionByName(row(t.supplier, "s", "n", "s_suppkey", "s_nationkey"))


EVENT_ITEM_SQL = "event_type || ':' || json_extract_string(props, '$.k')"


def recordings(t: Tables) -> DataFrame:
    """(store_id, test_id, kind, item, flags): what each user did on even and odd days."""
    return t.events.select(
        F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd").alias("store_id"), F.col("user_id").cast("string").alias("test_id"), F.lit("symbol").alias("kind"),
        F.concat(F.col("event_type"), F.lit(":"), F.get_json_object("props", "$.k")).alias("item"), F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "signup", 1).otherwise(0).alias("flags"), "event_id",
    )


RECORDINGS_SQL = f"rec AS (SELECT CASE WHEN day(ts) % 2 = 0 THEN 'even' ELSE 'odd' END AS store_id, user_id::VARCHAR AS test_id, {EVENT_ITEM_SQL} AS item, CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 1 ELSE 0 END AS flags, event_id FROM events)"
