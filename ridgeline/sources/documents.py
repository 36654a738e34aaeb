"""JSON documents in and out: loosely shaped collections become rows with a place in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas


def rows_of(text: Column, schema: str, *keys: str, promote: bool = True) -> Column:
    """The array of rows in a JSON text: a list; under the first of ``keys`` a list or a map of objects; else a map of objects.

    With ``promote``, a map's key is the id of an object that has none of its own. What is not an object is dropped.
    """
    item = f"STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in _fields(schema))}>"

    def listed(c: Column) -> Column:
        found = F.filter(F.from_json(c, "ARRAY<STRING>"), lambda x: F.trim(x).startswith("{"))
        return F.transform(found, lambda x: F.from_json(x, item))

    def mapped(c: Column) -> Column:
        entries = F.filter(F.map_entries(F.from_json(c, "MAP<STRING,STRING>")), lambda e: F.trim(e["value"]).startswith("{"))

        def one(e: Column) -> Column:
            row = F.from_json(e["value"], item)
            return row.withField("id", F.coalesce(row["id"], e["key"])) if promote else row

        return F.transform(entries, one)

    is_list = lambda c: F.coalesce(F.ltrim(c).startswith("["), F.lit(False))
    is_map = lambda c: F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))
    out = F.when(is_map(text), mapped(text))
    for key in reversed(keys):
        inner = F.get_json_object(text, f"$.{key}")
        out = F.when(is_map(text) & is_list(inner), listed(inner)).when(is_map(text) & is_map(inner), mapped(inner)).otherwise(out)
    return F.coalesce(F.when(is_list(text), listed(text)).otherwise(out), F.array().cast(f"ARRAY<{item}>"))


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(at.strip())
            at = ""
        else:
            at += ch
    return [*out, at.strip()]


def collection(df: DataFrame, column: str, schema: str, *keys: str, promote: bool = True) -> DataFrame:
    """The rows of every document in ``column``, with ``ord``, beside the other columns of df."""
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, F.posexplode(rows_of(F.col(column), schema, *keys, promote=promote)).alias("ord", "_row"))
    return rows.select(*rest, "_row.*", F.col("ord").cast("long").alias("ord"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one row (value)."""
    return spark.read.text(path, wholetext=True)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest of a JSON file."""
    return collection(read_text(spark, path), "value", schemas.POIS, "points", "nodes")


def map_rows(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of map documents (value); the edges' ends are src and dst."""
    nodes = collection(text.select(F.get_json_object("value", "$.nodes").alias("value")), "value", schemas.NODES, "points", "nodes")
    edge_schema = schemas.EDGES + ", id STRING"
    edges = collection(text.select(F.get_json_object("value", "$.edges").alias("value")), "value", edge_schema, "edges")
    return nodes, edges.drop("id").withColumnsRenamed({"from": "src", "to": "dst"})


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a map file."""
    return map_rows(read_text(spark, path))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, UTF-8, over what was there."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """(json): every row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table; filters and columns are pushed down by the source. Give partitionColumn and bounds for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The users, profiles and favourites tables: those that are missing, and in older ones the columns that are.

    Old rows have nulls in new columns; what a table has beside the declared columns stays. Doing it again changes nothing.
    """
    for name, schema in (("users", schemas.USERS), ("user_profiles", schemas.PROFILES), ("favorite_routes", schemas.FAVOURITES)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
        add_columns(spark, f"{database}.{name}", schema)


def add_columns(spark: SparkSession, table: str, schema: str) -> list[str]:
    """Add the columns of ``schema`` that a table lacks, by name, whatever the case; returns their names. A column of another type is refused."""
    has = {f.name.lower(): f.dataType for f in spark.table(table).schema}
    wanted = StructType.fromDDL(schema).fields
    for f in wanted:
        if f.name.lower() in has and has[f.name.lower()] != f.dataType:
            raise ValueError(f"{table}.{f.name} is {has[f.name.lower()].simpleString()}, not {f.dataType.simpleString()}")
    new = [f for f in wanted if f.name.lower() not in has]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    return [f.name for f in new]


def append(df: DataFrame, table: str) -> None:
    """Append rows to a table."""
    df.write.mode("append").saveAsTable(table)


def append_once(df: DataFrame, table: str, batch: int) -> None:
    """Rows of a batch into a table parted by ``batch``: written again they take the place of those written before.

    So a replay, or a second writer with the same batch, leaves the rows once. Writers of different batches don't meet.
    """
    spark = df.sparkSession
    rows = df.drop("batch").withColumn("batch", F.lit(batch).cast("bigint"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (batch)")
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows = rows.select(*spark.table(table).columns)
        if rows.isEmpty():
            # nothing to write is no partition to overwrite
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (batch = {batch})")
        else:
            rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)
