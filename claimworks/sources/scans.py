"""Reading benchmark tables, user files, caches, claims and corpora."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimworks.sources import arrow_streams, schemas


def benchmark(spark: SparkSession, path: str, split: str = "dev") -> DataFrame:
    """A pinned split; a row's id is its place in its file, which Parquet keeps whatever the plan."""
    rows = spark.read.schema(schemas.BENCHMARK).parquet(path)
    return rows.select(F.concat(F.lit(f"{split}:"), F.col("_metadata.row_index").cast("string")).alias("id"), "dataset", "doc", "claim", F.col("label").cast("int").alias("label"))


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records by line; empty lines are skipped, broken ones stop the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def only_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file below a folder that has a name of this pattern."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path").limit(2).collect()
    if len(found) != 1:
        raise FileNotFoundError(f"{folder}: {len(found) or 'no'} files like {pattern}; one is wanted")
    return found[0].path


def _flag(value: Column) -> Column:
    text = F.lower(value.cast("string"))
    return F.when(text.isin("1", "true"), 1).when(text.isin("0", "false"), 0).otherwise(F.raise_error(F.concat(F.lit("a label is 0, 1, true or false, not "), F.coalesce(text, F.lit("null")))).cast("int"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their number in the order they are read: the rows of earlier partitions, and those before it in its own."""
    own = rows.withColumn("_m", F.monotonically_increasing_id())
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = own.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return own.withColumn("_p", part).join(counts.select("_p", before.alias("_before")), "_p").withColumn("_number", F.col("_before") + place).drop("_m", "_p", "_before")


def user_rows(rows: DataFrame) -> DataFrame:
    """id, dataset, doc, claim, label of a user's rows: document or doc, ids and sources where they are missing."""
    have = set(rows.columns)
    col = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    if "id" in have:
        named = rows.withColumn("_id", F.col("id").cast("string"))
    else:
        named = numbered(rows).withColumn("_id", F.concat(F.lit("row:"), F.col("_number").cast("string")))
    need = lambda c, what: F.when(F.length(F.trim(c)) > 0, c).otherwise(F.raise_error(F.lit(f"a row has no {what}")).cast("string"))
    return named.select(F.col("_id").alias("id"), F.coalesce(col("dataset"), F.lit("all")).alias("dataset"), need(col("doc", "document"), "document").alias("doc"), need(col("claim"), "claim").alias("claim"), _flag(F.col("label")).alias("label"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 0), line of a text file or a folder's files, by name: a file may be read by many tasks.

    A task knows where its block starts in the file and the order of its lines; the lines of earlier blocks are added up, one
    count for each block.
    """
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    blocks = own.groupBy("_file", "_block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    return own.join(F.broadcast(blocks.select("_file", "_block", (before - F.col("_first")).alias("_shift"))), ["_file", "_block"]).select((F.col("_m") + F.col("_shift")).alias("number"), "line")


def cache(spark: SparkSession, path: str, identity: dict, schema: StructType) -> DataFrame:
    """Records of a cache whose first line holds the identity of the run; another identity is refused, a key's last record counts."""
    numbered_lines = lines(spark, path)
    head = spark.read.text(path).head(1)
    if not head or json.loads(head[0].value).get("identity") != identity:
        raise ValueError(f"{path} belongs to another run")
    records = numbered_lines.where((F.col("number") > 0) & (F.trim("line") != "")).select("number", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    key = schema.fields[0].name
    return records.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", "number").alias("r")).select("r.*")


def claims(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Claims of all JSON files of a folder, objects or lists; further fields stay together as metadata."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")
    items = files.select("_file", F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("item"))
    fields = F.from_json("item", schemas.CLAIM)
    whole = F.from_json("item", "map<string,string>")
    rows = items.select("_file", fields.alias("c"), F.map_filter(whole, lambda k, _: ~k.isin("claim", "claim_id")).alias("claim_metadata"))
    missing = F.raise_error(F.concat(F.lit("a claim lacks its text or id in "), "_file")).cast("string")
    return rows.select(F.when(F.col("c.claim_id").isNotNull() & F.col("c.claim").isNotNull(), F.col("c.claim_id")).otherwise(missing).alias("claim_id"), F.col("c.claim").alias("claim"), F.col("c.candidate_documents").alias("candidate_documents"), "claim_metadata")


def packs(spark: SparkSession, pattern: str) -> dict[str, dict]:
    """Question packs of all JSON files of a pattern, by the file's name without its ending; packs are few and small."""
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("name"), "value").collect()
    return {r.name: json.loads(r.value) for r in files}


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of all text files of a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow stream by its ending, Parquet otherwise."""
    if path.endswith(".arrow"):
        arrow_streams.register(spark)
        return spark.read.format("arrow_stream").load(path)
    return spark.read.parquet(path)


def predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """Predictions of all files of a pattern, with the file each comes from."""
    return json_lines(spark, pattern, schemas.PREDICTION).withColumn("file", F.col("_metadata.file_name"))


def spent(spark: SparkSession, pattern: str, price_in: float, price_out: float = 0.0) -> float:
    """What all predictions of a pattern have cost, by prices per million tokens."""
    row = predictions(spark, pattern).agg(F.sum("usage.input_tokens").alias("i"), F.sum("usage.output_tokens").alias("o")).first()
    return ((row.i or 0) * price_in + (row.o or 0) * price_out) / 1e6
