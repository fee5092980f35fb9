"""Scanners and golden set files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import ids

MAX_BYTES = 8_000_000
#: Media types by extension; others are application/octet-stream.
MEDIA = {"md": "text/markdown", "markdown": "text/markdown", "rst": "text/x-rst", "txt": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "xml": "application/xml", "pdf": "application/pdf", "py": "text/x-python", "yaml": "application/yaml", "yml": "application/yaml"}


def media_type(uri: Column) -> Column:
    ext = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[x for k, v in MEDIA.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def path_metadata(uri: Column, rules: dict[str, str]) -> Column:
    """A map of what each rule's pattern finds in a path: its first group, or the whole match."""
    entries = []
    for name, pattern in rules.items():
        group = 1 if "(" in pattern.replace("(?:", "").replace(r"\(", "") else 0
        entries.append(F.struct(F.lit(name).alias("key"), F.when(uri.rlike(pattern), F.regexp_extract(uri, pattern, group)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _like(glob: str) -> str:
    return "^" + glob.replace(".", r"\.").replace("**/", "(?:.*/)?").replace("*", "[^/]*").replace("?", "[^/]").replace("(?:.[^/]*/)[^/]", "(?:.*/)?") + "$"


def scan_files(spark: SparkSession, root: str, include: list[str] = ("*",), exclude: list[str] = (), namespace: str = "", max_bytes: int = MAX_BYTES, metadata: dict[str, str] | None = None) -> DataFrame:
    """documents (document_id, source_uri, content, text, content_hash, media_type, size, metadata) of the files below a folder. Each file
    once, whatever patterns it matches; files over MAX_BYTES are left out before they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_bytes)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "")
    f = f.withColumn("source_uri", rel)
    keep = F.lit(False)
    for g in include:
        keep = keep | F.element_at(F.split("source_uri", "/"), -1).rlike(_like(g)) | F.col("source_uri").rlike(_like(g))
    for g in exclude:
        keep = keep & ~F.col("source_uri").rlike(_like(g).replace("[^/]", "."))
    d = f.filter(keep).select(ids.document_id(namespace, F.col("source_uri")).alias("document_id"), "source_uri", "content", F.decode("content", "UTF-8").alias("text"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), media_type(F.col("source_uri")).alias("media_type"), F.col("length").alias("size"))
    return d.withColumn("metadata", path_metadata(F.col("source_uri"), metadata or {}) if metadata else F.create_map().cast("map<string,string>"))


def scan_table(rows: DataFrame, uri: Column, text: Column, namespace: str = "", metadata: list[str] = ()) -> DataFrame:
    """documents of a table's rows, with the columns of METADATA as a map."""
    d = rows.select(uri.cast("string").alias("source_uri"), text.alias("text"), F.create_map(*[x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]).alias("metadata") if metadata else F.create_map().cast("map<string,string>").alias("metadata"))
    return d.select(ids.document_id(namespace, F.col("source_uri")).alias("document_id"), "source_uri", "text", ids.text_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), media_type(F.col("source_uri")).alias("media_type"), F.octet_length("text").alias("size"), "metadata")


def concatenated(*sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Sources in order, cut at LIMIT documents in the order of source and id."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("_k", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return (out.orderBy("_k", "document_id").limit(limit) if limit is not None else out).drop("_k")


def first_of_each(*sources: DataFrame) -> DataFrame:
    """Sources together; a document_id that several hold is taken from the first."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("_k", F.lit(k))
        every = s if every is None else every.unionByName(s)
    rest = [c for c in every.columns if c not in ("document_id", "_k")]
    return every.groupBy("document_id").agg(F.min_by(F.struct(*rest), "_k").alias("r")).select("document_id", "r.*")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of a JSON-lines file; blank lines, # comments and the `_meta` line are skipped."""
    lines = spark.read.text(path).filter(r"trim(value) <> '' and trim(value) not like '#%' and not value rlike '^\\s*\\{\\s*\"_meta\"'")
    schema = "id string, query string, relevant array<struct<document_id:string,span:array<int>,weight:int,snippet:string,page:int>>, query_type string, answer string, answer_type string, origin string, generator string, difficulty string, tags array<string>, notes string, lexical_overlap double"
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*").withColumnRenamed("id", "query_id")


def golden_meta(spark: SparkSession, path: str) -> dict:
    """What the `_meta` line of a golden set says; empty if there is none."""
    line = spark.read.text(path).filter(r"value rlike '^\\s*\\{\\s*\"_meta\"'").head(1)
    return json.loads(line[0]["value"])["_meta"] if line else {}


def write_golden(golden: DataFrame, path: str, meta: dict | None = None) -> None:
    """Write a golden set as JSON lines, with a `_meta` line in a file of its own."""
    golden.withColumnRenamed("query_id", "id").write.mode("overwrite").json(path)
    if meta is not None:
        golden.sparkSession.createDataFrame([(json.dumps({"_meta": meta}, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def artifacts(blobs: DataFrame, content: str = "content", media_type: str = "media_type") -> DataFrame:
    """(content_hash, uri, media_type, content) of blobs, one row per content, for a table keyed by hash."""
    b = blobs.filter(F.col(content).isNotNull()).select(F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256)).alias("content_hash"), F.col(media_type).alias("media_type"), F.col(content).alias("content"))
    b = b.groupBy("content_hash").agg(F.min("media_type").alias("media_type"), F.first("content").alias("content"))
    return b.select("content_hash", F.concat(F.lit("artifact:"), "content_hash", F.lit("?type="), F.coalesce("media_type", F.lit("application/octet-stream"))).alias("uri"), "media_type", "content")


def log_decisions(decisions: DataFrame, path: str) -> None:
    """Append a batch of routing decisions to the log."""
    decisions.write.mode("append").json(path)
