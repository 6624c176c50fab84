"""Feed batches, candidate lists, earlier results and recorded pairs as tables; each check that fails names what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reachability classes in the order in which candidates are taken (fixed values).
BUCKETS = ("active", "unavailable", "restricted", "other", "redirected")
SCANNERS = ("virustotal", "urlscan")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table by column name, all columns text; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256) of the files in a folder."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def broken_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Names of an expected (name, sha256) table that are missing or differ."""
    return expected.join(found, ["name", "sha256"], "left_anti").select("name")


def load_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a batch, once every file of its manifest has the hash written there."""
    manifest = spark.read.json(f"{folder}/manifest.json", multiLine=True)
    expected = manifest.select(F.explode(F.from_json(F.to_json("files_sha256"), "map<string,string>")).alias("name", "sha256"))
    bad = broken_files(file_hashes(spark, folder), expected).orderBy("name").first()
    if bad:
        raise ValueError(f"snapshot_integrity_failed:{bad['name']}")
    return spark.read.json(f"{folder}/records.json")


def same_urls(a: DataFrame, b: DataFrame) -> bool:
    """Whether two (line, url) lists hold the same text in the same order; line ends are no part of it."""
    rows = a.select("line", "url")
    return rows.exceptAll(b.select("line", "url")).isEmpty() and b.select("line", "url").exceptAll(rows).isEmpty()


def _hosts(rows: DataFrame, place: str) -> DataFrame:
    """The first phishing row of each host, in its reachability class."""
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("reachability_class"))
    url = F.trim("url_normalized")
    rows = rows.filter((F.col("class_label") == "phishing") & (rank > 0) & url.startswith("http") & (F.coalesce("host", F.lit("")) != ""))
    own = F.struct(url.alias("url"), F.col("reachability_class"), F.col(place), rank.alias("bucket"))
    return rows.groupBy("host").agg(F.min_by(own, F.struct(place, url)).alias("r")).select("r.url", "host", "r.reachability_class", f"r.{place}", "r.bucket")


def candidates(rows: DataFrame, limit: int, place: str = "place") -> DataFrame:
    """Addresses of phishing rows, the first of each host, by reachability class and place, at most ``limit``."""
    return _hosts(rows, place).orderBy("bucket", place).limit(limit)


def bucket_sizes(rows: DataFrame, place: str = "place") -> DataFrame:
    """Hosts in each reachability class, before any limit."""
    return _hosts(rows, place).groupBy("reachability_class").agg(F.count("*").alias("hosts"))


def resolve_urls(spark: SparkSession, url: str | None = None, batch: DataFrame | None = None, listed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(line, url) to observe: a single address before a batch before a list; then the limit."""
    if url is not None:
        out = spark.createDataFrame([(1, url)], "line long, url string")
    elif batch is not None:
        out = batch.select(F.col("line").cast("long").alias("line"), "url")
    elif listed is not None:
        out = listed.filter((F.trim("raw_url") != "") & ~F.trim("raw_url").startswith("#")).select(F.col("line").cast("long").alias("line"), F.trim("raw_url").alias("url"))
    else:
        raise ValueError("no_url_source")
    return out if limit is None else out.orderBy("line").limit(limit)


def with_source(urls: DataFrame, records: DataFrame | None) -> DataFrame:
    """Each address with its source record, the first by line (else by its values) of several; one without a record is unlabelled manual input."""
    defaults = {"label": "", "source_label": "unlabeled", "source": "manual_input", "batch_id": "", "fetched_at": ""}
    if records is None:
        return urls.withColumns({k: F.lit(v) for k, v in defaults.items()})
    order = F.struct(*[c for c in ("line",) if c in records.columns], *defaults)
    own = records.groupBy("url").agg(F.min_by(F.struct(*defaults), order).alias("r")).select("url", "r.*")
    return urls.join(own, "url", "left").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(url, folder) of recorded pairs by their meta files; unreadable ones are left out."""
    meta = spark.read.json(f"{folder}/*/meta.json", schema="url string, _corrupt_record string", mode="PERMISSIVE", multiLine=True).withColumn("folder", F.regexp_replace(F.input_file_name(), "/meta\\.json$", ""))
    return meta.filter("url IS NOT NULL AND _corrupt_record IS NULL").select("url", "folder")


def reputation(vendors: DataFrame, key: str = "url") -> DataFrame:
    """(key, overall, hits) of (key, vendor, verdict, detail): any malicious, else suspicious, else clean if a scanner says so, else unknown.

    A list that does not hold an address has not looked at it, so only scanners can call it clean.
    """
    says = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    scanned = F.coalesce(F.bool_or((F.col("verdict") == "clean") & F.col("vendor").isin(*SCANNERS)), F.lit(False))
    hit = F.when(F.col("verdict") == "malicious", F.concat("vendor", F.lit(": "), F.coalesce(F.nullif(F.col("detail"), F.lit("")), F.lit("malicious"))))
    overall = F.when(says("malicious"), "malicious").when(says("suspicious"), "suspicious").when(scanned, "clean").otherwise("unknown")
    return vendors.groupBy(key).agg(overall.alias("overall"), F.array_sort(F.collect_list(hit)).alias("hits"))


def with_labels(rows: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Result rows with a ``label``: an own column is used as it is, even if blank; only without one ``other`` is joined."""
    if "label" in rows.columns:
        return rows
    if other is None:
        return rows.withColumn("label", F.lit(None).cast("string"))
    order = F.struct(*[c for c in ("line",) if c in other.columns], "label")
    return rows.join(other.groupBy("url").agg(F.min_by("label", order).alias("label")), "url", "left")
