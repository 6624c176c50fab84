"""Writers of results. Exclusive ones fail if their folder exists, so no evidence is ever written over."""

from __future__ import annotations

import difflib
import hashlib
import html as markup
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import url_hash
from ..operators.results import BLIND, report_text

DIFF_LINES, NAME_CHARS, LIST_LINES = 400, 60, 100_000


def _text_columns(rows: DataFrame, fields) -> DataFrame:
    """The fields in order as text; what a row does not have is empty, other columns are left out."""
    have = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in fields])


def write_csv(rows: DataFrame, path: str, fields) -> None:
    """A CSV table with a header; fails if the folder exists."""
    _text_columns(rows, fields).write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="")


def append_csv(rows: DataFrame, path: str, fields) -> None:
    """Rows added to a CSV table; Spark's commit protocol keeps writers apart, and each file has its own header."""
    _text_columns(rows, fields).write.mode("append").csv(path, header=True, escape='"', emptyValue="")


def _sharded(rows: DataFrame, key: str) -> DataFrame:
    """With ``shard``, two digits of the key's hash: 256 folders, however many rows."""
    return rows.withColumn("shard", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2))


def write_artifacts(records: DataFrame, path: str, key: str = "record_id") -> None:
    """Bodies and other evidence by record, in a folder for each two digits of the key's hash; fails if the folder exists."""
    _sharded(records, key).write.mode("errorifexists").partitionBy("shard").parquet(path)


def read_artifact(spark: SparkSession, path: str, key_value: str, key: str = "record_id") -> DataFrame:
    """The rows of one record; only its shard's files are read."""
    shard = hashlib.sha256(str(key_value).encode()).hexdigest()[:2]
    return spark.read.parquet(path).filter((F.col("shard") == shard) & (F.col(key).cast("string") == str(key_value))).drop("shard")


def audit_payload(rows: DataFrame, key: str) -> DataFrame:
    """(key, audit, sha256): each row as JSON text with sorted keys, and the hash of exactly that text."""
    names = sorted(c for c in rows.columns if c != key)
    audit = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return rows.select(key, audit.alias("audit")).withColumn("sha256", F.sha2("audit", 256))


def write_audit(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Writes audit texts, one line a row, and returns where each is and its hash."""
    payload = audit_payload(rows, key)
    payload.write.mode("errorifexists").json(path)
    return payload.select(key, "sha256", F.lit(path).alias("audit_path"))


def list_hash(urls: DataFrame, size: int = LIST_LINES) -> tuple[str, int]:
    """A hash of a (line, url) list and its length: of the addresses in the order of their lines, one a line.

    Longer lists than ``size`` lines are hashed in stretches of that many lines, and the hash is that of the stretches' hashes.
    """
    parts = urls.groupBy(F.expr(f"(line - 1) div {size}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("line", "url"))).alias("rows"))
    hashes = parts.select("part", F.sha2(F.array_join(F.transform("rows", lambda r: r["url"]), "\n"), 256).alias("h"), F.size("rows").alias("n"))
    whole = hashes.agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    found = [r["h"] for r in whole["all"]]
    return (found[0] if len(found) == 1 else hashlib.sha256("\n".join(found).encode()).hexdigest()), whole["n"]


def manifest(urls: DataFrame, settings: dict, **more) -> dict:
    """A run's settings and the hashes that tell whether two runs are alike: of the settings and of the list of addresses."""
    text = json.dumps(settings, sort_keys=True, ensure_ascii=True)
    listed, n = list_hash(urls)
    return {"observation_settings": settings, "run_config_sha256": hashlib.sha256(text.encode()).hexdigest(), "url_list_sha256": listed, "n_urls": n} | more


def write_manifest(urls: DataFrame, path: str, settings: dict, **more) -> dict:
    out = manifest(urls, settings, **more)
    urls.sparkSession.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return out


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Recorded pairs for annotators: the pages and the allowed facts only, with the address's hash; one folder for each two digits of it."""
    pages = [c for c in ("bot_html", "human_html", "human_dom") if c in pairs.columns]
    pairs.select(*BLIND, *pages, url_hash(F.col("url")).alias("url_hash")).withColumn("shard", F.substring("url_hash", 1, 2)).write.mode("errorifexists").partitionBy("shard").json(path)


def write_projections(records: DataFrame, folder: str) -> None:
    """The list of addresses and the table of source labels that older tools read; written over each time."""
    ordered = records.orderBy("line")
    ordered.select(F.col("url").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/urls.txt")
    _text_columns(ordered, ("url", "label", "source_label", "source", "batch_id", "fetched_at")).coalesce(1).write.mode("overwrite").csv(f"{folder}/ground_truth.csv", header=True)


def report_name(url: Column) -> Column:
    """A file name of at most 60 characters for an address."""
    return F.substring(F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[^A-Za-z0-9._-]", "_"), 1, NAME_CHARS)


def write_reports(results: DataFrame, path: str) -> None:
    """The ten-line report of each page with its file name, as lines of JSON in a folder for each two digits of the name's hash."""
    _sharded(results.select(report_name(F.col("url")).alias("name"), report_text().alias("report")), "name").write.mode("errorifexists").partitionBy("shard").json(path)


@F.arrow_udf(T.StringType())
def _panes(place: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Both pages of a pair in closed frames, and the lines in which they differ."""
    out = []
    for n, left, right in zip(place.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
        left, right = left or "", right or ""
        lines = list(difflib.unified_diff(left.splitlines(), right.splitlines(), "A", "B", lineterm="", n=1))[:DIFF_LINES]
        frames = "".join(f'<iframe sandbox srcdoc="{markup.escape(x, quote=True)}"></iframe>' for x in (left, right))
        out.append(f'<section id="p{n}">{frames}<pre>{markup.escape(chr(10).join(lines))}</pre></section>')
    return pa.array(out, pa.string())


def annotation_sheets(sample: DataFrame, a: str = "bot_text", b: str = "human_text") -> DataFrame:
    """(place, url_hash, sheet) of sampled pairs; no verdict, label or address is in the sheet."""
    return sample.select("place", url_hash(F.col("url")).alias("url_hash"), _panes("place", a, b).alias("sheet"))
