"""Files as rows: listing, gate, manifest check, storage paths, size estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.numbers import floor_div

# Accepted uploads.
EXTENSIONS = ("csv", "txt")
CONTENT_TYPES = ("text/csv", "application/csv", "text/plain")
MAX_BYTES = 10 * 1024 * 1024


def list_files(spark: SparkSession, prefix: str, glob: str | None = None) -> DataFrame:
    """Path, size and time of every file under a prefix; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(prefix).select("path", F.col("modificationTime").alias("modified_at"), "length")


def file_checksums(spark: SparkSession, prefix: str, glob: str | None = None) -> DataFrame:
    """Listing with the MD5 of each file.

    A file is one row here, so this is for uploads within the size limit, not
    for large data files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(prefix).select("path", "length", F.md5("content").alias("checksum"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; the whole name when there is none."""
    return F.element_at(F.split(F.lower(name), r"\."), -1)


def check_files(
    files: DataFrame,
    name: str = "name",
    size: str = "length",
    content_type: str | None = "content_type",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``reasons`` why a file is refused and ``accepted``."""
    label = F.col(name)
    checks = []
    if content_type:
        checks.append((~F.col(content_type).isin(*CONTENT_TYPES), "Invalid file type"))
    checks += [
        (~extension(label).isin(*EXTENSIONS), "Invalid file extension"),
        (label.contains("..") | label.contains("/") | label.contains("\\"), "Invalid filename"),
        (F.col(size) > max_bytes, "File size limit exceeded"),
        (F.col(size) == 0, "Uploaded file is empty"),
    ]
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(message)) for broken, message in checks]))
    return files.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def check_manifest(manifest: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Verdict per manifest row: present with the expected size and checksum.

    Columns ``expected_length`` and ``expected_checksum`` against ``length`` and
    ``checksum`` of the listing.
    """
    joined = manifest.join(listing.select(key, "length", "checksum"), key, "left")
    verdict = (
        F.when(F.col("length").isNull(), "file not found")
        .when(F.col("length") != F.col("expected_length"), "size mismatch")
        .when(F.col("checksum") != F.col("expected_checksum"), "checksum mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("verdict", verdict).withColumn("is_valid", F.col("verdict") == "ok")


# Storage layout. Folder names of the stored paths.
BASE = "private"


def raw_path(account: Column, action: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{BASE}/Accounts"), account, F.lit("Action"), action, F.lit("raw.csv"))


def chunk_path(account: Column, action: Column, job: Column, index: Column) -> Column:
    name = F.concat(F.lit("chunk"), index.cast("string"), F.lit(".csv"))
    return F.concat_ws(
        "/", F.lit(f"{BASE}/Accounts"), account, F.lit("Action"), action, F.lit("Chunks"), job, name
    )


def processing_path(account: Column, action: Column, name: Column) -> Column:
    """Path of a written chunk file under any of the three namings."""
    return F.concat_ws(
        "/", F.lit(f"{BASE}/Accounts"), account, F.lit("Action"), action, F.lit("Chunks/processing"), name
    )


_PREFIX = rf"^{BASE}/Accounts/([^/]+)/Action/([^/]+)/"
_HEX_SPAN = "[0-9a-f]{16}-[0-9a-f]{16}"
_KINDS = (
    ("raw", r"raw\.csv\z"),
    ("chunk", r"Chunks/[^/]+/chunk[0-9]+\.csv\z"),
    ("chunk", rf"Chunks/processing/chunk_([0-9]+|{_HEX_SPAN}|[0-9]+_{_HEX_SPAN})\.csv\z"),
    ("processing", r"[Pp]rocessing/.+\z"),
)


def path_kind(path: Column) -> Column:
    """``raw``, ``chunk`` or ``processing``; null for a path outside the layout."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(_KINDS):
        out = F.when(path.rlike(_PREFIX + pattern), F.lit(kind)).otherwise(out)
    return out


def parse_path(path: Column) -> dict[str, Column]:
    """Account, action and kind of a stored path; all null when it does not parse."""
    kind = path_kind(path)
    return {
        "account_id": F.when(kind.isNotNull(), F.regexp_extract(path, _PREFIX, 1)),
        "action_id": F.when(kind.isNotNull(), F.regexp_extract(path, _PREFIX, 2)),
        "kind": kind,
    }


def estimate_entities(size: Column, bytes_per_row: int = 20) -> Column:
    """Rows of an upload from its size, header excluded."""
    return F.greatest(F.lit(0), floor_div(size, bytes_per_row) - 1).cast("bigint")


def estimate_rows(size: Column, bytes_per_row: int = 150) -> Column:
    return F.ceil(size / F.lit(bytes_per_row)).cast("bigint")
