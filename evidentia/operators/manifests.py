"""Source manifests: JSON lists of files, decoded and refused as a whole for the first thing that is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of a manifest, and why one is refused.
MAX_BYTES, MAX_FILES = 4 * 1024 * 1024, 10_000
TOO_LARGE, MALFORMED, TOO_MANY = "manifest-too-large", "manifest-malformed", "too-many-files"
NOT_NORMALIZED, DUPLICATE = "path-not-normalized", "duplicate-path"
FILE = "struct<path:string,language:string,bytes:bigint,hash:string>"


def decode_manifests(manifests: DataFrame, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """key, files (array of path, language, bytes, hash, by path; null if refused), n_files, reason (null if sound) of ``manifests`` (key, raw).

    Checked in this order: size in bytes, JSON of the right form with no field missing, number of files, then for all files a
    relative path without empty, ``.`` or ``..`` segments, backslashes, NULs and drive letters, a known language and a hash,
    then repeated paths. A null manifest is malformed. Nothing is parsed beyond ``max_bytes``, so a row stays small.
    """
    small = F.octet_length("raw") <= max_bytes
    rows = manifests.select("key", small.alias("small"), F.from_json(F.when(small, F.col("raw")), f"array<{FILE}>", {"mode": "PERMISSIVE"}).alias("files"), (~F.coalesce(F.ltrim("raw").startswith("["), F.lit(False))).alias("none"))
    whole = F.forall("files", lambda f: f["path"].isNotNull() & f["language"].isNotNull() & f["bytes"].isNotNull() & f["hash"].isNotNull())
    bad = lambda p: p.rlike(r"(^|/)(\.{0,2})(/|$)|[\\\x00]|^[A-Za-z]:")
    wrong = F.exists("files", lambda f: (f["path"] == "") | (f["hash"] == "") | ~f["language"].isin("typescript", "tsx") | bad(f["path"]))
    paths = F.transform("files", lambda f: f["path"])
    reason = (
        F.when(~F.coalesce("small", F.lit(True)), TOO_LARGE).when(F.col("none") | F.col("files").isNull() | ~F.coalesce(whole, F.lit(False)), MALFORMED)
        .when(F.size("files") > max_files, TOO_MANY).when(wrong, NOT_NORMALIZED).when(F.size(F.array_distinct(paths)) < F.size(paths), DUPLICATE)
    )
    judged = rows.select("key", "files", reason.alias("reason"))
    kept = F.when(F.col("reason").isNull(), F.array_sort("files"))
    return judged.select("key", kept.alias("files"), F.size(kept).alias("n_files"), "reason")
