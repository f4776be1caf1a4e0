"""Identity as hashes of NUL-separated, domain-prefixed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(domain: str, *fields: Column | str) -> Column:
    """SHA-256 (hex) of the domain and the fields as strings, NUL between them; a null field is empty."""
    texts = [F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat_ws("\0", F.lit(domain), *texts).cast("binary"), 256)


def set_fingerprint(domain: str, values: Column) -> Column:
    """Fingerprint of an array column as a set: sorted, without repeats."""
    return fingerprint(domain, F.array_join(F.array_sort(F.array_distinct(values)), "\0"))
