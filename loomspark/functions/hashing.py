"""Content hashes as Arrow functions; Spark's own xxhash64 is another function with another seed."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F


def xxh3_hex():
    """A function of a text: XXH3-64 as 16 hex digits, empty for null."""

    @F.arrow_udf("string")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_hexdigest(t.encode("utf-8", "surrogatepass")) if t is not None else "" for t in texts.to_pylist()], pa.string())

    return digest
