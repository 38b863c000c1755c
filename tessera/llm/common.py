"""What the operators of this subpackage share: table access, stage tables, hex hashing."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.scratch import written as stage  # noqa: F401  tables used several times are written once

#: White space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' path, wherever the session was started."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parents[2]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for source in sorted(root.glob("tessera/**/*.py")):
                z.write(source, source.relative_to(root))
        path = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera.zip"
        path.write_bytes(held.getvalue())
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(key: Column, seed: str) -> Column:
    """A uniform double in (0, 1) that depends on ``key`` and ``seed`` alone."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
