"""Small tables and worker memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def small_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A DataFrame of rows that the driver holds.

    They reach the JVM as one Arrow table; no Python worker is started for them, as
    ``createDataFrame`` of a list would.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Give memory that a finished task held back to the system; workers live on for the next stage's tasks."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:      # only the GNU library has it
        pass
