"""Stage tables: write, append, cache, drop, list. Parquet tables in the session's catalog.

A table is replaced by writing a new version beside the old one and then pointing the catalog at it. That one change commits
the replacement: before it readers have the whole old table, whatever befalls the write, and after it the whole new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CACHE_PREFIX = "cache_table___"


def _qualified(table: str, database: str | None) -> str:
    return f"{database}.{table}" if database else table


def _refresh(spark: SparkSession, name: str) -> None:
    spark.sql(f"REFRESH TABLE {name}")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _version(path: str) -> str:
    return f"{path.rstrip('/')}/v_{uuid.uuid4().hex}"


def location(spark: SparkSession, table: str, database: str | None = None) -> str:
    """Folder of the version in force."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_qualified(table, database)}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def _replace(df: DataFrame, table: str, database: str | None, path: str) -> None:
    """Writes ``path`` and makes it the table's version in force; the old one goes when the new one is there."""
    spark, name = df.sparkSession, _qualified(table, database)
    before = location(spark, table, database)
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception:
        _delete(spark, path)
        raise
    old, new = spark.table(name).schema, spark.read.parquet(path).schema
    if [(f.name, f.dataType) for f in old] == [(f.name, f.dataType) for f in new]:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    else:
        # Other columns need another entry: the old one waits under another name until the new one stands.
        aside = _qualified(f"{table}_{uuid.uuid4().hex[:8]}", database)
        spark.sql(f"CREATE TABLE {aside} USING parquet LOCATION '{path}'")
        held = _qualified(f"{table}_{uuid.uuid4().hex[:8]}", database)
        spark.sql(f"ALTER TABLE {name} RENAME TO {held}")
        try:
            spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
        except Exception:
            spark.sql(f"ALTER TABLE {held} RENAME TO {name}")
            raise
        spark.sql(f"DROP TABLE {held}")
    _delete(spark, before)


def write_table(df: DataFrame, table: str, database: str | None = None, replace: bool = False) -> bool:
    """Write a table; an existing one is kept (False) unless ``replace``. A failed replacement leaves the old table."""
    spark, name = df.sparkSession, _qualified(table, database)
    exists = spark.catalog.tableExists(name)
    if exists and not replace:
        return False
    if exists:
        base = location(spark, table, database).rstrip("/")
        _replace(df, table, database, f"{base.rsplit('/', 1)[0]}/{table}__v_{uuid.uuid4().hex}")
    else:
        df.write.mode("errorifexists").saveAsTable(name)
    _refresh(spark, name)
    return True


def append_table(df: DataFrame, table: str, database: str | None = None) -> bool:
    """Append by column name to an existing table; False when there is none."""
    spark, name = df.sparkSession, _qualified(table, database)
    if not spark.catalog.tableExists(name):
        return False
    df.select(*spark.table(name).columns).write.insertInto(name, overwrite=False)
    _refresh(spark, name)
    return True


def cache_table(df: DataFrame, database: str | None = None) -> str:
    """Write under a unique name and return it."""
    name = f"{CACHE_PREFIX}{uuid.uuid4().hex}"
    write_table(df, name, database)
    return _qualified(name, database)


def write_path_table(df: DataFrame, table: str, path: str, database: str | None = None, replace: bool = False) -> bool:
    """Write a version under ``path`` and register the table there; an existing table is kept (False) unless ``replace``, and is
    kept too if writing its replacement fails."""
    spark, name = df.sparkSession, _qualified(table, database)
    exists = spark.catalog.tableExists(name)
    if exists and not replace:
        return False
    if exists:
        _replace(df, table, database, _version(path))
    else:
        df.write.mode("errorifexists").format("parquet").option("path", _version(path)).saveAsTable(name)
    _refresh(spark, name)
    return True


def append_path_table(df: DataFrame, table: str, database: str | None = None) -> bool:
    return append_table(df, table, database)


def drop_table(spark: SparkSession, table: str, database: str | None = None) -> bool:
    name = _qualified(table, database)
    existed = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return existed


def drop_cached_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Drop every table with the cache prefix; returns their names."""
    names = [n for n in list_tables(spark, database) if n.startswith(CACHE_PREFIX)]
    for n in names:
        drop_table(spark, n, database)
    return names


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the permanent tables."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return sorted(t.name for t in found if not t.isTemporary)
