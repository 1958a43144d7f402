"""Sources and sinks."""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables of the test data folders.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a table (parquet by default; any ``spark.read`` format, or a
    catalog table when ``fmt == "table"``). Filters and projections applied
    later are pushed into the scan by Catalyst."""
    if fmt == "table":
        return spark.table(path)
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, table_path(sf_dir, name))


#: Name of the one rule that a record fails when it does not fit the schema.
MALFORMED = "malformed_record"
_CORRUPT = "__scrubline_corrupt"


def read_permissive(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", **options) -> DataFrame:
    """S1 with records that may not fit: CSV or JSON under a declared schema. Every
    record is kept: ``failed_rules`` is ``['malformed_record']`` and ``record`` its text
    where a field cannot be read as its type or the record has other fields
    than the schema; else ``[]`` and NULL. Of a malformed record the fields that could
    be read have their values. Quarantine (``flag``) adds its rules to the same column."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"read_permissive reads csv or json, not {fmt!r}")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = {"failed_rules", "record"} & set(declared.fieldNames())
    if clash:
        raise ValueError(f"columns named like those that are added: {sorted(clash)}")
    full = T.StructType([*declared.fields, T.StructField(_CORRUPT, T.StringType())])
    if fmt == "csv":
        options = {"columnPruning": "false", **options}  # a record's fields are counted whatever is selected
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, **options}
    rows = spark.read.format(fmt).options(**options).schema(full).load(path)
    # a reader only converts the fields that a query uses, and only those can be found
    # malformed: the flag uses them all, so that it does not depend on the selection
    text = F.concat_ws("", *[F.col(c).cast("string") for c in declared.fieldNames()])
    bad = F.col(_CORRUPT).isNotNull() & (F.length(text) >= 0)
    flags = F.when(bad, F.array(F.lit(MALFORMED))).otherwise(F.array().cast("array<string>"))
    return rows.select(*declared.fieldNames(), flags.alias("failed_rules"), F.col(_CORRUPT).alias("record"))


class GateFailed(RuntimeError):
    """Raised by :func:`export` when the quality gate rejects the table."""


def _observed(df: DataFrame, suite) -> tuple[DataFrame, "object"]:
    """(``df`` that counts its rows and the suite's row rules while it is written, the counts)."""
    from pyspark.sql import Observation
    rules = [w.rule for w in suite.rules if w.rule.kind != "duplicates"]
    obs = Observation("scrubline_export")
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *[r.count(df).alias(r.name) for r in rules]), obs


def _decided(spark: SparkSession, seen: dict, written, suite, columns) -> DataFrame:
    """The score from the counts observed; only a rule over whole rows reads what was written."""
    from ..functions.rules import duplicate_count
    from ..plans.suite import score_counts
    counts = dict(seen)
    for w in suite.rules:
        if w.rule.kind == "duplicates":
            counts[w.rule.name] = duplicate_count(written(), w.rule.subset).first()[0] if w.rule.applicable(written()) else 0
    return score_counts(spark.createDataFrame([counts]), suite, columns)


def _check(gate: DataFrame, path: str, info: dict) -> None:
    row = gate.select("passed", *[c for c in ("score",) if c in gate.columns]).first()
    info["passed"] = bool(row["passed"]) if row is not None else False
    if row is not None and "score" in gate.columns:
        info["score"] = row["score"]
    if not info["passed"]:
        raise GateFailed(f"quality gate failed for {path}: {info}")


def _arranged(df: DataFrame, partition_by: Sequence[str] | None) -> DataFrame:
    """A partition's rows together (large ones in several files), not in as many
    files as there are tasks."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def _save(df: DataFrame, path: str, mode: str, partition_by: Sequence[str] | None, fmt: str) -> None:
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def export(df: DataFrame, path: str, mode: str = "errorifexists",
           partition_by: Sequence[str] | None = None, fmt: str = "parquet",
           gate: DataFrame | None = None, ledger: DataFrame | None = None,
           suite=None, publish: str = "rename") -> dict:
    """Write the cleaned table, refusing when the gate fails.

    ``gate`` is a one-row DataFrame with a boolean ``passed`` column (see
    ``plans.suite.score``); it is evaluated first (one small aggregate job) and
    nothing is written if it is false.

    With ``suite`` instead, the table is written once, in its final format, next to its
    place, and the rule counts are observed during that write. They decide the
    gate. If it passes, the files are *published*; if not, they are removed and
    ``GateFailed`` is raised, so readers see a whole table that passed, or the one before.
    ``publish="rename"`` moves the folder into place (one step where the store renames
    folders, as HDFS does). ``publish="manifest"`` leaves it in a folder of its own
    under ``path`` and then writes ``path/_current``, one row that names it: for object
    stores; read such a table with :func:`read_published`. ``mode`` is ``errorifexists``,
    ``overwrite`` or ``ignore``; ``append`` to a published folder copies the files.
    The optional ledger is written next to the table under ``_ledger``.
    """
    from ..session import exists, remove, rename
    spark = df.sparkSession
    info: dict = {"path": path, "written": False}
    if publish not in ("rename", "manifest"):
        raise ValueError(f"publish must be rename or manifest, not {publish!r}")
    base = path.rstrip("/")
    if suite is not None and gate is None:
        there = exists(spark, base)
        if mode in ("error", "errorifexists") and there:
            raise FileExistsError(f"{path} is there already")
        if mode == "ignore" and there:
            return info
        name = uuid.uuid4().hex[:12]
        staged = f"{base}/data-{name}" if publish == "manifest" else f"{base}.staged-{name}"
        # counted behind the last shuffle: tasks that are run again there count once
        counted, obs = _observed(_arranged(df, partition_by), suite)
        try:
            _save(counted, staged, "errorifexists", partition_by, fmt)
            info["written_metrics"] = dict(obs.get)
            _check(_decided(spark, obs.get, lambda: spark.read.schema(df.schema).format(fmt).load(staged), suite, df.columns), path, info)
        except BaseException:
            remove(spark, staged)
            if publish == "manifest" and not there:
                remove(spark, base)
            raise
        if publish == "manifest":
            row = [(f"data-{name}", info["written_metrics"]["rows"], info.get("score"))]
            spark.createDataFrame(row, "folder string, rows long, score double").coalesce(1).write.mode("overwrite").json(f"{base}/_current")
        elif mode == "append" and there:
            _save(_arranged(spark.read.schema(df.schema).format(fmt).load(staged), partition_by), base, "append", partition_by, fmt)
            remove(spark, staged)
        else:
            old = f"{base}.old-{name}" if there else None
            if old:
                rename(spark, base, old)
            rename(spark, staged, base)
            if old:
                remove(spark, old)
    else:
        if gate is not None:
            _check(gate, path, info)
        _save(_arranged(df, partition_by), path, mode, partition_by, fmt)
    if ledger is not None:
        ledger.write.mode(mode).format(fmt).save(f"{base}/_ledger")
    info["written"] = True
    return info


def read_published(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The table that ``path/_current`` names (``publish="manifest"``)."""
    base = path.rstrip("/")
    folder = spark.read.schema("folder string, rows long, score double").json(f"{base}/_current").first()["folder"]
    return read_table(spark, f"{base}/{folder}", fmt, schema)
