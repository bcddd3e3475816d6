"""Ingest: raw all-string extracts → one typed shipment table partitioned by source.

Pipeline: ``scan_shipments`` (csv / json / parquet, every column a string)
→ ``map_headers`` (tolerant header match) → ``clean_shipments`` (typed
projection, derived flags, guards, keyless rows dropped) → ``stamp_batch``
→ ``reload_table`` (new versions of the sources being loaded, in force with
one commit) with ``import_audit`` counters gathered on the same pass through
``DataFrame.observe``.
"""

from __future__ import annotations

import csv
import datetime as dt
import unicodedata
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import (VERBATIM_BLANK_TOKENS, canonical_date, clean_text, day_hours, is_crbt, is_delivered,
                                  parse_float, strip_ws, valid_month, valid_year)
from ..schema import COLUMN_MAP, EDI_VERBATIM_COLUMNS, KEY_COLUMNS, fold_header
from . import commits

SOURCES = ("national", "export", "import")
# Header row of each source's sheet (0-based).
DEFAULT_HEADER_ROW = {"national": 2, "export": 2, "import": 0}

AUDIT_SCHEMA = ("source string, batch_id string, rows_read bigint, rows_inserted bigint, "
                "rows_updated bigint, rows_skipped bigint, status string, message string")


class MissingKeyColumn(ValueError):
    pass


def scan_shipments(spark: SparkSession, path: str, fmt: str = "csv", header_row: int = 0,
                   options: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read a raw extract with every column as the text that stands in the file.

    CSV: a file whose header differs from the first file's makes the read fail
    instead of landing under the wrong names. Pass ``{"multiLine": True}`` for
    extracts with line breaks inside quotes (such files can't be split between
    tasks, so it isn't the default).

    With ``header_row`` > 0 the first ``header_row + 1`` lines of the
    first file are read (a bounded read); the header is the first of them
    holding the key column's name (blank lines are skipped by the reader, so
    the position alone is not trusted). Lines identical to those title lines
    or to the header — the same template heads every file of an export — are
    dropped from all files; any other line that holds the key column's name, in
    whatever spelling headers may have, is another header, and the read fails.

    JSON: numbers keep their spelling. ``columns`` names the fields and saves
    the pass that otherwise collects them.
    """
    opts = dict(options or {})
    if fmt == "csv" and header_row == 0:
        names = spark.read.options(**opts).option("header", True).csv(path).columns
        return (spark.read.options(**opts).schema(_text_schema(names)).option("header", True)
                .option("enforceSchema", False).csv(path))
    if fmt == "csv":
        return _scan_titled_csv(spark, path, header_row, opts)
    if fmt == "json":
        reader = spark.read.options(**opts).option("primitivesAsString", True)
        df = reader.schema(_text_schema(columns)).json(path) if columns else reader.json(path)
    elif fmt == "parquet":
        df = spark.read.options(**opts).parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def _text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def _scan_titled_csv(spark: SparkSession, path: str, header_row: int, opts: dict) -> DataFrame:
    sep = opts.get("sep", opts.get("delimiter", ","))
    lines = [r[0] for r in spark.read.text(path).limit(header_row + 1).collect()]
    head = [next(csv.reader([ln], delimiter=sep)) if ln.strip() else [] for ln in lines]
    keys = {fold_header(h) for h, c, _ in COLUMN_MAP if c in KEY_COLUMNS}
    idx = next((i for i, r in enumerate(head) if any(fold_header(v) in keys for v in r)), len(head) - 1)
    names = [v if v else f"_c{i}" for i, v in enumerate(head[idx])]
    cells = [f"_c{i}" for i in range(len(names))]
    raw = spark.read.options(**opts).schema(_text_schema(cells)).option("header", False).csv(path)

    def same(row: list[str]):
        values = (row + [None] * len(cells))[:len(cells)]
        return reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v or None)) for c, v in zip(cells, values)])

    title = reduce(Column.__or__, [same(r) for r in head[:idx + 1] if r], F.lit(False))
    other = F.exists(F.array(*cells), lambda c: _folded(c).isin(*keys))
    wrong = F.raise_error(F.lit(f"a header differs from {names}")).cast("boolean")
    return raw.filter(F.when(title, False).when(F.coalesce(other, F.lit(False)), wrong).otherwise(True)).toDF(*names)


def _folded(c: Column) -> Column:
    """``schema.fold_header`` of short text, for Latin letters; longer text is no header."""
    plain = {ch: unicodedata.normalize("NFKD", ch)[0] for ch in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", ch)[0].isascii()}
    text = F.translate(c, "".join(plain), "".join(plain.values()))
    return F.when(F.octet_length(c) <= 100, F.regexp_replace(F.lower(text), "[^a-z0-9]", ""))


def scan_source(spark: SparkSession, path: str, source: str, fmt: str = "csv",
                header_row: int | None = None, options: dict | None = None) -> DataFrame:
    """``scan_shipments`` with the source's default header row (national and
    export extracts carry two title lines, import none)."""
    hr = DEFAULT_HEADER_ROW.get(source, 0) if header_row is None else header_row
    return scan_shipments(spark, path, fmt, hr, options)


def header_lookup(columns) -> dict[str, str]:
    """Clean name → the actual column whose header folds to the same letters and digits."""
    clean = {fold_header(header): name for header, name, _ in COLUMN_MAP}
    return {clean[fold_header(c)]: c for c in columns if fold_header(c) in clean}


def map_headers(df: DataFrame) -> DataFrame:
    """Rename to the 33 clean names; an absent optional column becomes NULL,
    an absent key column raises ``MissingKeyColumn``."""
    actual = header_lookup(df.columns)
    for header, name, _ in COLUMN_MAP:
        if name in KEY_COLUMNS and name not in actual:
            raise MissingKeyColumn(f"key column {header!r} not found")
    text = lambda name: F.col(f"`{actual[name]}`") if name in actual else F.lit(None)
    return df.select([text(name).cast("string").alias(name) for _, name, _ in COLUMN_MAP])


def _by_steps(c: Column, *steps) -> Column:
    """The column after all steps, each a function of what the one before leaves. A step is a lambda over an
    array of the one value: what it reads is made once, however often it names it."""
    value = F.array(c)
    for step in steps:
        value = F.transform(value, step)
    return F.get(value, F.lit(0))


def _convert(name: str, kind: str) -> Column:
    """Conversion of one already-stripped text column."""
    s = F.col(name)
    if name in EDI_VERBATIM_COLUMNS:
        return clean_text(s, VERBATIM_BLANK_TOKENS)
    if name in ("crbt_amount", "revenue_ca"):
        return F.when(s.isNotNull(), _by_steps(s, parse_float)).try_cast("decimal(18,3)")
    if kind == "float":
        return F.when(s.isNotNull(), _by_steps(s, parse_float))
    if kind == "int":
        return F.bround(F.when(s.isNotNull(), _by_steps(s, parse_float)), 0).try_cast("int")
    if kind == "datetime":  # read together with its stripping
        return s
    return clean_text(s)


def clean_shipments(df: DataFrame) -> DataFrame:
    """Typed projection of the mapped columns + ``is_delivered`` / ``is_crbt``;
    month/year outside 1–12 / 1900–9999 become NULL; rows without a key are dropped.

    One projection strips each text column once and reads the dates, a second converts the
    stripped text; Catalyst keeps them apart, as the second reads the first more than once.
    Dates and numbers go through lambdas, for which Spark generates no code, so neither
    projection becomes part of one generated method: with 33 columns it would be larger than
    what the JVM compiles and run several times slower. Spark generates the other columns'
    code in small methods then, whatever ``spark.sql.codegen.hugeMethodLimit`` is.
    """
    mapped = {n for _, n, _ in COLUMN_MAP}
    rest = [c for c in df.columns if c not in mapped]
    date = lambda c: F.when(c.isNotNull(), _by_steps(c, strip_ws, day_hours, canonical_date).try_cast("timestamp_ntz"))
    is_date = lambda n, k: k == "datetime" and n not in EDI_VERBATIM_COLUMNS
    out = df.select([(date(F.col(n).cast("string")) if is_date(n, k) else strip_ws(n)).alias(n) for _, n, k in COLUMN_MAP] + rest)
    out = out.select([_convert(n, k).alias(n) for _, n, k in COLUMN_MAP] + rest)
    out = (out.withColumn("deposit_month", valid_month("deposit_month"))
           .withColumn("deposit_year", valid_year("deposit_year"))
           .withColumn("is_delivered", is_delivered("last_event"))
           .withColumn("is_crbt", is_crbt("shipment_type", "crbt_amount")))
    return out.filter(F.col("mailitm_fid").isNotNull())


def stamp_batch(df: DataFrame, batch_id: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    bid = batch_id or uuid.uuid4().hex[:12]
    ts = F.lit(now).cast("timestamp_ntz")
    return (df.withColumn("import_batch", F.lit(bid)).withColumn("created_at", ts)
            .withColumn("updated_at", ts))


def reload_table(df: DataFrame, path: str, fmt: str = "parquet", sources=(), batch_id: str | None = None, audit=None) -> list[str]:
    """Replace the content of the sources present in ``df`` and of those named in ``sources``; returns them.

    The rows go to version folders of their own and take effect, with the audit
    records that ``audit()`` gives once they're written, in one commit
    (``commits``): a load that stops anywhere leaves the table as it was, and a
    repeated one doesn't double a row. Other sources stay untouched; a named
    source without a row in ``df`` ends up empty.
    """
    spark = df.sparkSession
    base = commits.manifest(spark, path)
    version = commits.stage(df, path, fmt, batch_id or uuid.uuid4().hex[:12])
    present = commits.staged_sources(spark, path, version)
    names = dict.fromkeys([*sources, *present])
    commits.commit(spark, path, base, {s: version if s in present else None for s in names}, df.schema.json(), audit() if audit else [])
    return list(names)


def load_source(spark: SparkSession, raw: DataFrame, source: str, path: str,
                batch_id: str | None = None) -> dict:
    """Map, clean, stamp and write one source; return its audit record, which the table's commit carries too.

    ``rows_read`` and ``rows_inserted`` are observed on the write itself, so
    the data is read once. A load without the key column counts what it read.
    """
    bid = batch_id or uuid.uuid4().hex[:12]
    try:
        mapped = map_headers(raw)
    except MissingKeyColumn as e:
        return _failed(spark, path, _audit(source, bid, raw.count(), 0, "failed", str(e)))
    obs_in, obs_out = Observation(f"read_{source}_{bid}"), Observation(f"kept_{source}_{bid}")
    counted = mapped.observe(obs_in, F.count(F.lit(1)).alias("n"))
    cleaned = clean_shipments(counted).observe(obs_out, F.count(F.lit(1)).alias("n"))
    out = stamp_batch(cleaned, bid).withColumn("source", F.lit(source))
    record = lambda: _audit(source, bid, obs_in.get["n"], obs_out.get["n"], "success", None)
    try:
        reload_table(out, path, sources=[source], batch_id=bid, audit=lambda: [record()])
    except Exception as e:  # noqa: BLE001 — a failed load is recorded, not raised
        return _failed(spark, path, _audit(source, bid, 0, 0, "failed", f"{type(e).__name__}: {e}"[:500]))
    return record()


def _failed(spark: SparkSession, path: str, record: dict) -> dict:
    """Commit the audit record of a load that changed nothing."""
    commits.commit(spark, path, commits.manifest(spark, path), {}, None, [record])
    return record


def _audit(source, bid, read, kept, status, message) -> dict:
    return {"source": source, "batch_id": bid, "rows_read": int(read), "rows_inserted": int(kept),
            "rows_updated": 0, "rows_skipped": int(read) - int(kept), "status": status, "message": message}


def import_audit(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Audit rows (one per load) as a DataFrame."""
    return spark.createDataFrame([tuple(r[k] for k in ("source", "batch_id", "rows_read", "rows_inserted",
                                                       "rows_updated", "rows_skipped", "status", "message"))
                                  for r in records], AUDIT_SCHEMA)


def append_audit(audit: DataFrame, path: str) -> None:
    """Put audit rows into the audit table at ``path``, one for each batch and source: a repeated load replaces its own."""
    (audit.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "source").parquet(path))


def import_all(spark: SparkSession, raws: dict[str, DataFrame], path: str,
               batch_id: str | None = None, audit_path: str | None = None) -> DataFrame:
    """Load every given source, best effort each; returns the audit rows, and
    appends them (failed loads too) to the audit table where its path is given."""
    audit = import_audit(spark, [load_source(spark, raws[s], s, path, batch_id) for s in raws])
    if audit_path:
        append_audit(audit, audit_path)
    return audit


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows in force of a table that ``reload_table`` wrote."""
    return commits.read(spark, path, fmt)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit rows that the table's own commits carry, one for each batch and source."""
    return commits.audit_log(spark, path)
