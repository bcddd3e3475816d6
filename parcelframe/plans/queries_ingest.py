"""Registered queries: ingest (scan, header map, cleaning, reload, audit) and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.cleaning import clean_str
from ..operators import report as rp
from ..sources import ingest as ing
from ..sources.fixtures import shipments
from ..sources.sinks import scratch_path, write_csv, write_region_reports


#: Ways in which the sheets spell a date; each row takes one.
DATE_STYLES = ["yyyy-MM-dd HH:mm:ss", "MMM d yyyy HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy", "yyyy/MM/dd", "d MMM yyyy",
               "yyyy-MM-dd HH:mm:ss.SSS", "MMM d yyyy hh:mma", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
#: Ways in which they leave a value out.
BLANKS = ["(vide)", "nan", "", " ", "NULL", "_", "NaT", "(blank)"]


def _pick(n: int):
    return F.pmod(F.xxhash64("mailitm_fid"), F.lit(n)).cast("int")


def _varied(date, styles):
    """The date in the style of its row (column ``_style``); the others aren't made."""
    out = F.when(F.col("_style") == 0, F.date_format(date, styles[0]))
    for k, style in enumerate(styles[1:], 1):
        out = out.when(F.col("_style") == k, F.date_format(date, style))
    return out


def _blank(text):
    return F.coalesce(text, F.element_at(F.array(*map(F.lit, BLANKS)), _pick(len(BLANKS)) + 1))


def raw_extract(spark: SparkSession, sf_dir: str, source: str | None = None,
                headers: dict[str, str] | None = None) -> DataFrame:
    """Stand-in raw extract: the shipment rows rendered as source-style text
    (French headers, decimal commas, text dates, blank tokens). It only
    shapes input; all parsing happens in ``ingest``."""
    s = shipments(spark, sf_dir)
    if source:
        s = s.filter(F.col("source") == source)
    s = s.withColumn("_style", _pick(len(DATE_STYLES)))

    def comma(c):
        return F.translate(F.col(c).cast("string"), ".", ",")

    none = F.lit(None).cast("string")
    cols = {
        "MAILITM_FID": F.col("mailitm_fid"), "poids": comma("weight_kg"),
        "Nom_exp": none, "Pre_exp": none, "Exp_adresse": none, "Exp_cité": none,
        "Exp_code_postale": none, "Exp_phone": none,
        "Pays origine": F.col("origin_country"), "Pays Destination": F.col("destination_country"),
        "CRBT": comma("crbt_amount"),
        "Date depot": _varied(F.col("deposit_date"), DATE_STYLES),
        "Mois_depot": F.col("deposit_month").cast("string"), "Annee_depot": F.col("deposit_year").cast("string"),
        "Bureau depot": F.col("depot_office"), "Region Depot": F.col("depot_region"),
        "Dernier E": F.col("last_event"),
        "Date dernier E": _varied(F.col("last_event_date"), DATE_STYLES[::-1]),
        "Bureau dernier E": F.col("last_event_office"), "Region dernier E": F.col("last_event_region"),
        "Bureau next": none, "Region Next": _blank(F.col("next_region")),
        "Intervalle en jours": _blank(F.col("interval_days").cast("string")),
        "EDI_Event": F.lit("X"), "EDI_Date": F.lit("X"), "EDI_Cause": F.lit("X"), "EDI_action": F.lit("X"),
        "date echec ou livraison": none, "sup à 2 kg jusquà 3 kg": none,
        "Pour chaque kg supp ou fractionnement de 1 kg": none,
        "CA": comma("revenue_ca"), "CRBT/ORD": F.col("shipment_type"), "intervalle liv EDI/dépôt": none,
    }
    headers = headers or {}
    return s.select([c.alias(headers.get(h, h)) for h, c in cols.items()])


CLEAN_COLS = ["mailitm_fid", "weight_kg", "crbt_amount", "deposit_date", "deposit_month", "deposit_year",
              "depot_office", "depot_region", "last_event", "last_event_date", "last_event_office",
              "last_event_region", "next_region", "interval_days", "edi_event", "revenue_ca",
              "shipment_type", "origin_country", "destination_country", "is_delivered", "is_crbt"]

CLEAN_SQL = (
    "SELECT mailitm_fid, weight_kg, crbt_amount, CAST(deposit_date AS TIMESTAMP) AS deposit_date, deposit_month, "
    "deposit_year, depot_office, depot_region, last_event, CAST(last_event_date AS TIMESTAMP) AS last_event_date, "
    "last_event_office, last_event_region, next_region, interval_days, 'X' AS edi_event, revenue_ca, "
    "shipment_type, origin_country, destination_country, is_delivered, is_crbt FROM national")


@register("clean_shipments", CLEAN_SQL)
def q_clean_shipments(spark, sf):
    """Raw text rows → header map → typed cleaning (round trip of the national rows)."""
    raw = raw_extract(spark, sf, "national")
    return ing.clean_shipments(ing.map_headers(raw)).select(CLEAN_COLS)


@register("scan_shipments", CLEAN_SQL)
def q_scan_shipments(spark, sf):
    """Write the raw extract as CSV, scan it back as all-string rows, then clean."""
    path = scratch_path(spark, "raw-national")
    write_csv(raw_extract(spark, sf, "national"), path)
    raw = ing.scan_shipments(spark, path, "csv", header_row=0)
    return ing.clean_shipments(ing.map_headers(raw)).select(CLEAN_COLS)


# Header spellings that differ in case, accents, spacing and punctuation.
_VARIANT_HEADERS = {"MAILITM_FID": "mailitm fid", "Region Depot": " REGION-DEPOT ", "Region Next": "région_next",
                    "Exp_cité": "EXP CITE"}


@register("map_headers",
          "SELECT mailitm_fid, depot_region, next_region, "
          "CAST(NULL AS VARCHAR) AS sender_city FROM national")
def q_map_headers(spark, sf):
    raw = raw_extract(spark, sf, "national", headers=_VARIANT_HEADERS)
    mapped = ing.map_headers(raw).select("mailitm_fid", "depot_region", "next_region", "sender_city")
    return mapped.withColumn("next_region", clean_str("next_region"))


@register("stamp_batch", "SELECT mailitm_fid, 'batch-0001' AS import_batch FROM national")
def q_stamp_batch(spark, sf):
    raw = raw_extract(spark, sf, "national")
    return ing.stamp_batch(ing.clean_shipments(ing.map_headers(raw)), "batch-0001") \
        .select("mailitm_fid", "import_batch")


def _load_all(spark, sf):
    path = scratch_path(spark, "shipments")
    raws = {s: raw_extract(spark, sf, s) for s in ing.SOURCES}
    audit = ing.import_all(spark, raws, path, batch_id="batch-0001")
    return path, audit


@register("reload_table",
          "SELECT source, CAST(count(*) AS BIGINT) AS row_count FROM shipments GROUP BY source")
def q_reload_table(spark, sf):
    """Load all three sources into one table partitioned by source; read it back."""
    path, _ = _load_all(spark, sf)
    return ing.read_table(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("row_count"))


@register("import_audit",
          "SELECT source, CAST(count(*) AS BIGINT) AS rows_read, CAST(count(*) AS BIGINT) AS rows_inserted, "
          "CAST(0 AS BIGINT) AS rows_updated, CAST(0 AS BIGINT) AS rows_skipped, 'success' AS status "
          "FROM shipments GROUP BY source")
def q_import_audit(spark, sf):
    path = scratch_path(spark, "audit")
    for s in ing.SOURCES:  # one load after the other, each appending its row
        ing.import_all(spark, {s: raw_extract(spark, sf, s)}, scratch_path(spark, "shipments"), "batch-0001", path)
    return spark.read.parquet(path).select("source", "rows_read", "rows_inserted", "rows_updated", "rows_skipped", "status")


@register("audit_log",
          "SELECT source, 'batch-0001' AS batch_id, CAST(count(*) AS BIGINT) AS rows_read, CAST(count(*) AS BIGINT) AS rows_inserted, 'success' AS status "
          "FROM shipments GROUP BY source")
def q_audit_log(spark, sf):
    """The audit that the table's commits carry, after every load was repeated once: still a row for each source."""
    path = scratch_path(spark, "shipments")
    for _ in range(2):
        ing.import_all(spark, {s: raw_extract(spark, sf, s) for s in ing.SOURCES}, path, "batch-0001")
    return ing.audit_log(spark, path).select("source", "batch_id", "rows_read", "rows_inserted", "status")


@register("import_all",
          "SELECT source, 'success' AS status FROM shipments GROUP BY source "
          "UNION ALL SELECT 'broken' AS source, 'failed' AS status")
def q_import_all(spark, sf):
    """Best effort per source: a source without its key column is recorded as failed."""
    path = scratch_path(spark, "shipments")
    raws = {s: raw_extract(spark, sf, s) for s in ing.SOURCES}
    raws["broken"] = raw_extract(spark, sf, "import").drop("MAILITM_FID")
    return ing.import_all(spark, raws, path).select("source", "status")


@register("write_region_reports",
          "SELECT region, CASE WHEN grouping(office) = 1 THEN 'TOTAL' ELSE office END AS office, "
          "CAST(count(*) AS BIGINT) AS nb_ids FROM (SELECT *, trim(depot_region) AS region, trim(depot_office) "
          "AS office FROM national WHERE coalesce(trim(depot_office), '') <> '') "
          "GROUP BY GROUPING SETS ((region, office), (region))")
def q_write_region_reports(spark, sf):
    """All regions' depot tables written in one job, partitioned by region; read back."""
    from ..sources.fixtures import national
    path = scratch_path(spark, "reports")
    out = write_region_reports({"depot_table": rp.depot_table(national(spark, sf))}, path)
    back = spark.read.json(out["depot_table"])
    return back.select("region", "office", F.col("nb_ids").cast("bigint").alias("nb_ids"))


@register("write_csv",
          "SELECT CAST(deposit_date AS VARCHAR) AS ds, CAST(sum(weight_kg) AS VARCHAR) AS poids, "
          "CAST(count(*) AS VARCHAR) AS nb_envois FROM national GROUP BY deposit_date")
def q_write_csv(spark, sf):
    """Daily national totals written as CSV with header and read back (as text)."""
    from ..sources.fixtures import national
    daily = (national(spark, sf).groupBy(F.col("deposit_date").alias("ds"))
             .agg(F.sum("weight_kg").alias("poids"), F.count(F.lit(1)).alias("nb_envois")))
    path = scratch_path(spark, "daily-csv")
    write_csv(daily, path)
    return spark.read.option("header", True).csv(path)
