"""Registered queries: regional report tables, KPI scopes, drills, sliders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.formatting import fr_thousands
from ..operators import drills as dr
from ..operators import report as rp
from ..operators import windows as wn
from ..sources.fixtures import by_source, derived_once, derived_path, national, shipments

CRBT_SQL = "coalesce(upper(trim(shipment_type)) = 'CRBT', false)"
DELIV_SQL = "coalesce(lower(trim(last_event)) LIKE 'envoi liv%', false)"
EVENTS = ["Envoi Livré", "Recevoir envoi", "Tenir"]  # event vocabulary of the test tables (oracle side)


def _scoped_sql(src: str, region_col: str, office_col: str, extra: str = "") -> str:
    return (f"(SELECT *, trim({region_col}) AS region, trim({office_col}) AS office FROM {src} "
            f"WHERE coalesce(trim({office_col}), '') <> '' {extra})")


def _cat_sql(col: str, cats: list[str]) -> str:
    c = f"lower({col})"
    cat = (f"CASE WHEN {c} LIKE '%agence%' THEN 'agences' WHEN {c} LIKE '%centre%' OR {c} LIKE '%cdc%' "
           f"THEN 'centres' ELSE 'bureaux' END")
    return f"AND {cat} IN ({', '.join(repr(x) for x in cats)})"


# ── KPI scopes ────────────────────────────────────────────────────────────────

_REPORT_KPI_COLS = (
    f"CAST(count(*) FILTER (WHERE {DELIV_SQL}) AS BIGINT) AS livres, CAST(count(*) AS BIGINT) AS total, "
    f"round_even(100.0 * CAST(count(*) FILTER (WHERE {DELIV_SQL}) AS DOUBLE) / nullif(count(*), 0), 1) AS taux, "
    "round_even(avg(CAST(interval_days AS DOUBLE)), 1) AS avg_intervalle, "
    "CAST(round(coalesce(sum(revenue_ca), 0), 2) AS DECIMAL(38,2)) AS total_ca, "
    f"CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt")


@register("report_kpis", f"SELECT {_REPORT_KPI_COLS} FROM national")
def q_report_kpis(spark, sf):
    return rp.report_kpis(national(spark, sf))


@register("report_kpis_by_region",
          f"SELECT trim(depot_region) AS region, {_REPORT_KPI_COLS} FROM national GROUP BY trim(depot_region)")
def q_report_kpis_by_region(spark, sf):
    return rp.report_kpis(national(spark, sf), by_region=True)


@register("depot_kpis",
          "SELECT region, CASE WHEN g = 1 THEN 'global' ELSE source END AS scope, total, crbt, "
          "total - crbt AS ordinaire, ca, ca_crbt, ca_ordinaire FROM ("
          "SELECT region, source, grouping(source) AS g, CAST(count(*) AS BIGINT) AS total, "
          f"CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt, "
          "CAST(round(sum(coalesce(revenue_ca, 0)), 2) AS DECIMAL(38,2)) AS ca, "
          f"CAST(round(sum(CASE WHEN {CRBT_SQL} THEN coalesce(revenue_ca, 0) ELSE 0 END), 2) AS DECIMAL(38,2)) AS ca_crbt, "
          f"CAST(round(sum(CASE WHEN NOT {CRBT_SQL} THEN coalesce(revenue_ca, 0) ELSE 0 END), 2) AS DECIMAL(38,2)) "
          "AS ca_ordinaire FROM (SELECT *, trim(depot_region) AS region FROM shipments "
          "WHERE source IN ('national', 'export')) GROUP BY GROUPING SETS ((region, source), (region)))")
def q_depot_kpis(spark, sf):
    return rp.depot_kpis(shipments(spark, sf))


@register("livraison_kpis",
          "SELECT region, CASE WHEN g = 1 THEN 'global' ELSE source END AS scope, total, crbt, "
          "total - crbt AS ordinaire, ca, taux, CASE WHEN g = 1 THEN NULL ELSE av END AS avg_intervalle FROM ("
          "SELECT region, source, grouping(source) AS g, CAST(count(*) AS BIGINT) AS total, "
          f"CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt, "
          "CAST(round(coalesce(sum(revenue_ca), 0), 2) AS DECIMAL(38,2)) AS ca, "
          f"round_even(100.0 * CAST(count(*) FILTER (WHERE {DELIV_SQL}) AS DOUBLE) / nullif(count(*), 0), 1) AS taux, "
          "round_even(avg(CAST(interval_days AS DOUBLE)), 1) AS av "
          "FROM (SELECT *, trim(last_event_region) AS region FROM shipments WHERE source IN ('national', 'import')) "
          "GROUP BY GROUPING SETS ((region, source), (region)))")
def q_livraison_kpis(spark, sf):
    return rp.livraison_kpis(shipments(spark, sf))


# ── Tables ────────────────────────────────────────────────────────────────────

def _depot_table_sql(src: str, extra: str = "") -> str:
    return (
        "SELECT region, CASE WHEN grouping(office) = 1 THEN 'TOTAL' ELSE office END AS office, "
        "grouping(office) = 1 AS is_total, "
        f"CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt, "
        "CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS ca, coalesce(sum(weight_kg), 0.0) AS poids, "
        f"CAST(count(*) AS BIGINT) AS nb_ids FROM {_scoped_sql(src, 'depot_region', 'depot_office', extra)} "
        "GROUP BY GROUPING SETS ((region, office), (region))")


@register("depot_table", _depot_table_sql("national"))
def q_depot_table(spark, sf):
    return rp.depot_table(national(spark, sf))


@register("depot_table_region",
          _depot_table_sql("national", "AND trim(depot_region) = 'ASIA' " + _cat_sql("trim(depot_office)",
                                                                                  ["agences", "bureaux"])))
def q_depot_table_region(spark, sf):
    return rp.depot_table(national(spark, sf), "ASIA", ["agences", "bureaux"])


@register("depot_table_export", _depot_table_sql("(SELECT * FROM shipments WHERE source = 'export')"))
def q_depot_table_export(spark, sf):
    return rp.depot_table(by_source(spark, sf, "export"))


@register("depot_table_window",
          _depot_table_sql("national", "AND (deposit_date IS NULL OR deposit_date BETWEEN DATE '1996-03-01' "
                           "AND DATE '1998-12-31')"))
def q_depot_table_window(spark, sf):
    """A date range of the depot table, from sums by day that serve every range."""
    return wn.depot_window(_prefixes(spark, sf, "depot"), "1996-03-01", "1998-12-31")


def _prefixes(spark, sf, which: str):
    """The sums by day of the national rows, written once per session."""
    keys = {"depot": rp.DEPOT, "livraison": rp.LIVRAISON}[which]
    return derived_once(spark, sf, f"{which}-days", lambda path: wn.write_prefixes(national(spark, sf), keys, path))


YEARS = range(1992, 1999)


@register("depot_table_by_year",
          "SELECT CAST(y AS INTEGER) AS year, region, CASE WHEN grouping(office) = 1 THEN 'TOTAL' ELSE office END AS office, grouping(office) = 1 "
          f"AS is_total, CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt, CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS ca, "
          f"coalesce(sum(weight_kg), 0.0) AS poids, CAST(count(*) AS BIGINT) AS nb_ids FROM {_scoped_sql('national', 'depot_region', 'depot_office')} "
          f"JOIN (SELECT unnest(generate_series({YEARS[0]}, {YEARS[-1]})) AS y) ON deposit_date IS NULL OR year(deposit_date) = y "
          "GROUP BY GROUPING SETS ((y, region, office), (y, region))")
def q_depot_table_by_year(spark, sf):
    """The depot table of each year: as many date ranges, all from the same sums by day."""
    days = _prefixes(spark, sf, "depot")
    parts = [wn.depot_window(days, f"{y}-01-01", f"{y}-12-31").select(F.lit(y).alias("year"), "*") for y in YEARS]
    return reduce(DataFrame.unionByName, parts)


def _livraison_sql(src: str, extra: str = "") -> str:
    ev = ", ".join(f"CAST(count(*) FILTER (WHERE trim(last_event) = '{v}') AS BIGINT) AS \"{v}\"" for v in EVENTS)
    return (
        "SELECT region, CASE WHEN grouping(office) = 1 THEN 'TOTAL' ELSE office END AS office, "
        f"grouping(office) = 1 AS is_total, {ev}, CAST(count(*) AS BIGINT) AS total_ids, "
        f"CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt, "
        f"CAST(count(*) - count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS ordinaire, "
        "CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS ca, coalesce(sum(weight_kg), 0.0) AS poids "
        f"FROM {_scoped_sql(src, 'last_event_region', 'last_event_office', extra)} "
        "GROUP BY GROUPING SETS ((region, office), (region))")


@register("livraison_table", _livraison_sql("national"))
def q_livraison_table(spark, sf):
    """Delivery pivot for every region; event columns from the data's event list."""
    return rp.livraison_table(national(spark, sf))


@register("livraison_table_region",
          _livraison_sql("national", "AND trim(last_event_region) = 'EUROPE' "
                         + _cat_sql("trim(last_event_office)", ["bureaux", "centres"])))
def q_livraison_table_region(spark, sf):
    return rp.livraison_table(national(spark, sf), "EUROPE", ["bureaux", "centres"])


@register("livraison_table_import", _livraison_sql("(SELECT * FROM shipments WHERE source = 'import')"))
def q_livraison_table_import(spark, sf):
    return rp.livraison_table(by_source(spark, sf, "import"))


@register("livraison_table_window",
          _livraison_sql("national", "AND (last_event_date IS NULL OR last_event_date BETWEEN DATE '1996-03-01' "
                         "AND DATE '1998-12-31')"))
def q_livraison_table_window(spark, sf):
    return wn.livraison_window(_prefixes(spark, sf, "livraison"), "1996-03-01", "1998-12-31")


def _long_sql(src: str) -> str:
    return ("SELECT region, CASE WHEN grouping(office) = 1 THEN 'TOTAL' ELSE office END AS office, "
            "grouping(office) = 1 AS is_total, event, CAST(count(*) AS BIGINT) AS n FROM "
            f"(SELECT *, trim(last_event) AS event FROM {_scoped_sql(src, 'last_event_region', 'last_event_office')}"
            " WHERE coalesce(trim(last_event), '') <> '') GROUP BY GROUPING SETS ((region, office, event), (region, event))")


@register("livraison_table_long", _long_sql("national"))
def q_livraison_table_long(spark, sf):
    return rp.livraison_table_long(national(spark, sf))


@register("livraison_table_long_import", _long_sql("(SELECT * FROM shipments WHERE source = 'import')"))
def q_livraison_table_long_import(spark, sf):
    return rp.livraison_table_long(by_source(spark, sf, "import"))


@register("event_order",
          "SELECT CAST(row_number() OVER (ORDER BY lower(e) NOT LIKE 'envoi liv%', e) - 1 AS BIGINT) AS position, e FROM "
          "(SELECT DISTINCT trim(last_event) AS e FROM national WHERE coalesce(trim(last_event), '') <> '')")
def q_event_order(spark, sf):
    """Event list of the pivot, in display order (envoi liv… first, then A→Z)."""
    return rp.event_order(national(spark, sf)).select("position", F.col("event").alias("e"))


@register("column_totals",
          "SELECT trim(depot_region) AS region, "
          f"CAST(count(*) FILTER (WHERE {CRBT_SQL}) AS BIGINT) AS crbt, "
          "CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS ca, coalesce(sum(weight_kg), 0.0) AS poids, "
          "CAST(count(*) AS BIGINT) AS nb_ids FROM national WHERE coalesce(trim(depot_office), '') <> '' "
          "GROUP BY trim(depot_region)")
def q_column_totals(spark, sf):
    t = rp.depot_table(national(spark, sf))
    return rp.column_totals(t, ["crbt", "ca", "poids", "nb_ids"]).select(
        "region", F.col("crbt").cast("bigint").alias("crbt"), F.col("ca").cast("decimal(38,3)").alias("ca"),
        "poids", F.col("nb_ids").cast("bigint").alias("nb_ids"))


@register("fr_thousands_table",
          "SELECT region, office, CASE WHEN coalesce(CAST(ca AS DOUBLE), 0) = 0 THEN '' ELSE "
          "replace(format('{:,.0f}', round_even(CAST(ca AS DOUBLE), 0)), ',', ' ') END AS ca_txt FROM ("
          + _depot_table_sql("national") + ")")
def q_fr_thousands_table(spark, sf):
    t = rp.depot_table(national(spark, sf))
    return t.select("region", "office", fr_thousands("ca").alias("ca_txt"))


# ── Drills and sliders ───────────────────────────────────────────────────────

_ID = "trim(mailitm_fid)"


def _type_sql() -> str:
    u = "upper(trim(shipment_type))"
    return f"coalesce(concat(substr({u}, 1, 1), lower(substr({u}, 2))), '')"


def _txt_sql(c: str) -> str:
    return f"coalesce(trim(CAST({c} AS VARCHAR)), '')"


@register("depot_drill",
          f"SELECT region, office, subkey, {_ID} AS id, {_txt_sql('revenue_ca')} AS ca, {_type_sql()} AS type FROM "
          + _scoped_sql("national", "depot_region", "depot_office")
          + f" CROSS JOIN LATERAL (SELECT unnest(list_filter(['__all__', CASE WHEN {CRBT_SQL} THEN 'CRBT' END], "
          "lambda x: x IS NOT NULL)) AS subkey) WHERE coalesce(trim(mailitm_fid), '') <> ''")
def q_depot_drill(spark, sf):
    return rp.depot_drill(national(spark, sf))


@register("livraison_drill",
          f"SELECT region, office, subkey, {_ID} AS id, coalesce(trim(last_event), '') AS event, "
          f"{_type_sql()} AS type, {_txt_sql('revenue_ca')} AS ca, {_txt_sql('interval_days')} AS interval, "
          f"{_txt_sql('weight_kg')} AS poids FROM "
          + _scoped_sql("national", "last_event_region", "last_event_office")
          + " CROSS JOIN LATERAL (SELECT unnest(list_filter(['__all__', "
          "CASE WHEN coalesce(trim(last_event), '') <> '' THEN trim(last_event) END, "
          f"CASE WHEN {CRBT_SQL} THEN 'CRBT' ELSE 'Ordinaire' END], lambda x: x IS NOT NULL)) AS subkey) "
          "WHERE coalesce(trim(mailitm_fid), '') <> ''")
def q_livraison_drill(spark, sf):
    return rp.livraison_drill(national(spark, sf))


@register("export_drill",
          f"SELECT region, office, subkey, {_ID} AS id, {_txt_sql('weight_kg')} AS poids, "
          f"{_txt_sql('revenue_ca')} AS ca FROM "
          + _scoped_sql("(SELECT * FROM shipments WHERE source = 'export')", "depot_region", "depot_office")
          + f" CROSS JOIN LATERAL (SELECT unnest(['__all__', CASE WHEN {CRBT_SQL} THEN 'CRBT' ELSE 'Ordinaire' END]) "
          "AS subkey) WHERE coalesce(trim(mailitm_fid), '') <> ''")
def q_export_drill(spark, sf):
    return rp.export_drill(by_source(spark, sf, "export"))


@register("import_drill",
          f"SELECT region, office, subkey, {_ID} AS id, coalesce(trim(last_event), '') AS event, "
          f"{_txt_sql('interval_days')} AS interval, {_txt_sql('weight_kg')} AS poids FROM "
          + _scoped_sql("(SELECT * FROM shipments WHERE source = 'import')", "last_event_region", "last_event_office")
          + " CROSS JOIN LATERAL (SELECT unnest(list_filter(['__all__', "
          "CASE WHEN coalesce(trim(last_event), '') <> '' THEN trim(last_event) END], lambda x: x IS NOT NULL)) AS subkey) "
          "WHERE coalesce(trim(mailitm_fid), '') <> ''")
def q_import_drill(spark, sf):
    return rp.import_drill(by_source(spark, sf, "import"))


@register("drill_lookup",
          f"SELECT region, office, subkey, {_ID} AS id, {_txt_sql('revenue_ca')} AS ca, {_type_sql()} AS type FROM "
          + _scoped_sql("national", "depot_region", "depot_office")
          + f" CROSS JOIN LATERAL (SELECT 'CRBT' AS subkey) WHERE {CRBT_SQL} AND trim(depot_office) = 'Agence NATION_1' "
          "AND coalesce(trim(mailitm_fid), '') <> ''")
def q_drill_lookup(spark, sf):
    """One cell of the drill table, from the files of the clustered table that reach it."""
    return dr.lookup(spark, _drill_table(spark, sf), "Agence NATION_1", "CRBT").select("region", "office", "subkey", "id", "ca", "type")


def _drill_table(spark, sf) -> str:
    """The clustered drill table of the national rows, written once per session."""
    return derived_path(spark, sf, "depot-drill", lambda path: dr.write_drill(rp.depot_drill(national(spark, sf)), path, file_rows=20_000))


@register("drill_cells",
          "SELECT region, office, subkey, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT id) AS BIGINT) AS ids FROM (SELECT trim(depot_region) AS region, "
          f"trim(depot_office) AS office, {_ID} AS id, unnest(list_filter(['__all__', CASE WHEN {CRBT_SQL} THEN 'CRBT' END], lambda x: x IS NOT NULL)) AS subkey "
          "FROM national WHERE coalesce(trim(depot_office), '') <> '' AND coalesce(trim(mailitm_fid), '') <> '') GROUP BY ALL")
def q_drill_cells(spark, sf):
    """Entries and different ids of every cell, over the pages of the clustered table."""
    pages = dr.pages(spark, _drill_table(spark, sf), page_size=500)
    entry = pages.select("region", "office", "subkey", F.explode("entries").alias("e"))
    return entry.groupBy("region", "office", "subkey").agg(F.sum("e.times").alias("entries"), F.count_distinct("e.id").alias("ids"))


@register("drill_json",
          "SELECT region, office, subkey, CAST(to_json({'id': trim(mailitm_fid), 'ca': coalesce(trim(CAST(revenue_ca AS VARCHAR)), ''), "
          f"'type': {_type_sql()}}}) AS VARCHAR) AS json FROM "
          + _scoped_sql("national", "depot_region", "depot_office")
          + f" CROSS JOIN LATERAL (SELECT unnest(list_filter(['__all__', CASE WHEN {CRBT_SQL} THEN 'CRBT' END], "
          "lambda x: x IS NOT NULL)) AS subkey) WHERE coalesce(trim(mailitm_fid), '') <> ''")
def q_drill_json(spark, sf):
    return rp.drill_json(rp.depot_drill(national(spark, sf)))


@register("drill_pages")
def q_drill_pages(spark, sf):
    """Nested drill payload in bounded pages (hash-spread; rows-only check)."""
    return rp.drill_pages(rp.livraison_drill(national(spark, sf), long=False), page_size=500, subkeys=rp.livraison_subkeys())


@register("drill_page_entries",
          "SELECT region, office, subkey, CAST(count(*) AS BIGINT) AS entries FROM (SELECT trim(last_event_region) AS region, "
          "trim(last_event_office) AS office, unnest(list_filter(['__all__', CASE WHEN coalesce(trim(last_event), '') <> '' THEN trim(last_event) END, "
          f"CASE WHEN {CRBT_SQL} THEN 'CRBT' ELSE 'Ordinaire' END], lambda x: x IS NOT NULL)) AS subkey FROM national "
          "WHERE coalesce(trim(last_event_office), '') <> '' AND coalesce(trim(mailitm_fid), '') <> '') GROUP BY ALL")
def q_drill_page_entries(spark, sf):
    """Rows behind each cell, counted over its pages."""
    pages = rp.drill_pages(rp.livraison_drill(national(spark, sf), long=False), page_size=500, subkeys=rp.livraison_subkeys())
    times = F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["times"])
    return pages.groupBy("region", "office", "subkey").agg(F.sum(times).alias("entries"))


@register("depot_slider",
          "SELECT region, office AS b, coalesce(strftime(deposit_date, '%Y-%m-%d'), '') AS d, "
          "coalesce(upper(trim(shipment_type)), '') AS t, round_even(coalesce(CAST(revenue_ca AS DOUBLE), 0), 2) AS c, "
          "round_even(coalesce(CAST(weight_kg AS DOUBLE), 0), 2) AS p FROM "
          + _scoped_sql("national", "depot_region", "depot_office"))
def q_depot_slider(spark, sf):
    return rp.depot_slider(national(spark, sf))


@register("livraison_slider",
          "SELECT region, office AS b, coalesce(strftime(last_event_date, '%Y-%m-%d'), '') AS d, "
          "coalesce(trim(last_event), '') AS e, coalesce(upper(trim(shipment_type)), '') AS t, "
          "round_even(coalesce(CAST(revenue_ca AS DOUBLE), 0), 2) AS c, "
          "round_even(coalesce(CAST(weight_kg AS DOUBLE), 0), 2) AS p FROM "
          + _scoped_sql("national", "last_event_region", "last_event_office"))
def q_livraison_slider(spark, sf):
    return rp.livraison_slider(national(spark, sf))
