"""Regional report: scoped KPIs, depot and delivery tables, drills, sliders.

The source system rebuilt every table once per region, looping over
offices. Here each table is one aggregation at its finest grain, whose small
result gives the TOTAL rows by GROUPING SETS, so every region's report comes
out of a single pass over the data and no row is processed twice.
``region=None`` means every region; a region name scopes the input first.

All operators take cleaned text (as ingest leaves it), so region filters reach
the scan; pass raw rows through ``stripped`` before.

Depot tables key on the depot office/region; delivery ("livraison") tables
key on the last-event office/region. Tables come unordered; sort where they
are shown.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import bureau_category, parse_amount_or_zero, strip_ws
from ..functions.temporal import date_label
from .aggregates import MONEY, MONEY2, count_if
from ..session import materialize
from .filters import filter_date_range, filter_next_region
from .order import with_position

TOTAL = "TOTAL"
DEPOT = {"region": "depot_region", "office": "depot_office", "date": "deposit_date"}
LIVRAISON = {"region": "last_event_region", "office": "last_event_office", "date": "last_event_date"}


TEXT_COLUMNS = ("mailitm_fid", "depot_region", "depot_office", "last_event", "last_event_region", "last_event_office", "shipment_type")


def stripped(df: DataFrame) -> DataFrame:
    """Raw rows with the text columns of the report stripped once."""
    return df.withColumns({c: strip_ws(c) for c in TEXT_COLUMNS if c in df.columns})


def _in_region(df: DataFrame, column: str, region: str | None) -> DataFrame:
    out = df if not region else df.filter(F.col(column) == F.lit(region))
    return out.withColumn("region", F.col(column))


def _scope(df: DataFrame, keys: dict, region: str | None, categories=None) -> DataFrame:
    """Region/office keys, blank offices dropped, optional region and
    category (first-match office category) filters."""
    out = _in_region(df.filter(F.col(keys["office"]) != ""), keys["region"], region).withColumn("office", F.col(keys["office"]))
    if categories:
        out = out.filter(bureau_category(F.col("office")).isin(*categories))
    return out


def _delivered():
    return F.coalesce(F.lower("last_event").startswith("envoi liv"), F.lit(False))


def _with_total(grouped: DataFrame) -> DataFrame:
    """Turn the grand-total row of a (region, office) grouping set into TOTAL."""
    is_total = F.col("_g_office") == 1
    return (grouped.withColumn("is_total", is_total)
            .withColumn("office", F.when(is_total, F.lit(TOTAL)).otherwise(F.col("office")))
            .drop("_g_office"))


# ── KPI blocks ────────────────────────────────────────────────────────────────

def report_kpis(df: DataFrame, region: str | None = None, by_region: bool = False) -> DataFrame:
    """Top KPI block: delivered (event prefix), total, rate (1 dp), mean of every
    non-null interval (1 dp), revenue (2 dp), CRBT rows."""
    base = _in_region(df, "depot_region", region)
    delivered = count_if(_delivered())
    total = F.count(F.lit(1))
    cols = [
        delivered.alias("livres"), total.alias("total"),
        F.bround(F.try_divide(delivered * F.lit(100.0), total), 1).alias("taux"),
        F.bround(F.avg(F.col("interval_days").cast("double")), 1).alias("avg_intervalle"),
        F.round(F.coalesce(F.sum("revenue_ca"), F.lit(0)), 2).cast(MONEY2).alias("total_ca"),
        count_if(_is_crbt()).alias("crbt"),
    ]
    return base.groupBy("region").agg(*cols) if by_region else base.agg(*cols)


def _is_crbt():
    return F.coalesce(F.upper("shipment_type") == "CRBT", F.lit(False))


def _scopes(fine: DataFrame, sums) -> DataFrame:
    """Per region and source, and over sources, from rows that hold sums per (region, source)."""
    g = fine.groupingSets([["region", "source"], ["region"]], "region", "source").agg(
        *[F.sum(c).alias(c) for c in sums], F.grouping("source").alias("_g"))
    return g.withColumn("scope", F.when(F.col("_g") == 1, "global").otherwise(F.col("source")))


def depot_kpis(df: DataFrame, region: str | None = None) -> DataFrame:
    """National / export / global depot KPIs per depot region.

    ``df`` holds the national and export rows with a ``source`` column; the
    global row sums the two.
    """
    base = _in_region(df.filter(F.col("source").isin("national", "export")), "depot_region", region)
    ca = F.coalesce(F.col("revenue_ca"), F.lit(0))
    fine = base.groupBy("region", "source").agg(
        F.count(F.lit(1)).alias("total"), count_if(_is_crbt()).alias("crbt"), F.sum(ca).alias("ca"),
        F.sum(F.when(_is_crbt(), ca).otherwise(F.lit(0))).alias("ca_crbt"))
    g = _scopes(fine, ["total", "crbt", "ca", "ca_crbt"])
    money = lambda c: F.round(c, 2).cast(MONEY2)
    return g.select("region", "scope", "total", "crbt", (F.col("total") - F.col("crbt")).alias("ordinaire"), money(F.col("ca")).alias("ca"),
                    money(F.col("ca_crbt")).alias("ca_crbt"), money(F.col("ca") - F.col("ca_crbt")).alias("ca_ordinaire"))


def livraison_kpis(df: DataFrame, region: str | None = None) -> DataFrame:
    """National / import / global delivery KPIs per last-event region.

    Rate = round(100·delivered/total, 1) from exact counts (also for the global
    row); the global mean interval is NULL as in the source report.
    """
    base = _in_region(df.filter(F.col("source").isin("national", "import")), "last_event_region", region)
    interval = F.col("interval_days").cast("double")
    fine = base.groupBy("region", "source").agg(
        F.count(F.lit(1)).alias("total"), count_if(_is_crbt()).alias("crbt"), F.coalesce(F.sum("revenue_ca"), F.lit(0)).alias("ca"),
        count_if(_delivered()).alias("delivered"), F.sum(interval).alias("days"), F.count(interval).alias("timed"))
    g = _scopes(fine, ["total", "crbt", "ca", "delivered", "days", "timed"])
    return g.select(
        "region", "scope", "total", "crbt", (F.col("total") - F.col("crbt")).alias("ordinaire"),
        F.round("ca", 2).cast(MONEY2).alias("ca"),
        F.bround(F.try_divide(F.col("delivered") * F.lit(100.0), F.col("total")), 1).alias("taux"),
        F.when(F.col("_g") == 0, F.bround(F.try_divide(F.col("days"), F.col("timed")), 1)).alias("avg_intervalle"))


# ── Tables ────────────────────────────────────────────────────────────────────

def _totalled(fine: DataFrame, aggs) -> DataFrame:
    """Per (region, office) and a TOTAL row per region, from rows at a finer grain."""
    return _with_total(fine.groupingSets([["region", "office"], ["region"]], "region", "office").agg(
        *aggs, F.grouping("office").alias("_g_office")))


def depot_table(df: DataFrame, region: str | None = None, categories=None) -> DataFrame:
    """Per depot office: CRBT rows, revenue, weight, rows; plus a TOTAL row per region."""
    fine = _scope(df, DEPOT, region, categories).groupBy("region", "office").agg(
        count_if(_is_crbt()).alias("crbt"), F.sum("revenue_ca").alias("ca"), F.sum("weight_kg").alias("poids"),
        F.count(F.lit(1)).alias("nb_ids"))
    return depot_totals(fine)


def depot_totals(fine: DataFrame) -> DataFrame:
    """The depot table from sums (crbt, ca, poids, nb_ids) at (region, office) grain or finer."""
    g = _totalled(fine, [F.sum("crbt").alias("crbt"), F.coalesce(F.sum("ca"), F.lit(0)).cast(MONEY).alias("ca"),
                         F.coalesce(F.sum("poids"), F.lit(0.0)).alias("poids"), F.sum("nb_ids").alias("nb_ids")])
    return g.select("region", "office", "is_total", "crbt", "ca", "poids", "nb_ids")


def event_order(df: DataFrame, event_col: str = "last_event") -> DataFrame:
    """(position, event): distinct events, 'envoi liv…' first, then alphabetical."""
    events = df.select(F.col(event_col).alias("event")).where(F.col("event") != "").distinct()
    return with_position(events, [~F.lower("event").startswith("envoi liv"), "event"])


def event_values(df: DataFrame, event_col: str = "last_event") -> list[str]:
    """The pivot's value list, in display order: the names of a wide table's columns, however many."""
    ev = df.select(F.col(event_col).alias("e")).where(F.col("e") != "").distinct()
    return [r["e"] for r in ev.orderBy(~F.lower("e").startswith("envoi liv"), "e").collect()]


def livraison_table(df: DataFrame, region: str | None = None, categories=None,
                    events: list[str] | None = None) -> DataFrame:
    """Per last-event office: one count column per event, total, CRBT,
    ordinary, revenue, weight; plus a TOTAL row per region.

    The rows are read once: every measure is aggregated at
    (region, office, event) grain; ``delivery_pivot`` makes the table of those.
    ``livraison_table_long`` has the same counts without a column per event.
    """
    fine = (_scope(df, LIVRAISON, region, categories).withColumn("event", F.col("last_event"))
            .groupBy("region", "office", "event").agg(
        F.count(F.lit(1)).alias("n"), count_if(_is_crbt()).alias("n_crbt"),
        F.sum("revenue_ca").alias("ca_sum"), F.sum("weight_kg").alias("poids_sum")))
    return delivery_pivot(fine, events)


def delivery_pivot(fine: DataFrame, events: list[str] | None = None) -> DataFrame:
    """The delivery table from sums (n, n_crbt, ca_sum, poids_sum) at (region, office, event) grain.

    The sums are a small table that is written once. The event list (the names
    of the count columns, unless given) and the table itself, with the TOTAL row
    from GROUPING SETS, are then computed on it. The number of events has no
    limit but the schema's; ``livraison_table_long`` needs no column per event.
    """
    fine = materialize(fine)
    values = events if events is not None else event_values(fine, "event")
    total, crbt = F.sum("n"), F.sum("n_crbt")
    g = _totalled(fine, [
        *[F.sum(F.when(F.col("event") == F.lit(v), F.col("n")).otherwise(F.lit(0))).alias(v) for v in values],
        total.alias("total_ids"), crbt.alias("crbt"), (total - crbt).alias("ordinaire"),
        F.coalesce(F.sum("ca_sum"), F.lit(0)).cast(MONEY).alias("ca"),
        F.coalesce(F.sum("poids_sum"), F.lit(0.0)).alias("poids")])
    return g.select("region", "office", "is_total", *[F.col(f"`{v}`") for v in values],
                    "total_ids", "crbt", "ordinaire", "ca", "poids")


def livraison_table_long(df: DataFrame, region: str | None = None, categories=None) -> DataFrame:
    """Long form of the event pivot: (region, office, event, n) incl. TOTAL office."""
    base = _scope(df, LIVRAISON, region, categories).withColumn("event", F.col("last_event")).filter(F.col("event") != "")
    fine = base.groupBy("region", "office", "event").agg(F.count(F.lit(1)).alias("n"))
    g = fine.groupingSets([["region", "office", "event"], ["region", "event"]], "region", "office", "event") \
        .agg(F.sum("n").alias("n"), F.grouping("office").alias("_g_office"))
    return _with_total(g).select("region", "office", "is_total", "event", "n")


def depot_table_window(df: DataFrame, lo=None, hi=None, region=None, categories=None) -> DataFrame:
    """``depot_table`` over rows whose deposit date is missing or inside [lo, hi], from the rows themselves;
    ``windows.depot_window`` answers any number of ranges from sums by day."""
    return depot_table(filter_date_range(df, DEPOT["date"], lo, hi), region, categories)


def livraison_table_window(df: DataFrame, lo=None, hi=None, region=None, categories=None,
                           events=None) -> DataFrame:
    """``livraison_table`` over a date range, from the rows themselves (see ``windows.livraison_window``)."""
    return livraison_table(filter_date_range(df, LIVRAISON["date"], lo, hi), region, categories, events)


def column_totals(table: DataFrame, numeric_cols) -> DataFrame:
    """Column sums over the non-TOTAL rows, per region (must equal the TOTAL row)."""
    return (table.filter(~F.col("is_total")).groupBy("region")
            .agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in numeric_cols]))


# ── Drill-through (long form) ────────────────────────────────────────────────

def _entry_type(c) -> Column:
    """Type label as displayed: upper-cased then capitalised ('CRBT' → 'Crbt')."""
    s = F.upper(c)
    return F.coalesce(F.concat(F.substring(s, 1, 1), F.lower(F.substring(s, 2, 1 << 30))), F.lit(""))


def _txt(c) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _drill(base: DataFrame, subkeys: Column, fields: dict[str, Column], long: bool = True) -> DataFrame:
    """Entries are built once per row, then (if ``long``) repeated under each of the row's sub-keys."""
    entries = base.filter(F.col("mailitm_fid") != "").select(
        "region", "office", F.array_compact(subkeys).alias("_keys"), F.col("mailitm_fid").alias("id"),
        *[c.alias(n) for n, c in fields.items()])
    return entries.select("region", "office", F.explode("_keys").alias("subkey"), "id", *fields) if long else entries.drop("_keys")


def depot_drill(df: DataFrame, region=None, categories=None) -> DataFrame:
    """Per depot office: every entry under ``__all__`` and CRBT ones under ``CRBT``."""
    base = _scope(df, DEPOT, region, categories)
    return _drill(base, F.array(F.lit("__all__"), F.when(_is_crbt(), F.lit("CRBT"))),
                  {"ca": _txt("revenue_ca"), "type": _entry_type("shipment_type")})


def livraison_subkeys() -> list[Column]:
    """The sub-keys of a delivery entry (NULL: none), from its own fields: they tell the row's event and type."""
    return [F.lit("__all__"), F.when(F.col("event") != "", F.col("event")),
            F.when(F.col("type") == "Crbt", F.lit("CRBT")).otherwise(F.lit("Ordinaire"))]


def livraison_drill(df: DataFrame, region=None, categories=None, long: bool = True) -> DataFrame:
    """Per last-event office: ``__all__``, one key per event, CRBT or Ordinaire. Not ``long``: an entry
    stands once, without its sub-keys (``livraison_subkeys``)."""
    base = _scope(df, LIVRAISON, region, categories)
    keys = F.array(F.lit("__all__"), F.when(F.col("last_event") != "", F.col("last_event")),
                   F.when(_is_crbt(), F.lit("CRBT")).otherwise(F.lit("Ordinaire")))
    return _drill(base, keys, {"event": _txt("last_event"), "type": _entry_type("shipment_type"),
                               "ca": _txt("revenue_ca"), "interval": _txt("interval_days"),
                               "poids": _txt("weight_kg")}, long)


def export_drill(df: DataFrame, region=None, categories=None) -> DataFrame:
    """Export depot drill: ``__all__`` plus CRBT / Ordinaire (one rule: upper(type) = CRBT)."""
    base = _scope(df, DEPOT, region, categories)
    keys = F.array(F.lit("__all__"), F.when(_is_crbt(), F.lit("CRBT")).otherwise(F.lit("Ordinaire")))
    return _drill(base, keys, {"poids": _txt("weight_kg"), "ca": _txt("revenue_ca")})


def import_drill(df: DataFrame, region=None, categories=None) -> DataFrame:
    """Import delivery drill: ``__all__`` plus one key per event; repeated ids kept."""
    base = _scope(df, LIVRAISON, region, categories)
    keys = F.array(F.lit("__all__"), F.when(F.col("last_event") != "", F.col("last_event")))
    return _drill(base, keys, {"event": _txt("last_event"), "interval": _txt("interval_days"),
                               "poids": _txt("weight_kg")})


def drill_lookup(drill: DataFrame, office: str, subkey: str = "__all__") -> DataFrame:
    """Entries behind one table cell (a filter on the long form)."""
    return drill.filter((F.col("office") == F.lit(office)) & (F.col("subkey") == F.lit(subkey)))


#: Up to so many cells, their sizes are broadcast (some 10 MB).
CELLS_SENT = 50_000
#: Pages of an office that are dealt together, about; entries under their sub-keys that one task makes pages of, about.
SLICE_PAGES, PAGED_A_TASK = 100, 500_000


def drill_pages(drill: DataFrame, page_size: int = 1000, subkeys: Sequence[Column] | None = None) -> DataFrame:
    """Nested drill payload in bounded pages.

    Equal entries are first counted (each keeps its number as ``times``), so a
    page holds different entries only. A cell's number of pages follows from
    its number of entries, and entries are spread over pages by ranges of a hash:
    about ``page_size`` each, whatever the office's share of all rows.

    With ``subkeys``, an entry's sub-keys as columns over its own fields (NULL: none),
    ``drill`` holds each entry once; the pages are those of its long form. Entries are
    dealt by slices of their office's hash range. A page lies in one slice, so an entry
    goes once to each slice that has a page of it, nearly always one, and is repeated
    under its sub-keys only where the pages are made.
    """
    spark, place, keys = drill.sparkSession, ["region", "office"], ["region", "office", "subkey"]
    fields = [c for c in drill.columns if c not in keys]
    if subkeys is None:
        at = named = [F.col("subkey")]
        own, often = keys, [F.lit(1)]
    else:
        # an event may be called as another sub-key is: then the entry stands that often in the cell, which it enters once
        named, own = list(subkeys), place
        at = [reduce(lambda k, other: F.when(~other.eqNullSafe(named[i]), k), named[:i], named[i]) for i in range(len(named))]
        often = [reduce(lambda n, other: n + other.eqNullSafe(named[i]).cast("int"), named[i + 1:], F.lit(1)) for i in range(len(named))]
    counted = drill.groupBy(*own, *fields).agg(F.count(F.lit(1)).alias("times"))

    def under(rows: DataFrame, cells: Sequence[Column], *more: str) -> DataFrame:
        """The rows under each of their sub-keys, without the fields."""
        each = rows.select(*place, *more, F.explode(F.array(*cells)).alias("subkey"))
        return each if subkeys is None else each.filter("subkey IS NOT NULL")

    kinds = drill.select(*place, *[k.alias(f"_k{i}") for i, k in enumerate(at)])
    kinds = kinds.groupBy(*kinds.columns).agg(F.count(F.lit(1)).alias("_n"))
    cells, rows = under(kinds, [F.col(f"_k{i}") for i in range(len(at))], "_n").groupBy(*keys).agg(F.sum("_n").alias("_n")) \
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()

    # reads ``times``, so that both sides of the joins need the same shuffled entries and Spark makes them once
    held = under(counted, at, "times").groupBy(*keys).agg(F.count_if(F.col("times") > 0).alias("_n"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(page_size))).cast("long")
    slices = F.ceil(F.sum(pages).over(W.partitionBy(*place)) / F.lit(SLICE_PAGES)).cast("long")  # a row a cell
    sizes = held.select(*[F.col(k).alias(f"_{k}") for k in keys], pages.alias("_pages"), slices.alias("_slices"))
    if cells <= CELLS_SENT:  # otherwise all entries are shuffled by cell to meet their sizes
        sizes = F.broadcast(sizes)

    def page(n: Column) -> Column:
        """The one of n equal ranges that the upper half of the entry's hash lies in."""
        return F.shiftright(F.shiftrightunsigned(F.xxhash64(*fields), 32) * n, 32).cast("int")

    placed = counted
    for i, k in enumerate(at):
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place] + [k.eqNullSafe(F.col("_subkey"))]
        n, m = F.col("_pages"), F.col("_slices")
        where = F.when(n >= m, F.floor(page(n) * m / n)).otherwise(F.pmod(F.xxhash64(k, page(n)), m))
        placed = placed.join(sizes, same, "left").select(*placed.columns, n.alias(f"_n{i}"), where.cast("long").alias(f"_s{i}"))
    sent = placed.withColumn("_slice", F.explode(F.array_distinct(F.array(*[f"_s{i}" for i in range(len(at))])))).filter("_slice IS NOT NULL")
    sent = sent.select(*own, "_slice", *fields, "times", *[F.when(F.col(f"_s{i}") == F.col("_slice"), F.col(f"_n{i}")).alias(f"_n{i}") for i in range(len(at))])
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 16), -(-rows // PAGED_A_TASK))
    dealt = sent.sortWithinPartitions("_slice", *place).repartition(tasks, *place, "_slice")  # alike rows side by side take less when compressed

    each = F.array(*[F.struct(k.alias("subkey"), F.col(f"_n{i}").alias("n"), o.alias("often")) for i, (k, o) in enumerate(zip(at, often))])
    paged = dealt.select(*place, "_slice", *fields, "times", F.explode(each).alias("_c")).filter("_c.n IS NOT NULL") \
        .select(*place, "_slice", "_c.subkey", page(F.col("_c.n")).alias("page"), *fields, (F.col("times") * F.col("_c.often")).alias("times"))
    # by the page first: numbers sort faster than names
    return paged.groupBy("page", "_slice", *keys).agg(
        F.sort_array(F.collect_list(F.struct(*fields, "times"))).alias("entries")).select(*keys, "page", "entries")


def drill_json(drill: DataFrame) -> DataFrame:
    """One JSON document per drill entry (JSON lines, written in parallel)."""
    keys = ["region", "office", "subkey"]
    fields = [c for c in drill.columns if c not in keys]
    return drill.select(*keys, F.to_json(F.struct(*fields)).alias("json"))


# ── Sliders (narrow records for date re-filtering) ───────────────────────────

def depot_slider(df: DataFrame, region=None, categories=None) -> DataFrame:
    """{b, d, t, c, p}: office, date label, type, revenue (2 dp), weight (2 dp)."""
    base = _scope(df, DEPOT, region, categories)
    return base.select("region", F.col("office").alias("b"), date_label("deposit_date").alias("d"),
                       F.coalesce(F.upper("shipment_type"), F.lit("")).alias("t"),
                       parse_amount_or_zero("revenue_ca").alias("c"),
                       parse_amount_or_zero("weight_kg").alias("p"))


def livraison_slider(df: DataFrame, region=None, categories=None) -> DataFrame:
    """{b, d, e, t, c, p}: office, date label, event, type, revenue, weight (carried)."""
    base = _scope(df, LIVRAISON, region, categories)
    return base.select("region", F.col("office").alias("b"), date_label("last_event_date").alias("d"),
                       _txt("last_event").alias("e"),
                       F.coalesce(F.upper("shipment_type"), F.lit("")).alias("t"),
                       parse_amount_or_zero("revenue_ca").alias("c"),
                       parse_amount_or_zero("weight_kg").alias("p"))


# ── The whole report ─────────────────────────────────────────────────────────

def region_report(shipments: DataFrame, region: str | None = None, next_regions=None, cat_depot=None, cat_livraison=None,
                  include_depot: bool = True, include_livraison: bool = True) -> dict[str, DataFrame]:
    """Every part of the report by name, for one region or for all.

    ``shipments`` holds all sources. ``next_regions`` scopes all rows first;
    ``cat_depot`` and ``cat_livraison`` are office categories of the depot and
    the delivery half, each of which can be left out. The top KPI block is
    always there.
    """
    rows = filter_next_region(shipments, next_regions)
    by = {s: rows.filter(F.col("source") == s) for s in ("national", "export", "import")}
    parts = {"report_kpis": report_kpis(by["national"], region, by_region=True)}
    if include_depot:
        parts |= {
            "depot_kpis": depot_kpis(rows, region), "depot_table": depot_table(by["national"], region, cat_depot),
            "export_table": depot_table(by["export"], region, cat_depot), "depot_drill": depot_drill(by["national"], region, cat_depot),
            "export_drill": export_drill(by["export"], region, cat_depot), "depot_slider": depot_slider(by["national"], region, cat_depot)}
    if include_livraison:
        parts |= {
            "livraison_kpis": livraison_kpis(rows, region), "livraison_table": livraison_table_long(by["national"], region, cat_livraison),
            "import_table": livraison_table_long(by["import"], region, cat_livraison),
            "livraison_drill": livraison_drill(by["national"], region, cat_livraison),
            "import_drill": import_drill(by["import"], region, cat_livraison),
            "livraison_slider": livraison_slider(by["national"], region, cat_livraison)}
    return parts
