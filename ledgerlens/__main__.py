"""Run a report by name: ``python -m ledgerlens <report> [options]``.

Examples::

    python -m ledgerlens r01 --star /data/star --star-format csv --as-of 2024-06-10 --out /data/out/r01
    python -m ledgerlens r04 --catalog-db bank --agency-product "Agency" --show 20
    python -m ledgerlens x1 --star /data/star --keep /data/kept --filter SUBSIDIARY=North,South --show 20
    python -m ledgerlens list

The star comes from files (``--star``), catalog tables (``--catalog-db``) or
the TPC-H-like test tables (``--tpch``). A fact partitioned by month is read by
month; any other star is with ``--keep``, which writes it there once. Reports
over history then read rollups and label dictionaries kept beside the star.
``--filter`` sets a slicer for every table of the report. Results are written
by the executors (``--out``) or a bounded number of rows is printed (``--show``).
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import cohort, context, dashboards, export, measures, pages, reports, rfm, stats, worksheet
from ledgerlens.params import ReportParams
from ledgerlens.session import configure
from ledgerlens.sources.checks import check_star
from ledgerlens.sources.history import CustomerHistory
from ledgerlens.sources.labels import labels, values
from ledgerlens.sources.rollup import rollup
from ledgerlens.sources.star import Star, kept_star, star_from_catalog, star_from_files, star_from_tpch

Report = Callable[[Star, ReportParams], DataFrame]

PAIR = ["PRODUCT", "SUBSIDIARY"]


def _kept(s: Star, grain: str) -> DataFrame | None:
    """The rollup of a star that has a folder."""
    return rollup(s, grain) if s.folder else None


def _monthly(s: Star, by: list[str]) -> DataFrame:
    """The base measures per month: from the rollup, else one aggregate of the fact."""
    kept = _kept(s, "_".join(by).lower())
    return measures.monthly_measures(s.transactions, by) if kept is None else kept.drop("known_customers")


def _products(s: Star, p: ReportParams) -> list:
    return list(p.products) if p.products else values(s, "PRODUCT")


def _history(s: Star) -> CustomerHistory | None:
    """The customer history of a star that has a folder, brought up to date."""
    if not s.folder:
        return None
    history = CustomerHistory(s.transactions.sparkSession, f"{s.folder}/customer-history")
    history.refresh(s.transactions)
    return history


def _retention(s: Star) -> DataFrame | None:
    history = _history(s)
    return history.retention() if history else None


def _new_customers(s: Star) -> DataFrame:
    history = _history(s)
    return history.arrivals() if history else measures.new_customers(s.transactions)

REPORTS: dict[str, tuple[str, Report]] = {
    "r01": ("monthly product performance", lambda s, p: reports.monthly_product_performance(s.transactions, p.as_of, p.home_subsidiary, monthly=_kept(s, "product_category"))),
    "r02": ("KPI actual vs target RAG", lambda s, p: reports.kpi_rag(s.transactions, s.kpi_targets, p.as_of)),
    "r03": ("failure spikes", lambda s, p: reports.failure_spikes(s.transactions, p.as_of)),
    "r04": ("agent scorecard", lambda s, p: reports.agent_scorecard(s.transactions, s.agents, p.as_of, p.agency_product)),
    "r05": ("remittance corridors", lambda s, p: reports.corridor_analysis(s.transactions, p.as_of, p.remit_product)),
    "r06": ("rolling success rate", lambda s, p: reports.rolling_success_rate(s.transactions, p.as_of, monthly=_kept(s, "product_subsidiary"))),
    "r07": ("segment revenue", lambda s, p: reports.segment_revenue(s.transactions, s.customers, p.as_of)),
    "r08": ("channel x product matrix", lambda s, p: reports.channel_product_matrix(s.transactions, p.as_of)),
    "r09a": ("cohort retention, recent cohorts", lambda s, p: cohort.cohort_retention(s.transactions, p.as_of, cohort_months=8, kept=_retention(s))),
    "r09b": ("cohort retention, all cohorts", lambda s, p: cohort.cohort_retention(s.transactions, cohort_months=None, kept=_retention(s))),
    "r10": ("subsidiary benchmark", lambda s, p: reports.subsidiary_benchmark(s.transactions, p.as_of, p.remit_product)),
    "r11": ("fee profitability", lambda s, p: reports.fee_profitability(s.transactions, s.forex_rates, p.as_of)),
    "r12": ("activity heatmap", lambda s, p: reports.activity_heatmap(s.transactions, p.as_of)),
    "p1": ("z-score anomalies", lambda s, p: stats.zscore_anomalies(s.transactions, monthly=_kept(s, "product_subsidiary"))),
    "p2": ("A/B test", lambda s, p: stats.ab_test_success_rate(s.transactions, p.control_channel, p.treatment_channel, p.flagship_product, p.as_of)),
    "p3": ("RFM segments", lambda s, p: rfm.rfm_scores(rfm.rfm_features(s.transactions, s.customers, p.as_of))),
    "p3-summary": ("RFM segment summary", lambda s, p: rfm.rfm_summary(rfm.rfm_scores(rfm.rfm_features(s.transactions, s.customers, p.as_of)))),
    "p4": ("volume forecast", lambda s, p: stats.linear_forecast(s.transactions, p.as_of, monthly=_kept(s, "product_subsidiary"))),
    "p5": ("cohort grid", lambda s, p: cohort.cohort_grid(s.transactions, kept=_retention(s))),
    "x5": ("channel x product success rate", lambda s, p: worksheet.channel_product_sr(s.transactions)),
    "x5-wide": ("channel x product success matrix", lambda s, p: worksheet.channel_product_sr_matrix(s.transactions, _products(s, p))),
    "x8-grid": ("corridor x month matrix with zeros", lambda s, p: worksheet.corridor_month_grid(worksheet.corridor_month_matrix(s.transactions, p.remit_product))),
    "x10": ("rolling 3-month success rate", lambda s, p: worksheet.rolling_mean(export.monthly_kpis(s.transactions, _kept(s, "product_subsidiary")), "SuccessRate", "Month", ["PRODUCT", "SUBSIDIARY"])),
    "p1b": ("complete months", lambda s, p: stats.complete_months(s.transactions, days=_kept(s, "day_subsidiary"))),
    "p3-risk": ("revenue at risk", lambda s, p: rfm.revenue_at_risk(rfm.rfm_scores(rfm.rfm_features(s.transactions, s.customers, p.as_of)))),
    "m-float": ("float utilisation ratio per agent", lambda s, p: measures.float_utilisation_ratio(s.transactions, s.agents)),
    "m-cross-border": ("cross-border volume by month", lambda s, p: measures.cross_border_volume(measures.with_month(s.transactions), [measures.MONTH], p.remit_product)),
    "m-product-rank": ("product rank by volume, revenue per customer", lambda s, p: measures.dense_rank_desc(measures.revenue_per_customer(measures.base_measures(s.transactions, ["PRODUCT"])), "total_transactions", "product_rank_by_volume")),
    "m-title": ("report title", lambda s, p: measures.report_title_for(s.transactions, p.as_of)),
    "d1-products": ("product table of page 1", lambda s, p: dashboards.product_table(s.transactions, s.kpi_targets, p.as_of)),
    "d1-subsidiaries": ("subsidiary x value with rank", lambda s, p: dashboards.subsidiary_value(s.transactions)),
    "d2-status": ("product x status", lambda s, p: dashboards.product_status(s.transactions)),
    "d2-scatter": ("product scatter", lambda s, p: dashboards.product_scatter(s.transactions)),
    "d3-overview": ("failure cards", lambda s, p: dashboards.failure_overview(s.transactions)),
    "d3-descriptions": ("failures by description", lambda s, p: dashboards.failures_by_description(s.transactions)),
    "d3-categories": ("failed value by category", lambda s, p: dashboards.failed_value_by_category(s.transactions)),
    "d4-destinations": ("cross-border value by destination", lambda s, p: dashboards.destination_volume(s.transactions, p.remit_product)),
    "d4-cards": ("corridor cards", lambda s, p: dashboards.corridor_cards(s.transactions, p.remit_product)),
    "d5-cards": ("agent cards", lambda s, p: dashboards.agent_cards(s.transactions, p.agency_product)),
    "d5-counties": ("agency value by county", lambda s, p: dashboards.county_value(s.transactions, s.agents, p.agency_product)),
    "x6": ("MoM arrows", lambda s, p: worksheet.mom_arrow(s.transactions, p.as_of, labels=labels(s, ["PRODUCT"]))),
    "x8": ("corridor x month matrix", lambda s, p: worksheet.corridor_month_matrix(s.transactions, p.remit_product)),
    "m-growth": ("prior-period measures", lambda s, p: measures.prior_period_measures(_monthly(s, PAIR), PAIR)),
    "m-ytd": ("YTD measures", lambda s, p: measures.ytd_measures(_monthly(s, ["PRODUCT"]), ["PRODUCT"])),
    "x1": ("last-month volume per product", lambda s, p: worksheet.last_month_volume(s.transactions, p.as_of, p.home_subsidiary, labels=labels(s, ["PRODUCT"]))),
    "x2": ("last-month success rate", lambda s, p: worksheet.last_month_success_rate(s.transactions, p.as_of, labels=labels(s, PAIR))),
    "x3": ("volume RAG vs target lookup", lambda s, p: worksheet.volume_rag(s.transactions, s.kpi_targets, p.as_of, labels=labels(s, PAIR))),
    "x4": ("top 5 failures last month", lambda s, p: worksheet.top_failures(s.transactions, p.as_of)),
    "x7": ("agent float utilisation", lambda s, p: worksheet.float_utilisation(s.transactions, s.agents, p.as_of)),
    "x9": ("YTD running total", lambda s, p: worksheet.ytd_running_total(s.transactions, p.as_of, p.home_subsidiary)),
    "m-base": ("base measures by month x product", lambda s, p: _monthly(s, ["PRODUCT"])),
    "m-attainment": ("attainment and RAG measures", lambda s, p: measures.attainment_measures(_monthly(s, PAIR), s.kpi_targets)),
    "m-rolling": ("rolling 3-month measures", lambda s, p: measures.rolling_measures(_monthly(s, PAIR), PAIR)),
    "m-agents": ("active agents by month", lambda s, p: measures.agent_activity_measures(measures.with_month(s.transactions), [measures.MONTH], p.agency_product)),
    "m-new-customers": ("new customers by month", lambda s, p: _new_customers(s)),
    "calendar": ("day calendar of the fact", lambda s, p: measures.date_table(s.transactions)),
    "d1": ("executive KPI cards", lambda s, p: dashboards.kpi_cards(s.transactions, p.as_of)),
    "d2": ("channel share", lambda s, p: dashboards.channel_share(s.transactions)),
    "d2-matrix": ("month x product volume and success rate", lambda s, p: dashboards.month_product(s.transactions)),
    "d2-matrix-wide": ("month x product volume matrix", lambda s, p: dashboards.month_product_matrix(s.transactions, _products(s, p))),
    "d3": ("failure rate by month x channel", lambda s, p: dashboards.failure_rate_by_month_channel(s.transactions)),
    "d4": ("corridor table", lambda s, p: dashboards.corridor_table(s.transactions, p.remit_product)),
    "d5": ("agent region totals", lambda s, p: dashboards.region_totals(s.transactions, s.agents, p.agency_product)),
    "check": ("duplicate dimension keys (empty = sound)", lambda s, p: check_star(s)),
}


def _pack(star: Star, p: ReportParams) -> dict[str, DataFrame]:
    return pages.report_pack(star, p.as_of, p.agency_product, p.remit_product)


PAGES: dict[str, Callable[[Star, ReportParams], dict[str, DataFrame]]] = {
    "pack": _pack,
    "page1": lambda s, p: pages.executive_page(s, p.as_of),
    "page2": lambda s, p: pages.product_channel_page(s),
    "page3": lambda s, p: pages.failure_page(s),
    "page4": lambda s, p: pages.corridor_page(s, p.remit_product),
    "page5": lambda s, p: pages.agent_page(s, p.agency_product),
}


def slicers(given: list[str]) -> dict:
    """``COLUMN=value,value`` or ``COLUMN=low..high``; ``month`` takes dates, an empty end of a range is open."""
    out = {}
    for text in given:
        column, _, value = text.partition("=")
        if not value:
            raise ValueError(f"not COLUMN=value: {text}")
        read = dt.date.fromisoformat if column == context.MONTH else str
        if ".." in value:
            low, high = ((read(x) if x else None) for x in value.split("..", 1))
            out[column] = context.between(column, low, high)
        else:
            out[column] = [read(x) for x in value.split(",")]
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("report", help="report id, 'pack' for the export pack, 'page1' to 'page5' for a dashboard page, or 'list'")
    src = ap.add_mutually_exclusive_group()
    src.add_argument("--star", help="folder with transactions/agents/customers/kpi_targets/forex_rates")
    src.add_argument("--catalog-db", help="database holding the star tables")
    src.add_argument("--tpch", help="folder of the TPC-H-like test tables")
    ap.add_argument("--star-format", default="parquet", help="csv or parquet (with --star)")
    ap.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today(),
                    help="report date (default: today, as the original reports use the wall clock)")
    for role in ("home_subsidiary", "agency_product", "remit_product", "flagship_product", "control_channel", "treatment_channel"):
        ap.add_argument("--" + role.replace("_", "-"), default=getattr(ReportParams(), role))
    ap.add_argument("--keep", help="folder in which the star is kept laid out by month, with its rollups")
    ap.add_argument("--filter", action="append", default=[], metavar="COLUMN=VALUE[,VALUE]|LOW..HIGH", help="slicer; may be given several times")
    ap.add_argument("--products", help="comma-separated product columns of the wide matrices")
    ap.add_argument("--out", help="output folder (one folder per dataset for 'pack')")
    ap.add_argument("--format", default="parquet", help="output format: parquet or csv")
    ap.add_argument("--show", type=int, default=0, help="print this many rows instead of writing")
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan and exit")
    a = ap.parse_args(argv)

    if a.report == "list":
        for k, (desc, _) in REPORTS.items():
            print(f"{k:12s} {desc}")
        print(f"{'pack':12s} export pack (five datasets)")
        for k in list(PAGES)[1:]:
            print(f"{k:12s} dashboard page {k[-1]} (all its tables from one pass)")
        return 0
    if a.report not in PAGES and a.report not in REPORTS:
        ap.error(f"unknown report {a.report!r}; try 'list'")

    spark = configure(SparkSession.builder.appName(f"ledgerlens-{a.report}").getOrCreate())
    if a.star:
        star = star_from_files(spark, a.star, fmt=a.star_format, keep=a.keep)
    elif a.catalog_db:
        star = star_from_catalog(spark, database=a.catalog_db, keep=a.keep)
    elif a.tpch:
        star = star_from_tpch(spark, a.tpch)
        star = kept_star(star, a.keep, "tpch") if a.keep else star
    else:
        ap.error("give --star, --catalog-db or --tpch")
    star = context.sliced(star, slicers(a.filter))
    # a wide matrix needs its columns before the job runs: those given, else all labels of the star
    products = tuple(p.strip() for p in a.products.split(",")) if a.products else ()
    params = ReportParams(
        as_of=a.as_of, home_subsidiary=a.home_subsidiary, agency_product=a.agency_product,
        remit_product=a.remit_product, flagship_product=a.flagship_product,
        control_channel=a.control_channel, treatment_channel=a.treatment_channel, products=products,
    )
    if a.report in PAGES:
        datasets = PAGES[a.report](star, params)
        if a.out:
            export.write_pack(datasets, a.out, fmt=a.format)
        for name, df in datasets.items():
            if a.show:
                print(name)
                df.show(a.show, truncate=False)
        return 0
    df = REPORTS[a.report][1](star, params)
    if a.explain:
        df.explain("formatted")
        return 0
    if a.out:
        w = df.write.mode("overwrite").format(a.format)
        (w.option("header", True) if a.format == "csv" else w).save(a.out)
    if a.show or not a.out:
        df.show(a.show or 20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
