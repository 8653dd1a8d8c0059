"""The filter-context layer on rows made by hand, and its plans."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import context as c
from ledgerlens.operators import modelled as m
from ledgerlens.plans.inspect import fact_scans, physical_plan
from ledgerlens.sources.star import materialized_star

SF = "/root/testdata/sf0.001"


@pytest.fixture
def model(txns, frame):
    rows = [
        # product, subsidiary, month, status, customer, usd
        ("P1", "S1", 1, "SUCCESS", 1, "10"), ("P1", "S1", 1, "FAILED", 2, "20"), ("P1", "S1", 2, "SUCCESS", 2, "30"),
        ("P2", "S1", 1, "SUCCESS", 1, "40"), ("P2", "S1", 2, "SUCCESS", 3, "50"), ("P3", "S1", 2, "FAILED", None, "60"),
        ("P1", "S2", 1, "SUCCESS", 9, "70"), (None, "S2", 2, "SUCCESS", 9, "80"), ("P2", "S2", 2, "SUCCESS", None, "90"),
    ]
    t = txns([dict(PRODUCT=p, SUBSIDIARY=s, TRANSACTION_DATE=dt.date(2024, k, 10), STATUS=st, CUSTOMER_ID=cu, TXN_AMOUNT_USD=u) for p, s, k, st, cu, u in rows])
    targets = frame([("P1", "S1", dt.date(2024, 1, 1), 4, 90.0), ("P1", "S1", dt.date(2024, 2, 1), 5, 95.0), ("P9", "S1", dt.date(2024, 2, 1), 7, 50.0)],
                    "PRODUCT string, SUBSIDIARY string, month date, TARGET_VOLUME long, TARGET_SUCCESS_RATE double")
    return c.Model({c.FACT: c.with_month(t), "kpi_targets": targets})


def table(df, *columns) -> dict:
    return {tuple(r[k] for k in df.columns if k not in columns) if len(df.columns) - len(columns) > 1 else r[0]: tuple(r[k] for k in columns) for r in df.collect()}


def test_cell_selection_and_everything(model):
    measures = {
        "n": c.rows(), "of_selected": c.rows().calculate(c.visible("PRODUCT")), "of_all": c.rows().calculate(c.clear("PRODUCT")),
        "page": c.rows().calculate(c.visible()), "ever": c.rows().calculate(c.clear_all()),
        "own_s": c.rows().calculate(c.clear_but("SUBSIDIARY")),
    }
    out = c.evaluate(model, measures, ["SUBSIDIARY", "PRODUCT"], {"PRODUCT": ["P1", "P2"]})
    got = {(r.SUBSIDIARY, r.PRODUCT): (r.n, r.of_selected, r.of_all, r.page, r.ever, r.own_s) for r in out.collect()}
    assert got == {("S1", "P1"): (3, 5, 6, 7, 9, 6), ("S1", "P2"): (2, 5, 6, 7, 9, 6), ("S2", "P1"): (1, 2, 3, 7, 9, 3), ("S2", "P2"): (1, 2, 3, 7, 9, 3)}


def test_null_is_a_member(model):
    out = c.evaluate(model, {"n": c.rows()}, ["PRODUCT"], {"PRODUCT": [None, "P3"]})
    assert {r.PRODUCT: r.n for r in out.collect()} == {None: 1, "P3": 1}
    out = c.evaluate(model, {"n": c.rows(), "all_n": c.rows().calculate(c.clear("PRODUCT"))}, ["PRODUCT"], {"SUBSIDIARY": "S2"})
    assert {r.PRODUCT: (r.n, r.all_n) for r in out.collect()} == {"P1": (1, 3), "P2": (1, 3), None: (1, 3)}


def test_inner_change_has_the_last_word(model):
    base = c.rows().calculate(c.only("STATUS", "SUCCESS"))
    measures = {
        "inner": base.calculate(c.only("STATUS", "FAILED")), "kept": base.calculate(c.keep(c.among("STATUS", "FAILED"))),
        "replaced": c.rows().calculate(c.only("PRODUCT", "P2")), "both": c.rows().calculate(c.keep(c.among("PRODUCT", "P2"))),
        "cleared": c.rows().calculate(c.clear("STATUS"), c.only("STATUS", "SUCCESS")),
    }
    got = {r.PRODUCT: r[1:] for r in c.evaluate(model, measures, ["PRODUCT"], {"SUBSIDIARY": "S1"}).collect()}
    # ``base`` says SUCCESS itself, so an outer replacement does not reach it; an outer kept condition is replaced as well
    assert got == {"P1": (2, 2, 2, 0, 2), "P2": (2, 2, 2, 2, 2), "P3": (0, 0, 2, 0, 0)}
    kept_inside = c.rows().calculate(c.keep(c.among("STATUS", "SUCCESS"))).calculate(c.only("STATUS", "FAILED"))
    assert {r.PRODUCT: r.x for r in c.evaluate(model, {"x": kept_inside}, ["PRODUCT"]).collect()} == {"P1": 0, "P2": 0, "P3": 0, None: 0}


def test_distinct_counts_at_several_grains(model):
    measures = {
        "own": c.distinct("CUSTOMER_ID"), "known": c.distinct("CUSTOMER_ID", blank=False), "sub": c.distinct("CUSTOMER_ID").calculate(c.clear("PRODUCT")),
        "page": c.distinct("CUSTOMER_ID").calculate(c.visible()), "ok": c.distinct("CUSTOMER_ID", blank=False).calculate(c.only("STATUS", "SUCCESS"), c.clear("PRODUCT", "SUBSIDIARY")),
    }
    got = {(r.SUBSIDIARY, r.PRODUCT): r[2:] for r in c.evaluate(model, measures, ["SUBSIDIARY", "PRODUCT"]).collect()}
    assert got == {
        ("S1", "P1"): (2, 2, 4, 5, 4), ("S1", "P2"): (2, 2, 4, 5, 4), ("S1", "P3"): (1, 0, 4, 5, 4),
        ("S2", "P1"): (1, 1, 2, 5, 4), ("S2", None): (1, 1, 2, 5, 4), ("S2", "P2"): (1, 0, 2, 5, 4),
    }


def test_new_members_look_behind_the_slicer(model):
    measures = {"new": c.new_members("CUSTOMER_ID"), "n": c.rows(), "custs": c.distinct("CUSTOMER_ID")}
    feb = c.between("month", dt.date(2024, 2, 1))
    got = {(r.SUBSIDIARY, r.month): r[2:] for r in c.evaluate(model, measures, ["SUBSIDIARY", "month"], {"month": feb}).collect()}
    assert got == {("S1", dt.date(2024, 2, 1)): (2, 3, 3), ("S2", dt.date(2024, 2, 1)): (1, 2, 2)}  # 3 and blank; blank
    with pytest.raises(ValueError):
        c.evaluate(model, measures, ["SUBSIDIARY"])
    with pytest.raises(ValueError):
        c.evaluate(model, measures | {"x": c.distinct("AGENT_ID")}, ["month"])


def test_tables_meet_on_what_they_share(model):
    measures = {
        "n": c.rows(), "goal": c.total("TARGET_VOLUME", "kpi_targets"), "best": c.greatest("TARGET_SUCCESS_RATE", "kpi_targets").calculate(c.clear_but("PRODUCT", "SUBSIDIARY")),
    }
    by = ["PRODUCT", "SUBSIDIARY", "month"]
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    got = {(r.PRODUCT, r.SUBSIDIARY, r.month): r[3:] for r in c.evaluate(model, measures, by).collect()}
    assert got[("P1", "S1", jan)] == (2, 4, 95.0) and got[("P1", "S1", feb)] == (1, 5, 95.0)
    assert got[("P9", "S1", feb)] == (0, 7, 50.0) and got[("P2", "S1", jan)] == (1, None, None) and len(got) == 9
    # a table without a cell column is not bound by it
    wide = {"n": c.rows(), "goal": c.total("TARGET_VOLUME", "kpi_targets")}
    got = {(r.PRODUCT, r.STATUS): r[2:] for r in c.evaluate(model, wide, ["PRODUCT", "STATUS"], {"SUBSIDIARY": "S1"}).collect()}
    assert got == {("P1", "SUCCESS"): (2, 9), ("P1", "FAILED"): (1, 9), ("P2", "SUCCESS"): (2, None), ("P3", "FAILED"): (1, None)}
    with pytest.raises(ValueError):
        c.evaluate(model, wide, ["STATUS"]).collect()
    assert c.evaluate(model, wide, []).collect()[0][:] == (9, 16)


def test_rank_ties_and_blank_rows(model):
    measures = {"r": c.rank(c.rows(), "PRODUCT"), "page": c.rank(c.rows(), "PRODUCT", "SUBSIDIARY"), "failed": c.or_blank(m.FAILED)}
    got = {(r.SUBSIDIARY, r.PRODUCT): r[2:] for r in c.evaluate(model, measures, ["SUBSIDIARY", "PRODUCT"]).collect()}
    assert got == {("S1", "P1"): (1, 1, 1), ("S1", "P2"): (2, 2, None), ("S1", "P3"): (3, 3, 1), ("S2", "P1"): (1, 3, None), ("S2", "P2"): (1, 3, None), ("S2", None): (1, 3, None)}
    only_failed = c.evaluate(model, {"failed": c.or_blank(m.FAILED)}, ["PRODUCT"], drop_blank=True)
    assert sorted(r.PRODUCT for r in only_failed.collect()) == ["P1", "P3"]


def test_no_rows(model):
    empty = replace(model, tables={k: t.limit(0) for k, t in model.tables.items()})
    assert c.evaluate(empty, m.BASE, ["PRODUCT"]).collect() == []
    assert c.evaluate(model, m.BASE, ["PRODUCT"], {"PRODUCT": []}).collect() == []
    row = c.evaluate(model, m.BASE, [], {"PRODUCT": "none"}).collect()[0]
    assert row.total_transactions == 0 and row.total_value_usd is None and row.success_rate_pct == 0.0


def test_odd_literals(model):
    quoted = "it's a \\ \"name\" % _"
    t = model.tables[c.FACT].withColumn("PRODUCT", F.lit(quoted))
    assert c.evaluate(c.Model({c.FACT: t}), {"n": c.rows()}, ["PRODUCT"], {"PRODUCT": quoted}).collect()[0].n == 9
    assert c.literal(True) == "TRUE" and c.literal(None) == "NULL" and c.literal(dt.datetime(2024, 1, 2, 3)) == "TIMESTAMP_NTZ '2024-01-02 03:00:00'"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
class TestPlans:
    @pytest.fixture(scope="class")
    def star(self, spark):
        return materialized_star(spark, SF)

    @pytest.mark.parametrize("name", ["ctx_base_measures", "ctx_attainment_rag", "ctx_new_customers", "ctx_product_rank", "ctx_active_agents", "ctx_selected_products", "ctx_selected_new_customers"])
    def test_one_scan_whatever_the_measures(self, spark, name):
        import __spark_entry__ as entry

        assert fact_scans(entry.queries()[name](spark, SF)) == 1

    def test_conditions_all_share_reach_the_scan(self, star):
        out = c.evaluate(c.model_of(star), {"n": m.SUCCESSFUL, "v": m.SUCCESS_RATE}, ["PRODUCT"], {"SUBSIDIARY": "ASIA", "month": c.between("month", dt.date(2000, 1, 1))})
        plan = physical_plan(out)
        assert "TXN_MONTH" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "SUBSIDIARY" in plan.split("PushedFilters: [")[1].split("]")[0]
        assert "CUSTOMER_ID" not in plan

    def test_sliced_star_equals_filtered_rows(self, star):
        t = c.sliced(star, {"SUBSIDIARY": ["ASIA", "AFRICA"], "month": c.between("month", dt.date(1999, 1, 1), dt.date(1999, 12, 1))})
        plain = star.transactions.filter("SUBSIDIARY in ('ASIA', 'AFRICA') and year(TRANSACTION_DATE) = 1999")
        assert t.transactions.columns == star.transactions.columns and t.transactions.exceptAll(plain).isEmpty() and t.transactions.count() == plain.count()
        assert t.kpi_targets.count() == 0 and t.forex_rates.count() == star.forex_rates.filter("SUBSIDIARY_NAME in ('ASIA', 'AFRICA') and year(RATE_MONTH) = 1999").count()
        assert t.agents is star.agents and t.customers is star.customers and t.folder is None and c.sliced(star, None) is star
