"""Plan properties that the scale design relies on (checked on the smoke tables)."""

import contextlib
import io
import re

from __spark_entry__ import queries

from .conftest import SMOKE_DIR


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_roll_up_reads_only_needed_columns(spark):
    plan = _plan(queries()["revenue_over_time"](spark, SMOKE_DIR))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert "struct<l_orderkey:bigint,l_extendedprice:double>" in schemas
    assert "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in schemas
    # lineitem and orders once each: no second pass for the month gate
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 2


def test_period_filter_reaches_the_scan(spark):
    plan = _plan(queries()["period_total"](spark, SMOKE_DIR))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate,1996-01-01", plan)


def test_top_n_per_group_is_limited_before_the_shuffle(spark):
    plan = _plan(queries()["last_turns"](spark, SMOKE_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_lineitem_is_aggregated_before_the_order_join(spark):
    plan = _plan(queries()["orders_over_time"](spark, SMOKE_DIR))
    join = plan.index("Join")
    # a partial aggregate of lineitem sits below the join
    assert "HashAggregate" in plan[plan.index("Physical Plan"):][:join]


def test_rfm_has_no_unpartitioned_window(spark):
    df = queries()["rfm_customers"](spark, SMOKE_DIR)
    assert "Window" not in _plan(df)


def test_basket_pairs_stay_in_the_jvm(spark):
    plan = _plan(queries()["basket_rules"](spark, SMOKE_DIR))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_a_basket_with_all_items_is_dealt_by_blocks(spark, monkeypatch):
    from quillspark.operators import basket as BK
    monkeypatch.setattr(BK, "BLOCK_ITEMS", 8)
    rows = [(0, f"i{k:02d}") for k in range(50)] + [(o, f"i{k:02d}") for o in range(1, 30) for k in (o % 5, o % 7 + 5)]
    counts = {(r["A"], r["B"]): r["support"] for r in BK.pair_supports(spark.createDataFrame(rows, "o long, i string")).collect()}
    assert len(counts) == 50 * 49 // 2
    for (a, b), n in counts.items():
        assert n == sum({a, b} <= {i for p, i in rows if p == o} for o in range(30))
