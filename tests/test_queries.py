"""Every query of the core against its SQL, and the contract of the entry point."""

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import care, problems, statistics, tables, texts

CORE = problems.QUERIES | tables.QUERIES | statistics.QUERIES | texts.QUERIES | care.QUERIES
SQL = problems.ORACLE | tables.ORACLE | statistics.ORACLE | texts.ORACLE | care.ORACLE
#: Queries that search the whole grid take many minutes; their parts are tested on small tables in test_statistics, and their
#: results here where SLOW_TESTS is set.
SLOW = {"forecast_leaderboard", "stacking_forecast", "fold_scores", "best_params"}
#: What the results of queries without SQL must fulfil.
BOUNDS = {
    "forecast_leaderboard": lambda x: (x.model.nunique() == len(x) == 7 and "stacking" in set(x.model) and x.rmse.is_monotonic_increasing and x.rmse.notna().all()) or pytest.fail(str(x)),
    "stacking_forecast": lambda x: x.rmse[0] > 0 and x.n[0] > 0 or pytest.fail(str(x)),
    "fold_scores": lambda x: len(x) == 195 and x.rmse.notna().all() or pytest.fail(str(x)),
    "best_params": lambda x: len(x) == 6 and (x.folds == 5).all() or pytest.fail(str(x)),
    "feature_importance": lambda x: len(x) > 3 and not x.feature.str.contains("neighbourhood_cleansed__v_").any() and x.importance.between(0, 1).all() and x.importance.is_monotonic_decreasing or pytest.fail(str(x)),
    "booking_model": lambda x: 0 <= x.auc[0] <= 1 and x.positives[0] > 0 and x.negatives[0] > 0 or pytest.fail(str(x)),
    "revenue_curve": lambda x: len(x) and x.chance.between(0, 1).all() and ((x.price / x.base).between(0.5 - 1e-9, 2 + 1e-9)).all() or pytest.fail(str(x)),
    "optimal_prices": lambda x: len(x) and x.id.is_unique and (abs(x.price * x.chance - x.revenue) < 1e-6).all() or pytest.fail(str(x)),
    "hash_sample": lambda x: len(x) == min(1000, len(x)) and x.o_orderkey.is_unique or pytest.fail(str(x)),
    "hash_split": lambda x: 0.75 < x.is_train.mean() < 0.85 or pytest.fail(str(x)),
    "p7_filled": lambda x: x.filled.all() and x.donor_row_id.notna().all() and set(x.how) == {"same_entity", "similar"} or pytest.fail(str(x)),
    "search_speed": lambda x: len(x) == 68 and (x[x.name.str.startswith("index")].rows_examined.values <= x[x.name.str.startswith("like")].rows_examined.values).all() or pytest.fail(str(x)),
}


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    return Counter(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.keys() - (SLOW if not os.environ.get("SLOW_TESTS") else set())))
def test_query(spark, data, duck, name):
    got = CORE[name](spark, data).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        BOUNDS[name](got)


def test_entry(spark):
    assert entry.entry(spark).columns == ["nurse_id", "start_ms", "end_ms", "visit_count"]
    assert CORE.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
