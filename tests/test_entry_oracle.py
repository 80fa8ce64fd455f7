"""Driver contract and a sample of registered queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from kestrel.sources.fixtures import TABLES
from scripts.check_oracle import digest

from .conftest import SF_SMALL

SAMPLE = ["r06_preprocess", "r04_controller_summary", "w01b_rolling_mean_global", "w04_cumulative_savings",
          "w07_label_codes", "p02_chrono_split", "p04_permute_column", "f06_duplicate_pairs", "g08_predominant_share",
          "s04_chi_square", "s06_anova_f", "h06_roc_auc", "h07_kdd_target_mean_auc", "x05_exhaustive_linear",
          "f11_corr_groups_by_strength", "y10_mrmr_fcq", "r09_trend_season_forecast", "a05_jsonl_roundtrip", "t04_select_percentile"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "controllerName" in df.columns and "recommended_request" in df.columns


def test_registry_is_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150
    from kestrel.plans import registry
    assert set(registry.QUERIES) <= set(q) and all("_" in k for k in registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert len(sdf) == len(odf)
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert digest(sdf) == digest(odf)
