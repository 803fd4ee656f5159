import pytest

from marketspark import catalogue as Q
from tests.compare import SMALL, duck, rows


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.ORACLE_SQL])
def test_query_equals_sql(spark, name):
    got, want = Q.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL, Q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SMALL).schema


def events(path, rows) -> str:
    """A folder with the table of events: (hours, minutes, symbol, price, quantity)."""
    import duckdb

    made = [f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {h} HOUR + INTERVAL {m} MINUTE, {i}, '{s}', {p}::DOUBLE, '{{\"k\": {q}}}')" for i, (h, m, s, p, q) in enumerate(rows)]
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {', '.join(made)}) t(event_id, ts, user_id, event_type, value, props)) TO '{path}/events.parquet'")
    return str(path)


def test_collected_candles_with_prices_of_zero(spark, tmp_path):
    """The small tables hold none; sf0.1 does. The second bar opens with its high, the third's volume is negative."""
    d = events(tmp_path, [(0, 1, "view", 5, 1), (0, 2, "view", 0, 2), (0, 3, "view", 7, 3), (1, 1, "view", 9, 4), (1, 2, "view", 0, 5), (2, 1, "view", 3, -6), (3, 1, "view", 4, 7)])
    got, want = Q.QUERIES["collected_candles"](spark, d).toPandas(), duck(d, Q.ORACLE_SQL["collected_candles"])
    assert len(got) == 4 and not got.never.any()
    assert rows(got) == rows(want)


def test_quality_report_with_prices_of_zero(spark, tmp_path):
    """A low of 0, a close of 0 before and after others, closes of 0 only, a negative volume, a score that ends in a half."""
    made = [(0, 1, "view", 5, 1), (0, 2, "view", 0, 2), (0, 3, "view", 5, 3), (1, 1, "view", 5, 4), (0, 1, "click", 0, 1), (1, 1, "click", 5, 1), (0, 1, "signup", 5, 1), (1, 1, "signup", 0, 1)]
    made += [(0, 1, "error", 0, 1), (1, 1, "error", 0, 1), (0, 1, "short", 5, -1), (1, 1, "short", 5, 1)]
    made += [(h, 1, "purchase", 1 + h % 2, 1) for h in (*range(334), 639)]  # 305 are missing, so the score is 1 - 307 / 640
    d = events(tmp_path, made)
    got, want = Q.QUERIES["quality_report"](spark, d).toPandas(), duck(d, Q.ORACLE_SQL["quality_report"])
    assert rows(got) == rows(want)
    assert set(got[got.passed].symbol) == {"view", "short"}


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    assert E.entry(spark).limit(1).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())


def test_the_library_does_not_need_the_llm_subpackage():
    import subprocess
    import sys

    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("marketspark.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
import marketspark.queries, marketspark.streaming.candles, marketspark.sources.readers, marketspark.sources.sinks, marketspark.plans.sql
assert not any(m.startswith("marketspark.llm") for m in sys.modules)
"""
    from pathlib import Path

    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0
