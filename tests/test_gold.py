"""The match table on made tables whose gameweeks hold many matches of a team."""

import duckdb
from pyspark.sql import functions as F

from kickline.plans import contract as ct, gold as plan
from kickline.queries import ORACLE, QUERIES, sources
from tests.oracle_check import compare

MADE = {
    "region": "SELECT i::INT AS r_regionkey, 'R' || i AS r_name FROM range(2) t(i)",
    "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, (i % 2)::INT AS n_regionkey FROM range(4) t(i)",
    "supplier": "SELECT i AS s_suppkey, (i % 4)::INT AS s_nationkey FROM range(20) t(i)",
    "customer": "SELECT i AS c_custkey, (i % 4)::INT AS c_nationkey FROM range(37) t(i)",
    # 24 days, 200 orders a day
    "orders": "SELECT i AS o_orderkey, i * 7 % 37 AS o_custkey, 1.0 * i AS o_totalprice, TIMESTAMP '1995-01-03' + to_days(CAST((i // 200) * 103 AS INT)) AS o_orderdate FROM range(4800) t(i)",
    "lineitem": """SELECT i AS l_orderkey, (i * 13 + j * 5) % 101 AS l_partkey, (i * 3 + j) % 20 AS l_suppkey, (j + 1)::INT AS l_linenumber, 1.0 + (i * 7 + j * 3) % 50 AS l_quantity,
        100.0 + (i * 17 + j * 29) % 900 AS l_extendedprice, ((i + j) % 11) / 100.0::DOUBLE AS l_discount, ((i * j) % 9) / 100.0::DOUBLE AS l_tax FROM range(4800) t(i), range(3) u(j)""",
}


def made(folder):
    con = duckdb.connect()
    for name, sql in MADE.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def test_only_rows_within_shown_frames_become_wide(spark, tmp_path, monkeypatch):
    con = made(tmp_path)
    written, write = {}, plan.stage
    monkeypatch.setattr(plan, "stage", lambda df, name, *a: written.setdefault(name, write(df, name, *a)))
    ok, message = compare(spark, con, str(tmp_path), "gold_match_core", QUERIES["gold_match_core"], ORACLE["gold_match_core"])
    assert ok, message
    full = QUERIES["gold_match_full"](spark, str(tmp_path))
    matches = full.count()
    assert matches > 2000 and full.columns == list(ct.GOLD_COLUMNS)
    # before, every match side was made wide, and the whole table was written for every reader
    assert written["team-base"].count() < matches
    assert all(len(df.columns) < len(ct.GOLD_COLUMNS) / 1.3 for df in written.values())
    assert all(len(df.columns) < 60 for df in written.values() if df.count() >= matches)


def test_a_landed_file_of_statistics_holds_few_pages(spark, tmp_path, monkeypatch):
    con, landed, parse = made(tmp_path), [], sources.detailed.parse
    monkeypatch.setattr(sources, "PAGE", 1)
    monkeypatch.setattr(sources.detailed, "parse", lambda raw, *a: (landed.append(raw), parse(raw, *a))[1])
    name = "s04_detailed_stats_map"
    ok, message = compare(spark, con, str(tmp_path), name, QUERIES[name], ORACLE[name])
    assert ok, message
    per_file = [r["count"] for r in landed[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) > 2000 and max(per_file) <= sources.PAGES_PER_FILE   # a reader holds as many rows of a file at once as it has, up to 4,096
