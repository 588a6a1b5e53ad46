"""Headline queries, timed to a full materialisation. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_recent_form", "w01_rolling_form", "w06_calendar_congestion", "w08_squad_continuity",
    "j01_asof_strict", "j02_head_to_head_asof", "j04_interval_join_values", "j05_lookback_all_competitions",
    "a04_player_to_team_fixture", "a20_gameweek_status", "o01_league_table", "r01_elo", "r06_pi_grid",
    "f16_poisson_score_grid", "m01_class_metrics", "m05_accuracy_bootstrap", "m07_mcnemar_by_season",
    "m09_one_vs_rest_auc", "m18_monitoring_per_gameweek", "d07_bet_simulation", "v07_governing_prediction",
    "v08_append_only_if_different", "g02_latency_percentiles", "gold_match_full"]


def main() -> None:
    from kickline.queries import QUERIES
    from kickline.session import build_session
    from kickline.sources import silver

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        t = time.time()
        job()
        times[name] = round(time.time() - t, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # the Silver tables are written once; their cost is its own entry
    timed("silver_tables", lambda: (silver.match(spark, sf), silver.player(spark, sf)))
    for name in HEADLINE:
        timed(name, lambda: drain(QUERIES[name](spark, sf)))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
