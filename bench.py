"""Times the headline queries once cold and once warm; prints one JSON line with the warm seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sightline.plans import registry

HEADLINE = ["live_leaderboard", "o_ups_confidence_upsert", "a_cf_run_state", "j_own_chain", "j_ownr_as_of", "w_bnd_neighbour_bounds", "w_cum_offsets", "a_sep_separation", "a_arg_recognised_screen", "s_key_content_addresses", "m_pwr_growth", "m_stk_streaks", "m_car_lowest_decile", "er_rec_reconcile", "f_parse_round_trip", "er_rank_weighted", "er_asn_assignment", "er_att_attribution", "j_ovl_overlaps", "j_plan_due_work", "w_peak_decoys", "o_trn_runs", "g_bfs_hops"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
