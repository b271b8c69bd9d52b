"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from signalframe.session import get_session  # noqa: E402

HEADLINE = [
    "C3_rhythm_features", "A32_report_by_dataset", "A31_calibration_curve", "W3_moving_average", "A24_band_power",
    "R1_rhythm_class", "R2_stemi", "R7_af_score", "J6_territory_join", "P11_code_label", "M1_stratified_split",
    "M2_median_impute", "W4_qrs_peaks", "A9_p_wave", "A12_qt_qtc", "A14_qrs_axis", "A16_st_levels", "A2_signal_quality",
    "A24_fibrillatory_power", "J2_feature_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
