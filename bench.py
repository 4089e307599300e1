"""Times the headline queries; prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession  # noqa: E402

from stratavec.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["vec_cosine_topk", "vec_filter_topk", "vec_batch_topk", "vec_group_by", "ivf_topk", "int4_topk", "fts_bm25", "fts_phrase", "fts_nested", "hybrid_rrf", "f_contain_all", "m_conjunction", "q_int8", "dml_upsert", "collection_query"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.QUERIES["f_ge"](spark, SF_DIR).count()  # starts the session
    for name in NAMES:
        best = []
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        took[name] = round(min(best), 3)
    rows = catalog.read(spark, SF_DIR, "embeddings").count()
    asked = catalog.read(spark, SF_DIR, "embeddings").where("vec_id % 20 = 0").count()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "batch_queries_per_sec": round(asked / took["vec_batch_topk"], 1), "vectors": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
