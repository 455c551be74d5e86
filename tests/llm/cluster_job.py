"""Runs all queries and the pipeline's stages on a cluster of two executors and writes their results; see test_cluster."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(tables: str, out: str) -> None:
    spark = (
        SparkSession.builder.master("local-cluster[2,2,1024]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "2g").config("spark.executorEnv.PYTHONPATH", ":".join(p for p in sys.path if p))
        .config("spark.checkpoint.dir", f"{out}/checkpoint").config("spark.sql.warehouse.dir", f"{out}/warehouse").config("spark.sql.files.maxPartitionBytes", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import corpus_pipeline
    from lingloom.llm import exchange, queries

    # Many small groups, so that most letters come from the other executor; and relays between them.
    exchange.GROUP_BYTES, exchange.DIRECT_BITS = 20_000, 4
    for name, query in queries.QUERIES.items():
        query(spark, tables).write.parquet(f"{out}/{name}")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(f"{out}/stage_{name}")
        docs = spark.read.parquet(f"{out}/stage_{name}")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
