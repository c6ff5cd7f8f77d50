"""Tables written on the way leave no shuffle files behind."""

import time

from pyspark.sql import functions as F
from tidegauge.llm.common import RELEASE, saved


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return sum(name.startswith("shuffle_") and name.endswith(".data") for name in names)


def test_shuffle_files_go_with_the_write(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    for given in (None, "false"):
        spark.conf.unset(RELEASE) if given is None else spark.conf.set(RELEASE, given)
        before = _shuffle_files(spark)
        table = saved(rows.repartition("h"), "released")
        assert spark.conf.get(RELEASE, None) == given
        assert table.count() == 20_000  # its own exchange may stay, as it is no write
        grown = saved(rows.repartition("h"), "released")
        until = time.monotonic() + 20
        while _shuffle_files(spark) > before + 1 and time.monotonic() < until:
            time.sleep(0.2)
        assert _shuffle_files(spark) <= before + 1 and grown.count() == 20_000
    spark.conf.unset(RELEASE)
