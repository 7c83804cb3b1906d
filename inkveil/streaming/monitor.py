"""Traffic monitoring: requests that left the device, as a running count and the hosts involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_COUNTS = "host string, requests long, bytes long"
# The default ports of the schemes.
_ORIGIN = "^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?(?:[/?#].*)?\\z"


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case without a default port, or null for other and bad addresses."""
    low = F.lower(F.trim(url))
    scheme, host, port = (F.regexp_extract(low, _ORIGIN, i) for i in (1, 2, 3))
    default = F.when(scheme == "https", "443").otherwise("80")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise("")))


def is_off_device(url: Column, transfer_size: Column, own: str) -> Column:
    """Bytes came over the network, by http(s), from another origin than ``own``."""
    return F.coalesce((transfer_size != 0) & (origin(url) != F.lit(own)), F.lit(False))


def host(url: Column) -> Column:
    return F.regexp_replace(origin(url), "^https?://", "")


def per_host(requests: DataFrame, own: str) -> DataFrame:
    """host, requests, bytes of a batch or a stream of requests (ts, url, transfer_size) that left the device."""
    out = requests.where(is_off_device(F.col("url"), F.col("transfer_size"), own))
    return out.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("requests"), F.sum("transfer_size").alias("bytes"))


def _report(hosts: DataFrame) -> DataFrame:
    return hosts.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("off_device"), F.sort_array(F.collect_list("host")).alias("hosts"))


def off_device(requests: DataFrame, own: str) -> DataFrame:
    """off_device, hosts of a batch of requests: one row, hosts sorted.  per_host is the same without the list."""
    return _report(per_host(requests, own))


def host_totals(spark: SparkSession, path: str) -> DataFrame:
    """host, requests, bytes of all that ``watch`` has seen so far: the highest, thus the last counts of each host.  A row a host."""
    return spark.read.schema(_COUNTS).parquet(path).groupBy("host").agg(F.max("requests").alias("requests"), F.max("bytes").alias("bytes"))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """What off_device gives, of all that ``watch`` has seen so far; the list of hosts is for reports, ``host_totals`` for many hosts."""
    return _report(host_totals(spark, path))


def _drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def compact(spark: SparkSession, path: str, batch: int, every: int) -> None:
    """Puts the counts of the last ``every`` batches and the table so far into one folder, a row a host.

    Counts only grow and the highest one holds, so rows that stand twice do no harm: the new
    folder is whole before the old ones go, and whatever a failure leaves is put together next time.
    """
    host_totals(spark, path).write.mode("overwrite").parquet(f"{path}/batch=all-{batch}")
    for n in range(batch - every + 1, batch + 1):
        _drop(spark, f"{path}/batch={n}")
    _drop(spark, f"{path}/batch=all-{batch - every}")


def watch(requests: DataFrame, own: str, path: str, checkpoint: str, per: str | None = None, every: int = 32):
    """Starts the running count over all there is, then stops.  Buffered requests count as live ones do.

    The state is a count by host; each batch adds the hosts whose counts it changed to the
    Parquet table at ``path``, in a folder of its own that a retry overwrites; every so many
    batches these folders become one, so the table holds a row or so for each host.
    per: instead counts in windows of that length, with as long a watermark, are appended there.
    """
    if per is None:
        requests.sparkSession.createDataFrame([], _COUNTS).write.mode("ignore").parquet(f"{path}/batch=-1")

        def add(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
            if batch % every == every - 1:
                compact(changed.sparkSession, path, batch, every)

        writer = per_host(requests, own).writeStream.outputMode("update").foreachBatch(add)
    else:
        late = requests.withWatermark("ts", per).where(is_off_device(F.col("url"), F.col("transfer_size"), own))
        total = late.groupBy(F.window("ts", per).alias("window")).agg(F.count("*").alias("off_device"))
        writer = total.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
