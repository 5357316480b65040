"""Results that are computed once: a claim by an exclusive file, a result that appears whole.

Whoever creates the claim file computes; everyone else waits for the result and reads it.  Creation
without overwriting is one atomic step of the file system, as is the rename that publishes the
result, so one driver computes and the others read.  A claim without a result is void after its lease: its
driver is lost, and the next claim number decides who goes on.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEASE_SECONDS = 6 * 3600.0
STAMP = ("stamp_owner", "stamp_claim")


class Stamp:
    def __init__(self, spark: SparkSession, path: str, lease: float = LEASE_SECONDS, poll: float = 0.2) -> None:
        self.spark, self.path, self.lease, self.poll = spark, path, lease, poll
        self.owner = uuid.uuid4().hex
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.result = f"{path}/result"

    def done(self) -> bool:
        return self.files.exists(self._at(self.result))

    def claim(self, number: int) -> bool:
        """Whether this driver created claim ``number``; the one creation that succeeds wins."""
        try:
            out = self.files.create(self._at(f"{self.path}/claim-{number}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps({"owner": self.owner}).encode()))
        out.close()
        time.sleep(self.poll)  # a local disk looks before it creates, so two may come through at once: the last one stands
        return self.owner in self.spark.read.text(f"{self.path}/claim-{number}").first()[0]

    def release(self, number: int) -> None:
        self.files.delete(self._at(f"{self.path}/claim-{number}"), False)

    def age(self, number: int) -> float:
        return time.time() - self.files.getFileStatus(self._at(f"{self.path}/claim-{number}")).getModificationTime() / 1000.0

    def publish(self, rows: DataFrame, number: int) -> None:
        """Write beside, then show by rename; a result that is there already stays."""
        beside = f"{self.path}/attempt-{self.owner}-{number}"
        rows.withColumn(STAMP[0], F.lit(self.owner)).withColumn(STAMP[1], F.lit(number)).write.parquet(beside)
        if self.done() or not self.files.rename(self._at(beside), self._at(self.result)):
            self.files.delete(self._at(beside), True)


def computed_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame], lease: float = LEASE_SECONDS, poll: float = 0.2) -> DataFrame:
    """The result at ``path``, computed by whoever claims it first, with the winner's stamp as columns."""
    stamp, number = Stamp(spark, path, lease, poll), 0
    while not stamp.done():
        if stamp.claim(number):
            try:
                stamp.publish(compute(), number)
            except BaseException:
                stamp.release(number)  # others need not wait for the lease
                raise
        elif stamp.age(number) > lease:
            number += 1  # its driver is lost
        else:
            time.sleep(poll)
    return spark.read.parquet(stamp.result)


def rounds(spark: SparkSession, path: str) -> int:
    """How many results stand at ``path``: rounds are numbered from 0 and published in turn."""
    n = 0
    while Stamp(spark, f"{path}/round-{n}").done():
        n += 1
    return n
