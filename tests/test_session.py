import os

from pyspark.sql import functions as F

from navstead.session import TableScope, cut_lineage, stored


def folder(df) -> str:
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_a_scope_drops_its_own_tables_alone(spark):
    outside = cut_lineage(spark.range(3))
    with TableScope(spark) as outer:
        first = cut_lineage(spark.range(5))
        with TableScope(spark) as inner:
            second = cut_lineage(first.withColumn("x", F.lit(1)))
        third = cut_lineage(second)
    inner.drop()
    assert third.count() == 5 and first.count() == 5 and outside.count() == 3
    assert not os.path.exists(folder(third).rsplit("/", 1)[0] + "/none") and len(inner.paths) == 0
    gone = [folder(first), folder(third)]
    outer.drop()
    assert not any(os.path.exists(p) for p in gone) and outside.count() == 3
    outer.drop()  # again: nothing to do


def test_stored_tables_outlive_the_scope_they_are_built_in(spark):
    @stored
    def numbers(session, source):
        return session.range(7)

    with TableScope(spark) as scope:
        numbers(spark, "here")
    scope.drop()
    assert numbers(spark, "here").count() == 7
