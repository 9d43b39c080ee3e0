"""Scratch tables leave no shuffle files behind, and go when they are dropped."""

import os

from lodestone.llm.common import dropped, stored


def test_stored_tables_leave_no_shuffle_and_can_be_dropped(spark):
    blocks = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(",").count("shuffle_")
    before, setting = blocks(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = stored(spark.range(1000).repartition(4, "id").groupBy("id").count(), "scratch")
    assert blocks() <= before
    assert rows.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    path = rows.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    dropped(rows)
    assert not os.path.exists(os.path.dirname(path))
