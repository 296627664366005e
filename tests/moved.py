"""What stages have shuffled and written."""


def moved(spark) -> int:
    """Records that all stages of the session have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def moved_by(spark, query) -> tuple[int, list]:
    """Records that a query shuffles, and its rows."""
    before = moved(spark)
    rows = query().collect()
    return moved(spark) - before, rows
