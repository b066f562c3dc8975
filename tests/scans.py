"""What a plan's scans of files read."""


def scanned_rows(spark, df):
    """Rows that scans of files gave, from the metrics of the plan as it ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df.select("*")._jdf.queryExecution()
        run.toRdd().count()
        leaves = run.executedPlan().collectLeaves()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    each = [leaves.apply(i) for i in range(leaves.size())]
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in each if leaf.nodeName().startswith("Scan"))
