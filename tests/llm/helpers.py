def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
