"""Small tables for the tests of this folder."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
