"""Helpers of the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]
