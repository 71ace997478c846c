"""A long sequence is written down with the columns that are read, not with all that photos have."""

from fieldspark.plans import ordered
from workloads import report_q


def test_narrow_rows(spark, sf, monkeypatch):
    widths = []
    cut = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: (widths.append(df.columns), cut(df))[1])
    whole = sorted(report_q.sequence_indicators(spark, sf).collect())
    spark.conf.set("spark.fieldspark.maxGroupRows", "60")
    try:
        parts = sorted(report_q.sequence_indicators(spark, sf).collect())
    finally:
        spark.conf.unset("spark.fieldspark.maxGroupRows")
    assert parts == whole
    assert widths and all("scored" not in w and len(w) < 30 for w in widths)
