"""Physical-plan checks: the text never crosses a shuffle in the flagship query."""
import pytest

from paths import SF_SMALL


def _plan(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def _join_exchange_inputs(plan: str) -> list[str]:
    """Input lists of the exchanges the planner added for joins/aggregations."""
    out = []
    for s in plan.split("\n("):
        if s.split(")", 1)[-1].strip().startswith("Exchange") and "ENSURE_REQUIREMENTS" in s:
            out += [line for line in s.splitlines() if line.startswith("Input")]
    return out


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_feature_table_moves_only_narrow_rows(spark, threshold):
    """One plan with either join: text stays where it was scanned, the scan is pruned."""
    from slantspark.plans import dataset as DS
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = DS.features(spark, SF_SMALL)
        plan = _plan(df)
        assert ("SortMergeJoin" in plan) == (threshold == "-1")
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
        assert not any("text" in line for line in _join_exchange_inputs(plan))
        assert df.count() == 87
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
