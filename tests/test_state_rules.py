"""State changes of unknown alerts and long lists of invalid labels."""

import pytest
from pyspark.sql import functions as F
from tidegauge.contract import Contract
from tidegauge.errors import UnknownAlertError
from tidegauge.operators import alerts, quality


def test_unknown_alert_is_an_error_when_checked(spark):
    known = spark.createDataFrame([("a",), ("a",)], "alert_id string")
    changes = spark.createDataFrame([("a", "open", 1), ("b", "open", 2), (None, "open", 3)], "alert_id string, state string, updated_at long")
    with pytest.raises(UnknownAlertError):
        alerts.state_changes(known, changes)
    assert [tuple(r) for r in alerts.state_changes(known, changes, check=False).collect()] == [("a", "open", 1)]


@pytest.mark.parametrize("bad,more", [(20, None), (33, "and 13 more")])
def test_message_says_how_many_labels_are_not_shown(spark, bad, more):
    rows = spark.range(bad).select((F.col("id") + 100).alias("label"))
    (reason,) = [r for r in quality.failures(rows, Contract(label_column="label", label_mapping={"x": 0})) if r.startswith("invalid label")]
    assert (more in reason) if more else "more" not in reason
