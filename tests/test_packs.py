"""Content packs, combined sources, reports."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import dedup_report
from tidewright.plans import packs
from tidewright.queries import assess, migrate
from tidewright.sources import combined


def test_round_trip_and_checksum():
    text = packs.export_pack({"m": migrate.MAPPING}, assess.RULES, {"s": assess.FILTERED})
    mappings, exclusions, specs = packs.import_pack(text)
    assert mappings["m"].rules == migrate.MAPPING.rules and mappings["m"].status == "DRAFT" and exclusions == assess.RULES and specs["s"] == assess.FILTERED
    changed = json.loads(text)
    changed["body"]["version"] = 2
    with pytest.raises(ValueError):
        packs.import_pack(json.dumps(changed))


def test_content_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert combined.content(df) == combined.content(df.orderBy(F.desc("k")))
    assert combined.content(df) != combined.content(df.where("k = 1").unionByName(df.where("k = 2").limit(1)).unionByName(df.where("k = 1")))
    assert combined.content(df.limit(0))["rows"] == 0


def test_report(spark):
    records = spark.createDataFrame([(i,) for i in range(6)], "rn int")
    result = spark.createDataFrame([(0, 1, False, "EXACT"), (1, 1, True, "EXACT"), (2, 1, True, "NAME_ONLY")], "id int, cluster_no int, is_child boolean, match_strength string")
    row = dedup_report.report(records, result, "rn").first()
    assert (row["records"], row["clusters"], row["children"], row["largest_cluster"], row["children_exact"], row["merge_rate"], row["high_merge_rate"]) == (6, 1, 2, 3, 1, 0.3333, True)
    empty = dedup_report.report(records.limit(0), result.limit(0), "rn").first()
    assert (empty["records"], empty["clusters"], empty["children"], empty["merge_rate"]) == (0, 0, 0, 0.0)
