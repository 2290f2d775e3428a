"""Files that queries write for themselves: as many as the data asks for."""

from quizmill.catalog import io


def test_lines_are_not_dealt_to_a_fixed_number_of_files(spark):
    wide = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        path = io.jsonl_files(spark, "/root/testdata/sf0.001", bad=False)
        assert spark.read.text(path).selectExpr("_metadata.file_path AS f").distinct().count() == 9
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide)
        spark.conf.set("spark.sql.shuffle.partitions", before)
