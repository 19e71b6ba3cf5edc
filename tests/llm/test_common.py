import os
import zlib

from pyspark.sql import functions as F

from paperloom.llm import common


def test_fold_and_words(spark):
    frame = spark.createDataFrame([(5, " a\tb\x0bc d\n"), (None, None), (12, ""), (-3, "é ﻿")], "doc_id long, text string")
    got = {r.doc_id: (r.f, r.w) for r in frame.select("doc_id", common.fold(F.col("doc_id"), 5).alias("f"), common.word_count(F.col("text")).alias("w")).collect()}
    assert got == {5: (zlib.crc32(b"5") % 5, 4), None: (0, 0), 12: (zlib.crc32(b"12") % 5, 0), -3: (zlib.crc32(b"-3") % 5, 2)}


def test_written_tables_live_in_the_shared_folder(spark):
    mine, other = common.Scratch(spark, "test"), common.Scratch(spark, "test")
    first = mine.write(spark.range(3).toDF("x"), "a")
    last, theirs = mine.write(first.where("x > 0"), "b"), other.write(first, "a")
    place = mine.base.removeprefix("file://")
    assert place.startswith(common.shared_dir(spark).removeprefix("file://"))
    mine.drop("a", "never written")
    assert os.listdir(place) == ["b"] and last.count() == 2 and theirs.count() == 3
    assert common.materialize(spark.range(0).toDF("x"), "test-c").count() == 0


def test_shuffle_files_go_and_the_setting_stays(spark):
    before = spark.conf.get(common._CLEANUP, None)
    assert common.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test-d").count() == 7
    assert spark.conf.get(common._CLEANUP, None) == before


def test_batches_are_bounded(spark):
    common.bound_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 * 1024 * 1024


def test_pages_of_long_rows_are_bounded(spark):
    """Rows of 256 kB: no page of 100 of them."""
    written = common.Scratch(spark, "test").write(spark.range(0, 110, 1, 1).select(F.expr("repeat(sha2(cast(id as string), 512), 2048)").alias("t")), "long")
    jvm, hadoop, sizes = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    (file,) = written.inputFiles()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), hadoop))
    column = reader.getFileMetaData().getSchema().getColumns().get(0)
    while (group := reader.readNextRowGroup()) is not None:
        pages = group.getPageReader(column)
        while (page := pages.readPage()) is not None:
            sizes.append(page.getUncompressedSize())
    reader.close()
    assert sum(sizes) > 110 * 256 * 1024 and max(sizes) <= 2 << 20
