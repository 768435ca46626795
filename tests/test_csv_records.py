"""CSV records across splits against Python's csv module."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators.labels import CSV_COLUMNS, read_labelled_csv
from tierflow.sources import sinks as K
from tierflow.sources.csv_records import csv_records, _lines


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _parsed(texts):
    return sorted(tuple(next(csv.reader(io.StringIO(t, newline="")))) for t in texts)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_splits(spark, tmp_path, small_splits, end):
    rnd = random.Random(7)
    pieces = ['"', '""', "\n", "\n\n", ",", "a", "word word", "é", " ", "x" * 90, "\\", "\\\""]
    rows = [(str(i), "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))) for i in range(300)]
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["key", "text"])
            w.writerows(rows[part::2])
            f.write(end)                                        # an empty line is no record
    assert _lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 50
    got = [r["record"] for r in csv_records(spark, str(tmp_path)).collect()]
    assert _parsed(got) == sorted(rows)
    with_header = csv_records(spark, str(tmp_path), header=False).count()
    assert with_header == len(rows) + 2


def test_one_record_over_many_splits_and_no_records(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('key,text\n1,"' + "line\n" * 200 + '"\n2,b', encoding="utf-8")
    (tmp_path / "b.csv").write_text("key,text\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    got = _parsed(r["record"] for r in csv_records(spark, str(tmp_path)).collect())
    assert got == [("1", "line\n" * 200), ("2", "b")]


def test_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,text\n1,"open\n2,b\n', encoding="utf-8")
    with pytest.raises(ValueError):
        csv_records(spark, str(tmp_path))


def test_labelled_csv_written_and_read(spark, tmp_path, small_splits):
    texts = [" outer spaces ", 'quote " and "" two', "a,b\nc\r\nd", "\n", "back\\slash\\", 'end \\"', "\ttab", None, "", "NA"]
    df = spark.createDataFrame([(k, "s", "x", t, "tier_1", 0.5, 0.25, 1.0, "train" if k % 2 else "test")
                                for k, t in enumerate(texts)],
                               "key long, source_dataset string, dataset_level string, prompt string, routing_label string, "
                               "tier_1_score double, tier_2_score double, tier_3_score double, split string")
    path = str(tmp_path / "csv")
    K.write_labelled_csv(df, path, CSV_COLUMNS)
    back = {int(r["key"]): r["prompt"] for r in read_labelled_csv(spark, path).collect()}
    assert back == {k: None if t in ("", "NA") else t for k, t in enumerate(texts)}
    # a split written again replaces only itself
    K.write_labelled_csv(df.where(F.col("key") == 1), path, CSV_COLUMNS)
    assert {int(r["key"]) for r in read_labelled_csv(spark, path).collect()} == {0, 1, 2, 4, 6, 8}
