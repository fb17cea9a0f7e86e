"""CSV files that one task reads."""

from siftrank.sources import readers, writers
from siftrank.sources.records import largest_file


def test_files_of_texts_stay_short(spark, tmp_path):
    """A task that writes many texts makes several files, none too long for one task to read."""
    rows = [(i, None if i == 5 else f"line {i}\n\"quoted\", " + "é" * 500) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "texts.csv")
    writers.write_scores(df, path, "csv", file_rows=writers.rows_per_file(df, 1 << 16))
    assert largest_file(spark, path) < 1 << 17
    back = readers.read_table(spark, path, empty_as_null=False)
    assert sorted((int(r.doc_id), r.text) for r in back.collect()) == [(i, t or "") for i, t in rows]
    assert writers.rows_per_file(df.limit(0)) >= 1
