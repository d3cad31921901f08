"""Streams over a table that is a folder of part files, as larger tables are."""

import pytest

import __spark_entry__ as entry
from inciflow.plans.stream_queries import _stream
from inciflow.streaming import jobs as J
from tests.conftest import SF


@pytest.fixture
def in_parts(spark, tmp_path):
    """conversations and events dealt over part files; part is one file, as given."""
    for name in ("conversations", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "part.parquet").symlink_to(f"{SF}/part.parquet")
    return str(tmp_path)


def test_stream_reads_every_part_file(spark, in_parts, tmp_path):
    for sf in (SF, in_parts):
        out = f"{tmp_path}/out-{sf == SF}"
        J.run_to_end(_stream(spark, sf, "events"), f"{out}-checkpoint", path=out)
        assert spark.read.parquet(out).count() == spark.read.parquet(f"{sf}/events.parquet").count() > 0


def test_submissions_stream_over_part_files(spark, in_parts):
    rows = lambda sf: sorted(map(tuple, entry.queries()["j1_submissions_stream"](spark, sf).collect()))
    assert rows(in_parts) == rows(SF) != []
