"""Vector files read as they arrive."""

import numpy as np
import pytest

from helpers import random_rows, vectors
from nearfield.sources import vector_files as VF
from nearfield.streaming.ingest import keep_stream


def arrive(spark, folder, prefix, n, seed, fmt="fbin", files=2):
    rows = [(i, np.round(v * 100)) for i, v in random_rows(n, 3, seed)]
    VF.write_vectors(vectors(spark, rows), str(folder), fmt, files=files, prefix=prefix)
    return [[float(x) for x in v] for _, v in rows]


def run(spark, folder, tmp_path, fmt="fbin"):
    stream = VF.stream_vectors(spark, str(folder), fmt, rowsPerPartition="4")
    keep_stream(stream, str(tmp_path / "kept"), str(tmp_path / "state"), every=None).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "kept")).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows)))
    return [[float(x) for x in r["vector"]] for r in rows], {r["batch"] for r in rows}


@pytest.mark.parametrize("fmt", ["fbin", "ibin"])
def test_ids_go_on_over_batches_and_restarts(spark, tmp_path, fmt):
    folder = tmp_path / "arrived"
    want = arrive(spark, folder, "0-", 11, 1, fmt)
    assert run(spark, folder, tmp_path, fmt) == (want, {0})
    assert run(spark, folder, tmp_path, fmt) == (want, {0})  # nothing new, no batch
    want += arrive(spark, folder, "1-", 7, 2, fmt, files=1)
    want += arrive(spark, folder, "2-", 1, 3, fmt, files=1)
    got, batches = run(spark, folder, tmp_path, fmt)
    assert got == want and batches == {0, 1}


def test_a_batch_that_runs_again_leaves_no_doubles(spark, tmp_path):
    folder = tmp_path / "arrived"
    want = arrive(spark, folder, "0-", 9, 1)
    run(spark, folder, tmp_path)
    (tmp_path / "state" / "commits" / "0").unlink()  # as if the driver was lost before it noted the end
    for crc in (tmp_path / "state" / "commits").glob("*.crc"):
        crc.unlink()
    assert run(spark, folder, tmp_path) == (want, {0})
    want += arrive(spark, folder, "1-", 4, 2)
    assert run(spark, folder, tmp_path) == (want, {0, 1})


def test_a_file_that_comes_before_those_read_is_an_error(spark, tmp_path):
    folder = tmp_path / "arrived"
    arrive(spark, folder, "5-", 5, 1)
    run(spark, folder, tmp_path)
    arrive(spark, folder, "4-", 5, 2)
    with pytest.raises(Exception, match="has come in, or is gone"):
        run(spark, folder, tmp_path)
