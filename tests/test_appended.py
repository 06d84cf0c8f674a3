"""Lines of growing files, read as a stream."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.plans import audit_queries
from maskwright.sources import appended
from maskwright.sources.appended import LinesReader, Piece, follow_lines
from maskwright.sources.audit import follow_appended


def taken(reader, start):
    """One batch without Spark: the lines between an offset and the latest one."""
    end = reader.latestOffset()
    lines = [
        line
        for piece in reader.partitions(start, end)
        for batch in reader.read(piece)
        for line in batch.column("value").to_pylist()
    ]
    return lines, end


def append(path, text):
    with open(path, "ab") as file:
        file.write(text.encode())


@pytest.mark.parametrize("size", ["1", "7", "100000"])
def test_growth_rotation_and_truncation(tmp_path, size):
    log = tmp_path / "audit.log"
    reader = LinesReader({"path": str(log), "pieceBytes": size})
    assert taken(reader, {}) == ([], {})
    append(log, "no line end")
    assert taken(reader, {}) == ([], {})
    append(log, " yet\nsecond\r\nhal")
    lines, at = taken(reader, {})
    assert lines == ["no line end yet", "second"]
    append(log, "f and half é\n\nlast")
    lines, then = taken(reader, at)
    assert lines == ["half and half é", ""]
    assert taken(reader, at)[0] == lines  # a batch that is repeated
    append(log, " line\n")
    os.rename(log, tmp_path / "audit.log.1")
    append(log, "new log\nof two lines\n")
    append(tmp_path / "audit.log.1", "after all\n")
    lines, at = taken(reader, then)
    assert sorted(lines) == ["after all", "last line", "new log", "of two lines"]
    log.write_bytes(b"cut\n")
    lines, at = taken(reader, at)
    assert lines == ["cut"]
    os.remove(tmp_path / "audit.log.1")
    assert taken(reader, at)[0] == []
    append(tmp_path / "other.log", "not followed\n")
    assert taken(reader, at)[0] == []
    folder = LinesReader({"path": f"file://{tmp_path}", "pieceBytes": size})
    append(tmp_path / "_hidden", "hidden\n")
    assert Counter(taken(folder, {})[0]) == Counter(["cut", "not followed"])


def test_lines_longer_than_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "BLOCK", 10)
    monkeypatch.setattr(appended, "HEAD", 16)
    lines = ["x" * n for n in (0, 1, 9, 10, 11, 40, 15, 16, 17, 0)]
    append(tmp_path / "log", "\n".join(["y" * 50, *lines]) + "\n" + "z" * 90)
    for size in (1, 5, 10, 1000):
        reader = LinesReader({"path": str(tmp_path), "pieceBytes": str(size)})
        assert taken(reader, {})[0] == ["y" * 50, *lines]


def test_lost_lines(tmp_path):
    append(tmp_path / "log", "one\n")
    strict, loose = (LinesReader({"path": str(tmp_path), "failOnDataLoss": x}) for x in ("true", "false"))
    (piece,) = strict.partitions({}, strict.latestOffset())
    os.rename(tmp_path / "log", tmp_path / "renamed")
    assert [b.column("value").to_pylist() for b in strict.read(piece)] == [["one"]]
    os.remove(tmp_path / "renamed")
    assert list(loose.read(piece)) == []
    with pytest.raises(RuntimeError, match="gone"):
        list(strict.read(piece))
    assert isinstance(piece, Piece)


def test_stream_over_a_growing_log(spark, tmp_path):
    log, out = tmp_path / "audit.log", str(tmp_path / "out")
    row = '{"timestamp": "2024-01-01T00:00:0%dZ", "host": "h%d"}\n'

    def run():
        query = (
            follow_appended(spark, str(log))
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return sorted(r.host for r in spark.read.parquet(out).collect())

    append(log, row % (1, 1) + row % (2, 2) + (row % (3, 3))[:20])
    assert run() == ["h1", "h2"]
    assert run() == ["h1", "h2"]
    append(log, (row % (3, 3))[20:] + "{torn\n" + row % (4, 4))
    assert run() == ["h1", "h2", "h3", "h4"]
    os.rename(log, tmp_path / "audit.log.1")
    append(log, row % (5, 5))
    assert run() == ["h1", "h2", "h3", "h4", "h5"]


def test_one_stream_sees_lines_as_they_come(spark, tmp_path):
    append(tmp_path / "log", "a\nb\n")
    query = (
        follow_lines(spark, str(tmp_path / "log"))
        .writeStream.format("memory")
        .queryName("growing")
        .start()
    )
    try:
        query.processAllAvailable()
        append(tmp_path / "log", "c\n")
        query.processAllAvailable()
        rows = spark.sql("select value, offset from growing order by offset").collect()
        assert [tuple(r) for r in rows] == [("a", 0), ("b", 2), ("c", 4)]
    finally:
        query.stop()


def test_the_growing_log_has_more_files_as_it_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit_queries, "FILE_BYTES", 100)
    lines = spark.createDataFrame([(f"{i:04}" * 5,) for i in range(200)], "value string")
    files = audit_queries._log_files(lines)
    assert files == 42 and audit_queries._log_files(lines.limit(0)) == audit_queries.FILES
    placed = lines.withColumns({"file": F.pmod(F.xxhash64("value"), F.lit(files)), "round": F.lit(0)})
    audit_queries._grown(placed, str(tmp_path / "log"), 1, files)
    written = [p.read_text().splitlines() for p in (tmp_path / "log").iterdir()]
    assert sorted(sum(written, [])) == sorted(r.value for r in lines.collect())
    assert len(written) > 30 and max(map(len, written)) < 20
