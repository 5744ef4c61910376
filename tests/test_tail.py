import os

import pytest

from tidelog.streaming import ingest, tail


def lines(batch):
    return sorted(r["value"] for r in batch)


def test_growing_rotated_and_cut_files(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    log = src / "app.log"

    def run():
        seen.clear()
        ingest.into_batches(tail.tail_growing(spark, str(src), pattern="app.log*"), str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect())).awaitTermination(120)
        return lines(seen)

    log.write_text("one\ntwo\nhal")
    (src / "other.txt").write_text("no\n")
    assert run() == ["one", "two"] and run() == []
    with log.open("a") as f:
        f.write("f\nthree\n")
    assert run() == ["half", "three"]
    with log.open("a") as f:
        f.write("last of the old\n")
    log.rename(src / "app.log.1")  # rotation
    log.write_text("first of the new\n\n")
    assert run() == ["", "first of the new", "last of the old"]
    with open(log, "r+") as f:  # cut off and begun anew
        f.truncate(0)
        f.write("anew\n")
    assert run() == ["anew"] and run() == []
    os.remove(src / "app.log.1")
    assert run() == []


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_ranges_part_no_line(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "RANGE", size)
    monkeypatch.setattr(tail, "BACK", 2)
    text = "a\n\nbcdef\nlong line of many words\n\nx\nrest"
    (tmp_path / "f").write_text(text)
    reader = tail.TailReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert [r[3] for r in sorted(rows, key=lambda r: r[2])] == text.split("\n")[:-1] and all(text.encode()[r[2] :].startswith(r[3].encode() + b"\n") for r in rows)


def test_bytes_per_trigger(tmp_path):
    (tmp_path / "f").write_text("12345\n" * 10)
    reader = tail.TailReader({"path": str(tmp_path), "bytesPerTrigger": "20"})
    at, got = reader.initialOffset(), []
    for _ in range(5):
        end = reader.latestOffset()
        got.append(sum(1 for p in reader.partitions(at, end) for _ in reader.read(p)))
        at = end
    assert got == [3, 3, 3, 1, 0]
    with (tmp_path / "f").open("a") as f:
        f.write("a line of more than twenty bytes\nb\nunfinished line of more than twenty bytes")
    for want in (1, 1, 0):
        end = reader.latestOffset()
        assert sum(1 for p in reader.partitions(at, end) for _ in reader.read(p)) == want
        at = end
