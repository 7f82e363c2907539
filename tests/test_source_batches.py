"""The data source codes small archives together, with the same bytes."""

from blockframe.functions import codec, matches
from blockframe.sources.archive import ArchiveReader, ArchiveWriter


def test_small_archives_go_together(tmp_path, monkeypatch):
    calls = {"lines": 0, "rebuilt": 0}
    line, rebuild = matches.Line.__init__, codec.rebuild
    monkeypatch.setattr(matches.Line, "__init__", lambda self, *a: (calls.update(lines=calls["lines"] + 1), line(self, *a))[1])
    monkeypatch.setattr(codec, "rebuild", lambda *a: (calls.update(rebuilt=calls["rebuilt"] + 1), rebuild(*a))[1])
    rows = [(f"n{i}", b"some words that come again, again and again %d " % i * (i % 7)) for i in range(300)] + [("large", b"x" * 3_000_000), ("last", None)]
    writer = ArchiveWriter({"path": f"{tmp_path}/a", "block_size": "4096"}, False)
    writer.commit([writer.write(iter(rows))])
    reader = ArchiveReader({"path": f"{tmp_path}/a", "mode": "bytes"})
    got = {path.rsplit("/", 1)[1].removesuffix(".blk"): data for part in reader.partitions() for path, data in reader.read(part)}
    assert got == {name: data or b"" for name, data in rows}
    assert calls["lines"] < 60 and calls["rebuilt"] < 60  # some 24 each are the large one's
    made = codec.encode(rows[5][1], codec.Options(3, 4096, True, True))
    assert (tmp_path / "a" / "n5.blk").read_bytes() == made
