"""Archives from the command line."""

import json

import pytest

from blockframe.__main__ import main

TEXT = b"a line that comes again and again, with a number\n" * 3000


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(TEXT)
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(TEXT[:100])
    (tmp_path / "in" / "empty").write_bytes(b"")
    return tmp_path / "in"


def test_round_trip(folder, capsys):
    path = str(folder / "a.txt")
    assert main(["-z", "-5", "-S", "-B", "4k", path]) == 0 and (folder / "a.txt").exists()
    assert main(["-z", path]) == 1  # it is there
    assert main(["-t", f"{path}.blk"]) == 0 and main(["-d", "-o", str(folder / "back"), f"{path}.blk"]) == 0
    assert (folder / "back").read_bytes() == TEXT
    capsys.readouterr()
    assert main(["-l", "-j", f"{path}.blk"]) == 0
    seen = json.loads(capsys.readouterr().out)
    assert seen["uncompressed_size_bytes"] == len(TEXT) and seen["has_checksum"] and seen["blocks"] == -(-len(TEXT) // 4096) and seen["compression_ratio"] > 3


def test_damage(folder, capsys):
    path = folder / "a.txt"
    main(["-z", str(path)])
    made = bytearray((folder / "a.txt.blk").read_bytes())
    made[40] ^= 1
    (folder / "bad.blk").write_bytes(made)
    assert main(["-t", str(folder / "bad.blk")]) == 1 and "BAD_CHECKSUM" in capsys.readouterr().err
    assert main(["-d", str(folder / "bad.blk")]) == 1 and not (folder / "bad").exists()
    assert main(["-t", str(folder / "a.txt.blk"), str(folder / "none.blk")]) == 1


def test_folders(folder, tmp_path, capsys):
    assert main(["-z", str(folder)]) == 1
    assert main(["-z", "-r", str(folder)]) == 0
    assert main(["-z", "-r", "-f", str(folder)]) == 0  # archives are left out
    assert sorted(p.name for p in folder.rglob("*.blk")) == ["a.txt.blk", "b.txt.blk", "empty.blk"]
    (tmp_path / "out").mkdir()
    assert main(["-d", "-r", "-o", str(tmp_path / "out"), str(folder)]) == 0
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a.txt": TEXT, "b.txt": TEXT[:100], "empty": b""}


def test_dictionary_and_bench(folder, tmp_path, capsys):
    own = str(tmp_path / "words.dict")
    assert main(["--train", "-o", own, str(folder / "a.txt"), str(folder / "deep" / "b.txt")]) == 0
    path = str(folder / "deep" / "b.txt")
    assert main(["-z", "-6", "-D", own, path]) == 0 and main(["-d", f"{path}.blk", "-o", str(tmp_path / "x")]) == 1
    assert "DICT_REQUIRED" in capsys.readouterr().err and not (tmp_path / "x").exists()
    assert main(["-d", "-D", own, f"{path}.blk", "-o", str(tmp_path / "x"), "--progress"]) == 0 and (tmp_path / "x").read_bytes() == TEXT[:100]
    capsys.readouterr()
    assert main(["-l", "-j", own, f"{path}.blk"]) == 0
    first, second = map(json.loads, capsys.readouterr().out.splitlines())
    assert first["type"] == "dictionary" and first["dict_id"] == second["dict_id"]
    assert main(["-b", "-j", "--runs", "1", str(folder / "a.txt")]) == 0
    seen = json.loads(capsys.readouterr().out)
    assert seen["ratio"] > 3 and seen["compress_mb_s"] > 0 and seen["decompress_mb_s"] > 0
