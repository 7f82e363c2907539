"""Archives from the command line: python -m blockframe -z|-d|-l|-t|-b FILE..., --train FILE... Inputs are never deleted. Without files, or for -, standard input and output are used.

Many files (-m, -r) are handled one after the other on this machine; for a cluster's files there is the data source `blkarc`.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Iterator

from blockframe import api
from blockframe.functions import codec, wire
from blockframe.streaming import files

SUFFIX, DICT_SUFFIX = ".blk", ".dict"


def _sizes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20}
    return int(text[:-1]) * units[text[-1].lower()] if text[-1:].lower() in units else int(text)


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("blockframe", description=__doc__)
    what = p.add_mutually_exclusive_group()
    for short, long, text in (("-z", "--compress", "make archives (the default)"), ("-d", "--decompress", "restore contents"), ("-l", "--list", "list archives and dictionaries"), ("-t", "--test", "check archives"), ("-b", "--bench", "time both ways")):
        what.add_argument(short, long, dest="what", action="store_const", const=long[2:], help=text)
    what.add_argument("--train", dest="what", action="store_const", const="train", help="a dictionary from the files")
    for level in range(api.min_level(), api.max_level() + 1):
        p.add_argument(f"-{level}", dest="level", action="store_const", const=level, help=f"level {level}")
    p.add_argument("-B", "--block-size", type=_sizes, default=wire.DEFAULT_BLOCK, help="a power of two from 4k to 2m")
    p.add_argument("-C", "--checksum", dest="checksum", action="store_true", default=True, help="with checksums (the default)")
    p.add_argument("-N", "--no-checksum", dest="checksum", action="store_false")
    p.add_argument("-S", "--seekable", action="store_true", help="with a seek table")
    p.add_argument("-D", "--dict", help="a saved dictionary")
    p.add_argument("-o", "--output", help="where to write; with several files a folder")
    p.add_argument("-c", "--stdout", action="store_true")
    p.add_argument("-f", "--force", action="store_true", help="overwrite")
    p.add_argument("-k", "--keep", action="store_true", help="inputs are always kept")
    p.add_argument("-m", "--multiple", action="store_true", help="several files are always taken")
    p.add_argument("-r", "--recursive", action="store_true", help="files of folders; archives are left out when compressing")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-j", "--json", action="store_true", help="lists as JSON")
    p.add_argument("--progress", action="store_true")
    p.add_argument("--runs", type=int, default=3, help="of a bench")
    p.add_argument("files", nargs="*")
    return p


def walk(paths: list[str], recursive: bool, what: str) -> Iterator[str]:
    for path in paths:
        if not os.path.isdir(path):
            yield path
            continue
        if not recursive:
            raise IsADirectoryError(f"{path} is a folder; -r takes its files")
        for top, folders, names in os.walk(path):
            folders.sort()
            for name in sorted(names):
                if name.endswith(SUFFIX) != (what == "compress"):
                    yield os.path.join(top, name)


def listing(path: str) -> dict:
    """What is known of an archive or a saved dictionary without decoding it."""
    with open(path, "rb") as f:
        size, head = os.fstat(f.fileno()).st_size, f.read(16)
        if api.dict_get_id(head):
            f.seek(0)
            own = codec.Dictionary.load(f.read())
            return {"type": "dictionary", "filename": path, "dict_id": f"0x{own.id:08X}", "content_size_bytes": len(own.content), "file_size_bytes": size}
        f.seek(max(0, size - 12))
        foot = f.read(12)
    seen = codec.directory(head, foot, size)
    return {
        "type": "archive", "filename": path, "compressed_size_bytes": size, "uncompressed_size_bytes": seen["decompressed_size"], "compression_ratio": round(seen["decompressed_size"] / size, 3),
        "format_version": seen["version"], "block_size_kb": seen["block_size"] // 1024, "blocks": seen["n_blocks"], "has_checksum": seen["checksums"], "dict_id": None if seen["dict_id"] is None else f"0x{seen['dict_id']:08X}",
    }


def bench(path: str, made: codec.Options, runs: int) -> dict:
    """MB (10^6 bytes) of content a second, the best of runs each way, and content to stored bytes."""
    with open(path, "rb") as f:
        data = f.read()
    there, back = [], []
    for _ in range(max(1, runs)):
        began = time.perf_counter()
        archive = codec.encode(data, made)
        middle = time.perf_counter()
        if codec.decode(archive, made.dictionary) != data:
            raise api.ArchiveError("CORRUPT_DATA")
        there.append(middle - began)
        back.append(time.perf_counter() - middle)
    return {"filename": path, "level": made.level, "bytes": len(data), "archive_bytes": len(archive), "ratio": round(len(data) / len(archive), 3), "compress_mb_s": round(len(data) / 1e6 / min(there), 2), "decompress_mb_s": round(len(data) / 1e6 / min(back), 2)}


def main(argv: list[str] | None = None) -> int:
    given = options().parse_args(argv)
    what, level = given.what or "compress", given.level or api.default_level()
    say = (lambda *_: None) if given.quiet else lambda *parts: print(*parts, file=sys.stderr)
    failed = 0
    try:
        dictionary = codec.NO_DICT
        if given.dict:
            with open(given.dict, "rb") as f:
                dictionary = codec.Dictionary.load(f.read())
        made = codec.Options(level, given.block_size, given.checksum, given.seekable, dictionary)
        paths = list(walk(given.files, given.recursive, what)) or ["-"]
        if what == "train":
            samples = []
            for path in paths:
                with open(path, "rb") as f:
                    samples.append(f.read())
            out = given.output or f"trained{DICT_SUFFIX}"
            with open(out, "wb" if given.force else "xb") as f:
                f.write(api.Dictionary.train(samples).save())
            say(f"{out}: dictionary 0x{listing(out)['dict_id'][2:]}")
            return 0
    except (OSError, api.ArchiveError) as e:
        say(f"error: {e}")
        return 1
    for path in paths:
        try:
            _one(path, what, given, made, len(paths) > 1, say)
        except (OSError, api.ArchiveError) as e:
            say(f"error: {path}: {e}")
            failed = 1
    return failed


def _target(path: str, what: str, given, many: bool) -> str | None:
    """Where the result goes; None is standard output."""
    if given.stdout or path == "-" and not given.output:
        return None
    name = f"{path}{SUFFIX}" if what == "compress" else path.removesuffix(SUFFIX) if path.endswith(SUFFIX) else f"{path}.out"
    if given.output:
        return os.path.join(given.output, os.path.basename(name)) if many or os.path.isdir(given.output) else given.output
    return name


def _one(path: str, what: str, given, made: codec.Options, many: bool, say) -> None:
    if what in ("list", "bench"):
        seen = listing(path) if what == "list" else bench(path, made, given.runs)
        print(json.dumps(seen) if given.json else "  ".join(f"{k}={v}" for k, v in seen.items() if given.verbose or what == "bench" or k not in ("format_version", "blocks")))
        return
    progress = (lambda done, total: say(f"\r{path}: {done} of {'?' if total is None else total} bytes")) if given.progress else None
    target = None if what == "test" else _target(path, what, given, many)
    source = sys.stdin.buffer if path == "-" else open(path, "rb")  # noqa: SIM115
    sink = None if what == "test" else sys.stdout.buffer if target is None else open(target, "wb" if given.force else "xb")  # noqa: SIM115
    good = False
    try:
        if what == "compress":
            size = files.compress_file(source, sink, made, progress)
        else:
            size = files.decompress_file(source, sink, progress, made.dictionary)
        good = True
    finally:
        if path != "-":
            source.close()
        if target is not None:
            sink.close()
            if not good:
                os.remove(target)  # this run's own, unfinished
    if given.verbose or what == "test":
        say(f"{path}: OK, {size} bytes")


if __name__ == "__main__":
    sys.exit(main())
