"""The block codec: sequences of literals and matches, sections, archives of blocks and their checks. Blocks are encoded many at once."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from operator import add

import numpy as np

from blockframe.functions import chains, matches, wire
from blockframe.functions.huffman import Tree, code_lengths, nudged, pack_lengths, unpack_lengths
from blockframe.functions.wire import ArchiveError

MIN_MATCH, MAX_DISTANCE = matches.MIN_MATCH, matches.MAX_DISTANCE
#: Bytes of blocks that are searched for matches at once (a larger block alone).
TOGETHER = 1 << 17
#: Bits that a match costs: its token and a distance of two bytes.
MATCH_BITS = 24
#: How often the cheapest path is sought.
PATHS = {6: 2, 7: 3}
#: By level: candidates looked at for a match, and whether the next position may offer a longer one (levels 6 and 7 weigh whole paths instead).
EFFORT = {1: (1, False), 2: (2, False), 3: (3, True), 4: (6, True), 5: (16, True), 6: (32, True), 7: (64, True)}
#: Cost in 1/256 bytes for each literal of an encoding that decodes slower than raw bytes, below level 6 and from there on.
PREMIUM = {wire.LIT_RAW: (0, 0), wire.LIT_RLE: (8, 1), wire.LIT_HUFFMAN: (8, 4), wire.LIT_SHARED: (8, 4)}
HUFFMAN_LEAST = 139


@dataclass(frozen=True)
class Dictionary:
    content: bytes = b""
    table: bytes | None = None  # packed code lengths for literals

    @property
    def id(self) -> int:
        if not self.content:
            return 0
        own = wire.checksum(self.content)
        return own if self.table is None else wire.checksum(self.table, own)

    def save(self) -> bytes:
        if not self.content or len(self.content) > 65_535:
            raise ArchiveError("DICT_TOO_LARGE" if self.content else "SRC_TOO_SMALL")
        table = self.table or bytes(128)
        head = struct.pack("<IBBHI", wire.DICT_MAGIC, 1, 0, len(self.content), Dictionary(self.content, table).id)
        return head + b"\0\0" + struct.pack("<H", wire.hash16(head + b"\0\0\0\0")) + self.content + table

    @classmethod
    def load(cls, data: bytes) -> Dictionary:
        if len(data) < 16:
            raise ArchiveError("SRC_TOO_SMALL")
        magic, version, _, size, number = struct.unpack_from("<IBBHI", data)
        if magic != wire.DICT_MAGIC:
            raise ArchiveError("BAD_MAGIC")
        if version != 1:
            raise ArchiveError("BAD_VERSION")
        if not size or len(data) < 16 + size + 128:
            raise ArchiveError("SRC_TOO_SMALL")
        if wire.hash16(data[:12] + b"\0\0\0\0") != struct.unpack_from("<H", data, 14)[0]:
            raise ArchiveError("BAD_HEADER")
        out = cls(data[16 : 16 + size], data[16 + size : 16 + size + 128])
        if out.id != number:
            raise ArchiveError("DICT_MISMATCH")
        return out


def dictionary_id(data: bytes) -> int:
    """The id that a saved dictionary states, 0 if data are none; nothing but the magic number is checked."""
    return struct.unpack_from("<I", data, 8)[0] if len(data) >= 16 and data[:4] == struct.pack("<I", wire.DICT_MAGIC) else 0


NO_DICT = Dictionary()


# -- matches ----------------------------------------------------------------------------------------------------


def find(line: matches.Line, level: int, exact: bool = False) -> matches.Found:
    """exact: by the published encoder's rules (levels 1 to 5), else faster ones."""
    if exact:
        return chains.exact(line, level)
    tries, lazy = EFFORT[level]
    return cheapest(line, level) if level >= 6 else line.greedy(tries, lazy)


def parse(data: bytes, start: int, level: int) -> tuple[list[tuple[int, int, int]], int]:
    """Sequences (literals before, match length, distance) that cover data from start on, and where the literals after the last one begin. What is before start serves as a dictionary."""
    line = matches.Line([data[start:]], data[:start])
    found = find(line, level)
    rest = int(found.at[-1] + found.length[-1]) if len(found.at) else start
    return list(zip(found.literals.tolist(), found.length.tolist(), found.distance.tolist(), strict=True)), rest


def _bits(values: np.ndarray, n: int, most: float) -> np.ndarray:
    """What each of n values costs by its share: its entropy, at most `most` bits."""
    share = np.bincount(values, minlength=n) / max(1, len(values))
    return np.minimum(most, -np.log2(np.maximum(share, 2.0**-most)))


def cheapest(line: matches.Line, level: int) -> matches.Found:
    """Each block's cheapest path over literals and matches, whole or cut. A path tells what literals, and at level 7 tokens, cost on the next."""
    lengths, distances = line.longest(EFFORT[level][0])
    at, size, counts = [], [], []
    for start, stop in zip(line.starts.tolist(), line.stops.tolist(), strict=True):
        steps = _path(line.data[start:stop], lengths[start:stop].tolist(), level)
        at += [start + a for a, _ in steps]
        size += [n for _, n in steps]
        counts.append(len(steps))
    place = np.array(at, np.int64)
    return line.sequences(place, np.array(size, np.int64), distances[place], np.array(counts, np.int64))


def _path(raw: np.ndarray, lengths: list[int], level: int) -> list[tuple[int, int]]:
    """Place and length of the matches on the cheapest path through one block."""
    n, one = len(raw), 15 + MIN_MATCH
    values, literals, tokens, out = raw.tolist(), raw, [MATCH_BITS] * 16, []
    for _ in range(PATHS[level]):
        bits = np.maximum(1, _bits(literals, 256, 8)).tolist() if len(literals) >= HUFFMAN_LEAST else [8] * 256
        cost, step = [0.0] * (n + 1), [1] * n
        for at in range(n - 1, -1, -1):
            least = bits[values[at]] + cost[at + 1]
            if length := lengths[at]:
                short = list(map(add, cost[at + MIN_MATCH : at + min(length + 1, one)], tokens))  # lengths that the token holds
                if (low := min(short)) < least:
                    least, step[at] = low, MIN_MATCH + short.index(low)
                if length >= one and (more := cost[at + length] + tokens[15] + 8 * len(wire.varint(length - one))) <= least:
                    least, step[at] = more, length
            cost[at] = least
        out, at, plain, runs, anchor = [], 0, np.ones(n, bool), [], 0
        while at < n:
            if step[at] > 1:
                out.append((at, step[at]))
                runs.append(at - anchor)
                plain[at : at + step[at]] = False
                anchor = at + step[at]
            at += step[at]
        literals = raw[plain]
        if level == 7 and len(out) >= HUFFMAN_LEAST:
            runs_, sizes = np.minimum(runs, 15), np.minimum(np.array(out)[:, 1] - MIN_MATCH, 15)
            tokens = (MATCH_BITS - 8 + _bits(runs_, 16, 8)[runs_].mean() + _bits(sizes, 16, 8)).tolist()
    return out


# -- literal sections -------------------------------------------------------------------------------------------


def rle_encode(data: bytes) -> bytes:
    """Runs of 4 to 131 as 0x80 | (n - 4) and the byte, other stretches of up to 128 as n - 1 and the bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    begin = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]]))
    size = np.diff(np.append(begin, len(raw)))
    out, plain = bytearray(), 0

    def flush(upto: int) -> None:
        nonlocal plain
        while plain < upto:
            n = min(128, upto - plain)
            out.append(n - 1)
            out.extend(data[plain : plain + n])
            plain += n

    for at, n in zip(begin[size >= 4].tolist(), size[size >= 4].tolist(), strict=True):
        flush(at)
        while n >= 4:
            k = min(131, n)
            out.append(0x80 | k - 4)
            out.append(data[at])
            at, n = at + k, n - k
        plain = at
    flush(len(data))
    return bytes(out)


def rle_decode(data: bytes, n: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        size = (head & 0x7F) + 4 if head & 0x80 else head + 1
        need = 1 if head & 0x80 else size
        part = data[at + 1 : at + 1 + need]
        if len(part) < need or len(out) + size > n:
            raise ArchiveError("CORRUPT_DATA")
        out += part * size if head & 0x80 else part
        at += 1 + need
    if len(out) != n:
        raise ArchiveError("CORRUPT_DATA")
    return bytes(out)


def _cost(kind: int, size: int, n: int, level: int) -> int:
    return size + (n * PREMIUM[kind][level >= 6] >> 8)


def encode_literals(data: bytes, level: int, table: bytes | None) -> tuple[int, bytes]:
    """The cheapest of raw bytes, runs, an own code and the dictionary's code."""
    n = len(data)
    options = [(_cost(wire.LIT_RAW, n, n, level), wire.LIT_RAW, data)]
    runs = rle_encode(data)
    options.append((_cost(wire.LIT_RLE, len(runs), n, level), wire.LIT_RLE, runs))
    if level >= 6 and n:
        raw = np.frombuffer(data, np.uint8)
        counts = np.bincount(raw, minlength=256)
        if n >= HUFFMAN_LEAST:
            lengths = nudged(counts, 8 if level == 6 else 11)
            tree = Tree(lengths)
            options.append((_cost(wire.LIT_HUFFMAN, 128 + tree.size(counts), n, level), wire.LIT_HUFFMAN, lambda: pack_lengths(lengths) + tree.encode(raw)))
        if table is not None and any(table):
            shared = unpack_lengths(table)
            if (shared[counts > 0] > 0).all():
                known = Tree(shared)
                options.append((_cost(wire.LIT_SHARED, known.size(counts), n, level), wire.LIT_SHARED, lambda: known.encode(raw)))
    _, kind, section = min(options, key=lambda o: (o[0], o[1]))
    return kind, section() if callable(section) else section


def decode_literals(kind: int, data: bytes, n: int, table: bytes | None) -> bytes:
    if kind == wire.LIT_RAW:
        return data
    if kind == wire.LIT_RLE:
        return rle_decode(data, n)
    if kind == wire.LIT_HUFFMAN:
        if len(data) < 128:
            raise ArchiveError("CORRUPT_DATA")
        return Tree(unpack_lengths(data)).decode(data[128:], n).tobytes()
    if kind == wire.LIT_SHARED:
        if table is None:
            raise ArchiveError("DICT_REQUIRED")
        return Tree(unpack_lengths(table)).decode(data, n).tobytes()
    raise ArchiveError("CORRUPT_DATA")


# -- blocks -----------------------------------------------------------------------------------------------------


def encode_payloads(blocks: list[bytes], level: int, dictionary: Dictionary = NO_DICT, exact: bool = False) -> list[tuple[int, bytes]]:
    """Block types and payloads: words of sequences at levels 1 and 2, separate streams above; raw bytes where that is not smaller."""
    line = matches.Line(blocks, dictionary.content)
    found = find(line, level, exact)
    texts, cap = line.texts(found), 255 if level <= 2 else 15
    more = matches.extras(found, cap)
    runs, sizes = np.minimum(found.literals, cap), np.minimum(found.length - MIN_MATCH, cap)
    bounds, out = found.bounds.tolist(), []
    if level <= 2:
        words = (runs << 24 | sizes << 16 | found.distance - 1).astype("<u4").tobytes()
    else:
        tokens_, far = (runs << 4 | sizes).astype(np.uint8), found.distance - 1
        wide = np.concatenate([[0], np.cumsum(far > 255)])
        near, full = far.astype(np.uint8).tobytes(), far.astype("<u2").tobytes()
    for data, text, extra, a, b in zip(blocks, texts, more, bounds[:-1], bounds[1:], strict=True):
        if level <= 2:
            kind, head, body = wire.GHI, struct.pack("<IIBBBB", b - a, len(text), 0, 0, 0, 0), words[4 * a : 4 * b]
            section = text
        else:
            lit, section = encode_literals(text, level, dictionary.table)
            raw = tokens_[a:b]
            tokens, tok = raw.tobytes(), 0
            if level == 7 and len(tokens) >= HUFFMAN_LEAST:
                counts = np.bincount(raw, minlength=256)
                lengths = nudged(counts)
                tree = Tree(lengths)
                if _cost(wire.LIT_HUFFMAN, 128 + tree.size(counts), len(tokens), level) < len(tokens):
                    tokens, tok = pack_lengths(lengths) + tree.encode(raw), 2
            narrow = bool(wide[b] == wide[a])
            head = struct.pack("<IIBBBB", b - a, len(text), lit, tok, 0, narrow)
            head += (struct.pack("<I", len(section)) if lit else b"") + (struct.pack("<I", len(tokens)) if tok else b"")
            kind, body = wire.GLO, tokens + (near[a:b] if narrow else full[2 * a : 2 * b])
        body += extra
        payload = head + section + body + bytes(max(0, wire.SLACK - len(body)))
        out.append((kind, payload) if 8 + len(payload) < len(data) else (wire.RAW, data))
    return out


def encode_payload(data: bytes, level: int, dictionary: Dictionary = NO_DICT) -> tuple[int, bytes]:
    return encode_payloads([data], level, dictionary)[0]


@dataclass(frozen=True)
class Parsed:
    """A block's literals and sequences, all checked; size: the bytes they stand for."""

    literals: np.ndarray
    runs: np.ndarray
    lengths: np.ndarray
    distances: np.ndarray
    size: int


_NONE = np.zeros(0, np.int64)


def decode_payload(kind: int, payload: bytes, most: int, dictionary: Dictionary = NO_DICT) -> bytes:
    """At most `most` bytes; every size and distance is checked."""
    return rebuild([parse_payload(kind, payload, most, dictionary)], dictionary)[0]


def rebuild(blocks: list[Parsed], dictionary: Dictionary = NO_DICT) -> list[bytes]:
    """The bytes of blocks. Without a dictionary, blocks are resolved together: each one's last literals count as a sequence without a match."""
    if dictionary.content:
        before = np.frombuffer(dictionary.content, np.uint8)
        return [matches.resolve(b.literals, before, b.runs, b.lengths, b.distances).tobytes() if len(b.runs) else b.literals.tobytes() for b in blocks]
    if len(blocks) == 1 and not len(blocks[0].runs):
        return [blocks[0].literals.tobytes()]
    rest = [len(b.literals) - int(b.runs.sum()) for b in blocks]
    runs = np.concatenate([x for b, n in zip(blocks, rest, strict=True) for x in (b.runs, [n])]).astype(np.int64)
    lengths = np.concatenate([x for b in blocks for x in (b.lengths, [0])]).astype(np.int64)
    distances = np.concatenate([x for b in blocks for x in (b.distances, [1])]).astype(np.int64)
    whole = matches.resolve(np.concatenate([b.literals for b in blocks]), np.zeros(0, np.uint8), runs, lengths, distances).tobytes()
    ends = np.cumsum([b.size for b in blocks]).tolist()
    return [whole[e - b.size : e] for b, e in zip(blocks, ends, strict=True)]


def parse_payload(kind: int, payload: bytes, most: int, dictionary: Dictionary = NO_DICT) -> Parsed:
    if kind == wire.RAW:
        if len(payload) > most:
            raise ArchiveError("DST_TOO_SMALL")
        return Parsed(np.frombuffer(payload, np.uint8), _NONE, _NONE, _NONE, len(payload))
    if kind not in (wire.GLO, wire.GHI):
        raise ArchiveError("BAD_BLOCK_TYPE")
    if len(payload) < 12:
        raise ArchiveError("SRC_TOO_SMALL")
    count, n, lit, tok, _, narrow = struct.unpack_from("<IIBBBB", payload)
    at = 12
    if kind == wire.GHI:
        lit_size, tok_size, off_size = n, 4 * count, 0
    else:
        if lit > 3 or tok not in (0, 2) or narrow > 1:
            raise ArchiveError("CORRUPT_DATA")
        lit_size, tok_size = n, count
        if len(payload) < 12 + 4 * (lit != 0) + 4 * (tok == 2):
            raise ArchiveError("CORRUPT_DATA")
        if lit:
            lit_size, at = struct.unpack_from("<I", payload, at)[0], at + 4
        if tok:
            tok_size, at = struct.unpack_from("<I", payload, at)[0], at + 4
        off_size = count * (1 if narrow else 2)
    if at + lit_size + tok_size + off_size > len(payload) or len(payload) - at - lit_size < wire.SLACK or n > most:
        raise ArchiveError("CORRUPT_DATA")
    literals = payload[at : at + lit_size]
    if kind == wire.GLO:
        literals = decode_literals(lit, literals, n, dictionary.table)
    at += lit_size
    section, at = payload[at : at + tok_size], at + tok_size
    if kind == wire.GHI:
        words = np.frombuffer(section, "<u4")
        runs, matches_, distances, cap = words >> 24, words >> 16 & 255, (words & 0xFFFF).astype(np.int64) + 1, 255
    else:
        tokens = np.frombuffer(decode_literals(wire.LIT_HUFFMAN, section, count, None) if tok else section, np.uint8)
        runs, matches_, cap = tokens >> 4, tokens & 15, 15
        distances = np.frombuffer(payload, "u1" if narrow else "<u2", count, at).astype(np.int64) + 1
        at += off_size
    runs, lengths, cut = runs.astype(np.int64), matches_.astype(np.int64) + MIN_MATCH, None
    longer = np.flatnonzero((runs == cap) | (lengths == cap + MIN_MATCH))
    if len(longer):
        try:
            for i, r, m in zip(longer.tolist(), (runs[longer] == cap).tolist(), (lengths[longer] == cap + MIN_MATCH).tolist(), strict=True):
                cut = i
                if r:
                    value, at = wire.read_varint(payload, at)
                    runs[i] += value
                if m:
                    value, at = wire.read_varint(payload, at)
                    lengths[i] += value
            cut = None
        except ArchiveError:  # what is wrong before counts first
            runs, lengths, distances = runs[:cut], lengths[:cut], distances[:cut]
    used, ends = np.cumsum(runs), np.cumsum(runs + lengths)
    wrong = np.flatnonzero((used > n) | (ends > most))
    lost = np.flatnonzero(distances > len(dictionary.content) + ends - lengths)
    if len(lost) and (not len(wrong) or lost[0] < wrong[0]):
        raise ArchiveError("BAD_OFFSET")
    if len(wrong) or cut is not None or n + int(lengths.sum()) > most:
        raise ArchiveError("CORRUPT_DATA")
    return Parsed(np.frombuffer(literals, np.uint8), runs, lengths, distances, n + int(lengths.sum()))


def encode_blocks(blocks: list[bytes], level: int = 3, *, checksums: bool = False, dictionary: Dictionary = NO_DICT, exact: bool = False) -> list[bytes]:
    """Blocks with their headers and, if asked for, their checksums."""
    level, out, at = 3 if level <= 0 else min(level, 7), [], 0
    while at < len(blocks):
        end, size = at, 0
        while end < len(blocks) and (end == at or size + len(blocks[end]) <= TOGETHER):
            size += len(blocks[end])
            end += 1
        for kind, payload in encode_payloads(blocks[at:end], level, dictionary, exact):
            out.append(wire.block_header(kind, len(payload)) + payload + (struct.pack("<I", wire.checksum(payload)) if checksums else b""))
        at = end
    return out


def encode_block(data: bytes, level: int = 3, *, checksums: bool = False, dictionary: Dictionary = NO_DICT) -> bytes:
    return encode_blocks([data], level, checksums=checksums, dictionary=dictionary)[0]


def decode_block(data: bytes, most: int = wire.MAX_BLOCK, *, checksums: bool = False, dictionary: Dictionary = NO_DICT) -> bytes:
    return rebuild([parse_block(data, most, checksums=checksums, dictionary=dictionary)], dictionary)[0]


def parse_block(data: bytes, most: int = wire.MAX_BLOCK, *, checksums: bool = False, dictionary: Dictionary = NO_DICT) -> Parsed:
    kind, size = wire.parse_block_header(data[:8])
    if len(data) < 8 + size + 4 * checksums:
        raise ArchiveError("SRC_TOO_SMALL")
    payload = data[8 : 8 + size]
    if kind == wire.EOF:
        raise ArchiveError("CORRUPT_DATA")
    if checksums and wire.checksum(payload) != struct.unpack_from("<I", data, 8 + size)[0]:
        raise ArchiveError("BAD_CHECKSUM")
    return parse_payload(kind, payload, most, dictionary)


# -- archives ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    level: int = 3
    block_size: int = wire.DEFAULT_BLOCK
    checksums: bool = True
    seekable: bool = False
    dictionary: Dictionary = field(default=NO_DICT)
    exact: bool = False

    def __post_init__(self):
        if not wire.MIN_BLOCK <= self.block_size <= wire.MAX_BLOCK or self.block_size & self.block_size - 1:
            raise ArchiveError("BAD_BLOCK_SIZE")
        if len(self.dictionary.content) > 65_535:
            raise ArchiveError("DICT_TOO_LARGE")


def assemble(blocks: list[bytes], size: int, options: Options) -> bytes:
    """An archive from its encoded blocks, in order."""
    total = 0
    if options.checksums:
        for b in blocks:
            total = wire.fold_block(total, struct.unpack("<I", b[-4:])[0])
    head = wire.file_header(options.block_size, checksums=options.checksums, dict_id=options.dictionary.id if options.dictionary.content else None)
    seek = wire.block_header(wire.SEK, 4 * len(blocks)) + b"".join(struct.pack("<I", len(b)) for b in blocks) if options.seekable else b""
    return head + b"".join(blocks) + wire.block_header(wire.EOF, 0) + seek + wire.footer(size, total)


def encode_many(contents: list[bytes], options: Options = Options()) -> list[bytes]:  # noqa: B008
    """An archive of each content; their blocks are encoded together."""
    size = options.block_size
    cut = [[data[i : i + size] for i in range(0, len(data), size)] for data in contents]
    made = iter(encode_blocks([b for own in cut for b in own], options.level, checksums=options.checksums, dictionary=options.dictionary, exact=options.exact))
    return [assemble([next(made) for _ in own], len(data), options) for own, data in zip(cut, contents, strict=True)]


def encode(data: bytes, options: Options = Options()) -> bytes:  # noqa: B008
    return encode_many([data], options)[0]


def decode(data: bytes, dictionary: Dictionary = NO_DICT, *, verify: bool = True) -> bytes:
    """The whole content; errors as ArchiveError. verify: check block and stream checksums, where the archive has them."""
    out = decode_many([data], dictionary, verify=verify)[0]
    if isinstance(out, ArchiveError):
        raise out
    return out


def decode_many(archives: list[bytes], dictionary: Dictionary = NO_DICT, *, verify: bool = True) -> list[bytes | ArchiveError]:
    """Of each archive its whole content or the error. Blocks of many archives, some TOGETHER bytes of content, are resolved together."""
    out: list[bytes | ArchiveError] = []
    waiting: list[tuple[int, list[Parsed]]] = []
    held = 0

    def flush() -> None:
        if waiting:
            use = dictionary if wire.parse_file_header(archives[waiting[0][0]])["dict_id"] is not None else NO_DICT
            made = iter(rebuild([b for _, blocks in waiting for b in blocks], use) if any(blocks for _, blocks in waiting) else [])
            for i, blocks in waiting:
                out[i] = b"".join([next(made) for _ in blocks])
            waiting.clear()

    for i, data in enumerate(archives):
        out.append(b"")
        try:
            blocks = _parse(data, dictionary, verify)
        except ArchiveError as e:
            out[i] = e
            continue
        size = sum(b.size for b in blocks)
        if waiting and (held + size > TOGETHER or wire.parse_file_header(data)["dict_id"] != wire.parse_file_header(archives[waiting[0][0]])["dict_id"]):
            flush()
            held = 0
        waiting.append((i, blocks))
        held += size
    flush()
    return out


def _parse(data: bytes, dictionary: Dictionary, verify: bool) -> list[Parsed]:
    """The checked blocks of an archive whose footer and checksums fit them."""
    head = wire.parse_file_header(data)
    check_dictionary(head["dict_id"], dictionary)
    use = dictionary if head["dict_id"] is not None else NO_DICT
    at, out, total = 16, [], 0
    while True:
        kind, size = wire.parse_block_header(data[at : at + 8])
        if kind == wire.EOF:
            if size:
                raise ArchiveError("BAD_HEADER")
            break
        if kind not in (wire.RAW, wire.GLO, wire.GHI):
            raise ArchiveError("BAD_BLOCK_TYPE")
        end = at + 8 + size + 4 * head["checksums"]
        block = data[at:end]
        out.append(parse_block(block, head["block_size"], checksums=head["checksums"] and verify, dictionary=use))
        if head["checksums"]:
            if len(block) < end - at:
                raise ArchiveError("SRC_TOO_SMALL")
            total = wire.fold_block(total, struct.unpack("<I", block[-4:])[0])
        at = end
    if len(data) < at + 20:
        raise ArchiveError("SRC_TOO_SMALL")
    size, stored = struct.unpack("<QI", data[-12:])
    if size != sum(b.size for b in out):
        raise ArchiveError("CORRUPT_DATA")
    if verify and head["checksums"] and stored != total:
        raise ArchiveError("BAD_CHECKSUM")
    return out


def check_dictionary(wanted: int | None, dictionary: Dictionary) -> None:
    if wanted is not None:
        if not dictionary.content:
            raise ArchiveError("DICT_REQUIRED")
        if dictionary.id != wanted:
            raise ArchiveError("DICT_MISMATCH")


def content_size(data: bytes, strict: bool = True) -> int:
    """Size of the content as the footer states it. strict: the whole header and the footer's plausibility are checked, else nothing but the magic number."""
    if strict:
        return index(data)["decompressed_size"]
    if len(data) < 28:
        raise ArchiveError("SRC_TOO_SMALL")
    if not wire.is_archive(data):
        raise ArchiveError("BAD_MAGIC")
    return struct.unpack("<Q", data[-12:-4])[0]


def index(data: bytes, strict: bool = True) -> dict:
    """Header fields and, of a seekable archive, the places of its blocks: comp_off, comp_size, decomp_off, decomp_size. Reads no payload. strict: the blocks' sizes must add up to where the content ends."""
    return directory(data[:16], data[16:], len(data), strict)


def directory(header: bytes, tail: bytes, stored: int, strict: bool = True) -> dict:
    """index() of an archive of `stored` bytes from its first 16 and its last ones: seek table and footer, or more."""
    head = wire.parse_file_header(header)
    if stored < 36:
        raise ArchiveError("SRC_TOO_SMALL")
    size, total = struct.unpack("<QI", tail[-12:])
    n = -(-size // head["block_size"])
    if n > stored // 8:
        raise ArchiveError("CORRUPT_DATA")
    head |= {"decompressed_size": size, "global_hash": total, "n_blocks": n, "seekable": False, "blocks": []}
    at, table = stored - 20 - 4 * n, tail[-20 - 4 * n : -12]
    if at >= 24 and len(table) == 8 + 4 * n and table[0] == wire.SEK and wire.hash8(table[:7] + b"\0") == table[7] and struct.unpack_from("<I", table, 3)[0] == 4 * n:
        sizes = np.frombuffer(table, "<u4", n, 8).astype(np.int64)
        offsets = 16 + np.concatenate([[0], np.cumsum(sizes)])
        if strict and ((sizes < 8).any() or offsets[-1] != at - 8):
            raise ArchiveError("CORRUPT_DATA")
        bs = head["block_size"]
        head["seekable"] = True
        head["blocks"] = [(int(offsets[i]), int(sizes[i]), i * bs, min(bs, size - i * bs)) for i in range(n)]
    return head


def read_range(data: bytes, offset: int, length: int, dictionary: Dictionary = NO_DICT, *, verify: bool = False) -> bytes:
    """Bytes [offset, offset + length) of a seekable archive; only the blocks that hold them are decoded."""
    if not length:
        return b""
    head = index(data)
    if offset + length > head["decompressed_size"] or not head["seekable"]:
        raise ArchiveError("SRC_TOO_SMALL")
    check_dictionary(head["dict_id"], dictionary)
    use = dictionary if head["dict_id"] is not None else NO_DICT
    first, last = offset // head["block_size"], (offset + length - 1) // head["block_size"]
    got = b"".join(decode_block(data[at : at + size], head["block_size"], checksums=verify and head["checksums"], dictionary=use) for at, size, _, _ in head["blocks"][first : last + 1])
    skip = offset - first * head["block_size"]
    return got[skip : skip + length]


def literal_counts(samples: list[bytes], content: bytes) -> np.ndarray:
    """How often each byte value is a literal when samples are matched against content at level 6."""
    if not samples:
        return np.zeros(256, np.int64)
    line = matches.Line(samples, content)
    return np.bincount(np.frombuffer(b"".join(line.texts(find(line, 6))), np.uint8), minlength=256)


def train_table(counts: np.ndarray) -> bytes:
    """Packed code lengths for literals that come so often; all zeros if there are none."""
    return pack_lengths(code_lengths(counts, 8)) if counts.any() else bytes(128)
