"""Media columns: AVI motion-JPEG, from RIFF chunks to timed clips.

``write_avi`` stores frames of 8-bit grey samples as lossless-process JPEG
(SOF3, predictor 1) in a RIFF AVI file with an ``idx1`` index.  ``read_avi``
parses the headers and the index and gives the frames' JPEG bytes; every frame
is intra coded.  Files without ``idx1`` (such as those of several RIFF parts) are
read by walking their movie lists.  ``decode_frames`` undoes stuffing, Huffman codes and prediction
of many frames at once: all frames advance together, a sample a step, so numpy
works on whole columns and no Python loop runs over samples of one frame.
Ordinary motion-JPEG (sequential DCT, any frame size) goes to ``jpeg_dct``, a
frame at a time, for the grey samples of its first component.
``shots`` cuts where the histogram difference of neighbouring frames exceeds the
mean of the recent differences by a multiple of their spread.

``clips`` yields a row for each shot of each media value, with times.

Memory is bounded by ``batch_bytes`` of payload (or one payload, if larger); the
work arrays of coding are those of at most ``RUN`` frames, whatever the payload.

Defined cases: null text counts as empty; an empty payload is one frame of
padding; a media value that is null or not such an AVI file, or whose frames
differ in size, gives no clips and an error text; an empty frame, which such
files use for a repeat, repeats the one before; repeated rows give equal rows; an empty table gives an empty
result.  Only the id and the media column are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tasklattice.llm.common import small_batches
from tasklattice.llm.jpeg_dct import decode_grey

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
FPS = 25
PAD = 255
#: Frames that are coded or decoded at once.
RUN = 4096

#: Number of Huffman codes of each length 1 to 16 for the 12 difference categories
#: (the luminance DC table of the JPEG standard).
CODE_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Length and code of each category, by the standard's canonical rule."""
    lengths = np.repeat(np.arange(1, 17), CODE_COUNTS)
    codes, code = [], 0
    for k, n in enumerate(lengths):
        code <<= n - (lengths[k - 1] if k else n)
        codes.append(code)
        code += 1
    return lengths.astype(np.int64), np.array(codes, np.int64)


_LENGTH, _CODE = _codes()
_MAX = int(_LENGTH.max())


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255..255; length and category for each prefix of _MAX bits."""
    diff = np.arange(-255, 256)
    category = np.array([int(abs(d)).bit_length() for d in diff])
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    bits, n = (_CODE[category] << category) | extra, _LENGTH[category] + category
    prefix_length, prefix_category = np.zeros(1 << _MAX, np.int64), np.zeros(1 << _MAX, np.int64)
    for c, (length, code) in enumerate(zip(_LENGTH, _CODE, strict=True)):
        span = slice(code << (_MAX - length), (code + 1) << (_MAX - length))
        prefix_length[span], prefix_category[span] = length, c
    return bits, n, prefix_length, prefix_category


_BITS, _N, _PREFIX_LENGTH, _PREFIX_CATEGORY = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Start of image, frame of the lossless process, Huffman table, scan with predictor 1.
_HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes((1, 0x11, 0)))
    + _segment(0xC4, bytes((0x00, *CODE_COUNTS, *range(sum(CODE_COUNTS)))))
    + _segment(0xDA, bytes((1, 1, 0x00, 1, 0, 0)))
)
_TAIL = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG bytes of frames (n, FRAME) of 8-bit samples."""
    return [j for at in range(0, len(samples), RUN) for j in _encode_run(samples[at : at + RUN])]


def _encode_run(samples: np.ndarray) -> list[bytes]:
    x = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    d = d.reshape(len(x), FRAME) + 255
    n = _N[d]
    ends = np.cumsum(n, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    first = np.concatenate(([0], np.cumsum(sizes)))
    at = ends - n + 8 * first[:-1, None]
    # Each code is at most 24 bits after its shift within a byte: three bytes take it.
    value = _BITS[d] << (24 - n - (at & 7))
    where = (at >> 3).ravel()
    total = int(first[-1]) + 3
    value = value.ravel()
    packed = np.zeros(total)
    for k in range(3):
        packed += np.bincount(where + k, (value >> (16 - 8 * k)) & 255, total)
    packed = packed.astype(np.uint8)
    spare = (8 * sizes - ends[:, -1]).astype(np.int64)
    packed[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    data = packed.tobytes()
    return [_HEAD + data[a:b].replace(b"\xff", b"\xff\x00") + _TAIL for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _scan_data(jpeg: bytes) -> bytes:
    """Entropy-coded bytes of a lossless-process JPEG, without stuffing; checks the segments."""
    if jpeg.startswith(_HEAD) and jpeg.endswith(_TAIL):
        return jpeg[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff")
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG start")
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xC3 and body[:6] != struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1):
            raise ValueError("unsupported frame size or precision")
        if marker in (0xC0, 0xC1, 0xC2):
            raise ValueError("not the lossless process")
        if marker == 0xC4 and body != bytes((0x00, *CODE_COUNTS, *range(sum(CODE_COUNTS)))):
            raise ValueError("unsupported Huffman table")
        at += 2 + size
        if marker == 0xDA:
            end = jpeg.rfind(_TAIL)
            return jpeg[at : end if end >= at else len(jpeg)].replace(b"\xff\x00", b"\xff")
    raise ValueError("no scan")


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (n, FRAME) of frames; all frames of a run advance together."""
    out = np.empty((len(jpegs), FRAME), np.uint8)
    for at in range(0, len(jpegs), RUN):
        out[at : at + RUN] = _decode_run(jpegs[at : at + RUN])
    return out


def _decode_run(jpegs: list[bytes]) -> np.ndarray:
    scans = [_scan_data(j) for j in jpegs]
    sizes = np.array([len(s) + 4 for s in scans])
    data = np.frombuffer(b"".join(s + b"\xff\xff\xff\xff" for s in scans), np.uint8).astype(np.uint32)
    # Four bytes from every position on: any code with its extra bits lies within.
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = (np.cumsum(sizes) - sizes) * 8
    diffs = np.empty((FRAME, len(jpegs)), np.int16)
    category_of, length_of = _PREFIX_CATEGORY.astype(np.uint32), _PREFIX_LENGTH.astype(np.uint32)
    top = np.uint32(32 - _MAX)
    last = (np.cumsum(sizes) - 4) * 8
    for k in range(FRAME):
        word = words[at >> 3] << (at & 7).astype(np.uint32)
        prefix = word >> top
        length, category = length_of[prefix], category_of[prefix]
        extra = ((word << length) >> np.uint32(1)) >> (np.uint32(31) - category)
        low = np.uint32(1) << category
        diffs[k] = extra.astype(np.int32) - np.where((extra << np.uint32(1)) < low, low - np.uint32(1), 0).astype(np.int32)
        at = at + length + category
        if k % 64 == 63 and (at > last + 7).any():
            raise ValueError("scan too short")
    d = diffs.T.reshape(-1, HEIGHT, WIDTH).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(-1, FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(jpegs: list[bytes], fps: int = FPS) -> bytes:
    largest = max(map(len, jpegs), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(jpegs), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, len(jpegs), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    frames = [_chunk(b"00dc", j) for j in jpegs]
    index, at = [], 4
    for j, f in zip(jpegs, frames, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        at += len(f)
    body = b"AVI " + head + _list(b"movi", b"".join(frames)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks from ``at`` to ``end``; of lists, the kind is the name and the start is behind it."""
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        inside = name in (b"RIFF", b"LIST")
        yield (media[at + 8 : at + 12], at + 12, size - 4) if inside else (name, at + 8, size)
        at += 8 + size + (size & 1)


def _frames_in(media: bytes, at: int, end: int, grouped: bool = False) -> Iterator[bytes]:
    """The frames of a movie list and of the groups in it."""
    for name, start, size in _chunks(media, at, end):
        if name == b"rec " and not grouped:
            yield from _frames_in(media, start, min(end, start + size), True)
        elif name[2:] in (b"dc", b"db"):
            if start + size > end:
                raise ValueError("frame beyond its list")
            yield media[start : start + size]


def _indexed(media: bytes, movi: int, index: tuple[int, int]) -> Iterator[bytes]:
    """Frames by the index, whose offsets count from the list's kind or, in some files, from the file's start."""
    base = None
    for name, _, offset, size in struct.iter_unpack("<4sIII", media[index[0] : index[0] + index[1] // 16 * 16]):
        if name[2:] not in (b"dc", b"db"):
            continue
        if base is None:
            base = movi - 4 if media[movi - 4 + offset : movi + offset] == name else 0
        start = base + offset
        if media[start : start + 4] != name or start + 8 + size > len(media):
            raise ValueError("index does not point to a frame")
        yield media[start + 8 : start + 8 + size]


def read_avi(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames by the file's index or, without one, by its movie lists."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    micros, lists, index = 1_000_000 // FPS, [], None
    for kind, start, size in _chunks(media, 0, len(media)):
        if kind not in (b"AVI ", b"AVIX"):
            continue
        for name, at, n in _chunks(media, start, min(len(media), start + size)):
            if name == b"hdrl":
                for part, place, _ in _chunks(media, at, min(len(media), at + n)):
                    if part == b"avih":
                        micros = struct.unpack_from("<I", media, place)[0] or micros
            elif name == b"movi":
                lists.append((at, min(len(media), at + n)))
            elif name == b"idx1" and kind == b"AVI ":
                index = (at, n)
    if not lists:
        raise ValueError("no movie list")
    # The old index covers the first list only.
    if index and len(lists) == 1:
        return 1_000_000 / micros, list(_indexed(media, lists[0][0], index))
    return 1_000_000 / micros, [x for at, end in lists for x in _frames_in(media, at, end)]


@dataclass(frozen=True)
class ShotParams:
    bins: int = 16
    #: Neighbours before a frame that set its threshold.
    recent: int = 8
    spread: float = 3.0
    #: Least difference of a cut, as a share of the largest possible.
    floor: float = 0.15
    min_frames: int = 2


PRODUCTION = ShotParams()


def shots(samples: np.ndarray, p: ShotParams = PRODUCTION) -> list[tuple[int, int]]:
    """Frame ranges (start, end) of the shots of one film's frames (n, samples)."""
    n = len(samples)
    if n < 2:
        return [(0, n)] * (n > 0)
    hist = np.empty((n, p.bins), np.int64)
    for at in range(0, n, RUN):
        part = samples[at : at + RUN]
        cell = np.arange(len(part))[:, None] * p.bins + (part.astype(np.int32) * p.bins >> 8)
        hist[at : at + RUN] = np.bincount(cell.ravel(), minlength=len(part) * p.bins).reshape(-1, p.bins)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * max(1, samples.shape[1]))
    cuts, start = [0], 0
    for k, d in enumerate(diff.tolist()):
        recent = diff[max(start, k - p.recent) : k]
        limit = p.floor + (recent.mean() + p.spread * recent.std() if len(recent) else 0.0)
        if d > limit and k + 1 - start >= p.min_frames:
            start = k + 1
            cuts.append(start)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text, filled with bytes 255 to a positive multiple of the frame size."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes((PAD,)) * (-len(data) % FRAME if data else FRAME)


def _batches(values: list, size_of, batch_bytes: int) -> Iterator[list]:
    part, held = [], 0
    for v in values:
        if part and held + size_of(v) > batch_bytes:
            yield part
            part, held = [], 0
        part.append(v)
        held += size_of(v)
    if part:
        yield part


def stored(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads whose sizes are multiples of the frame size."""
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    out, at = [], 0
    for x in payloads:
        n = len(x) // FRAME
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def _dct_film(frames: list[bytes]) -> np.ndarray:
    """Samples (n, height * width) of sequential DCT frames of one size."""
    films: list[np.ndarray] = []
    for f in frames:
        films.append(films[-1] if not f and films else decode_grey(f))
    if len({x.shape for x in films}) > 1:
        raise ValueError("frames differ in size")
    return np.stack([x.ravel() for x in films])


def _lossless(jpeg: bytes) -> bool:
    """Whether the frame's header is that of the lossless process."""
    if jpeg.startswith(_HEAD):
        return True
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        if jpeg[at + 1] in (0xC0, 0xC1, 0xC3):
            return jpeg[at + 1] == 0xC3
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    return False


def opened(media: list[bytes]) -> list[tuple[float, np.ndarray]]:
    """Frame rate and samples of AVI files; all their frames of the lossless process are decoded together."""
    parsed = [read_avi(m) for m in media]
    own = [not frames or _lossless(frames[0]) for _, frames in parsed]
    samples = decode_frames([f for (_, frames), lossless in zip(parsed, own, strict=True) if lossless for f in frames])
    out, at = [], 0
    for (fps, frames), lossless in zip(parsed, own, strict=True):
        if lossless:
            out.append((fps, samples[at : at + len(frames)]))
            at += len(frames)
        else:
            out.append((fps, _dct_film(frames)))
    return out


def to_media(docs: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes and media (AVI) of (doc_id, text)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            for part in _batches(rows, lambda r: 4 * len(r[1] or ""), batch_bytes):
                payloads = [payload_of(t) for _, t in part]
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for _, t in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in part], pa.int64()), pa.array(sizes, pa.int64()), pa.array(stored(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


CLIP = "struct<clip:int,start_frame:int,end_frame:int,start_s:double,end_s:double>"


def analysed(media: DataFrame, params: ShotParams = PRODUCTION, batch_bytes: int = 1 << 20) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with what is read back: payload size, hashes, frame rate and clips."""
    clip_type = pa.list_(pa.struct([("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def one(m: bytes | None) -> tuple[float, np.ndarray | None, str | None]:
        try:
            return (*opened([m or b""])[0], None)
        except (ValueError, struct.error, IndexError) as e:
            return 0.0, None, str(e)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True))
            for part in _batches(rows, lambda r: len(r[2] or b""), batch_bytes):
                try:
                    films = [(*x, None) for x in opened([m or b"" for _, _, m in part])]
                except (ValueError, struct.error, IndexError):
                    films = [one(m) for _, _, m in part]
                cols: list[list] = [[] for _ in range(8)]
                for (_, _, m), (fps, samples, error) in zip(part, films, strict=True):
                    payload = samples.tobytes() if samples is not None else b""
                    found = shots(samples, params) if samples is not None else []
                    cells = (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(m or b""),
                        hashlib.sha256(m or b"").hexdigest(),
                        fps,
                        [{"clip": k, "start_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for k, (a, b) in enumerate(found)],
                        error,
                    )
                    for c, v in zip(cols, cells, strict=True):
                        c.append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), clip_type, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fps", "clips", "error"],
                )

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fps double, clips array<{CLIP}>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def clips(media: DataFrame, params: ShotParams = PRODUCTION) -> DataFrame:
    """A row for each shot: doc_id, clip, frames and seconds."""
    return analysed(media, params).selectExpr("doc_id", "inline(clips)")


def query(spark, sf_dir: str) -> DataFrame:
    read = analysed(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    feature = "concat_ws(';', concat('frames=', payload_bytes div 576), concat('fps=', cast(fps as int)), concat('shots=', array_join(transform(clips, c -> concat(c.start_frame, '-', c.end_frame)), ','))) AS feature"
    return read.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)
