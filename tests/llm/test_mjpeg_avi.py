import hashlib
import zlib

import numpy as np
import pytest

from tasklattice.llm import mjpeg_avi as m
from tests.llm import edge


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 256, (50, m.FRAME)), np.full((2, m.FRAME), 255), np.zeros((2, m.FRAME)), np.tile([0, 255], (3, m.FRAME // 2))]).astype(np.uint8)
    jpegs = m.encode_frames(x)
    assert (m.decode_frames(jpegs) == x).all()
    fps, frames = m.read_avi(m.write_avi(jpegs))
    assert frames == jpegs and round(fps) == m.FPS
    extra = jpegs[0][:2] + m._segment(0xFE, b"a comment") + jpegs[0][2:]
    assert (m.decode_frames([extra])[0] == x[0]).all()


def test_bit_by_bit_decoder_agrees():
    """A plain decoder of one frame, a sample at a time."""
    rng = np.random.default_rng(2)
    x = rng.integers(60, 130, (1, m.FRAME)).astype(np.uint8)
    bits = "".join(f"{b:08b}" for b in m._scan_data(m.encode_frames(x)[0]))
    codes = {f"{int(c):0{int(n)}b}": k for k, (n, c) in enumerate(zip(m._LENGTH, m._CODE, strict=True))}
    out, at = np.zeros((m.HEIGHT, m.WIDTH), int), 0
    for r in range(m.HEIGHT):
        for c in range(m.WIDTH):
            end = at + 1
            while bits[at:end] not in codes:
                end += 1
            n = codes[bits[at:end]]
            v = int(bits[end : end + n] or "0", 2)
            at = end + n
            before = out[r, c - 1] if c else out[r - 1, 0] if r else 128
            out[r, c] = before + (v if not n or v >> (n - 1) else v - (1 << n) + 1)
    assert (out.ravel() == x[0]).all()


def test_shots_cut_where_the_picture_changes():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (9, m.FRAME)), rng.integers(180, 250, (7, m.FRAME))
    assert m.shots(np.concatenate([a, b, a]).astype(np.uint8)) == [(0, 9), (9, 16), (16, 25)]
    assert m.shots(np.zeros((0, m.FRAME), np.uint8)) == []


@pytest.mark.parametrize("source", ["table", "edge"])
def test_payload_is_read_back(spark, sf, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "table" else edge.documents(spark)
    texts = docs.collect()
    rows = m.analysed(m.to_media(docs)).collect()
    assert len(rows) == len(texts)
    by_id = {t.doc_id: t.text for t in texts}
    for r in rows:
        data = (by_id[r.doc_id] or "").encode()
        payload = m.payload_of(by_id[r.doc_id])
        assert payload[: len(data)] == data and len(payload) % 576 == 0 and len(payload) > 0 and set(payload[len(data) :]) <= {255}
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.clips[0].start_frame == 0 and r.clips[-1].end_frame == len(payload) // 576
        assert all(x.end_frame == y.start_frame for x, y in zip(r.clips, r.clips[1:], strict=False))


def test_broken_media_and_clip_rows(spark):
    media = spark.createDataFrame([(1, 0, None), (2, 3, bytearray(b"abc")), (3, 576, bytearray(m.stored([b"x" * 576])[0]))], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in m.analysed(media).collect()}
    assert rows[1].error and rows[2].error and rows[1].clips == [] and rows[3].error is None
    clips = m.clips(media).collect()
    assert [(c.doc_id, c.clip, c.start_frame, c.end_frame, c.end_s) for c in clips] == [(3, 0, 0, 1, 0.04)]
    assert m.analysed(m.to_media(edge.empty(spark))).count() == 0


def java_jpeg(spark, x, colour=False):
    """A JPEG of grey or colour samples by the JVM's encoder, and the samples that the JVM's decoder reads from it."""
    j = spark._jvm
    image = j.java.awt.image.BufferedImage(x.shape[1], x.shape[0], 5 if colour else 10)
    raster = image.getRaster()
    flat = np.repeat(x.ravel(), 3) if colour else x.ravel()
    if colour:
        flat = (flat * np.tile([1.0, 0.6, 0.3], x.size)).astype(int)
    array = spark.sparkContext._gateway.new_array(j.int, len(flat))
    for k, v in enumerate(flat.tolist()):
        array[k] = int(v)
    raster.setPixels(0, 0, x.shape[1], x.shape[0], array)
    out = j.java.io.ByteArrayOutputStream()
    assert j.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    if colour:
        return data, None
    back = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(data)).getRaster()
    pixels = back.getPixels(0, 0, x.shape[1], x.shape[0], spark.sparkContext._gateway.new_array(j.int, x.size))
    return data, np.array(list(pixels)).reshape(x.shape)


def picture(height, width, shift=0):
    y, x = np.mgrid[:height, :width]
    return ((np.sin(x / 5 + shift) + np.cos(y / 7)) * 50 + 120 + shift).clip(0, 255).astype(np.uint8)


def test_typical_tables_are_those_of_the_standard(spark):
    from tasklattice.llm.jpeg_dct import TYPICAL

    std = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for key, t in {(0, 0): std.StdDCLuminance, (0, 1): std.StdDCChrominance, (1, 0): std.StdACLuminance, (1, 1): std.StdACChrominance}.items():
        assert [bytes.fromhex(x) for x in TYPICAL[key]] == [bytes(v & 255 for v in t.getLengths()), bytes(v & 255 for v in t.getValues())]


@pytest.mark.parametrize("size", [(8, 8), (17, 23), (40, 56)])
def test_dct_frames_equal_the_jvm_decoder(spark, size):
    from tasklattice.llm.jpeg_dct import decode_grey

    data, back = java_jpeg(spark, picture(*size))
    got = decode_grey(data)
    assert got.shape == size and np.abs(got.astype(int) - back).max() <= 1
    without = data.replace(_segment_of(data, 0xC4), b"")
    assert (decode_grey(without) == got).all()
    coloured = decode_grey(java_jpeg(spark, picture(*size), colour=True)[0]).astype(int)
    grey = picture(*size).astype(float)
    luma = 0.299 * np.floor(grey * 0.3) + 0.587 * np.floor(grey * 0.6) + 0.114 * grey
    other = 0.114 * np.floor(grey * 0.3) + 0.587 * np.floor(grey * 0.6) + 0.299 * grey
    assert min(np.abs(coloured - luma).mean(), np.abs(coloured - other).mean()) < 6
    for bad in (data[:-40], data[:30], b"\xff\xd8", data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            decode_grey(bad)


def _segment_of(data, marker):
    """All segments of one kind, which stand side by side."""
    start = end = data.index(bytes((0xFF, marker)))
    while data[end : end + 2] == bytes((0xFF, marker)):
        end += 2 + int.from_bytes(data[end + 2 : end + 4], "big")
    return data[start:end]


def test_ordinary_films_and_files_without_index(spark):
    frames = [java_jpeg(spark, picture(16, 24, s))[0] for s in (0, 0, 0, 90, 90, 90)]
    film = m.write_avi(frames)
    at = film.index(b"idx1")
    walked = film[:4] + (at - 8).to_bytes(4, "little") + film[8:at]
    second = b"AVIX" + m._list(b"movi", b"".join(m._chunk(b"00dc", f) for f in frames))
    two = walked + b"RIFF" + len(second).to_bytes(4, "little") + second
    assert m.read_avi(film) == m.read_avi(walked) == (25.0, frames) and m.read_avi(two)[1] == frames * 2
    mixed = m.write_avi([frames[0], java_jpeg(spark, picture(8, 8))[0]])
    held = m.write_avi([frames[0], b"", frames[3]])
    own = m.stored([b"x" * 576])[0]
    rows = [(k, 0, bytearray(x)) for k, x in enumerate((film, walked, mixed, held, own, film[:-100], m.write_avi([])))]
    got = {r.doc_id: r for r in m.analysed(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    for k in (0, 1):
        assert got[k].error is None and [(c.start_frame, c.end_frame) for c in got[k].clips] == [(0, 3), (3, 6)]
        assert got[k].payload_bytes == 6 * 16 * 24
    assert got[2].error and got[2].clips == [] and got[3].payload_bytes == 3 * 16 * 24
    assert got[4].error is None and got[6].error is None and got[6].clips == []


def test_runs_of_frames(monkeypatch):
    x = np.random.default_rng(5).integers(0, 256, (23, m.FRAME)).astype(np.uint8)
    whole, cut = m.encode_frames(x), m.shots(x)
    monkeypatch.setattr(m, "RUN", 4)
    assert m.encode_frames(x) == whole and (m.decode_frames(whole) == x).all() and m.shots(x) == cut


def test_damage_gives_an_error_text_and_no_crash(spark):
    rng = np.random.default_rng(8)
    films = [m.write_avi([java_jpeg(spark, picture(24, 32, s))[0] for s in (0, 60)]), m.stored([b"some text " * 576])[0]]
    rows = []
    for k in range(300):
        film = bytearray(films[k % 2])
        for at in rng.integers(0, len(film), rng.integers(1, 6)):
            film[at] = rng.integers(0, 256)
        rows.append((k, 0, film[: rng.integers(1, len(film))] if k % 3 == 0 else film))
    got = m.analysed(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert len(got) == 300 and all((r.error is None) or (r.clips == [] and r.payload_bytes == 0) for r in got)
    assert any(r.error for r in got)
