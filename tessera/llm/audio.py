"""Audio features of 8-bit media: polyphase resampling, log-mel filterbanks and hysteresis energy segmentation.

A payload is stored as an 8-bit mono WAV file, read back, resampled from 12 to 8 kHz by a polyphase filter
(up 2, down 3), cut into overlapped frames, and turned into log energies of mel filters. Frames whose energy
passes the upper threshold open a segment, which lasts while the energy stays above the lower one. Features are
stored as clips: Arrow tensors of one fixed shape, (``CLIP_FRAMES``, ``MELS``), each with its time span and the active
spans in it. What is reported of a text is read from its stored clips.

Tasks write pairs of Parquet files, media and clips, of about ``FILE_BYTES`` of media to the shared folder under names
of their own for each attempt; only those that the manifest of finished tasks lists are read, so a lost executor leaves
no trace in the result. A task holds one such pair in memory, or one text; a long payload is resampled and framed in
stretches of ``STRETCH`` frames.

Null text is an empty payload: 192 spaces. Each text is handled alone, so equal texts, repeated rows among them, give
equal values, whatever batch they are in. An empty table gives an empty one. Only the key and the text are read, so
other columns can't clash; null and repeated keys are kept as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_folder, saved
from tessera.llm.zipwarc import opened

RATE, UP, DOWN = 12_000, 2, 3
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS = 256, 128, 16
#: Frames of a clip; frames that are handled at a time.
CLIP_FRAMES, STRETCH = 16, 4096
#: Bytes of media after which a task begins another pair of files.
FILE_BYTES = 8 << 20
#: Energy above its mean, in units of log power, that opens and that keeps a segment.
OPEN, KEEP = 0.5, -0.25
#: Payloads are padded with spaces to a multiple of this.
UNIT = 192
TAPS = 8


def wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file of a payload."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV file with 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: str) -> tuple[bytes, int]:
    """Payload of a text, with spaces up to a positive multiple of the unit, and its bytes before them."""
    data = text.encode()
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data)), len(data)


def _low_pass() -> np.ndarray:
    """Windowed-sinc taps for the polyphase filter, one row per phase."""
    n = 2 * TAPS * DOWN + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / DOWN) * np.hamming(n) * UP / DOWN
    return np.stack([np.pad(h[p::UP], (0, (n // UP + 1) - len(h[p::UP]))) for p in range(UP)])


def _mel() -> np.ndarray:
    """(bins, mels) triangular filters, evenly spaced on the mel scale."""
    to, back = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = back(np.linspace(to(60.0), to(OUT_RATE / 2), MELS + 2))
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


PHASES, MEL, SHAPE = _low_pass(), _mel(), np.hanning(FRAME + 1)[:-1]


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate: output m is phase (m * DOWN mod UP) applied at input m * DOWN div UP."""
    return resampled(lambda lo, hi: x[lo:hi], len(x), 0, len(x) * UP // DOWN)


def resampled(read, n: int, lo: int, hi: int) -> np.ndarray:
    """Outputs lo to hi, lo a multiple of UP, of n inputs, of which read(a, b) gives those from a to b."""
    width = PHASES.shape[1]
    half = width // 2
    first = lo // UP * DOWN - (width - 1 - half)
    last = (hi - 1) * DOWN // UP + half + 1
    inside = read(max(first, 0), min(last, n))
    wide = np.pad(inside, (max(-first, 0), max(last - n, 0) + DOWN))
    out = np.empty(hi - lo)
    for p in range(UP):  # m = p, p + UP, ...: the inputs step by DOWN
        start, phase = p * DOWN // UP, p * DOWN % UP
        count = len(range(p, hi - lo, UP))
        if count:
            view = np.lib.stride_tricks.as_strided(wide[start:], (count, width), (wide.strides[0] * DOWN, wide.strides[0]))
            out[p::UP] = view @ PHASES[phase][::-1]
    return out


def frames_of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies of 8-bit samples, and each frame's log power, stretch by stretch.

    Both are rounded to 4 and 6 digits, far above what the order of sums can change, so that all executors store equal values.
    """
    data = np.frombuffer(payload, np.uint8)

    def read(lo: int, hi: int) -> np.ndarray:
        return (data[lo:hi].astype(np.float64) - 128) / 128

    length = len(data) * UP // DOWN
    n = 1 + max(0, length - FRAME) // HOP
    mels, power = np.empty((n, MELS), np.float32), np.empty(n)
    for at in range(0, n, STRETCH):
        k = min(STRETCH, n - at)
        y = resampled(read, len(data), at * HOP, min((at + k - 1) * HOP + FRAME, length))
        y = np.pad(y, (0, (k - 1) * HOP + FRAME - len(y)))
        frames = np.lib.stride_tricks.as_strided(y, (k, FRAME), (y.strides[0] * HOP, y.strides[0])) * SHAPE
        spectrum = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        mels[at : at + k] = np.round(np.log(spectrum @ MEL + 1e-6), 4)
        power[at : at + k] = np.round(np.log((frames * frames).mean(axis=1) + 1e-8), 6)
    return mels, power


def segments(power: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) frames of stretches with high energy, by hysteresis about the mean."""
    level = power - power.mean()
    above = np.concatenate(([False], level > KEEP, [False]))
    edges = np.flatnonzero(above[1:] != above[:-1])
    high = np.concatenate(([0], np.cumsum(level > OPEN)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if high[b] > high[a]]


#: How a clip's features are stored: an Arrow tensor of one fixed shape.
TENSOR = pa.fixed_shape_tensor(pa.float32(), (CLIP_FRAMES, MELS), dim_names=("frame", "mel"))
#: A clip: the number of its text's row in the media file, its place, its frames before zeros fill it up, its time
#: span in seconds, the frames of the text that are active in it, as first and last + 1 of each stretch, and the tensor.
CLIPS = pa.schema([("row", pa.int64()), ("clip", pa.int32()), ("frames", pa.int32()), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("active", pa.list_(pa.int32())), ("features", TENSOR)])


def tensors(rows: np.ndarray) -> pa.ExtensionArray:
    """(clips, frames, mels) values as an Arrow array of the fixed-shape tensor type."""
    flat = pa.array(np.ascontiguousarray(rows, np.float32).ravel(), pa.float32())
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, CLIP_FRAMES * MELS))


def clips(row: int, payload: bytes) -> pa.Table:
    """The clips of one payload."""
    mels, power = frames_of(payload)
    n = -(-len(mels) // CLIP_FRAMES)
    begin = np.arange(n) * CLIP_FRAMES
    frames = np.minimum(CLIP_FRAMES, len(mels) - begin)
    active: list[list[int]] = [[] for _ in range(n)]
    for a, b in segments(power):
        for k in range(a // CLIP_FRAMES, (b - 1) // CLIP_FRAMES + 1):
            active[k] += [max(a, k * CLIP_FRAMES), min(b, (k + 1) * CLIP_FRAMES)]
    values = np.zeros((n * CLIP_FRAMES, MELS), np.float32)
    values[: len(mels)] = mels
    columns = [np.full(n, row), np.arange(n, dtype=np.int32), frames.astype(np.int32), begin * HOP / OUT_RATE, ((begin + frames - 1) * HOP + FRAME) / OUT_RATE]
    return pa.Table.from_arrays([*map(pa.array, columns), pa.array(active, CLIPS.field("active").type), tensors(values.reshape(n, CLIP_FRAMES, MELS))], schema=CLIPS)


def feature(own: pa.Table) -> str:
    """What a text's stored clips say: frames, active segments, and means over frames of the log energies."""
    values = own["features"].combine_chunks()
    values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).to_numpy_ndarray().reshape(-1, MELS)
    frames = own["frames"].to_numpy()
    mels = values[: int(frames.sum())]  # only the last clip is filled up
    parts: list[list[int]] = []
    for a, b in ((x[i], x[i + 1]) for x in own["active"].to_pylist() for i in range(0, len(x), 2)):
        if parts and a == parts[-1][1] and a % CLIP_FRAMES == 0:  # a segment that goes on from the clip before
            parts[-1][1] = b
        else:
            parts.append([a, b])
    spans = sha256(",".join(f"{a}-{b}" for a, b in parts).encode()).hexdigest()[:16]
    mean, spread = mels.mean(axis=0, dtype=np.float64), mels.std(dtype=np.float64)
    return f"frames={len(mels)};segments={len(parts)};active={sum(b - a for a, b in parts)};spans={spans};spread={spread:.3f};mel=" + ",".join(f"{v:.2f}" for v in mean)


MANIFEST = "path string, n_texts long, n_clips long, media_bytes long"
_MANIFEST = pa.schema([("path", pa.string()), ("n_texts", pa.int64()), ("n_clips", pa.int64()), ("media_bytes", pa.int64())])


def write_media(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Manifest (path, n_texts, n_clips, media_bytes) of the pairs path-media.parquet, path-clips.parquet that hold all texts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        task, done, kind = TaskContext.get(), 0, None
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{done:05d}"
            table = pa.table({"key": pa.array([h[0] for h in held], kind), "n_bytes": pa.array([h[1] for h in held], pa.int64()), "media": pa.array([h[2] for h in held], pa.large_binary())})
            with system.open_output_stream(f"{root}/{name}-media.parquet") as out:
                pq.write_table(table, out, compression="zstd", row_group_size=1024)
            held.clear()
            del table
            n = 0
            with system.open_input_file(f"{root}/{name}-media.parquet") as back, system.open_output_stream(f"{root}/{name}-clips.parquet") as out, pq.ParquetWriter(out, CLIPS, compression="zstd") as to:
                row, wait = 0, []
                for batch in pq.ParquetFile(back).iter_batches(256, columns=["media"]):
                    for media in batch.column(0):
                        wait.append(clips(row, samples(media.as_py())))
                        n, row = n + wait[-1].num_rows, row + 1
                    to.write_table(pa.concat_tables(wait))
                    wait.clear()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_texts": [row], "n_clips": [n], "media_bytes": [size]}, schema=_MANIFEST)

        size = 0
        for batch in batches:
            kind = batch.column(0).type
            for one, t in zip(batch.column(0), batch.column(1), strict=True):
                payload, n_bytes = padded(t.as_py() or "")
                held.append((one.as_py(), n_bytes, wav(payload)))
                size += len(held[-1][2])
                if size >= FILE_BYTES:
                    yield flush()
                    size, done = 0, done + 1
        if held:
            yield flush()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(write, MANIFEST)


def _pairs(paths: list[str]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Media and clips of each pair of files."""
    import pyarrow.parquet as pq

    for path in paths:
        system, name = opened(path)
        tables = []
        for part in ("media", "clips"):
            with system.open_input_file(f"{name}-{part}.parquet") as f:
                tables.append(pq.read_table(f))
        yield tables[0], tables[1]


def spread_out(manifest: DataFrame) -> DataFrame:
    """Paths of a manifest, in tasks of a few files each."""
    n = manifest.agg(F.count("*")).first()[0]
    return manifest.select("path").repartition(max(1, min(n, 10_000)), "path")


SUMMARY = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SUMMARY = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def summaries(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """key and, of what is stored of each text, digests and the feature; kind is the key's type."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, own in _pairs(batch.column(0).to_pylist()):
                rows, at = [], 0
                for (row, of), n_bytes, data in zip(groupby(own["row"].to_pylist()), media["n_bytes"].to_pylist(), media["media"], strict=True):
                    n, stored = len(list(of)), data.as_py()
                    if row != len(rows):
                        raise ValueError("clips and media do not belong together")
                    back = samples(stored)
                    rows.append((n_bytes, len(back), sha256(back).hexdigest(), crc32(back[-16:]), len(stored), sha256(stored).hexdigest(), feature(own.slice(at, n))))
                    at += n
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMMARY, strict=True)]
                yield pa.RecordBatch.from_arrays([media["key"].combine_chunks(), *columns], names=["key", *_SUMMARY.names])

    return spread_out(manifest).mapInArrow(read, f"key {kind}, {SUMMARY}")


def clip_table(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """key, clip, frames, begin_s, end_s, active_s, features: the stored clips, each tensor as its CLIP_FRAMES * MELS values."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, own in _pairs(batch.column(0).to_pylist()):
                for part in own.to_batches(4096):
                    active = pa.array([sum(x[1::2]) - sum(x[::2]) for x in part["active"].to_pylist()], pa.float64())
                    seconds = pa.array(active.to_numpy() * HOP / OUT_RATE)
                    values = part["features"].storage.cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([media["key"].combine_chunks().take(part["row"]), part["clip"], part["frames"], part["begin_s"], part["end_s"], seconds, values], names=["key", "clip", "frames", "begin_s", "end_s", "active_s", "features"])

    return spread_out(manifest).mapInArrow(read, f"key {kind}, clip int, frames int, begin_s double, end_s double, active_s double, features array<float>")


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Manifest of the media and clips of all texts, in the shared folder."""
    return saved(write_media(docs, new_folder(docs.sparkSession, "media"), text, key), "manifest")


def summarised(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, digests of the stored media and the feature of the stored clips: one row for each of docs."""
    return summaries(stored(docs, text, key), docs.schema[key].dataType.simpleString()).withColumnRenamed("key", key)
