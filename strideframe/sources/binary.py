"""Readers and writers of binary and text frame files. Files are read whole by Spark, decoded by numpy, numbered by their order."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.errors import InvalidFormatError
from strideframe.operators.order import total_before

FRAMES = "utt_id string, frame_idx long, x array<double>"
SAMPLES = "utt_id string, frame_idx long, c short, y short, x array<double>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """decode(bytes) gives columns without utt_id and frame_idx."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                columns = decode(bytes(content))
                n = len(next(iter(columns.values())))
                yield pd.DataFrame({"utt_id": [path.rsplit("/", 1)[-1]] * n, "frame_idx": np.arange(n), **columns})

    return files.mapInPandas(run, schema)


def decode_frames(data: bytes, double: bool = False, width: int | None = None) -> np.ndarray:
    """Rows of a frame file: an int32 width (unless given), then little-endian float32 or float64 rows."""
    if width is None:
        if len(data) < 4:
            raise InvalidFormatError("no width")
        width, data = int(np.frombuffer(data[:4], "<i4")[0]), data[4:]
    kind = np.dtype("<f8" if double else "<f4")
    if width <= 0 or len(data) % (width * kind.itemsize):
        raise InvalidFormatError(f"{len(data)} bytes aren't rows of {width}")
    return np.frombuffer(data, kind).reshape(-1, width).astype(float)


def encode_frames(x: np.ndarray, double: bool = False, header: bool = True) -> bytes:
    x = np.asarray(x, float)
    return (np.array([x.shape[1]], "<i4").tobytes() if header else b"") + x.astype("<f8" if double else "<f4").tobytes()


def read_frames(spark: SparkSession, path: str, double: bool = False, width: int | None = None) -> DataFrame:
    """Frame files to (utt_id, frame_idx, x); the utterance is the file's name."""
    return _decoded(_files(spark, path), lambda b: {"x": list(decode_frames(b, double, width))}, FRAMES)


def decode_samples(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels c and y (int16) and float32 vectors of a sample file."""
    width = int(np.frombuffer(data[:4], "<i4")[0])
    kind = np.dtype([("c", "<i2"), ("y", "<i2"), ("x", "<f4", (width,))])
    if (len(data) - 4) % kind.itemsize:
        raise InvalidFormatError("not whole samples")
    rows = np.frombuffer(data[4:], kind)
    return rows["c"], rows["y"], rows["x"].astype(float)


def encode_samples(c, y, x: np.ndarray) -> bytes:
    x = np.asarray(x, float)
    rows = np.zeros(len(x), np.dtype([("c", "<i2"), ("y", "<i2"), ("x", "<f4", (x.shape[1],))]))
    rows["c"], rows["y"], rows["x"] = c, y, x
    return np.array([x.shape[1]], "<i4").tobytes() + rows.tobytes()


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    def decode(b: bytes) -> dict:
        c, y, x = decode_samples(b)
        return {"c": c, "y": y, "x": list(x)}

    return _decoded(_files(spark, path), decode, SAMPLES)


def decode_labels(data: bytes) -> np.ndarray:
    """One byte per frame; digit characters mean their number."""
    raw = np.frombuffer(data, np.uint8)
    raw = raw[~np.isin(raw, (9, 10, 13, 32))] if len(raw) and (raw >= 48).mean() > 0.5 else raw
    return np.where((raw >= 48) & (raw <= 57), raw - 48, raw).astype(int)


# Fixed value: bytes of the label before each row of a labelled file.
LABEL_BYTES = 12


def encode_labelled(c, x: np.ndarray) -> bytes:
    """Rows of a label as digits, filled with zero bytes, and float32 values; no header."""
    x = np.asarray(x, float)
    rows = np.zeros(len(x), np.dtype([("c", f"S{LABEL_BYTES}"), ("x", "<f4", (x.shape[1],))]))
    rows["c"], rows["x"] = [str(int(v)).encode() for v in c], x
    return rows.tobytes()


def decode_labelled(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and vectors of what encode_labelled writes; labels must be numbers."""
    kind = np.dtype([("c", f"S{LABEL_BYTES}"), ("x", "<f4", (width,))])
    if len(data) % kind.itemsize:
        raise InvalidFormatError(f"{len(data)} bytes aren't labelled rows of {width}")
    rows = np.frombuffer(data, kind)
    try:
        return np.array([int(v.decode().strip("\x00 ")) for v in rows["c"]], int), rows["x"].astype(float)
    except ValueError as e:
        raise InvalidFormatError(f"labels must be numbers: {e}") from None


def _parse_format(spec: str) -> tuple[str, int]:
    name, _, width = spec.partition(",")
    if name in ("ufv", "lfv") and width.isdigit() and int(width) > 0:
        return name, int(width)
    if name in ("frame", "frame_double", "sample_a", "sample_b", "ascii") and not width:
        return name, 0
    raise InvalidFormatError(f"unknown format {spec!r}")


def convert(data: bytes, source: str, target: str) -> bytes:
    """A file's bytes from one format to another: ufv,dim; lfv,dim; frame; frame_double; sample_a; sample_b; ascii. Without labels they are 0."""
    (kind, width), (to, _) = _parse_format(source), _parse_format(target)
    if kind == "lfv":
        c, x = decode_labelled(data, width)
        y = np.zeros(len(x), int)
    elif kind == "sample_b":
        c, y, x = decode_samples(data)
    elif kind == "sample_a":
        rows = parse_text_frames(data.decode(), True)
        c, y, x = np.array(rows["c"]), np.array(rows["y"]), np.array(rows["x"])
    else:
        x = np.array(parse_text_frames(data.decode())["x"]) if kind == "ascii" else decode_frames(data, kind == "frame_double", width or None)
        c = y = np.zeros(len(x), int)
    if to == "lfv":
        return encode_labelled(c, x)
    if to == "sample_b":
        return encode_samples(c, y, x)
    if to == "sample_a":
        return "".join(" ".join([str(int(a)), str(int(b)), *map(repr, map(float, row))]) + "\n" for a, b, row in zip(c, y, x, strict=True)).encode()
    return encode_text_frames(x, "\t") if to == "ascii" else encode_frames(x, to == "frame_double", to != "ufv")


def convert_files(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """(utt_id, content): the files of a path in another format, for ``write_files``."""
    _parse_format(source), _parse_format(target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"utt_id": [p.rsplit("/", 1)[-1] for p in batch["path"]], "content": [convert(bytes(c), source, target) for c in batch["content"]]})

    return _files(spark, path).mapInPandas(run, "utt_id string, content binary")


# The primitive types of binary files.
PRIMITIVES = {"byte": "i1", "short": "i2", "int": "i4", "long": "i8", "float": "f4", "double": "f8"}


def encode_values(values, kind: str, big: bool = False) -> bytes:
    """Numbers of one primitive type, little- or big-endian."""
    return np.asarray(values).astype((">" if big else "<") + PRIMITIVES[kind]).tobytes()


def decode_values(data: bytes, kind: str, big: bool = False) -> np.ndarray:
    out = np.dtype((">" if big else "<") + PRIMITIVES[kind])
    if len(data) % out.itemsize:
        raise InvalidFormatError(f"{len(data)} bytes aren't whole {kind}s")
    return np.frombuffer(data, out)


def encode_labels(labels) -> bytes:
    """One digit character per frame, as decode_labels reads them."""
    values = np.asarray(labels, int)
    if len(values) and (values.min() < 0 or values.max() > 9):
        raise InvalidFormatError("labels are digits")
    return (values + 48).astype(np.uint8).tobytes()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, frame_idx, label): per-frame byte labels or 0/1 decisions."""
    return _decoded(_files(spark, path), lambda b: {"label": decode_labels(b)}, "utt_id string, frame_idx long, label int")


def parse_text_frames(text: str, labelled: bool = False) -> dict:
    """Rows of numbers between blanks, commas or tabs; blank lines and lines that begin with @ before the first row are skipped."""
    rows = []
    for line in text.splitlines():
        fields = line.replace(",", " ").split()
        if not fields or (not rows and fields[0].startswith("@")):
            continue
        rows.append([float(f) for f in fields])
        if len(rows[-1]) != len(rows[0]):
            raise InvalidFormatError(f"{len(rows[-1])} values after rows of {len(rows[0])}")
    if labelled:
        if rows and len(rows[0]) < 3:
            raise InvalidFormatError("a sample needs two labels and a value")
        return {"c": [int(r[0]) for r in rows], "y": [int(r[1]) for r in rows], "x": [r[2:] for r in rows]}
    return {"x": rows}


def read_text_frames(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(_files(spark, path), lambda b: parse_text_frames(b.decode()), FRAMES)


def read_text_samples(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(_files(spark, path), lambda b: parse_text_frames(b.decode(), True), SAMPLES)


def write_text_frames(frames: DataFrame, path: str, separator: str = " ") -> None:
    """A folder per utterance with its rows in order."""
    ordered = frames.repartition("utt_id").sortWithinPartitions("utt_id", "frame_idx")
    line = F.array_join(F.transform("x", lambda v: v.cast("string")), separator)
    ordered.select("utt_id", line.alias("value")).write.partitionBy("utt_id").text(path)


def pack_files(rows: DataFrame, columns: str | list[str], encode: Callable[..., bytes], utt: str = "utt_id", order: str = "frame_idx") -> DataFrame:
    """(utt_id, content): the bytes that encode makes of each utterance's columns, in order."""
    kind = rows.schema[utt].dataType.simpleString()
    columns = [columns] if isinstance(columns, str) else columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({"utt_id": [key[0]], "content": [encode(*(np.stack(pdf[c].to_numpy()) for c in columns))]})

    return rows.select(utt, order, *columns).groupBy(utt).applyInPandas(run, f"utt_id {kind}, content binary")


def to_files(frames: DataFrame, double: bool = False, header: bool = True) -> DataFrame:
    """(utt_id, content): each utterance as the bytes of a frame file, for any binary sink."""
    return pack_files(frames, "x", lambda x: encode_frames(x, double, header))


def to_sample_files(samples: DataFrame) -> DataFrame:
    """(utt_id, content): each utterance of (c, y, x) as the bytes of a labelled sample file."""
    return pack_files(samples, ["c", "y", "x"], encode_samples)


def encode_text_frames(x: np.ndarray, separator: str = " ", head: Sequence[str] = ()) -> bytes:
    """Rows of numbers, behind comment lines."""
    return "".join([*(f"@{h}\n" for h in head), *(separator.join(map(repr, map(float, row))) + "\n" for row in np.atleast_2d(x))]).encode()


def write_files(files: DataFrame, path: str, suffix: str = "") -> None:
    """Each (utt_id, content) as a file of the path, written by the executors through Arrow's file systems.

    A file appears under its name only when it is whole, and a repeated task writes the same bytes again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("utt_id"), batch.column("content"), strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_py())
                system.move(part, f"{root}/{name.as_py()}{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    files.select("utt_id", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def tee(df: DataFrame, *sinks: Callable[[DataFrame], object]) -> DataFrame:
    """Give df to each sink, computed once; df itself goes on."""
    kept = df.persist()
    for sink in sinks:
        sink(kept)
    return kept


def by_list(rows: DataFrame, entries: DataFrame, utt: str = "utt_id") -> DataFrame:
    """rows of the files that a list (pos, utt_id, ...) names, with the list's columns: each as often as it is named.

    Names that no file has are skipped.
    """
    return rows.join(entries.withColumnRenamed("utt_id", utt), utt)


def list_audio(audio: DataFrame, entries: DataFrame, block: int) -> DataFrame:
    """(block_idx, samples): the files of a list (pos, utt_id) read one after another in blocks, the last of each file filled with zeros.

    audio: (utt_id, samples). Blocks are numbered through the list by prefix sums of the files' numbers of blocks.
    """
    named = by_list(audio, entries).select("pos", "samples", F.ceil(F.size("samples") / block).alias("n")).filter("n > 0")
    starts = total_before(named.select("pos", "n"), "pos", "n", "first").select("pos", "first")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.slice("samples", (k * block + 1).cast("int"), F.lit(block)))
    rows = named.select("pos", F.posexplode(cut).alias("k", "part")).join(starts, "pos")
    zeros = F.array_repeat(F.lit(0.0), F.lit(block) - F.size("part"))
    return rows.select((F.col("first") + F.col("k")).alias("block_idx"), F.concat("part", zeros).alias("samples"))


def audio_from_array(spark: SparkSession, samples, rate: int, utt_id: str = "memory") -> DataFrame:
    """(utt_id, sample_rate, samples) of samples in memory."""
    return spark.createDataFrame([(utt_id, rate, [float(v) for v in samples])], "utt_id string, sample_rate int, samples array<double>")


# ---- audio

# Named raw formats as (bits, rate, encoding, little endian, header bytes).
AUDIO_FORMATS = {
    "ssg/16": (16, 16000, "signed", True, 0), "ssg/8": (16, 8000, "signed", True, 0),
    "ulaw/16": (8, 16000, "ulaw", True, 0), "ulaw/8": (8, 8000, "ulaw", True, 0),
    "alaw/16": (8, 16000, "alaw", True, 0), "alaw/8": (8, 8000, "alaw", True, 0), "sphere/8": (8, 8000, "ulaw", True, 1024),
    "wav/44": (16, 44100, "signed", True, 44), "wav/32": (16, 32000, "signed", True, 44),
    "wav/16": (16, 16000, "signed", True, 44), "wav/8": (16, 8000, "signed", True, 44),
}


def parse_audio_format(spec: str) -> tuple[int, int, str, bool, int]:
    """``t:name`` or ``r:bits,rate,signed,little`` (0 or 1)."""
    kind, _, rest = spec.partition(":")
    if kind == "t" and rest in AUDIO_FORMATS:
        return AUDIO_FORMATS[rest]
    fields = rest.split(",")
    if kind == "r" and len(fields) == 4:
        return int(fields[0]), int(fields[1]), "signed" if fields[2] == "1" else "unsigned", fields[3] == "1", 0
    raise InvalidFormatError(f"unknown audio format {spec!r}")


def _ulaw(raw: np.ndarray) -> np.ndarray:
    u = ~raw.astype(np.uint8)
    magnitude = (((u & 0x0F).astype(int) << 3) + 0x84 << ((u >> 4) & 7).astype(int)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude)


def _alaw(raw: np.ndarray) -> np.ndarray:
    a = raw.astype(np.uint8) ^ 0x55
    exponent, mantissa = ((a >> 4) & 7).astype(int), (a & 0x0F).astype(int)
    magnitude = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude)


def decode_audio(data: bytes, fmt: tuple[int, int, str, bool, int]) -> np.ndarray:
    """Samples in [-1, 1]: signed over 2^(b-1) - 1, unsigned moved to the middle first, A-law and mu-law as 16 bit."""
    bits, _, encoding, little, header = fmt
    data = data[header:]
    if encoding in ("ulaw", "alaw"):
        values, bits = (_ulaw if encoding == "ulaw" else _alaw)(np.frombuffer(data, np.uint8)).astype(float), 16
    else:
        width = bits // 8
        kind = ("<" if little else ">") + ("i" if encoding == "signed" else "u") + str(width)
        values = np.frombuffer(data[: len(data) // width * width], kind).astype(float)
        if encoding == "unsigned":
            values -= 2 ** (bits - 1)
    return np.clip(values / (2 ** (bits - 1) - 1), -1, 1)


def read_audio(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """(utt_id, sample_rate, samples), one row per file."""
    fmt = parse_audio_format(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "utt_id": [p.rsplit("/", 1)[-1] for p in batch["path"]], "sample_rate": fmt[1], "samples": [decode_audio(bytes(c), fmt) for c in batch["content"]],
            })

    return _files(spark, path).mapInPandas(run, "utt_id string, sample_rate int, samples array<double>")


def to_wav(samples, rate: int) -> bytes:
    """16-bit mono WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(to_pcm16(samples))
    return out.getvalue()


def to_pcm16(samples) -> bytes:
    return np.round(np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes()


def normalize_pcm16(data: bytes, remove_dc: bool = False) -> bytes:
    """16-bit samples scaled to full range, optionally without their mean."""
    x = np.frombuffer(data, "<i2").astype(float)
    x = x - x.mean() if remove_dc and len(x) else x
    top = np.abs(x).max() if len(x) else 0
    return to_pcm16(x / top) if top else data
