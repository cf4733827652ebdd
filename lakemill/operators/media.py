"""Images, audio and documents as columns: own PNG, PPM and WAV codecs, numpy kernels over Arrow.

Other formats need a codec that isn't part of the library; ``register_decoder`` takes one. Null bytes
give null.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions.text import col

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
_DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {}


def register_decoder(name: str, fn: Callable[[bytes], np.ndarray]) -> None:
    """A decoder of image bytes to height x width x channels, tried where the own ones don't know the format."""
    _DECODERS[name] = fn


# codecs


def encode_png(pixels: np.ndarray) -> bytes:
    h, w, c = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    at, idat, palette = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
    if depth != 8 or laced:
        raise ValueError("PNG of other than 8 bits, or interlaced")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, w * c + 1)
    out, last = np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(w, c), axis=0).ravel()
        elif kind == 2:
            line = line + last
        elif kind in (3, 4):
            for x in range(w * c):
                a, b = line[x - c] if x >= c else 0, last[x]
                if kind == 3:
                    line[x] = (line[x] + (a + b) // 2) & 255
                else:
                    d = last[x - c] if x >= c else 0
                    pa_, pb, pc = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    line[x] = (line[x] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else d)) & 255
        last = line & 255
        out[y] = last
    return palette[out] if color == 3 else out.reshape(h, w, c)


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of PNG or PPM bytes, or by a registered decoder."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] in (b"P6", b"P5"):
        head = data.split(None, 4)
        w, h = int(head[1]), int(head[2])
        return np.frombuffer(data[-w * h * (c := 3 if data[:2] == b"P6" else 1) :], np.uint8).reshape(h, w, c)
    for fn in _DECODERS.values():
        try:
            return fn(data)
        except Exception:  # noqa: BLE001, S112  (another decoder may know the format)
            continue
    raise ValueError("no decoder for this image; register one")


def to_rgb(p: np.ndarray) -> np.ndarray:
    return np.repeat(p[..., :1], 3, axis=2) if p.shape[2] < 3 else p[..., :3]


def luminance(p: np.ndarray) -> np.ndarray:
    p = to_rgb(p).astype(np.float64)
    return 0.299 * p[..., 0] + 0.587 * p[..., 1] + 0.114 * p[..., 2]


def resize(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """By a triangle filter, as wide as a target pixel where the image shrinks."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        wide = max(scale, 1.0)
        centre = (np.arange(new) + 0.5) * scale - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(old)[None] - centre[:, None]) / wide)
        return w / w.sum(1, keepdims=True)

    x = np.einsum("yh,hwc->ywc", weights(p.shape[0], height), p.astype(np.float64))
    return np.clip(np.rint(np.einsum("xw,ywc->yxc", weights(p.shape[1], width), x)), 0, 255).astype(np.uint8)


def crop(p: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    return p[y : y + height, x : x + width]


def to_mode(p: np.ndarray, mode: str) -> np.ndarray:
    if mode == "L":
        return np.rint(luminance(p)).astype(np.uint8)[..., None]
    if mode == "RGB":
        return to_rgb(p)
    if mode == "RGBA":
        return p if p.shape[2] == 4 else np.concatenate([to_rgb(p), np.full((*p.shape[:2], 1), 255, np.uint8)], axis=2)
    raise ValueError(f"unknown mode {mode!r}")


# hashes and quality


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def ahash(p: np.ndarray) -> str:
    g = luminance(resize(to_rgb(p), 8, 8))
    return _hex(g >= g.mean())


def dhash(p: np.ndarray) -> str:
    g = luminance(resize(to_rgb(p), 9, 8))
    return _hex(g[:, :-1] > g[:, 1:])


def phash(p: np.ndarray) -> str:
    g = luminance(resize(to_rgb(p), 32, 32))
    i = np.arange(32)
    basis = np.cos(np.pi * (2 * i[None] + 1) * i[:, None] / 64)
    low = (basis @ g @ basis.T)[:8, :8]
    return _hex(low > np.median(low.ravel()[1:]))


HASHES = {"ahash": ahash, "dhash": dhash, "phash": phash}


def image_quality(p: np.ndarray) -> dict[str, float]:
    """Width, height, aspect, brightness, variance of the Laplacian, share of nearly black or white pixels."""
    g = luminance(p)
    lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] if min(g.shape) > 2 else np.zeros(1)
    return {"width": p.shape[1], "height": p.shape[0], "aspect": p.shape[1] / p.shape[0], "brightness": float(g.mean()), "sharpness": float(lap.var()), "extreme_ratio": float(((g < 5) | (g > 250)).mean())}


def _over(fn: Callable[[bytes], object], kind: str) -> Callable[[Column], Column]:
    """A column function; struct results are made of dicts."""
    if kind.startswith("struct"):

        def rows(data: pd.Series) -> pd.DataFrame:
            out = [fn(bytes(d)) if d is not None else None for d in data]
            names = [f.split(":")[0] for f in kind[7:-1].split(",")]
            return pd.DataFrame([o or {} for o in out], columns=names)

        return F.pandas_udf(rows, kind)

    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: fn(bytes(d)), na_action="ignore")

    return F.pandas_udf(run, kind)


def add_image_hash(df: DataFrame, column: str = "image", out_column: str = "phash", kind: str = "phash") -> DataFrame:
    fn = HASHES[kind]
    return df.withColumn(out_column, _over(lambda d: fn(decode_image(d)), "string")(col(column)))


QUALITY = "struct<width:int,height:int,aspect:double,brightness:double,sharpness:double,extreme_ratio:double>"


def add_image_quality(df: DataFrame, column: str = "image", prefix: str = "img_") -> DataFrame:
    scored = df.withColumn("__q", _over(lambda d: image_quality(decode_image(d)), QUALITY)(col(column)))
    names = ("width", "height", "aspect", "brightness", "sharpness", "extreme_ratio")
    return scored.select(*(col(c) for c in df.columns), *(F.col(f"__q.{n}").alias(prefix + n) for n in names))


def image_quality_filter(df: DataFrame, column: str = "image", min_width: int = 0, min_height: int = 0, min_sharpness: float = 0.0, max_extreme_ratio: float = 1.0, min_aspect: float = 0.0, max_aspect: float = float("inf")) -> DataFrame:
    q = add_image_quality(df, column, "__i_")
    ok = (F.col("__i_width") >= min_width) & (F.col("__i_height") >= min_height) & (F.col("__i_sharpness") >= min_sharpness) & (F.col("__i_extreme_ratio") <= max_extreme_ratio) & F.col("__i_aspect").between(min_aspect, max_aspect)
    return q.where(ok).select(*(col(c) for c in df.columns))


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits that differ between hashes of 16 hex digits, by halves of 32 bits."""
    half = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def image_dedup(df: DataFrame, id_column: str, column: str = "image", kind: str = "phash", max_distance: int = 6, bands: int | None = None, keep_cluster: bool = False) -> DataFrame:
    """One image of each group whose hashes differ in few bits.

    Pairs share a band of their hash; with more bands than ``max_distance`` bits, the default, none is missed.
    """
    from lakemill.operators.dedup import keep_representatives
    from lakemill.operators.store import stored

    n = bands or max_distance + 1
    hashed = stored(add_image_hash(df.select(col(id_column).alias("id"), col(column).alias("image")), "image", "h", kind).where("h IS NOT NULL").select("id", "h"))
    leaders = stored(hashed.groupBy("h").agg(F.min("id").alias("id"), F.collect_set("id").alias("all")))
    bits = F.concat(*(F.lpad(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(2)))
    edges = np.linspace(0, 64, n + 1).astype(int).tolist()
    keyed = leaders.withColumn("bits", bits).select("id", "h", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.substring("bits", a + 1, b - a).alias("k")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))).alias("b"))
    left = keyed.select(F.col("id").alias("a"), F.col("h").alias("ha"), "b")
    near = left.join(keyed.select(F.col("id").alias("b_id"), F.col("h").alias("hb"), "b"), "b").where((F.col("a") < F.col("b_id")) & (hamming_hex(F.col("ha"), F.col("hb")) <= max_distance))
    equal = leaders.where("size(all) > 1").select(F.col("id").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return keep_representatives(df, id_column, near.select("a", F.col("b_id").alias("b")).distinct().unionByName(equal), keep_cluster)


# chains of operations in one function


class MediaExpr:
    """image("c").resize(8, 8).encode(): a chain that one Python function computes; with_column of a relation takes it."""

    def __init__(self, column: str, steps: tuple = ()) -> None:
        self.column, self.steps = column, steps

    def _then(self, fn: Callable[[np.ndarray], np.ndarray]) -> MediaExpr:
        return MediaExpr(self.column, (*self.steps, fn))

    def resize(self, width: int, height: int) -> MediaExpr:
        return self._then(lambda p: resize(p, width, height))

    def crop(self, x: int, y: int, width: int, height: int) -> MediaExpr:
        return self._then(lambda p: crop(p, x, y, width, height))

    def to_mode(self, mode: str) -> MediaExpr:
        return self._then(lambda p: to_mode(p, mode))

    def pixels(self, data: bytes) -> np.ndarray:
        p = to_rgb(decode_image(data))
        for s in self.steps:
            p = s(p)
        return p

    def encode(self) -> Column:
        return _over(lambda d: encode_png(self.pixels(d)), "binary")(col(self.column))

    def decoded(self) -> Column:
        def one(d: bytes) -> dict:
            p = self.pixels(d)
            return {"height": p.shape[0], "width": p.shape[1], "channels": p.shape[2], "data": p.tobytes()}

        return _over(one, IMAGE)(col(self.column))

    def append(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, self.decoded())


def image(column: str) -> MediaExpr:
    return MediaExpr(column)


def decode_images(df: DataFrame, column: str = "image", out_column: str = "tensor", size: tuple[int, int] | None = None, mode: str = "RGB") -> DataFrame:
    """A struct of height, width, channels and bytes."""
    e = MediaExpr(column)
    return (e.resize(*size) if size else e).to_mode(mode).append(df, out_column)


AUDIO = "struct<samples:array<double>,sample_rate:int,num_frames:int,num_channels:int>"


def decode_wav(data: bytes, mono: bool = True, rate: int | None = None) -> dict:
    """Samples in [-1, 1]; a new rate is reached by linear interpolation."""
    with wave.open(io.BytesIO(data)) as w:
        n, c, width, own = w.getnframes(), w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / (1 << (8 * width - 1))
    x = x.reshape(-1, c)
    if mono:
        x = x.mean(axis=1, keepdims=True)
    if rate and rate != own and len(x):
        at = np.arange(round(len(x) * rate / own)) * own / rate
        x = np.stack([np.interp(at, np.arange(len(x)), x[:, i]) for i in range(x.shape[1])], axis=1)
    return {"samples": x.ravel().tolist(), "sample_rate": rate or own, "num_frames": len(x), "num_channels": x.shape[1]}


def decode_audio(df: DataFrame, column: str = "audio", out_column: str = "sound", mono: bool = True, target_sample_rate: int | None = None) -> DataFrame:
    return df.withColumn(out_column, _over(lambda d: decode_wav(d, mono, target_sample_rate), AUDIO)(col(column)))


def decode_documents(df: DataFrame, column: str = "document", out_column: str = "text", max_pages: int | None = None, decoder: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """A row per page with page_index; plain text divides at form feeds, other formats need a decoder."""

    def pages(d: bytes) -> list[str]:
        if decoder:
            return decoder(d)[:max_pages]
        if d[:5] == b"%PDF-":
            raise ValueError("PDF needs a decoder")
        return d.decode("utf-8", "replace").split("\f")[:max_pages]

    return df.withColumn("__pages", _over(pages, "array<string>")(col(column))).select(*(col(c) for c in df.columns), F.posexplode("__pages").alias("page_index", out_column))


def explode_video(df: DataFrame, column: str, decoder: Callable[[bytes], list[np.ndarray]], max_frames: int = 8, stride: int = 1, out_column: str = "frame") -> DataFrame:
    """A row per frame with frame_index, as PNG, by the decoder given."""
    frames = _over(lambda d: [encode_png(to_rgb(f)) for f in decoder(d)[::stride][:max_frames]], "array<binary>")
    return df.withColumn("__f", frames(col(column))).select(*(col(c) for c in df.columns), F.posexplode("__f").alias("frame_index", out_column))


def tensor(values: list, shape: list[int]) -> Column:
    """struct<shape, data> of literal values."""
    return F.struct(F.array(*map(F.lit, shape)).alias("shape"), F.array(*(F.lit(float(v)) for v in np.ravel(values))).alias("data"))


def tensor_to_numpy(rows: list) -> np.ndarray:
    """Rows of tensor structs of one shape, stacked."""
    return np.stack([np.array(r["data"]).reshape(r["shape"]) for r in rows])


def image_array(images: list[np.ndarray | None]) -> pa.Array:
    """Pixel arrays as a column of PNG files."""
    return pa.array([None if p is None else encode_png(np.asarray(p, np.uint8)) for p in images], pa.binary())


def url_download(df: DataFrame, column: str, out_column: str = "data") -> DataFrame:
    """Bytes of local paths and file:// URLs; other schemes raise."""

    def read(u: str) -> bytes:
        if "://" in u and not u.startswith("file://"):
            raise ValueError(f"only local files are read: {u}")
        with open(u.removeprefix("file://"), "rb") as f:
            return f.read()

    return df.withColumn(out_column, F.udf(lambda u: None if u is None else read(u), "binary", useArrow=True)(col(column)))
