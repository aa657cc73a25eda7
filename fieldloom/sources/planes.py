"""Binary plane files (int32 n, float64 n*n or 5*n*n interleaved, int32 n), FITS images and geometry records.

Planes and images are written and read by ranges of lines, so a task holds one block of about ``BLOCK`` values, whatever the size of the grid.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import opened

ROW_BLOCK = 64
#: Values of a block, about.
BLOCK = 1 << 20
FIELDS = ("psi_x", "psi_y", "psi_xx", "psi_xy", "psi_yy")


def _bytes(where: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
    """Parts (offset, length) of a file."""
    system, path = opened(where)
    with system.open_input_file(path) as f:
        return [f.read_at(length, offset) for offset, length in ranges]


def block_lines(n: int, components: int = 1) -> int:
    """Grid lines in a block."""
    return max(1, BLOCK // (n * components))


_RANGES = "path string, n int, i int, height int, start long, error string, kind string, scale double, zero double"


def _read_ranges(spark: SparkSession, path: str, layout: Callable[[str, int], dict], components: int) -> DataFrame:
    """(path, n, i, values, error) of all files: ``layout`` looks at a file's ends, and its lines are then read block by block, each block where
    the shuffle puts it. No task holds more than a block."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # without their content

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length in zip(batch["path"], batch["length"]):
                f = {"height": 0, "start": 0, "error": None, "kind": "<f8", "scale": 1.0, "zero": 0.0} | layout(name, int(length))
                lines = block_lines(max(f["n"], 1), components)
                total = f.pop("lines", 0)
                firsts = [-1] if f["error"] else range(0, total, lines)
                width = components * f["n"] * np.dtype(f["kind"]).itemsize
                rows = [
                    f | {"path": name, "i": i, "height": 0 if i < 0 else min(lines, total - i), "start": f["start"] + max(i, 0) * width} for i in firsts
                ]
                for k in range(0, len(rows), 1024):
                    yield pd.DataFrame(rows[k : k + 1024], columns=["path", "n", "i", "height", "start", "error", "kind", "scale", "zero"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                if f.i < 0:
                    yield pd.DataFrame({"path": [f.path], "n": [f.n], "i": [-1], "values": [[]], "error": [f.error]})
                    continue
                width = components * f.n
                (content,) = _bytes(f.path, [(f.start, f.height * width * np.dtype(f.kind).itemsize)])
                data = np.frombuffer(content, f.kind).reshape(f.height, width).astype("f8") * f.scale + f.zero
                for s in range(0, f.height, ROW_BLOCK):
                    part = data[s : s + ROW_BLOCK]
                    yield pd.DataFrame({"path": f.path, "n": f.n, "i": np.arange(s, s + len(part)) + f.i, "values": list(part), "error": None})

    blocks = files.mapInPandas(plan, _RANGES).repartition("path", "i")
    return blocks.mapInPandas(parse, "path string, n int, i int, values array<double>, error string")


def read_planes(spark: SparkSession, path: str, components: int = 1, expected: int | None = None) -> DataFrame:
    """(path, n, i, values, error): one row per grid line, ``values`` in file order.

    A file whose header, footer or length disagree gives one row with ``error`` set instead of failing the job. Files are read by ranges of
    lines, so a file larger than a task's memory is no obstacle. Spark lists no empty files, so those show up as absent when the result is
    compared with what was expected.
    """

    def layout(name: str, length: int) -> dict:
        if length < 8:
            return {"n": 0, "error": "file too short"}
        n, foot = (int(np.frombuffer(x, "<i4")[0]) for x in _bytes(name, [(0, 4), (length - 4, 4)]))
        if n != foot:
            error = f"header {n} != footer {foot}"
        elif expected is not None and n != expected:
            error = f"grid {n} != expected {expected}"
        elif length != 8 + 8 * components * n * n:
            error = f"length {length} does not fit grid {n}"
        else:
            error = None
        return {"n": n, "lines": n, "start": 4, "error": error}

    return _read_ranges(spark, path, layout, components)


def positions(lines: DataFrame, keys: Sequence[str] = ("path",), components: int = 1) -> DataFrame:
    """(keys, position, value): lines as single numbers by their place in the file."""
    flat = lines.where(F.col("error").isNull()).select(*keys, "n", "i", F.posexplode("values").alias("p", "value"))
    return flat.select(*keys, (F.col("p") + F.lit(components) * F.col("n").cast("long") * F.col("i")).alias("position"), "value")


def to_pixels(lines: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Lines of a one-component plane to (keys, i, j, v)."""
    return lines.where(F.col("error").isNull()).select(*keys, "i", F.posexplode("values").alias("j", "v"))


def to_potential_pixels(lines: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Lines of an interleaved five-component plane to one column per component."""
    flat = lines.where(F.col("error").isNull()).select(*keys, "i", "values", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return flat.select(*keys, "i", "j", *[F.element_at("values", F.col("j") * 5 + (f + 1)).alias(nm) for f, nm in enumerate(FIELDS)])


def interleave(pixels: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, position, value) with position f + 5*(j + n*i)."""
    comps = F.array(*[F.col(c) for c in FIELDS])
    spread = pixels.select(*keys, "i", "j", F.posexplode(comps).alias("f", "value"))
    return spread.select(*keys, (F.col("f") + 5 * (F.col("j") + F.lit(n).cast("long") * F.col("i"))).alias("position"), "value")


def _write_ranges(pixels: DataFrame, folder: str, name: str, n: int, values: Sequence[str], head: bytes, tail: bytes, kind: str, suffix: str) -> DataFrame:
    """(file, pixels): each block of lines is written by a task of its own, as a part that is named by its offset; the list of a file's parts
    then goes to one task, which streams them into the file, part by part. Lines without pixels are zero. The file takes its name at the
    end, and a part written twice is the same, so retried tasks leave nothing half done. The parts stay in ``folder``-parts."""
    comps, lines = len(values), block_lines(n, len(values))
    size = np.dtype(kind).itemsize * comps * n

    def part(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(keys[1])
        data = np.zeros((min(lines, n - first), n, comps))
        data[pdf["i"].to_numpy() - first, pdf["j"].to_numpy()] = pdf[list(values)].to_numpy()
        where = store(f"{folder}-parts", f"{keys[0]}{suffix}/{len(head) + size * first}", data.astype(kind).tobytes())
        return pd.DataFrame({"file": [f"{keys[0]}{suffix}"], "first": [first], "part": [where], "pixels": [len(pdf)]})

    def whole(keys: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        system, path = opened(f"{folder.rstrip('/')}/{keys[0]}")
        system.create_dir(os.path.dirname(path), recursive=True)
        partial = f"{path}.{uuid.uuid4().hex}.part"
        at = dict(zip(parts["first"].tolist(), parts["part"].tolist(), strict=True))
        with system.open_output_stream(partial) as out:
            out.write(head)
            for first in range(0, n, lines):
                length = size * min(lines, n - first)
                out.write(_bytes(at[first], [(0, length)])[0] if first in at else bytes(length))
            out.write(tail)
        system.move(partial, path)
        return pd.DataFrame({"file": [path], "pixels": [int(parts["pixels"].sum())]})

    first = (F.floor(F.col("i") / lines) * lines).cast("int").alias("first")
    parts = pixels.select(name, first, "i", "j", *values).groupBy(name, "first").applyInPandas(part, "file string, first int, part string, pixels long")
    return parts.groupBy("file").applyInPandas(whole, "file string, pixels long")


def write_planes(pixels: DataFrame, folder: str, name: str, n: int, values: Sequence[str] = ("v",)) -> DataFrame:
    """Write one binary file per ``name`` value (a path below ``folder``), its components interleaved; returns (file, pixels)."""
    mark = np.array([n], dtype="<i4").tobytes()
    return _write_ranges(pixels, folder, name, n, values, mark, mark, "<f8", "")


def store(folder: str, name: str, content: bytes) -> str:
    """Put one file into a folder on any file system Arrow knows, whole or not at all; returns where it is."""
    where = f"{folder.rstrip('/')}/{name}"
    system, path = opened(where)
    system.create_dir(os.path.dirname(path), recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(partial) as out:
        out.write(content)
    system.move(partial, path)
    return where


# --- FITS primary images ---------------------------------------------------------

_BLOCK = 2880
_FITS_TYPES = {-64: ">f8", -32: ">f4", 32: ">i4", 16: ">i2"}


def fits_header(shape: tuple[int, int]) -> bytes:
    """The header of a two-dimensional float64 image as a FITS primary unit."""
    cards = [("SIMPLE", "T"), ("BITPIX", "-64"), ("NAXIS", "2"), ("NAXIS1", str(shape[1])), ("NAXIS2", str(shape[0]))]
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
    return head.ljust(-(-len(head) // _BLOCK) * _BLOCK).encode("ascii")


def fits_cards(block: Callable[[int], bytes]) -> tuple[dict[str, str], int]:
    """The cards of a primary header and the offset of its data; ``block`` gives the k-th block of the file."""
    cards: dict[str, str] = {}
    for k in itertools.count():
        text = block(k).decode("ascii", "replace")
        if len(text) < _BLOCK:
            raise ValueError("FITS header has no END")
        for c in range(0, _BLOCK, 80):
            card = text[c : c + 80]
            if card[:8].strip() == "END":
                return cards, (k + 1) * _BLOCK
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip()


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, i, values, error): one row per image line of ``n`` values, scaled by BSCALE and BZERO. Read by ranges, like planes; a file
    without a two-dimensional primary image of its length gives a row with ``error`` set."""

    def layout(name: str, length: int) -> dict:
        try:
            cards, start = fits_cards(lambda k: _bytes(name, [(k * _BLOCK, _BLOCK)])[0])
            nx, ny = (int(cards[f"NAXIS{d}"]) for d in (1, 2))
            kind = _FITS_TYPES[int(cards["BITPIX"])]
            if cards["NAXIS"] != "2" or length < start + nx * ny * np.dtype(kind).itemsize:
                raise ValueError(f"length {length} does not fit the image")
            scale, zero = (float(cards.get(c, d)) for c, d in (("BSCALE", 1), ("BZERO", 0)))
        except (KeyError, ValueError) as e:
            return {"n": 0, "error": f"not a FITS image: {e}"}
        return {"n": nx, "lines": ny, "start": start, "kind": kind, "scale": scale, "zero": zero}

    return _read_ranges(spark, path, layout, 1)


def write_fits(pixels: DataFrame, folder: str, name: str, n: int, value: str = "v") -> DataFrame:
    """One FITS file per map of n*n pixels."""
    return _write_ranges(pixels, folder, name, n, [value], fits_header((n, n)), bytes(-8 * n * n % _BLOCK), ">f8", ".fits")


def geometry_bytes(planes: Sequence[tuple], transforms: Sequence[tuple], box: float) -> bytes:
    """Light-cone geometry record: plane and snapshot counts, a, chi, chi_out, box sizes, transforms.

    planes: (plane, chi_lens, z_lens, chi_source, z_source); transforms: (direction, dx, dy, dz, flip).
    """
    n_p, n_s = len(planes), len(transforms)
    a = [1.0] + [1.0 / (1.0 + p[2]) for p in planes]
    parts = [
        np.array([n_p, n_s], dtype="<i4"),
        np.array(a),
        np.array([0.0] + [p[1] for p in planes]),
        np.array([p[3] for p in planes]),
        np.full(n_s, box),
        np.full(n_s, box),
        np.array([t[0] for t in transforms], dtype="<i4"),
        np.array([t[1:4] for t in transforms]).ravel(),
        np.repeat(np.array([t[4] for t in transforms], dtype=np.bool_), 3),
    ]
    return b"".join(p.tobytes() for p in parts)


def read_geometry(content: bytes) -> dict[str, np.ndarray]:
    """The fields of a geometry record."""
    n_p, n_s = np.frombuffer(content, "<i4", 2).tolist()
    fields = [("a", "<f8", n_p + 1), ("chi", "<f8", n_p + 1), ("chi_out", "<f8", n_p), ("box", "<f8", n_s), ("box_out", "<f8", n_s)]
    fields += [("direction", "<i4", n_s), ("shift", "<f8", 3 * n_s), ("flip", "?", 3 * n_s)]
    out, at = {}, 8
    for field, kind, count in fields:
        out[field] = np.frombuffer(content, kind, count, at)
        at += out[field].nbytes
    if at != len(content):
        raise ValueError(f"record of {len(content)} bytes, {at} expected")
    return out | {"shift": out["shift"].reshape(-1, 3), "flip": out["flip"].reshape(-1, 3)}


def write_geometry(planes: DataFrame, folder: str, name: str, box: float) -> DataFrame:
    """One geometry record per ``name`` value, of its planes (plane, chi_lens, z_lens, chi_source, z_source), which a light cone has few of; returns
    (file, planes). Repeated planes count once."""
    columns = ("plane", "chi_lens", "z_lens", "chi_source", "z_source")
    held = planes.groupBy(F.col(name).cast("string").alias("name")).agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("planes"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [[tuple(p[c] for c in columns) for p in ps] for ps in b["planes"]]
            yield pd.DataFrame({"file": [store(folder, k, geometry_bytes(r, [], box)) for k, r in zip(b["name"], rows, strict=True)], "planes": [len(r) for r in rows]})

    return held.mapInPandas(write, "file string, planes int")


def geometry_planes(spark: SparkSession, path: str) -> DataFrame:
    """(path, k, a, chi_lens, chi_source): the planes of geometry records, in their order; entry 0, the observer, is left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                g = read_geometry(content)
                yield pd.DataFrame({"path": name, "k": np.arange(len(g["chi_out"])), "a": g["a"][1:], "chi_lens": g["chi"][1:], "chi_source": g["chi_out"]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, k int, a double, chi_lens double, chi_source double")
