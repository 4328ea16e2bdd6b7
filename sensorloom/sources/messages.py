"""Binary messages: little-endian CDR with an encapsulation header, decoded in Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layout after the header, by message kind: struct codes of the fields in order; those without a name are passed over.
LAYOUTS = {
    "VelocitySensor": (("v", "d"),),
    "DriverControllerCommand": (("position", "b"),),
    "NavSatFix": (("status", "b"), ("service", "H"), ("lat", "d"), ("lon", "d"), ("alt", "d"), *((f"cov{i}", "d") for i in range(9)), ("cov_type", "B")),
    "Odometry": (("", "text"), *((n, "d") for n in ("x", "y", "z", "qx", "qy", "qz", "qw")), *(("", "d"),) * 36, ("vx", "d"), ("vy", "d"), ("vz", "d"), ("", "d"), ("", "d"), ("wz", "d")),
    "TwistStamped": tuple((n, "d") for n in ("vx", "vy", "vz", "wx", "wy", "wz")),
}
SCHEMA = "t_us long, frame string, fields map<string, double>"


def decode(kind: str, data: bytes) -> tuple[int, str, dict[str, float]] | None:
    """Stamp in microseconds, frame and fields; null for an unknown kind or a cut message."""
    layout = LAYOUTS.get(kind.rpartition("/")[2])
    if layout is None or data is None:
        return None
    at = 4  # alignment counts from here

    def take(code: str):
        nonlocal at
        if code == "text":
            at += take("I")
            return 0.0
        size = struct.calcsize(code)
        at += -(at - 4) % size
        (value,) = struct.unpack_from("<" + code, data, at)
        at += size
        return value

    try:
        sec, nsec, length = take("i"), take("I"), take("I")
        frame = data[at : at + length - 1].decode("utf-8", "replace")
        at += length
        return sec * 1_000_000 + nsec // 1000, frame, {name: x for name, x in [(name, float(take(code))) for name, code in layout] if name}
    except struct.error:
        return None


def encode(kind: str, sec: int, nsec: int, frame: str, fields: dict[str, float]) -> bytes:
    """The inverse of ``decode``, for tests and replays."""
    out = bytearray(b"\x00\x01\x00\x00")

    def put(code: str, value) -> None:
        size = struct.calcsize(code)
        out.extend(b"\0" * (-(len(out) - 4) % size))
        out.extend(struct.pack("<" + code, value))

    text = frame.encode() + b"\0"
    put("i", sec)
    put("I", nsec)
    put("I", len(text))
    out.extend(text)
    for name, code in LAYOUTS[kind]:
        if code == "text":
            put("I", len(text))
            out.extend(text)
        else:
            put(code, fields.get(name, 0.0) if code == "d" else int(fields[name]))
    return bytes(out)


def decoded(kind: Column, data: Column) -> Column:
    """A struct (t_us, frame, fields) of each message."""

    @F.pandas_udf(SCHEMA)
    def run(kinds: pd.Series, blobs: pd.Series) -> pd.DataFrame:
        rows = [decode(k, bytes(b)) if k is not None and b is not None else None for k, b in zip(kinds, blobs, strict=True)]
        return pd.DataFrame([r or (None, None, None) for r in rows], columns=["t_us", "frame", "fields"]).astype({"t_us": "Int64"})

    return run(kind, data)


def wheel_samples(raw: DataFrame) -> DataFrame:
    """``run, stream, seq, kind, data`` to samples; unknown kinds are dropped, as are cut messages."""
    m = raw.withColumn("m", decoded(F.col("kind"), F.col("data"))).filter("m.t_us is not null")
    return m.select("run", "stream", "seq", F.col("m.t_us").alias("t"), F.coalesce(F.col("m.fields")["v"], F.col("m.fields")["position"]).alias("v"), F.col("m.fields").alias("fields"))
