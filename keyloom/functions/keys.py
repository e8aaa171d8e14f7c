"""Keys: physical encoding, successors, ordered codecs and range predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEYSPACE = (1 << 24) - 1
MAX_KEY, MAX_VALUE, MAX_BATCH, MAX_BOUND = 4096, 65536, 256, 65536
MODES = ("r", "s")


def physical_key(keyspace_id: Column, user_key: Column, mode: str = "r") -> Column:
    """mode byte, keyspace id in three big-endian bytes, user key; ids out of range raise."""
    if mode not in MODES:
        raise ValueError(f"invalid key mode {mode!r}")
    good = (keyspace_id >= 0) & (keyspace_id <= MAX_KEYSPACE)
    head = F.unhex(F.lpad(F.hex(keyspace_id.cast("long")), 6, "0"))
    checked = F.when(good, head).otherwise(F.raise_error(F.lit("keyspace id out of range")).cast("binary"))
    return F.concat(F.lit(mode).cast("binary"), checked, user_key)


def decode_key(key: Column) -> Column:
    """struct (mode, keyspace_id, user_key); null for a malformed key or an unknown mode."""
    mode = F.substring(key, 1, 1).cast("string")
    space = F.conv(F.hex(F.substring(key, 2, 3)), 16, 10).cast("int")
    good = (F.octet_length(key) >= 4) & mode.isin(*MODES)
    return F.when(good, F.struct(mode.alias("mode"), space.alias("keyspace_id"), F.substring(key, 5, MAX_BOUND).alias("user_key")))


def keyspace_bounds(keyspace_id: int, mode: str = "r") -> tuple[bytes, bytes | None]:
    """First physical key of a keyspace and the first one after it (None: no end)."""
    if not 0 <= keyspace_id <= MAX_KEYSPACE:
        raise ValueError("keyspace id out of range")
    start = mode.encode() + keyspace_id.to_bytes(3, "big")
    return start, prefix_successor(start)


def prefix_successor(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def successor(key: Column) -> Column:
    """The least key above key."""
    return F.concat(key, F.unhex(F.lit("00")))


def encode_ordered(*values: int | str | bytes) -> bytes:
    """Order-preserving bytes of a tuple: big-endian numbers, escaped and closed strings."""
    out = b""
    for v in values:
        if isinstance(v, int):
            out += v.to_bytes(8, "big")
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += raw.replace(b"\0", b"\0\xff") + b"\0\1"
    return out


def decode_ordered(data: bytes, kinds: list[type]) -> tuple:
    """The tuple that encode_ordered wrote; malformed bytes raise ValueError."""
    out, at = [], 0
    for kind in kinds:
        if kind is int:
            if len(data) < at + 8:
                raise ValueError("malformed key")
            out.append(int.from_bytes(data[at : at + 8], "big"))
            at += 8
            continue
        raw = bytearray()
        while True:
            pair = data[at : at + 2]
            if pair[:1] != b"\0":
                if not pair:
                    raise ValueError("malformed key")
                raw += pair[:1]
                at += 1
            elif pair == b"\0\xff":
                raw += b"\0"
                at += 2
            elif pair == b"\0\1":
                at += 2
                break
            else:
                raise ValueError("malformed key")
        out.append(raw.decode() if kind is str else bytes(raw))
    if at != len(data):
        raise ValueError("malformed key")
    return tuple(out)


def literal_key(text: str) -> bytes:
    """A key as typed: hex:0a1b, "quoted" or plain text."""
    if text.startswith("hex:"):
        return bytes.fromhex(text[4:])
    if len(text) >= 2 and text[0] == text[-1] == '"':
        return text[1:-1].encode().decode("unicode_escape").encode("latin-1")
    return text.encode()


def in_range(key: Column, start: Column, end: Column) -> Column:
    """Half-open containment; a null end is no end."""
    return (key >= start) & (end.isNull() | (key < end))


def range_in_range(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    """Whether [start, end) lies within [outer_start, outer_end); null ends are no ends."""
    return (start >= outer_start) & (outer_end.isNull() | (end.isNotNull() & (end <= outer_end)))


def fresh(conf_ver: Column, version: Column, now_conf: Column, now_version: Column) -> Column:
    """Router's rule: each part of the request's epoch is at least the current one."""
    return F.coalesce((conf_ver >= now_conf) & (version >= now_version), F.lit(False))


def exact_epoch(conf_ver: Column, version: Column, now_conf: Column, now_version: Column, sealed: Column) -> Column:
    """Serving and applying rule: the epoch is the current one and the range is not sealed."""
    return F.coalesce((conf_ver == now_conf) & (version == now_version) & ~sealed, F.lit(False))
