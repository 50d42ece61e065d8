"""Column functions: base64 and data URLs, token URLs, JSON, byte reading, EBML numbers, pixels, histograms, geometry.

All are built-in expressions, so they stay in generated code and their filters can be pushed down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mime types of photographs, and the multi-picture one.
MIMES = ["image/mpo", "image/jpeg", "image/png", "image/gif", "image/webp"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def b64(data: Column) -> Column:
    """Standard base64 without line breaks."""
    return F.regexp_replace(F.base64(data), r"\s", "")


def unb64(text: Column) -> Column:
    """Bytes of a base64 text; foreign characters are skipped."""
    return F.unbase64(F.regexp_replace(text, "[^A-Za-z0-9+/=]", ""))


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), b64(data))


def data_url_mime(url: Column) -> Column:
    """The mime type of a base64 data URL, or null if it isn't one."""
    head = F.split(F.substring_index(F.substr(url, F.lit(6)), ",", 1), ";")
    mime = F.get(head, F.lit(0))
    fine = url.startswith("data:") & (F.instr(url, ",") > 1) & F.exists(head, lambda a: a == "base64") & ((mime == "") | (F.instr(mime, "/") > 1))
    return F.when(fine, mime)


def data_url_bytes(url: Column) -> Column:
    return F.when(data_url_mime(url).isNotNull(), unb64(F.substr(url, F.instr(url, ",") + 1)))


def is_numeric(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def supported_mime(mime: Column) -> Column:
    return mime.isin(*MIMES)


def maybe_stereo(mime: Column, name: Column) -> Column:
    """Whether a file may hold a stereo photograph, by its declared type and name."""
    lower = F.lower(name)
    return F.coalesce(mime, F.lit("")).isin("", "image/mpo") | ((mime == "image/jpeg") & (lower.endswith(".mpo") | lower.contains(".mpo.")))


def download_url(url: Column) -> Column:
    """/d before the last path segment."""
    return F.regexp_replace(url, "/([^/]*)$", "/d/$1")


def files_token(ids: Column) -> Column:
    return F.array_join(ids, "/")


def album_token(user: Column, album_id: Column, album: Column, auth: Column) -> Column:
    """Four parts with trailing empty ones trimmed."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.concat_ws("/", part(user), part(album_id), part(album), part(auth)), "/+$", "")


def parse_album_token(token: Column) -> Column:
    """struct(user, album_id, album, auth), or null if there is no user, or neither album nor id."""
    part = lambda k: F.nullif(F.get(F.split(token, "/"), F.lit(k)), F.lit(""))
    return F.when(part(0).isNotNull() & (part(1).isNotNull() | part(2).isNotNull()), F.struct(part(0).alias("user"), part(1).alias("album_id"), part(2).alias("album"), part(3).alias("auth")))


def unsigned(data: Column, at: Column | int, size: int, little: Column | bool = False) -> Column:
    """The unsigned number of size bytes at a place (from 0), or null where the bytes end before."""
    at = at if isinstance(at, Column) else F.lit(at)
    digits = F.hex(F.substr(data, at + 1, F.lit(size)))
    low = F.concat(*(F.hex(F.substr(data, at + (k + 1), F.lit(1))) for k in reversed(range(size))))
    value = F.when(little, low).otherwise(digits) if isinstance(little, Column) else low if little else digits
    return F.when((at >= 0) & (at + size <= F.octet_length(data)), F.conv(value, 16, 10).cast("long"))


def signed32(data: Column, at: Column | int, little: Column | bool = False) -> Column:
    value = unsigned(data, at, 4, little)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def ebml_id(value: Column) -> Column:
    """Hex of the fewest big-endian bytes; 0 has none."""
    digits = F.hex(value)
    return F.when(value == 0, "").otherwise(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))


def ebml_width(value: Column) -> Column:
    """Bytes of a variable-length size; null for 0 and less. One byte for 1, else one more than whole bytes hold the bits of value - 1."""
    bits = F.length(F.bin(value - 1))
    return F.when(value == 1, 1).when(value > 1, (F.ceil(bits / 8) + 1).cast("int"))


def ebml_size(value: Column) -> Column:
    """Hex of a variable-length size: a marker bit, then 7 bits of each byte; for values below 2**48."""
    width = ebml_width(value)
    return F.lpad(F.hex(value + F.pow(F.lit(2.0), 7 * width).cast("long")), 2 * width, F.lit("0"))


def ebml_number(value: Column, width: int | None = None) -> Column:
    """Hex of an unsigned number, zero-padded to a width; null where it doesn't fit."""
    digits = F.when(value == 0, "00").otherwise(ebml_id(value))
    return digits if width is None else F.when(F.length(digits) <= 2 * width, F.lpad(digits, 2 * width, "0"))


#: The weights of red, green and blue in luma and in both chromas, in 16 bits.
LUMA, CHROMA_U, CHROMA_V = (16839, 33059, 6420), (-9719, -19081, 28800), (28800, -24116, -4684)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + F.lit((1 << 15) + (16 << 16)), 16)


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """(u, v) from the sums of four pixels."""
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(x + F.lit(257 << 17), 18)))
    mixed = lambda w: clip(w[0] * r + w[1] * g + w[2] * b)
    return mixed(CHROMA_U), mixed(CHROMA_V)


def aspect_fit(width: Column, height: Column, box_w: Column, box_h: Column) -> tuple[Column, Column, Column, Column]:
    """(left, top, width, height) of a picture fitted into a box, centred: by width first, by height if it is then too tall."""
    tall = F.ceil(box_w * height / width)
    fits = tall <= box_h
    w, h = F.when(fits, box_w).otherwise(F.ceil(box_h * width / height)).cast("long"), F.when(fits, tall).otherwise(box_h).cast("long")
    return F.floor((box_w - w) / 2), F.floor((box_h - h) / 2), w, h


def fold_checksum(values: Column) -> Column:
    """An order-sensitive checksum of an array of numbers: each step is cut to 32 bits with a sign, whose sign then goes."""
    cut = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.lit(1 << 31)) - (1 << 31)
    return F.aggregate(values, F.lit(0).cast("long"), lambda old, v: F.abs(cut(3 * old + F.abs(v.cast("long")) + 1)))
