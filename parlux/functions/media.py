"""Column functions: links and tokens, error classes, sets, texts, and layouts of a viewer. Built-in expressions only.

Null inputs give null, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlux.functions import columns as C

#: Parameters of links, the display types that need stereo photographs, second bytes of a section's marker.
STATE, FILES, FILE, FOLDER, PHOTO = "state", "googledrivefiles", "file", "googledrivefolder", "photo"
STEREO_TYPES = ["three_d_anaglyph", "three_d_cross", "three_d_left_image", "three_d_nvidia", "three_d_right_image", "three_d_wobble"]
SECTION_MARKERS = [0xDB, 0xDD, 0xC0, 0xC4, 0xDA]
#: Fixed values of layouts, in pixels and milliseconds: gap and widest picture side by side, margin of the dots, least picture height;
#: frame and fill of a progress bar; interval of alternating pictures, time of a notice, seconds before a login's end and least delay.
GAP, WIDEST, DOT_MARGIN, LEAST_HEIGHT, BAR_FRAME, BAR_LEAST, WOBBLE_MS, NOTICE_MS, REFRESH_S = 4, 350, 16, 50, 6, 14, 100, 5000, 300
#: Fixed value: photographs that are looked ahead for.
PREFETCH = 4


# links


def parameter(url: Column, name: str) -> Column:
    """A query parameter, decoded; null if it is absent or empty."""
    return F.nullif(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit(""))


def state_ids(url: Column) -> Column:
    """The ids that a link's state opens: null for no JSON, another action than open, or no ids."""
    state = F.from_json(parameter(url, STATE), "action string, ids array<string>")
    return F.when((state["action"] == "open") & (F.size(state["ids"]) > 0), state["ids"])


def link_token(url: Column) -> Column:
    """struct(kind, ids, current) of a link: files of its state, else a list of files, else a folder; the first parameter that is there
    decides, even if it is not valid. Null if there is none."""
    return C.let(url, _link_token)


def _link_token(url: Column) -> Column:
    token = lambda kind, ids, current: F.struct(F.lit(kind).alias("kind"), ids.alias("ids"), current.alias("current"))
    state, files, folder = (parameter(url, p) for p in (STATE, FILES, FOLDER))
    opened = F.when(state_ids(url).isNotNull(), token("files", state_ids(url), F.lit(None).cast("string")))
    return F.when(state.isNotNull(), opened).when(files.isNotNull(), token("files", F.split(files, "/"), parameter(url, FILE))).when(folder.isNotNull(), token("folder", F.array(folder), parameter(url, PHOTO)))


def folder_link(folder: Column, photo: Column) -> Column:
    """The query of a folder's link, its photograph if there is one."""
    return F.concat(F.lit(f"{FOLDER}="), F.url_encode(folder), F.coalesce(F.concat(F.lit(f"&{PHOTO}="), F.url_encode(photo)), F.lit("")))


def plain_slashes(url: Column) -> Column:
    """Encoded slashes of the query as slashes; the rest of the url stays, what stands behind # as well."""
    parts = C.let(url, lambda u: F.struct(F.regexp_extract(u, r"(?s)^([^?#]*)", 1).alias("a"), F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("b"), F.regexp_extract(u, r"(?s)^[^#]*(#.*)$", 1).alias("c")))
    return C.let(parts, lambda p: F.concat(p["a"], F.regexp_replace(p["b"], "%2[Ff]", "/"), p["c"]))


def feed_url(user: Column, album_id: Column, album: Column, auth: Column) -> Column:
    """The address of an album's feed: by id if there is one, else by name."""
    where = F.coalesce(F.concat(F.lit("/albumid/"), F.nullif(album_id, F.lit(""))), F.concat(F.lit("/album/"), album))
    key = F.coalesce(F.concat(F.lit("&authkey="), F.url_encode(F.nullif(auth, F.lit("")))), F.lit(""))
    return F.concat(F.lit("https://picasaweb.google.com/data/feed/api/user/"), user, where, F.lit("?alt=json&v=2"), key)


# answers and errors


def answer_class(answer: Column, empty_is_fine: Column | bool = False) -> Column:
    """What a service's JSON answer means: OK, RETRY (an authorization failed; once), NOT_FOUND, NETWORK or UNEXPECTED. A null answer is
    UNEXPECTED, unless an empty one is expected."""
    code, message = F.get_json_object(answer, "$.error.code"), F.coalesce(F.get_json_object(answer, "$.error.message"), F.lit(""))
    failed = F.get_json_object(answer, "$.error").isNotNull()
    kind = F.when(~failed, "OK").when(code == "401", "RETRY").when(code == "404", "NOT_FOUND").when((code == "-1") & F.contains(message, F.lit("network")), "NETWORK").otherwise("UNEXPECTED")
    empty = empty_is_fine if isinstance(empty_is_fine, Column) else F.lit(empty_is_fine)
    return F.when(answer.isNull(), F.when(empty, "OK").otherwise("UNEXPECTED")).otherwise(kind)


def status_class(status: Column, missing: int) -> Column:
    """What an HTTP status means, null for a network error; missing: the status of what is not found (403 for data, 404 for feeds)."""
    return F.when(status.isNull(), "NETWORK").when(status == 200, "OK").when(status == missing, "NOT_FOUND").otherwise("UNEXPECTED")


def error_text(error: Column) -> Column:
    """An error (a struct) as JSON, without its null fields."""
    return F.to_json(error)


def one_or_many(text: Column, path: str, kind: str) -> Column:
    """A JSON value that is an array of kind or a single one, as an array; empty if it is absent."""
    value = F.get_json_object(text, path)
    many = F.from_json(value, f"array<{kind}>")
    single = F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"array<{kind}>")
    return F.coalesce(F.when(F.startswith(value, F.lit("[")), many).otherwise(single), F.array().cast(f"array<{kind}>"))


# sets of texts


def add_all(have: Column, new: Column) -> tuple[Column, Column]:
    """(the union in the order of first occurrence, whether anything was added)."""
    return F.array_union(have, new), F.size(F.array_except(new, have)) > 0


def contains_all(have: Column, other: Column) -> Column:
    return F.size(F.array_except(other, have)) == 0


def equal_sets(a: Column, b: Column) -> Column:
    return contains_all(a, b) & contains_all(b, a)


def in_states(state: Column, *states: str) -> Column:
    return state.isin(*states)


def is_stereo_type(kind: Column) -> Column:
    return F.lower(kind).isin(*STEREO_TYPES)


def by_name(name: Column, values: list[str]) -> Column:
    """The value of an enumeration by its name, null if unknown."""
    return F.when(name.isin(values), name)


# texts and bytes


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def header_parts(header: Column) -> tuple[Column, Column]:
    """(name, value) around the first = ; no = gives a null value."""
    at = F.instr(header, "=")
    return F.when(at > 0, F.substr(header, F.lit(1), at - 1)).otherwise(header), F.when(at > 0, F.substr(header, at + 1))


def codes(text: Column) -> Column:
    """The UTF-16 code units of a text."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    return F.transform(F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 4 - 1).cast("int"))).when(digits == "", F.array().cast("array<int>")), lambda k: F.conv(F.substr(digits, 4 * k + 1, F.lit(4)), 16, 10).cast("int"))


def from_codes(units: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(units, lambda u: F.lpad(F.hex(u.cast("long")), 4, "0")), "")), "UTF-16BE")


def hex_dump(data: Column) -> Column:
    """Bytes as unpadded hexadecimal numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "), "0([0-9a-f]) ", "$1 "))


def reversed_bytes(data: Column) -> Column:
    digits = F.hex(data)
    return F.unhex(F.array_join(F.transform(F.when(F.length(digits) > 0, F.sequence((F.length(digits) / 2 - 1).cast("int"), F.lit(0), F.lit(-1))).when(digits == "", F.array().cast("array<int>")), lambda k: F.substr(digits, 2 * k + 1, F.lit(2))), ""))


def lines_of(text: Column, first: int = 73, rest: int = 78) -> Column:
    """A text in lines of a first and a following length; one pass over the text."""
    tail = F.regexp_extract_all(F.substr(text, F.lit(first + 1)), F.lit(f"(?s).{{1,{rest}}}"), F.lit(0))
    return F.concat(F.array(F.substr(text, F.lit(1), F.lit(first))), tail)


def is_section_marker(data: Column) -> Column:
    return F.substr(data, F.lit(2), F.lit(1)).isin([F.lit(bytes([m])) for m in SECTION_MARKERS])


def with_end(image: Column) -> Column:
    """A picture with its end marker, which is appended where it is missing."""
    return F.when(F.substr(image, F.lit(-2)) == F.lit(b"\xff\xd9"), image).otherwise(F.concat(image, F.lit(b"\xff\xd9")))


# layouts


def cross_layout(box_w: Column, box_h: Column, header: Column, width: Column, height: Column, right: Column) -> Column:
    """struct(x, y, width, height) of the left or right one of two pictures for cross-eyed viewing."""
    half, top = F.ceil(box_w / 2), F.greatest(F.lit(LEAST_HEIGHT), box_h - header)
    w = F.least(half - GAP // 2, F.lit(WIDEST))
    h = F.ceil(w * height / width)
    tall = h > top
    w, h = F.when(tall, F.ceil(top * width / height)).otherwise(w).cast("long"), F.when(tall, top).otherwise(h).cast("long")
    x = F.when(right, half + GAP // 2).otherwise(half - w - GAP // 2)
    return F.struct(x.cast("long").alias("x"), F.greatest(header, F.floor((box_h - h) / 2)).cast("long").alias("y"), w.alias("width"), h.alias("height"))


def wobble_layout(box_w: Column, box_h: Column, width: Column, height: Column, parallax: Column) -> Column:
    """struct(x, y, width, height, shift0, shift1) of the window in which two pictures alternate, each shifted by its share of the parallax."""
    ratio = parallax / width
    clipped = width * (1 - F.abs(ratio))
    h = F.ceil(box_w * height / clipped)
    tall = h > box_h
    w, h = F.when(tall, F.ceil(box_h * clipped / height)).otherwise(box_w).cast("long"), F.when(tall, box_h).otherwise(h).cast("long")
    shift = h * width / height * ratio
    return F.struct(F.floor((box_w - w) / 2).alias("x"), F.floor((box_h - h) / 2).alias("y"), w.alias("width"), h.alias("height"), F.when(shift >= 0, F.floor(-shift)).otherwise(0).alias("shift0"), F.when(shift < 0, F.floor(shift)).otherwise(0).alias("shift1"))


def strip_height(window: Column) -> Column:
    """Height of a strip of thumbnails: a quarter of the window, from 80 to 120."""
    return F.greatest(F.lit(80.0), F.least(window / 4, F.lit(120.0)))


def thumb_width(height: Column) -> Column:
    return F.ceil(height * 1.5).cast("int")


def progress_width(pos: Column, total: Column, bar: Column) -> Column:
    """Width of a progress bar's fill; null where the total is not above 0."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos / total))
    return F.when(total > 0, F.greatest(F.lit(BAR_LEAST), F.ceil(ratio * (F.coalesce(F.nullif(bar, F.lit(0)), F.lit(200)) - BAR_FRAME))).cast("int"))


def refresh_delay(expires: Column) -> Column:
    """Seconds until a login is renewed."""
    return F.greatest(F.lit(REFRESH_S), expires - REFRESH_S)


def anaglyph(left_g: Column, left_b: Column, right_g: Column, right_b: Column) -> tuple[Column, Column, Column]:
    """(red, green, blue) of a pixel for coloured glasses; red is rounded half to even."""
    return F.rint(left_g * 0.7 + left_b * 0.3).cast("int"), right_g, right_b
