"""Albums and photographs from recorded service answers, JSON texts, one answer a row. Transport is no part of this.

Answers that are null or no JSON give no rows; fields that are absent are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.functions import media as M

#: Children whose metadata are one request (a listing itself counts whole), the name of a folder without metadata.
CHILDREN, UNKNOWN = 1000, "Unknown Folder"
#: Fixed value: addresses that may be relayed.
RELAYED = r"^https://(picasaweb.google.com|lh[0-9]+.googleusercontent.com)/.*$"
#: Types of picked items.
FOLDER, ALBUM, PHOTO = "application/vnd.google-apps.folder", "application/vnd.google-apps.photoalbum", "application/vnd.google-apps.photo"

#: Height of a listed file's thumbnail and what its address ends with, the status of a missing feed.
THUMB_HEIGHT, THUMB_SUFFIX, NO_FEED = 220, "=s220", 404

_META = "id string, title string, mimeType string, downloadUrl string"
_DOCS = "action string, docs array<struct<serviceId:string, mimeType:string, id:string, name:string, url:string, thumbnails:array<struct<width:string, height:string, url:string>>>>"


_TEXT = "struct<`$t`:string>"
_ENTRY = f"struct<`gphoto$id`:{_TEXT}, content:struct<type:string, src:string>, title:{_TEXT}, `media$group`:struct<`media$thumbnail`:string>>"
_FEED = f"feed struct<title:{_TEXT}, entry:array<{_ENTRY}>>"


def _number(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def _sizes(thumbnails: Column) -> Column:
    return F.transform(thumbnails, lambda t: F.struct(_number(t["width"]).alias("width"), _number(t["height"]).alias("height"), t["url"].alias("url")))


def file_thumbnails(link: Column) -> tuple[Column, Column]:
    """(thumbnails of a listed file: one without a width if it has a link, else none; whether the link ends as it should)."""
    one = F.array(F.struct(F.lit(None).cast("int").alias("width"), F.lit(THUMB_HEIGHT).alias("height"), link.alias("url")))
    return F.when(link.isNotNull(), one).otherwise(F.slice(one, 1, 0)), F.endswith(link, F.lit(THUMB_SUFFIX))


def feed_albums(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and photographs of feeds.

    answers: album_id, name (given), status (null for a network error), answer. An album's kind is OK, NOT_FOUND, NETWORK or UNEXPECTED;
    an answer that is no JSON, has no feed or list of entries, or an entry without id, type, address or title is UNEXPECTED. Albums:
    album_id, name (the feed's if it has one), kind. Photographs of those that are OK, of whatever type: album_id, place (from 0), photo_id,
    title, mime, download_url, thumbnails. Numbers in place of texts count as texts."""
    rows = answers.select("album_id", "name", "status", F.from_json("answer", _FEED)["feed"].alias("feed"))
    entries = F.col("feed")["entry"]
    fields = lambda e: (e["gphoto$id"]["$t"], e["title"]["$t"], e["content"]["type"], e["content"]["src"])
    whole = F.coalesce(F.forall(entries, lambda e: ~F.array_contains(F.transform(F.array(*fields(e)), lambda x: x.isNull()), True)), F.lit(False))
    status = M.status_class(F.col("status"), NO_FEED)
    rows = rows.withColumn("kind", F.when((status == "OK") & ~whole, "UNEXPECTED").otherwise(status))
    fine = rows.where("kind = 'OK'").select("album_id", F.posexplode(entries).alias("place", "e"))
    photo_id, title, mime, src = fields(F.col("e"))
    thumbs = M.one_or_many(F.col("e")["media$group"]["media$thumbnail"], "$", "struct<width:string, height:string, url:string>")
    photos = fine.select("album_id", "place", photo_id.alias("photo_id"), title.alias("title"), mime.alias("mime"), C.download_url(src).alias("download_url"), _sizes(thumbs).alias("thumbnails"))
    return rows.select("album_id", F.when(F.col("kind") == "OK", F.coalesce(F.nullif(F.col("feed")["title"]["$t"], F.lit("")), "name")).otherwise(F.col("name")).alias("name"), "kind"), photos


def relay_allowed(url: Column) -> Column:
    return F.coalesce(url.rlike(RELAYED), F.lit(False))


def album_from_url(url: Column, given_id: Column) -> Column:
    """user_id, album, album_id and auth_key of an album's address; null if it is none. A numeric album without a given id takes the
    address's second part as its id, whichever host it is."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.split(F.substring(F.try_parse_url(url, F.lit("PATH")), 2, 1 << 30), "/")
    at = lambda k: F.get(path, F.lit(k))
    web = (host == "picasaweb.google.com") & (F.size(path) >= 2)
    plus = (host == "plus.google.com") & (F.size(path) >= 4) & (F.lower(at(0)) == "photos") & (F.lower(at(2)) == "albums")
    empty = lambda c: F.nullif(c, F.lit(""))
    user = F.when(web, at(0)).when(plus, at(1))
    album = empty(F.when(web, at(1)).when(plus, at(3)))
    given = empty(given_id)
    album_id = F.when(given.isNull() & C.is_numeric(album), at(1)).otherwise(given)
    auth = F.try_parse_url(url, F.lit("QUERY"), F.lit("authkey"))
    found = F.struct(user.alias("user_id"), album.alias("album"), album_id.alias("album_id"), auth.alias("auth_key"))
    return F.when(C.is_numeric(user) & (album.isNotNull() | album_id.isNotNull()), found)


def folder_albums(listings: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and photographs of folders.

    listings: folder_id, answer (items with ids); metadata: answer (one file's). Every folder needs the metadata of all its children
    and its own, else its album is not complete and has no photographs. Albums: folder_id, name, complete. Photographs, those of
    supported types by title (ties: as listed): folder_id, place, photo_id, title, mime, download_url."""
    items = F.from_json("answer", "items array<struct<id:string>>")["items"]
    lists = listings.select("folder_id", items.alias("items")).where("items is not null")
    wanted = lists.select("folder_id", F.posexplode(F.concat(F.transform("items", lambda x: x["id"]), F.array("folder_id"))).alias("pos", "id"))
    files = metadata.select(F.from_json("answer", _META).alias("m")).where("m.id is not null").select("m.*")
    # of differing answers the least by title, type and address
    files = files.groupBy("id").agg(F.min(F.struct("title", "mimeType", "downloadUrl")).alias("m")).select("id", "m.*")
    rows = wanted.join(files, "id", "left").withColumn("found", F.col("title").isNotNull())
    own = F.max(F.when(F.col("id") == F.col("folder_id"), F.col("title")))
    albums = rows.groupBy("folder_id").agg(F.coalesce(own, F.lit(UNKNOWN)).alias("name"), F.bool_and("found").alias("complete"))
    inside = rows.where((F.col("id") != F.col("folder_id")) & C.supported_mime(F.col("mimeType"))).join(albums.where("complete").select("folder_id"), "folder_id")
    return albums, in_title_order(inside.select("folder_id", "pos", F.col("id").alias("photo_id"), "title", F.col("mimeType").alias("mime"), F.col("downloadUrl").alias("download_url")))


def in_title_order(photos: DataFrame) -> DataFrame:
    """Photographs of folders (folder_id, pos, ...) with their place by title (ties: as listed) for pos."""
    place = F.row_number().over(Window.partitionBy("folder_id").orderBy("title", "pos"))
    return photos.select("folder_id", place.alias("place"), *(c for c in photos.columns if c not in ("folder_id", "pos")))


def picked(answers: DataFrame) -> DataFrame:
    """What a picker's answers hold, one row an item: answer_id, pos, kind (folder, file, album, photo; null if not supported), id, name,
    mime, url, album (album_from_url) and thumbnails. answers: answer_id, answer; only those of the action `picked` count."""
    docs = answers.select("answer_id", F.from_json("answer", _DOCS).alias("r")).where("r.action = 'picked'").select("answer_id", F.posexplode("r.docs").alias("pos", "d"))
    service, mime = F.col("d.serviceId"), F.col("d.mimeType")
    album = F.when((service == "picasa") & (mime == ALBUM), album_from_url(F.col("d.url"), F.col("d.id")))
    files = F.when(mime == FOLDER, "folder").when(C.supported_mime(mime), "file")
    photos = F.when((mime == ALBUM) & album.isNotNull(), "album").when(mime == PHOTO, "photo")
    small = _sizes(F.coalesce("d.thumbnails", F.array()))
    return docs.select("answer_id", "pos", F.when(service == "docs", files).when(service == "picasa", photos).alias("kind"), "d.id", "d.name", mime.alias("mime"), "d.url", album.alias("album"), small.alias("thumbnails"))
