"""Embed descriptions, article JSON and data embedded in pages.

Input rows have payload_id, url and body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as ST

from factloom.functions import let
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import iso, parse_date
from factloom.functions.dom import fragment_markdown
from factloom.sources.entities import entity_rows, image

J = F.get_json_object

# Per source the shown provider name, the fallback titles and the method.
PROVIDERS = (
    ("vimeo", "Vimeo", "Vimeo video", "vimeo-oembed"),
    ("soundcloud", "SoundCloud", "SoundCloud audio", "soundcloud-oembed"),
    ("spotify", "Spotify", "Spotify audio", "spotify-oembed"),
)


def _by_source(source: Column, index: int, default: Column) -> Column:
    value = default
    for row in PROVIDERS:
        value = F.when(source == row[0], F.lit(row[index])).otherwise(value)
    return value


def normalize_oembed(payloads: DataFrame) -> DataFrame:
    """Embed descriptions of known media sites and of any page that advertises one."""
    body, page = F.col("body"), F.col("url")
    field = lambda name: T.as_value(F.trim(J(body, f"$.{name}")))
    df = payloads.filter(F.try_parse_json("body").isNotNull()).withColumn(
        "kind", F.when(U.is_vimeo(page), "vimeo").when(U.is_soundcloud(page), "soundcloud").when(U.is_spotify(page), "spotify").otherwise("web"))
    df = df.withColumn("markup", fragment_markdown(F.coalesce(field("html"), F.lit("")), page)).withColumn(
        "described", fragment_markdown(F.coalesce(field("description"), F.lit("")), page))
    kind, parts = F.col("kind"), U.segments(page)
    profile = ((kind == "soundcloud") & (F.size(parts) == 1)) | ((kind == "spotify") & U.path(page).rlike("/artist/"))
    df = df.withColumn("type", F.when(profile, "profile").when(kind == "vimeo", "video").when(kind.isin("soundcloud", "spotify"), "audio").otherwise("document"))
    shown = F.when(profile & (kind == "spotify"), F.lit("Spotify artist")).when(profile, F.lit("SoundCloud profile")).otherwise(
        _by_source(kind, 2, F.lit(None).cast("string")))
    df = df.withColumn("title", F.coalesce(field("title"), shown)).withColumn("author", field("author_name")).withColumn("thumbnail", field("thumbnail_url"))
    df = df.withColumn("seconds", N.as_number(J(body, "$.duration"))).withColumn("published", parse_date(field("upload_date")))
    df = df.filter((kind != "web") | F.coalesce(F.col("title"), F.col("thumbnail"), T.as_value(F.col("markup"))).isNotNull())
    e = T.escape_markdown
    long = F.when(F.col("seconds") > 0, F.col("seconds"))
    details = T.join_present(
        " · ", F.concat(F.lit("Author: "), e(F.col("author"))), F.concat(F.lit("Published: "), iso(F.col("published"))),
        F.concat(F.lit("Duration: "), F.regexp_replace(long.cast("string"), r"\.0$", ""), F.lit(" seconds")), F.concat(F.lit("Type: "), e(field("type"))))
    title = F.coalesce("title", F.lit("Preview"))
    picture = F.concat(F.lit("!["), e(title), F.lit("]("), F.col("thumbnail"), F.lit(")"))
    head = F.concat(F.lit("# "), e(F.col("title")))
    content = F.when(kind == "web", T.join_present(
        "\n\n", head, F.col("markup"), picture, F.concat(F.lit("[View source]("), page, F.lit(")")))).otherwise(T.join_present(
            "\n\n", head, F.col("described"), F.col("markup"), details, picture,
            F.concat(F.lit("[View on "), _by_source(kind, 1, F.lit("source")), F.lit("]("), page, F.lit(")"))))
    media_id = F.when(kind == "vimeo", F.regexp_extract(page, r"/(\d+)", 1)).when(kind == "spotify", U.spotify_id(page)).when(kind == "soundcloud", U.last_segment(page))
    timed = F.col("type").isin("video", "audio", "post")
    alt = F.when(kind == "web", title).otherwise(F.concat(F.col("title"), F.lit(" thumbnail")))
    return entity_rows(
        df, ["payload_id"], type=F.col("type"), source=kind, method=_by_source(kind, 3, F.lit("oembed")), id=media_id, url=page, title=F.col("title"),
        author=F.col("author"), published_at=F.when(kind != "web", F.col("published")), content=content, media=image(F.col("thumbnail"), alt),
        attributes={"durationSeconds": F.when(timed, F.floor(long + 0.5)), "handle": F.when(F.col("type") == "profile", F.when(kind == "soundcloud", U.last_segment(page)))})


def normalize_wordpress(payloads: DataFrame) -> DataFrame:
    """Article JSON with rendered title and content."""
    body = F.col("body")
    df = payloads.withColumn("markdown", fragment_markdown(J(body, "$.content.rendered"), F.col("url"))).withColumn(
        "heading", T.as_value(F.trim(F.regexp_replace(fragment_markdown(J(body, "$.title.rendered"), F.col("url")), r"^#+\s*", ""))))
    df = df.filter(F.coalesce("markdown", F.lit("")) != "")
    return entity_rows(
        df, ["payload_id"], type="article", source="web", method="wordpress-json", id=J(body, "$.id"), url=F.coalesce(J(body, "$.link"), F.col("url")),
        title=F.col("heading"), published_at=parse_date(F.coalesce(T.as_value(J(body, "$.date_gmt")), J(body, "$.date"))),
        content=T.join_present("\n\n", F.concat(F.lit("# "), F.col("heading")), F.col("markdown")))


def embedded_json(html: Column, script_id: str) -> Column:
    """Text of the JSON script with an id, null when it does not parse."""
    raw = F.regexp_extract(html, rf"""(?is)<script\b[^>]*\bid\s*=\s*["']{script_id}["'][^>]*>(.*?)</script>""", 1)
    return let(F.trim(raw), lambda t: F.when(F.try_parse_json(t).isNotNull() & (t != ""), t))


def context_json(html: Column) -> Column:
    """The JSON object kept as an escaped string under `contextJSON`."""
    quoted = F.regexp_extract(html, r'"contextJSON":("(?:[^"\\]++|\\.)*+")', 1)
    inner = J(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v")
    return let(inner, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


# What get_json_object takes, too.
JSON_OPTIONS = {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false"}


def json_fields(df: DataFrame, text: Column, paths: list[str] | tuple[str, ...]) -> tuple[DataFrame, Callable[[str], Column]]:
    """Rows with the texts of many paths of one JSON object, which is read once, and the column of each path (`a/b`).

    A field asked for by its own path reads the whole object again, and a filter on it is moved below and makes the object once more; rows made by
    an explode are neither.
    """
    tree: dict = {}
    for path in paths:
        *above, last = path.split("/")
        place = tree
        for name in above:
            place = place.setdefault(name, {})
        place[last] = None
    shape = lambda names: ST.StructType([ST.StructField(n, ST.StringType() if inner is None else shape(inner)) for n, inner in names.items()])
    # A list is no object.
    read = let(text, lambda t: F.when(~t.rlike(r"^\s*\["), F.from_json(t, shape(tree), JSON_OPTIONS)))
    out = df.select("*", F.explode_outer(F.array(read)).alias("_json"))

    def field(path: str) -> Column:
        found = F.col("_json")
        for name in path.split("/"):
            found = found[name]
        return found

    return out, field
