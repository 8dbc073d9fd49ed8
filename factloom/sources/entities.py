"""Rows of the one entity shape that all payload normalizers return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom import schema as S
from factloom.functions.dates import iso

NO_ATTRIBUTES = "named_struct(%s)" % ", ".join(
    f"'{f.name}', CAST(NULL AS {f.dataType.simpleString()})" for f in S.ATTRIBUTES_TYPE.fields)
EMPTY_MEDIA = "array<struct<type:string,url:string,alt:string,width:bigint,height:bigint>>"


def image(url: Column, alt: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Media array with one image, empty without an address."""
    none = F.lit(None).cast("long")
    one = F.array(F.struct(
        F.lit("image").alias("type"), url.alias("url"), alt.alias("alt"),
        (width if width is not None else none).alias("width"), (height if height is not None else none).alias("height")))
    return F.when(url.isNotNull() & (url != ""), one.cast(EMPTY_MEDIA)).otherwise(F.array().cast(EMPTY_MEDIA))


def images(rows: Column) -> Column:
    """Media array from structs with url, alt, width, height."""
    return F.transform(rows, lambda r: F.struct(
        F.lit("image").alias("type"), r["url"].alias("url"), r["alt"].alias("alt"), r["width"].cast("long").alias("width"),
        r["height"].cast("long").alias("height"))).cast(EMPTY_MEDIA)


def entity_rows(
    df: DataFrame, keep: list[str], *, type: Column | str, source: Column | str, method: Column | str, url: Column, id: Column | None = None,
    title: Column | None = None, author: Column | None = None, published_at: Column | None = None, content: Column | None = None,
    media: Column | None = None, attributes: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows in the entity shape with the `keep` columns in front; absent attributes are null."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    given = attributes or {}
    unknown = set(given) - set(S.ATTRIBUTES_TYPE.names)
    if unknown:
        raise ValueError(f"no such attributes: {sorted(unknown)}")
    packed = F.expr(NO_ATTRIBUTES)
    for name, value in given.items():
        packed = packed.withField(name, value.cast(S.ATTRIBUTES_TYPE[name].dataType))
    stamp = iso(published_at) if published_at is not None else F.lit(None).cast("string")
    return df.select(
        *keep, lit(type).alias("type"), lit(source).alias("source"), text(id).alias("id"), url.alias("url"), text(title).alias("title"),
        text(author).alias("author"), stamp.alias("publishedAt"), F.coalesce(text(content), F.lit("")).alias("content"),
        (media if media is not None else F.array()).cast(EMPTY_MEDIA).alias("media"), packed.alias("attributes"), lit(method).alias("method"))


def public_json(columns: list[str] | None = None) -> Column:
    """Public JSON text of an entity row; absent attributes are left out."""
    names = columns or [f.name for f in S.ENTITY.fields if f.name != "method"]
    return F.to_json(F.struct(F.lit(1).cast("long").alias("schemaVersion"), *names))
