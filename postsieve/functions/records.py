"""Mail rows as JSON records and back.

A record is read as VARIANT, field by field, so records of changing shape need no schema: a field that is missing or of another
type has its default, one that is not known is named, and text that is no JSON gives a null record.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Type and default of each field; dates are ISO 8601 in UTC.
FIELDS = {
    "id": ("string", None), "raw_sha256": ("string", None), "norm_body_hash": ("string", None), "source": ("string", ""), "folder": ("string", ""),
    "label": ("string", None), "date": ("timestamp", None), "subject": ("string", ""), "from_addr": ("string", ""), "reply_to": ("string", ""), "to": ("string", ""),
    "headers": ("map<string,string>", F.create_map), "text": ("string", ""), "html_share": ("double", 0.0), "urls": ("array<string>", F.array), "n_attachments": ("int", 0), "attachment_types": ("array<string>", F.array),
}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def to_record(*without: str) -> Column:
    """The row's fields as a JSON object; nulls are written."""
    return F.to_json(F.struct(*[F.col(f"`{f}`").alias(f) for f in FIELDS if f not in without]), {"ignoreNullFields": "false", "timestampFormat": ISO, "timeZone": "UTC"})


def from_record(text: Column) -> Column:
    """A struct of FIELDS and `unknown`, the sorted names of other fields."""

    def read(v: Column) -> list[Column]:
        made = []
        for name, (kind, default) in FIELDS.items():
            path = f"$.{name}"
            value = F.try_to_timestamp(F.try_variant_get(v, path, "string")) if kind == "timestamp" else F.try_variant_get(v, path, kind)
            missing = F.lit(default) if not callable(default) else default()
            made.append(F.coalesce(value, missing.cast(kind)).alias(name))
        return made

    names = F.array_sort(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS))))
    # the parsed value is named once, and the record made whole: a field added to a finished struct reads it once for each of its fields
    parsed = F.struct(F.try_parse_json(text).alias("value"), names.alias("unknown"))
    return F.transform(F.array(parsed), lambda p: F.when(p["value"].isNotNull(), F.struct(*read(p["value"]), p["unknown"].alias("unknown"))))[0]
