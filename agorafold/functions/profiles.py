"""Profile fields from account metadata in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text fields with their longest length, and those that hold addresses.
TEXTS = {"name": 20, "about": 160, "location": 30, "blacklist_description": 256, "muted_list_description": 256}
IMAGES = ("profile_image", "cover_image")
ADDRESS_LENGTH, IMAGE_LENGTH = 100, 1024


def _document(text: Column) -> Column:
    """The profile object of one metadata text, itself where it has none; null if it is no JSON."""
    valid = F.when(F.try_parse_json(text).isNotNull() & (text != ""), text)
    return F.coalesce(F.get_json_object(valid, "$.profile"), valid)


def _shortened(value: Column, limit: int) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 3)), F.lit("..."))).otherwise(value)


def profile(posting: Column, fallback: Column) -> Column:
    """struct of eight texts, empty where unset; the posting metadata wins over the other."""
    document = F.coalesce(_document(posting), _document(fallback))
    fields = []
    for name, limit in TEXTS.items():
        value = F.get_json_object(document, f"$.{name}")
        value = F.when(~F.contains(value, F.lit("\0")), _shortened(value, limit))
        if name == "name":
            value = F.when(~value.startswith("@"), value)
        fields.append(F.coalesce(value, F.lit("")).alias(name))
    site = F.get_json_object(document, "$.website")
    site = F.when(F.length(site) <= ADDRESS_LENGTH, F.when(site.rlike("^https?://"), site).otherwise(F.concat(F.lit("http://"), site)))
    fields.append(F.coalesce(site, F.lit("")).alias("website"))
    for name in IMAGES:
        url = F.get_json_object(document, f"$.{name}")
        fields.append(F.coalesce(F.when(url.rlike("^https?://") & (F.length(url) <= IMAGE_LENGTH), url), F.lit("")).alias(name))
    return F.struct(*fields)
