"""Tags, mentions, names and JSON dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of mentions, communities and account names; longest tag.
MENTION = r"(?:^|[^a-zA-Z0-9_!#$%&*@\\/])(?:@)([a-zA-Z0-9\.-]{1,16}[a-zA-Z0-9])(?![a-z])"
COMMUNITY = r"^hive-[123]\d{4,6}$"
ACCOUNT = r"^[a-z][a-z0-9-]*[a-z0-9](\.[a-z][a-z0-9-]*[a-z0-9])*$"
TAG_LENGTH = 32
DATE = "yyyy-MM-dd'T'HH:mm:ss"
NO_DATE = "1969-12-31T23:59:59"
NEVER = "9999-12-31 23:59:59"


def tag(raw: Column) -> Column:
    """Without ``#`` and white space, lower case, 32 characters at most."""
    return F.left(F.lower(F.regexp_replace(raw, r"[#\s]", "")), F.lit(TAG_LENGTH))


def tags(raw: Column) -> Column:
    """Distinct tags of an array, in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(raw, tag), lambda t: t != ""))


def mentions(body: Column) -> Column:
    """Names that a body mentions, in lower case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(MENTION), F.lit(1)), F.lower))


def is_community(name: Column) -> Column:
    return F.coalesce(name.rlike(COMMUNITY), F.lit(False))


def is_account(name: Column) -> Column:
    return F.coalesce(name.rlike(ACCOUNT) & F.length(name).between(3, 16), F.lit(False))


def community_type(name: Column) -> Column:
    """1 topic, 2 journal, 3 council: the first digit of the name."""
    return F.when(is_community(name), F.substring(name, 6, 1).cast("int"))


def json_date(at: Column) -> Column:
    """A date as JSON texts have it; null and never have one fixed text."""
    return F.when(at.isNull() | (at >= F.lit(NEVER).cast("timestamp_ntz")), NO_DATE).otherwise(F.date_format(at, DATE))


def post_url(category: Column, author: Column, permlink: Column) -> Column:
    return F.concat(F.lit("/"), category, F.lit("/@"), author, F.lit("/"), permlink)


def truncated(body: Column, limit: int) -> Column:
    """The first ``limit`` characters, or all for 0."""
    return F.left(body, F.lit(limit)) if limit else body


# Two-letter language codes.
LANGUAGES = (
    "ab aa af ak sq am ar an hy as av ae ay az bm ba eu be bn bh bi bs br bg my ca ch ce ny zh cv kw co cr hr cs da dv nl dz en eo et ee fo fj fi fr ff gl ka de el gn gu ht ha he hz hi ho hu ia id ie ga ig ik io is "
    "it iu ja jv kl kn kr ks kk km ki rw ky kv kg ko ku kj la lb lg li ln lo lt lu lv gv mk mg ms ml mt mi mr mh mn na nv nd ne ng nb nn no ii nr oc oj cu om or os pa pi fa pl ps pt qu rm rn ro ru sa sc sd se sm sg "
    "sr gd sn si sk sl so st es su sw ss sv ta te tg th ti bo tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa cy wo fy xh yi yo za"
).split()
# Integers that JSON readers hold exactly; longest address of an image.
SAFE = 9007199254740991
IMAGE_LENGTH = 1024


def is_language(code: Column) -> Column:
    return F.coalesce(code.isin(*LANGUAGES), F.lit(False))


def without_nul(body: Column) -> Column:
    """NUL characters as spaces."""
    return F.translate(body, "\0", " ")


def safe_integer(number: Column) -> Column:
    """A whole number as JSON text: bare where readers hold it exactly, else in quotes."""
    bare = number.cast("string")
    return F.when(number.between(-SAFE, SAFE), bare).otherwise(F.concat(F.lit('"'), bare, F.lit('"')))


def first_image(metadata: Column) -> Column:
    """The address of a post's first image; empty where metadata has no good one."""
    parsed = F.try_parse_json(F.when(F.trim(metadata) != "", metadata))
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.image", "variant"))
    value = F.when(kind == "STRING", F.try_variant_get(parsed, "$.image", "string")).when(kind.startswith("ARRAY"), _text_of(parsed, "$.image[0]"))
    trimmed = F.trim(F.regexp_replace(value, r"^[ \n\t\r ]+|[ \n\t\r ]+$", ""))
    return F.coalesce(F.when((F.length(value) < IMAGE_LENGTH) & (F.lower(F.left(trimmed, F.lit(4))) == "http"), trimmed), F.lit(""))


def _text_of(parsed: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", F.try_variant_get(parsed, path, "string"))


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from one time to another; years and months by their numbers alone, the rest toward zero."""
    if unit == "year":
        return F.year(end) - F.year(start)
    if unit == "month":
        return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    seconds = {"week": 604_800, "day": 86_400, "hour": 3600, "minute": 60, "second": 1}[unit]
    apart = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return (apart / seconds).cast("long")
