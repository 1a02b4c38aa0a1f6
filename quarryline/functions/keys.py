"""Catalogue keys: spellings, templates and equality, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, compact_key

#: The placeholders of a url template.
PLACEHOLDER = r"\{part(?:Upper|Lower|Compact|Snake|Dash|SlashBraces|AfterColon|AfterColonLower|AfterColonCompact)?\}"


def encode_component(value: Column) -> Column:
    """Percent-encoding as in a url component: a space is %20, and ``!'()*~`` stay."""
    out = F.url_encode(value)
    for written, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(written), F.lit(sign))
    return out


def after_colon(key: Column) -> Column:
    return F.substring_index(key, ":", -1)


def _joined(key: Column, sign: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(key, "(?i)[^a-z0-9]+", sign), f"^{sign}+|{sign}+$", ""))


def slash_braces(key: Column) -> Column:
    """Each part between slashes encoded, joined by an encoded pair of braces."""
    return F.array_join(F.transform(F.split(key, "/"), encode_component), "%7B%7D")


def key_variants(key: Column) -> Column:
    return F.struct(
        compact_key(key).alias("compact"), after_colon(key).alias("after_colon"), _joined(key, "_").alias("snake"), _joined(key, "-").alias("dash"), slash_braces(key).alias("slash_braces")
    )


def match_candidates(key: Column, aliases: Column | None = None) -> Column:
    """The distinct spellings by which a text may name a key: itself, what follows its last colon, aliases; trimmed, none empty."""
    listed = F.concat(F.array(key, after_colon(key)), *([] if aliases is None else [F.coalesce(aliases, F.array().cast("array<string>"))]))
    trimmed = F.transform(listed, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def same_key(value: Column, key: Column) -> Column:
    """Equal to a candidate without regard to case or, in compact form, to separators."""
    return F.coalesce(F.exists(match_candidates(key), lambda c: (F.lower(value) == F.lower(c)) | (compact_key(value) == compact_key(c))), F.lit(False))


def text_names_key(text: Column, key: Column) -> Column:
    """The text contains a candidate in any case or, from 4 letters and digits on, in compact form."""
    low, compact = F.lower(text), compact_key(text)
    hit = F.exists(match_candidates(key), lambda c: F.contains(low, F.lower(c)) | ((F.length(compact_key(c)) >= 4) & F.contains(compact, compact_key(c))))
    return F.coalesce(hit, F.lit(False))


def has_placeholder(template: Column) -> Column:
    return F.coalesce(template.rlike(PLACEHOLDER), F.lit(False))


def fill_template(template: Column | str, key: Column) -> Column:
    """The template with all ten placeholders filled in, url-encoded; of a text given as such only those that it has are worked out."""
    after = after_colon(key)
    values = {
        "{part}": encode_component(key), "{partUpper}": encode_component(F.upper(key)), "{partLower}": encode_component(F.lower(key)), "{partCompact}": encode_component(compact_key(key)),
        "{partSlashBraces}": slash_braces(key), "{partAfterColon}": encode_component(after), "{partAfterColonLower}": encode_component(F.lower(after)),
        "{partAfterColonCompact}": encode_component(compact_key(after)), "{partSnake}": encode_component(_joined(key, "_")), "{partDash}": encode_component(_joined(key, "-")),
    }
    filled = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        if not isinstance(template, str) or name in template:
            filled = F.replace(filled, F.lit(name), value)
    return filled


def path_has_key(path: Column, key: Column) -> Column:
    """A segment of the path is the key in compact form."""
    segments = F.transform(F.split(path, "/"), lambda s: compact_key(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)))
    return F.coalesce(F.array_contains(segments, compact_key(key)), F.lit(False))
