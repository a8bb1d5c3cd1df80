"""Column functions over JSON properties, text and story time."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 2147483647


def prop(name: str, props: str = "props") -> Column:
    """A property as text; JSON null and a missing one are NULL."""
    return F.get_json_object(F.col(props), f"$.{name}")


def typed(name: str, props: str = "props") -> Column:
    """A property as canonical JSON text, so 1 and "1" differ; a missing one is 'null'."""
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(F.col(props)), f"$.{name}", "variant")), F.lit("null"))


def flag(name: str, props: str = "props") -> Column:
    """Whether a property is JSON true or 1."""
    return F.coalesce(prop(name, props).isin("1", "true"), F.lit(False))


def items(name: str, schema: str, props: str = "props") -> Column:
    """A property that is an array of objects, typed."""
    return F.from_json(F.get_json_object(F.col(props), f"$.{name}"), f"array<struct<{schema}>>")


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Inclusive story intervals meet; open ends are without bound."""
    return (F.coalesce(a_to, F.lit(FAR)) >= F.coalesce(b_from, F.lit(-FAR - 1))) & (F.coalesce(b_to, F.lit(FAR)) >= F.coalesce(a_from, F.lit(-FAR - 1)))


def revealed(as_of: int | None, column: str = "reveal_at") -> Column:
    return F.lit(True) if as_of is None else F.col(column).isNull() | (F.col(column) <= as_of)


def begun(as_of: int | None, column: str = "story_from") -> Column:
    return F.lit(True) if as_of is None else F.col(column).isNull() | (F.col(column) <= as_of)


def suffix(ident: str) -> Column:
    """What follows the last slash of an id."""
    return F.substring_index(F.col(ident), "/", -1)


def short_text(text: Column, most: int = 240) -> Column:
    """White space collapsed, cut to the most characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def token_estimate(*texts: Column) -> Column:
    total = F.lit(0)
    for t in texts:
        total = total + F.length(F.coalesce(t, F.lit("")))
    return F.greatest(F.lit(1), F.floor(total / 4).cast("long"))


def field_value(path: str, props: str = "props") -> Column:
    """The value, as text, of the field that a column names: title, summary or props.*."""
    of_props = F.try_variant_get(F.try_parse_json(F.col(props)), F.concat(F.lit("$."), F.regexp_replace(F.col(path), r"^props\.", "")), "string")
    return F.when(F.col(path) == "title", F.col("title")).when(F.col(path) == "summary", F.col("summary")).when(F.col(path).startswith("props."), of_props)


# Latin letters whose stroke is no mark of its own, and without
STROKED, UNSTROKED = "øđħıłŧ", "odhilt"


def _marked() -> tuple[str, str]:
    """Lower-case letters that are a Latin letter with combining marks, their Latin letters, and at the end of the first the marks themselves."""
    found = {}
    for c in map(chr, range(0x80, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in string.ascii_lowercase and all(map(unicodedata.combining, marks)):
            found[c] = base
    return STROKED + "".join(found) + "".join(map(chr, range(0x300, 0x370))), UNSTROKED + "".join(found.values())


MARKED, PLAIN = _marked()


def folded(text: Column) -> Column:
    """Lower case without diacritics of Latin letters, composed or not, so an accented and a plain spelling are one term."""
    lower = F.lower(text)
    return F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.translate(lower, MARKED, PLAIN))
