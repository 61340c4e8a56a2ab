"""Language tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import strip

# Language -> locale used when the target is chosen automatically.
DEFAULT_LOCALES = {
    "ja": "ja-JP",
    "en": "en-US",
    "ko": "ko-KR",
    "fr": "fr-FR",
    "de": "de-DE",
    "es": "es-ES",
    "it": "it-IT",
    "pt": "pt-BR",
    "ru": "ru-RU",
    "th": "th-TH",
    "vi": "vi-VN",
    "id": "id-ID",
}
FALLBACK_LOCALE = "en-US"


def normalize_tag(code: Column) -> Column:
    """Canonical BCP-47 casing; null when a subtag is empty or not alphanumeric."""
    tag = F.replace(strip(code), F.lit("_"), F.lit("-"))
    parts = F.split(tag, "-")

    def cased(part: Column, position: Column) -> Column:
        return (
            F.when(position == 0, F.lower(part))
            .when(part.rlike(r"^\p{L}{4}$"), F.initcap(part))
            .when(part.rlike(r"^\p{L}{2}$"), F.upper(part))
            .otherwise(F.lower(part))
        )

    valid = tag.rlike(r"^[\p{L}\p{N}]+(-[\p{L}\p{N}]+)*$")
    return F.when(valid, F.array_join(F.transform(parts, cased), "-"))


def base_language(tag: Column) -> Column:
    return F.split(tag, "-")[0]


def resolve_target(code: Column, preferred: Column) -> Column:
    """``auto`` becomes the locale of the first preferred language; other codes are only trimmed."""
    trimmed = strip(code)
    parts = F.filter(F.split(F.replace(preferred, F.lit("_"), F.lit("-")), "-"), lambda p: p != "")
    language = F.lower(F.get(parts, F.lit(0)))
    subtags = F.transform(F.slice(parts, 2, 16), F.lower)
    region = F.upper(F.get(F.filter(subtags, lambda p: p.rlike(r"^(\p{L}{2}|\p{N}{3})$")), F.lit(0)))
    simplified = (
        F.when(F.arrays_overlap(subtags, F.array(F.lit("hans"), F.lit("chs"))), True)
        .when(F.arrays_overlap(subtags, F.array(F.lit("hant"), F.lit("cht"))), False)
        .otherwise(F.coalesce(region.isin("CN", "SG"), F.lit(False)))
    )
    locale = F.lit(FALLBACK_LOCALE)
    for name, value in DEFAULT_LOCALES.items():
        locale = F.when(language == name, F.lit(value)).otherwise(locale)
    chosen = F.when(
        language == "zh", F.when(simplified, F.lit("zh-Hans")).otherwise(F.lit("zh-Hant"))
    ).otherwise(locale)
    return F.when(F.lower(trimmed) == "auto", chosen).otherwise(trimmed)
