"""Reading model-service replies kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from presswork.functions.text import strip, with_value


def message_text(response: Column, default: str) -> Column:
    """The trimmed text of the first choice, ``default`` when there is none."""
    text = F.get_json_object(response, "$.choices[0].message.content")
    return F.coalesce(strip(text), F.lit(default))


def image_url(response: Column) -> Column:
    """The URL of the first image; NULL when missing, empty or not a string."""
    def text_of(value: Column) -> Column:
        url = F.try_variant_get(value, "$", "string")
        return F.when((F.schema_of_variant(value) == "STRING") & (url != ""), url)

    return with_value(F.try_variant_get(F.try_parse_json(response), "$.data[0].url", "variant"), text_of)


def string_urls(urls: Column) -> Column:
    """An array of URLs without its NULL entries."""
    return F.filter(urls, lambda u: u.isNotNull())
