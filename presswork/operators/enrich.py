"""Prompt tables for batch enrichment and the tables read from its replies.

Calling a model is left to the user: these make its input and take its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions.responses import image_url, message_text
from presswork.functions.text import filled, first_filled, join_list, split_list
from presswork.operators.binding import bind
from presswork.operators.filters import needs_translation
from presswork.operators.latest import latest
from presswork.operators.sieve import sieve
from presswork.operators.tags import short_tag_lists, tag_quota, under_tagged
from presswork.session import durable

# The prompt texts. %s marks what is filled in, in order.
TAG_PROMPT = (
    "Generate total %s relevant and concise tags for the following content. "
    "Return the tags in a comma-separated list:\n\nContent: %s\n\n"
    "Existing tags: %s"
)
TRANSLATION_PROMPT = (
    "Translate this news from %s to %s, and return only the translated content. "
    "Keep the html structure: %s"
)
ARTICLE_PROMPT = """
        Write an analytical article in Persian for %s based on the following news content. 
        Provide insights from an economist's perspective and include the following keywords: %s (if applicable). 
        The article should be at least 1300 words. Generate an attractive and concise title for it. It can contain images and tables if needed.

        - **Title**: %s
        - **Source**: %s
        - **URL**: %s
        - **Date**: %s

        **News Content**:
        %s

        Ensure the article is informative and engaging. Avoid unnecessary jargon, and keep it clear for a general audience.
        """
IMAGE_PROMPT = (
    "generate a natural image related to this content news. content summary:%s. "
    "            Please ensure that no text is included in the image. "
    "The theme of the image should be yellow and purple and its quality should be 1%%."
)
NO_ARTICLE = "No Article"


def _fill(template: str, *values: Column) -> Column:
    """A template with its ``%s`` marks replaced; NULL reads ``None``."""
    return F.format_string(template, *[F.coalesce(v.cast("string"), F.lit("None")) for v in values])


def shown_date(date: Column) -> Column:
    """A moment as text, with six decimals only where it has any."""
    text = date.cast("string")
    return F.when(date.isNull(), F.lit("NaT")).otherwise(
        F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text))


def main_content() -> Column:
    """The content, or the second-language content when that is empty."""
    return first_filled(F.col("content"), F.col("content_persian"))


def main_summary() -> Column:
    return first_filled(F.col("summary"), F.col("summary_persian"))


def tag_prompts(content: DataFrame, content_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(content_id, quota, prompt) for items with text and too few tags.

    Which items those are is found first, from ids and links alone, and written. Texts of
    others leave where they are read, by a sieve, and do not move; those of the items do once.
    """
    lists = short_tag_lists(content_tags, tags).withColumnRenamed("content_id", "id")
    backlog = durable(under_tagged(content, content_tags).select("id").join(lists, "id", "left"))
    texts = content.select("id", main_content().alias("_text")).where(filled(F.col("_text")))
    quota = tag_quota(F.col("existing_tags"))
    return sieve(texts, "id", backlog).join(backlog, "id").select(
        F.col("id").alias("content_id"),
        quota.alias("quota"),
        _fill(TAG_PROMPT, quota, F.col("_text"), join_list(F.col("existing_tags"))).alias("prompt"),
    )


def latest_replies(replies: DataFrame) -> DataFrame:
    """(content_id, seq, response): the last reply per item by ``seq``."""
    return latest(replies, "content_id", "seq", "response").select("content_id", "seq", "response")


def tag_results(items: DataFrame, replies: DataFrame) -> DataFrame:
    """(content_id, tags): existing tags, then new ones up to the target.

    ``items`` is (content_id, existing_tags). Items without a reply, or with
    enough tags, keep the list they have.
    """
    existing = F.coalesce(F.col("existing_tags"), F.array().cast("array<string>"))
    generated = split_list(message_text(F.col("response"), ""))
    tags = F.concat(existing, F.slice(generated, 1, tag_quota(existing)))
    return items.join(latest_replies(replies), "content_id", "left").select(
        "content_id", tags.alias("tags"))


def translation_prompts(content: DataFrame, source_language: str = "en",
                        target_language: str = "fa") -> DataFrame:
    """(content_id, prompt) for items with text that lack a translation."""
    text = main_content()
    return needs_translation(content).where(filled(text)).select(
        F.col("id").alias("content_id"),
        _fill(TRANSLATION_PROMPT, F.lit(source_language), F.lit(target_language), text)
        .alias("prompt"))


def translation_updates(replies: DataFrame) -> DataFrame:
    """(content_id, seq, translation) of the replies that hold any text."""
    read = bind(replies, "translation", message_text(F.col("response"), ""))
    return read.select("content_id", "seq", "translation").where(filled(F.col("translation")))


def article_prompts(content: DataFrame, site: str) -> DataFrame:
    """(content_id, prompt) for an article on ``site`` from each item.

    Uses ``matched_keywords`` when the frame has them.
    """
    keywords = (join_list(F.col("matched_keywords"))
                if "matched_keywords" in content.columns else F.lit(""))
    return content.select(
        F.col("id").alias("content_id"),
        _fill(ARTICLE_PROMPT, F.lit(site), keywords, F.col("title_persian"), F.col("source"),
              F.col("url"), shown_date(F.col("date")), main_content()).alias("prompt"))


def generated_articles(replies: DataFrame) -> DataFrame:
    """(content_id, seq, article) of the replies that hold an article."""
    read = bind(replies, "article", message_text(F.col("response"), NO_ARTICLE))
    return read.select("content_id", "seq", "article").where(
        filled(F.col("article")) & (F.col("article") != NO_ARTICLE))


def image_prompts(content: DataFrame, images: int = 1) -> DataFrame:
    """(content_id, image_no, prompt), ``images`` rows per item with any text."""
    text = first_filled(main_summary(), F.col("title_persian"), main_content())
    numbers = F.sequence(F.lit(1), F.lit(images)) if images > 0 else F.array().cast("array<int>")
    return (
        content.select(F.col("id").alias("content_id"), text.alias("_text"))
        .where(filled(F.col("_text")))
        .select("content_id", _fill(IMAGE_PROMPT, F.col("_text")).alias("prompt"))
        .select("content_id", F.explode(numbers).alias("image_no"), "prompt")
    )


def generated_image_urls(replies: DataFrame) -> DataFrame:
    """(content_id, seq, url) of the replies that name an image."""
    read = bind(replies, "url", image_url(F.col("response")))
    return read.select("content_id", "seq", "url").where(F.col("url").isNotNull())
