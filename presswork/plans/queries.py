"""Every operator as a query over the test tables.

Results are flat: lists are joined to text and moments are formatted, so that
they compare by value with the SQL in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.functions.suffixes import public_rules, suffix_frame
from presswork.functions.text import (
    clean_html, first_filled, join_list, occurrences, preview, split_list, strip,
)
from presswork.functions.responses import string_urls
from presswork.functions.urls import host
from presswork.operators import enrich, filters, ingest, stats, tags as tagging
from presswork.operators.binding import bind
from presswork.operators.blocks import html_blocks
from presswork.operators.domains import with_domain
from presswork.operators.collation import IGNORE_CASE
from presswork.operators.ids import assign_ids, highest_id
from presswork.operators.integrity import cascade_delete, orphans
from presswork.operators.keywords import DEFAULT_PAIRS, keyword_pairs, match_keywords
from presswork.operators.ordering import SORT_COLUMNS, sort_articles
from presswork.operators.translations import apply_translations
from presswork.operators.url_keys import read_url_keys, write_url_keys
from presswork.plans.enrich_job import (
    store_generated_tags, store_images, store_translations, stored_images)
from presswork.plans.ingest_job import corpus_table, ingest_batch, ledger, store_corpus
from presswork.plans.listing import (
    ListRequest, article_cards, article_details, article_list,
)
from presswork.schema import CONTENT, conform, union_conformed
from presswork.session import TEXT_CODEC, durable_table, shared_folder
from presswork.sources import standin
from presswork.sources.images import (
    image_files, images_by_item, images_of, new_images, read_images, write_images)
from presswork.sources.standin import AS_OF
from presswork.sources.tables import content_scan

Query = Callable[[SparkSession, str], DataFrame]

TITLE_PATTERN = "ÉTION|the|ung"
SEARCH_WORDS = "heitung, ntthe ,éreaux"
PAIRS = (("the", 5), ("The", 3), ("ère", 2), ("a.b", 1), ("UNG", 4), ("the", 1))
MANY_PAIRS = tuple((a + b, 3 + i % 4) for i, (a, b) in enumerate(
    (a, b) for a in ("th", "er", "un", "é", "ion", "de") for b in ("e", "st", "re", "", "an", "x")))
ONE_URL = "https://thther.example.org/en/685"
SITE = "example.org"


def moment(column: str = "date") -> Column:
    """A moment with all six decimals, whatever the session's zone."""
    text = F.col(column).cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(
        F.concat(text, F.lit(".000000"))).alias(column)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def _schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = standin.content(spark, sf_dir)
    older = now.drop("title_persian", "content_persian", "summary_persian").withColumn(
        "views", F.col("views").cast("string"))
    merged = union_conformed(CONTENT, now, older)
    return merged.select("id", "title", "title_persian", "summary_persian", "views", "type")


def _content_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = content_scan(standin.content(spark, sf_dir))
    return scan.withColumn("date", moment())


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(filters.since_days(standin.content(spark, sf_dir, "id", "date"), AS_OF))


def _source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.source_counts(standin.content(spark, sf_dir, "date", "source"), AS_OF)


def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = stats.daily_counts(standin.content(spark, sf_dir, "date"))
    return days.select(F.col("day").cast("string").alias("day"), "articles")


def _facet(column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if column == "domain":
        return stats.domain_facet(standin.content(spark, sf_dir, "url"))
    return stats.facet(standin.content(spark, sf_dir, column), column)


def _url_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.url_count(standin.content(spark, sf_dir, "url"), ONE_URL)


def _by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_url(standin.content(spark, sf_dir, "id", "url"), ONE_URL)


def _url_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.url_stored(standin.content(spark, sf_dir, "url"), ONE_URL)


def _title_search(mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = standin.content(spark, sf_dir, "id", "title", "title_persian")
    return filters.title_search(titles, TITLE_PATTERN, mode)


def _content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = standin.content(spark, sf_dir, "id", "content", "content_persian")
    return _ids(filters.content_search(texts, SEARCH_WORDS))


def _source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "source")
    return filters.by_sources(rows, ["src1", "src7", "src19"])


def _date_range(whole_day: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "date")
    return _ids(filters.by_date_range(rows, "2024-01-05", "2024-01-10", whole_day))


def _domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_domain(standin.content(spark, sf_dir, "id", "url"))
    return filters.by_domain(rows, "example.net")


def _type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_type(standin.content(spark, sf_dir, "id", "type"), "purchase")


def _by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_id(standin.content(spark, sf_dir, "id", "title", "url", "author"), 42)


def _backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(filters.needs_translation(standin.content(spark, sf_dir, "id", "content_persian")))


def _sorted(column: str, ascending: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", *SORT_COLUMNS)
    return sort_articles(rows, column, ascending).withColumn("date", moment())


def _clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.content(spark, sf_dir, "id", "content").select(
        "id", clean_html(F.col("content")).alias("text"))


def _keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "content")
    rows = bind(rows, "text", F.lower(clean_html(F.col("content"))))
    text = F.col("text")
    return rows.select(
        "id",
        occurrences(text, "the").alias("n_the"),
        occurrences(text, "èr").alias("n_accented"),
        occurrences(text, "").alias("n_empty"),
        occurrences(text, F.substring("text", 1, 2)).alias("n_own_start"))


def _keyword_match(pairs, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match_keywords(standin.content(spark, sf_dir, "id", "content"), pairs)
    return rows.select("id", join_list(F.col("matched_keywords")).alias("keywords"))


def _html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(standin.table(spark, sf_dir, "pages"), "page_id", "html")


def _html_blocks_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of pages that leave their paragraphs, lists, items and quotations open."""
    html = F.regexp_replace("html", r"(?i)</(p|ul|blockquote|li)\s*>", "")
    pages = standin.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return html_blocks(pages, "page_id", "html")


#: Endings for the hosts of pages, one of each kind of rule, and the domain under each.
HOST_KINDS = [
    ("a.b.co.uk", "b.co.uk"), ("a.b.com.ar", "b.com.ar"), ("a.b.gov.au", "b.gov.au"),
    ("a.b.x.ck", "b.x.ck"), ("a.www.ck", "www.ck"), ("a.b.github.io", "github.io"),
    ("a.foo.museum", "foo.museum"), ("a.b.xn--mgba3a4f16a", "b.xn--mgba3a4f16a"), ("co.ke", "")]


def _domain_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages under hosts of each kind of rule, by their ids."""
    hosts = F.array(*[F.lit(name) for name, _ in HOST_KINDS])
    kind = (F.col("page_id") % len(HOST_KINDS) + 1).cast("int")
    url = F.concat(F.lit("https://"), F.element_at(hosts, kind), F.lit("/"), F.col("page_id"))
    pages = standin.table(spark, sf_dir, "pages")
    return with_domain(pages.select("page_id", url.alias("url")))


def _domains(from_table: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = suffix_frame(spark, public_rules()) if from_table else None
    return with_domain(standin.table(spark, sf_dir, "pages").select("page_id", "url"), suffixes)


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bridge and the tag table of all documents."""
    wanted = standin.tag_rows(spark, sf_dir)
    tags = standin.tags(wanted)
    return standin.content_tags(wanted, tags), tags


def _stored_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wanted tags, and the tag table and bridge that are there before.

    The tags of documents in two languages are stored, and the links of every
    document to them.
    """
    wanted = standin.tag_rows(spark, sf_dir)
    tags = standin.tags(standin.in_languages(wanted, sf_dir, "en", "de"))
    return wanted, tags, standin.content_tags(wanted, tags)


def _tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tags_of(*_links(spark, sf_dir))


def _tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag_lines(*_links(spark, sf_dir))


def _tag_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, tags, _ = _stored_tags(spark, sf_dir)
    known = tags.unionAll(tagging.create_missing_tags(wanted, tags))
    return tagging.tag_ids(wanted, known).select("content_id", "pos", "tag", "tag_id")


def _new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents beyond those of documents in two languages."""
    wanted = standin.tag_rows(spark, sf_dir)
    tags = standin.tags(wanted)
    stored = standin.content_tags(standin.in_languages(wanted, sf_dir, "en", "de"), tags)
    return tagging.new_links(tagging.tag_ids(wanted, tags), stored)


def _surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "date").select(F.col("id").alias("doc"), "date")
    order = [F.col("date").desc_nulls_last(), F.col("doc")]
    return assign_ids(rows, order, after=1000).select("doc", "id")


def _parents(spark: SparkSession, sf_dir: str, deleted: bool) -> DataFrame:
    error = F.col("type") == "error"
    return standin.content(spark, sf_dir, "id", "type").where(error if deleted else ~error)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = standin.image_rows(spark, sf_dir).select("content_id", "image_url")
    return orphans(images, _parents(spark, sf_dir, deleted=False), "content_id")


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = standin.image_rows(spark, sf_dir).select("content_id", "image_url")
    return cascade_delete(images, _parents(spark, sf_dir, deleted=True), "content_id")


def _apply_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "title", "content_persian", "views")
    return apply_translations(rows, standin.translations(spark, sf_dir))


def _under_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, _ = _links(spark, sf_dir)
    return tagging.under_tagged(standin.content(spark, sf_dir, "id"), links)


def _tag_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.tag_lists(spark, sf_dir).select(
        "content_id", tagging.tag_quota(F.col("tags")).alias("quota"))


def _stored(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The part of the corpus that is there before a batch comes in."""
    names = columns or ("id", "url")
    rows = standin.content(spark, sf_dir, *dict.fromkeys((*names, "type")))
    return rows.where(F.col("type") == "view").select(*names)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its URL keys, as a corpus folder holds them."""
    path = shared_folder(spark, "keys")
    write_url_keys(_stored(spark, sf_dir), path)
    return read_url_keys(spark, path)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_items(standin.items(spark, sf_dir))


def _staged(spark: SparkSession, sf_dir: str) -> ingest.Staged:
    return ingest.stage_items(standin.items(spark, sf_dir))


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = highest_id(_stored(spark, sf_dir))
    return ingest.new_content(_staged(spark, sf_dir).accepted, _keys(spark, sf_dir), last)


def _ingest_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(_added(spark, sf_dir), CONTENT).withColumn("date", moment())


def _ingest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tags, _ = _stored_tags(spark, sf_dir)
    return tagging.create_missing_tags(tagging.explode_tags(
        _added(spark, sf_dir).withColumnRenamed("id", "content_id")), tags)


def _ingest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tags, links = _stored_tags(spark, sf_dir)
    last = highest_id(_stored(spark, sf_dir))
    return ingest.ingest(_staged(spark, sf_dir), _keys(spark, sf_dir), tags, links, after=last).content_tags


def _ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).rejected.select("seq", "reject_reason")


def _ingest_tag_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that are NULL or too long, with their item, place and reason."""
    added = _added(spark, sf_dir).select(F.col("id").alias("content_id"), "tags")
    return tagging.rejected_tags(added).select(
        "content_id", "pos", "reject_reason", F.length("tag").alias("n_chars"))


def _corpus(spark: SparkSession, sf_dir: str) -> str:
    """A corpus folder with the stored part of all tables as its first batch."""
    _, tags, links = _stored_tags(spark, sf_dir)
    root = shared_folder(spark, "corpus")
    store_corpus(_stored(spark, sf_dir, *CONTENT.fieldNames()), tags, links, root)
    return root


def _ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch stored and turned away, after the whole job has run on a corpus folder."""
    root = _corpus(spark, sf_dir)
    ingest_batch(_batch(spark, sf_dir), root, 1)
    return ledger(spark, root).where("batch = 1").select("name", "reason", "rows", "highest")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a batch that lies in storage, as batches do."""
    return durable_table(standin.items(spark, sf_dir), TEXT_CODEC)


def _url_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unseen_urls(_staged(spark, sf_dir).accepted, _keys(spark, sf_dir))


def _url_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.seen_urls(_staged(spark, sf_dir).accepted, _keys(spark, sf_dir))


def _mixed_case(text: str, number: str) -> Column:
    """Every third text in capitals."""
    return F.when(F.col(number) % 3 == 0, F.upper(text)).otherwise(F.col(text))


def _url_new_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New records where URLs that differ in case only are the same."""
    good = durable_table(ingest.accepted(_parsed(spark, sf_dir)).select("seq", "url")).withColumn(
        "url", _mixed_case("url", "seq"))
    return ingest.unseen_urls(good, _stored(spark, sf_dir), collation=IGNORE_CASE)


def _tags_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted tags in mixed case with the ids of tags that differ in case only."""
    wanted, tags, _ = _stored_tags(spark, sf_dir)
    wanted = wanted.withColumn("tag", _mixed_case("tag", "content_id"))
    fresh = tagging.create_missing_tags(wanted, tags, collation=IGNORE_CASE)
    return tagging.tag_ids(wanted, tags.unionAll(fresh), collation=IGNORE_CASE).select(
        "content_id", "pos", "tag", "tag_id")


def _tag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "content", "content_persian")
    return enrich.tag_prompts(rows, *_links(spark, sf_dir))


def _tag_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = standin.tag_lists(spark, sf_dir).withColumnRenamed("tags", "existing_tags")
    results = enrich.tag_results(lists, standin.replies(spark, sf_dir))
    return results.select("content_id", join_list(F.col("tags"), "|").alias("tags"))


def _translation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "content", "content_persian")
    return enrich.translation_prompts(rows)


def _translation_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.translation_updates(standin.replies(spark, sf_dir))


def _article_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "title_persian", "source", "url", "date",
                           "content", "content_persian")
    return enrich.article_prompts(match_keywords(rows, keyword_pairs(PAIRS)), SITE)


def _generated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.generated_articles(standin.replies(spark, sf_dir))


def _image_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "title_persian", "summary", "summary_persian",
                           "content", "content_persian")
    return enrich.image_prompts(rows, images=2)


def _image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.generated_image_urls(standin.image_replies(spark, sf_dir))


def _string_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "url", "source")
    urls = string_urls(F.array("url", "source", "url"))
    return rows.select("id", F.size(urls).alias("n_urls"), join_list(urls, " ").alias("urls"))


def _image_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.image_rows(spark, sf_dir)
    path = shared_folder(spark, "images")
    write_images(rows.select("image_url", "image_data"), path)
    found = new_images(read_images(spark, path), rows.select("content_id", "image_url"), after=500)
    return found.select("id", "content_id", "image_url", "n_bytes")


def _image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that lie as files in a folder, stored and linked by the whole job."""
    folder, root = shared_folder(spark, "files"), shared_folder(spark, "corpus")
    standin.write_files(spark, sf_dir, folder)
    files = image_files(spark, folder)
    item = F.regexp_extract("image_url", r"page=([0-9]+)", 1).cast("long")
    store_images(files, files.select(item.alias("content_id"), "image_url"), root, 0)
    rows, _ = stored_images(spark, root)
    return rows.select("content_id", "digest", "n_bytes")


def _images_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.image_rows(spark, sf_dir)
    root = shared_folder(spark, "corpus")
    store_images(rows.select("image_url", "image_data"), rows.select("content_id", "image_url"), root, 0)
    found = images_of(*stored_images(spark, root), content_id=7)
    return found.select(F.decode("image_data", "UTF-8").alias("image"))


def _translations_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of a corpus folder after its translations are stored there."""
    none = standin.tags(standin.tag_rows(spark, sf_dir)).limit(0)
    root = shared_folder(spark, "corpus")
    store_corpus(standin.content(spark, sf_dir), none, none.select(
        F.col("id").alias("content_id"), F.col("id").alias("tag_id")), root)
    store_translations(standin.translations(spark, sf_dir), root)
    return corpus_table(spark, root, "content").select("id", "title", "content_persian", "views")


def _generated_tags_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that replies to tag prompts add to a corpus folder."""
    root = _corpus(spark, sf_dir)
    store_generated_tags(standin.replies(spark, sf_dir), root, 1)
    tags = corpus_table(spark, root, "tags")
    added = corpus_table(spark, root, "content_tags").join(
        corpus_table(spark, root, "content_tags", before_batch=1), ["content_id", "tag_id"], "left_anti")
    return tagging.tags_of(added, tags)


def _images_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = standin.image_rows(spark, sf_dir).where(F.octet_length("image_data") > 0)
    rows = images_by_item(standin.content(spark, sf_dir, "id"), stored)
    return rows.select("id", F.decode("image_data", "UTF-8").alias("image"))


def _split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return standin.table(spark, sf_dir, "documents").select(
        "doc_id",
        join_list(split_list(text), "|").alias("entries"),
        F.size(split_list(text, keep_empty=True)).alias("n_all"))


def _stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t \n "), "text", F.lit(" 　\r\n"))
    return standin.table(spark, sf_dir, "documents").select(
        "doc_id", strip(padded).alias("text"))


def _fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.content(spark, sf_dir, "id", "title", "title_persian", "summary",
                           "summary_persian", "content_persian")
    return rows.select(
        "id",
        first_filled(F.col("title_persian"), F.col("title")).alias("title"),
        preview(F.col("summary")).alias("summary"),
        first_filled(F.col("content_persian"), F.col("summary_persian"), F.col("title"))
        .alias("three_way"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = article_cards(with_domain(standin.content(spark, sf_dir)))
    return cards.select("id", "title", moment(), "source", "domain", "views", "summary")


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_details(standin.content(spark, sf_dir)).withColumn("date", moment())


LIST_REQUEST = ListRequest(
    pairs=PAIRS, title="e", sources=[f"src{i}" for i in range(12)],
    start="2024-01-02", end="2024-01-12", sort_by="final_score")


_LISTED = [f for f in CONTENT.fieldNames() if f not in ("author", "content_persian")]


def news_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list page with every filter but type and domain in use."""
    cards = article_list(standin.content(spark, sf_dir, *_LISTED), LIST_REQUEST)
    return cards.withColumn("date", moment())


def _news_list_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = ListRequest(domain="example.com", kind="click", sort_by="date", ascending=True)
    cards = article_list(standin.content(spark, sf_dir, *_LISTED), request)
    return cards.withColumn("date", moment()).drop("keywords")


QUERIES: dict[str, Query] = {
    "content_scan": _content_scan,
    "schema_evolution": _schema_evolution,
    "recent_articles": _recent,
    "source_counts_last_week": _source_counts,
    "daily_counts": _daily_counts,
    "facet_source": partial(_facet, "source"),
    "facet_type": partial(_facet, "type"),
    "facet_domain": partial(_facet, "domain"),
    "url_count": _url_count,
    "article_by_url": _by_url,
    "url_stored": _url_stored,
    "title_search_bag": partial(_title_search, "bag"),
    "title_search_any": partial(_title_search, "any"),
    "content_search_bag": _content_search,
    "source_filter": _source_filter,
    "date_range": partial(_date_range, False),
    "date_range_whole_day": partial(_date_range, True),
    "domain_filter": _domain_filter,
    "type_filter": _type_filter,
    "article_by_id": _by_id,
    "translation_backlog": _backlog,
    **{f"sort_{column}_{'asc' if up else 'desc'}": partial(_sorted, column, up)
       for column in SORT_COLUMNS for up in (True, False)},
    "html_clean_text": _clean_text,
    "keyword_counts": _keyword_counts,
    "keyword_match": partial(_keyword_match, PAIRS),
    "keyword_match_default": partial(_keyword_match, DEFAULT_PAIRS),
    "keyword_match_many": partial(_keyword_match, MANY_PAIRS),
    "html_blocks": _html_blocks,
    "html_blocks_unclosed": _html_blocks_unclosed,
    "registered_domain": partial(_domains, False),
    "registered_domain_table": partial(_domains, True),
    "registered_domain_kinds": _domain_kinds,
    "url_host": _hosts,
    "content_tag_rows": _tag_rows,
    "tag_lines": _tag_lines,
    "tag_get_or_create": _tag_get_or_create,
    "content_tag_links": _new_links,
    "surrogate_ids": _surrogate_ids,
    "orphan_images": _orphans,
    "cascade_delete": _cascade,
    "translations_applied": _apply_translations,
    "translations_stored": _translations_stored,
    "generated_tags_stored": _generated_tags_stored,
    "under_tagged": _under_tagged,
    "tag_quota": _tag_quota,
    "ingest_content": _ingest_content,
    "ingest_tags": _ingest_tags,
    "ingest_links": _ingest_links,
    "ingest_rejects": _ingest_rejects,
    "ingest_tag_rejects": _ingest_tag_rejects,
    "ingest_counts": _ingest_counts,
    "url_new": _url_new,
    "url_seen": _url_seen,
    "url_new_any_case": _url_new_any_case,
    "tag_get_or_create_any_case": _tags_any_case,
    "tag_prompts": _tag_prompts,
    "tag_results": _tag_results,
    "translation_prompts": _translation_prompts,
    "translation_updates": _translation_updates,
    "article_prompts": _article_prompts,
    "generated_articles": _generated_articles,
    "image_prompts": _image_prompts,
    "image_urls": _image_urls,
    "string_urls": _string_urls,
    "image_insert": _image_insert,
    "image_files": _image_files,
    "images_of_item": _images_of_item,
    "images_by_item": _images_by_item,
    "split_lists": _split_lists,
    "stripped_text": _stripped,
    "text_fallbacks": _fallbacks,
    "article_cards": _cards,
    "article_details": _details,
    "news_list": news_list,
    "news_list_site": _news_list_site,
}
