"""HTML documents as ordered rows of displayable blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions.text import html_text
from presswork.operators.binding import bind

# Text that only looks like markup, taken out first. What never closes runs to the end.
_UNSHOWN = (r"(?is)<!--.*?(?:-->|\z)"
            r"|<(script|style|template)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)")
_TAG = r"(?is)<(/?[a-z][a-z0-9]*)(?=[\s/>])[^>]*+>"

# Elements that never have content.
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"

# Tags by name, closing ones with a slash; a void one, or one that closes itself, is ">"
# and its name.
_NAME = f"""transform(arrays_zip(names, tags), t -> CASE
  WHEN lower(t.names) RLIKE '^({_VOID})$' OR t.tags LIKE '%/>' THEN concat('>', lower(t.names))
  ELSE lower(t.names) END)"""

#: Tags of a run. What is found in a run is gathered there and then put, as one entry, behind
#: that of the runs before: a list that grew by one block at a time would be copied as often.
RUN = 128


def _in_runs(state: dict[str, str], step: str, finish: str) -> str:
    """SQL that folds ``step``, a lambda of (s, i), over the places 0 to the number of tags.

    ``state`` are the fields of ``s`` and their first values. The step's ``s.found`` holds
    what its run has found; ``finish`` makes the result of all that was found, as ``found``.
    """
    fields = list(state)
    first = ", ".join(f"'{name}', {value}" for name, value in state.items())
    entered = ", ".join(f"'{name}', o.{name}" for name in fields)
    left = ", ".join(f"'{name}', r.{name}" for name in fields)
    run = (f"aggregate(sequence(c * {RUN}, least(c * {RUN} + {RUN - 1}, size(elements))), "
           f"named_struct({entered}, 'found', {_NONE}), {step})")
    return (f"aggregate(sequence(0, cast(size(elements) DIV {RUN} AS int)), "
            f"named_struct({first}, 'runs', cast(array() AS array<array<struct<first:int,last:int>>>)), "
            f"(o, c) -> transform(array({run}), r -> named_struct({left}, 'runs', array_append(o.runs, r.found)))[0], "
            f"o -> transform(array(flatten(o.runs)), found -> {finish})[0])")


_NONE = "cast(array() AS array<struct<first:int,last:int>>)"

# One pass over the names with the open elements as a stack, "/div/p/" for a paragraph in
# a div. A closing tag also closes what was opened after its element, and counts for
# nothing without one. ``found`` gets a block when the stack is down to where it began
# (``depth``), or the text ends (``last`` is then past the tags).
_OUTERMOST = _in_runs({"stack": "'/'", "depth": "0", "first": "0"}, """
  (s, i) -> CASE
    WHEN i = size(elements) THEN CASE WHEN s.depth = 0 THEN s ELSE named_struct('stack', '/', 'depth', 0,
      'first', 0, 'found', array_append(s.found, named_struct('first', s.first, 'last', i))) END
    WHEN startswith(elements[i], '>') THEN CASE
      WHEN s.depth = 0 AND elements[i] IN ('>img', '>p', '>ul', '>blockquote') THEN named_struct(
        'stack', s.stack, 'depth', 0, 'first', 0,
        'found', array_append(s.found, named_struct('first', i, 'last', i)))
      ELSE s END
    WHEN NOT startswith(elements[i], '/') THEN named_struct('stack', concat(s.stack, elements[i], '/'),
      'depth', if(s.depth = 0 AND elements[i] IN ('p', 'ul', 'blockquote'), length(s.stack), s.depth),
      'first', if(s.depth = 0, i, s.first), 'found', s.found)
    WHEN instr(s.stack, concat(elements[i], '/')) = 0 THEN s
    ELSE transform(array(left(s.stack, length(s.stack) - length(substring_index(
      s.stack, concat(elements[i], '/'), -1)) - length(elements[i]))), stack ->
        named_struct('stack', stack, 'depth', if(length(stack) <= s.depth, 0, s.depth), 'first', s.first,
          'found', if(s.depth > 0 AND length(stack) <= s.depth,
            array_append(s.found, named_struct('first', s.first, 'last', i)), s.found)))[0] END""", "found")

# The same inside a list: each open list is a "u", followed by an "l" while it has an open
# item. An item ends at its closing tag, at the next item of its list, or with its list.
_ITEMS = _in_runs({"stack": "''", "open": "cast(array() AS array<int>)"}, """
  (s, i) -> CASE
    WHEN i = size(elements) THEN named_struct('stack', '', 'open', s.open, 'found', concat(s.found,
      transform(s.open, x -> named_struct('first', x, 'last', i))))
    WHEN elements[i] = 'ul' THEN named_struct('stack', concat(s.stack, 'u'), 'open', s.open, 'found', s.found)
    WHEN elements[i] = 'li' AND s.stack NOT LIKE '%l' THEN named_struct(
      'stack', concat(s.stack, 'l'), 'open', array_append(s.open, i), 'found', s.found)
    WHEN elements[i] IN ('li', '/li', '/ul') AND s.stack LIKE '%l' THEN named_struct(
      'stack', CASE elements[i] WHEN 'li' THEN s.stack WHEN '/li' THEN left(s.stack, length(s.stack) - 1)
        ELSE left(s.stack, length(s.stack) - 2) END,
      'open', CASE elements[i] WHEN 'li' THEN array_append(slice(s.open, 1, size(s.open) - 1), i)
        ELSE slice(s.open, 1, size(s.open) - 1) END,
      'found', array_append(s.found, named_struct('first', element_at(s.open, -1), 'last', i)))
    WHEN elements[i] = '/ul' THEN named_struct(
      'stack', left(s.stack, greatest(length(s.stack) - 1, 0)), 'open', s.open, 'found', s.found)
    ELSE s END""", "array_sort(found)")


def _tokens(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``tags``, the ``gaps`` around them and their ``elements``, each worked out once."""
    read = F.struct(
        F.regexp_extract_all(text, F.lit(_TAG), 0).alias("tags"),
        F.split(text, _TAG, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(_TAG), 1).alias("names"))
    out = bind(df, "_read", read).select(*df.columns, "_read.*")
    return bind(out, "elements", F.expr(_NAME))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare; NULL when the tag lacks it."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    parts = [F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)]
    return F.when(F.rlike(tag, F.lit(pattern)), F.concat(*parts))


def html_blocks(df: DataFrame, key: str, html_column: str) -> DataFrame:
    """(key, pos, item, kind, text, src, alt, is_svg), one row per block in order.

    Kinds are p, img, li and blockquote; a ul gives one row per item. Blocks are
    the outermost ones at any depth: a paragraph in a quotation belongs to the
    quotation. A block without a closing tag runs to the end of the document, and
    an item's text takes in the lists inside it, whose items have rows too.
    """
    body = F.regexp_replace(F.col(html_column), _UNSHOWN, "")
    read = _tokens(df.select(F.col(key).alias("_key"), body.alias("_body")), F.col("_body"))
    # The tags and gaps from the first tag to the last one, or to the end of the text.
    whole = """transform(found, f -> concat(array_join(transform(slice(tags, f.first + 1, f.last - f.first),
      (tag, k) -> concat(tag, gaps[f.first + k + 1])), ''), coalesce(get(tags, f.last), '')))"""
    read = bind(read.select("_key", "tags", "gaps", F.expr(_OUTERMOST).alias("found")), "_whole", F.expr(whole))
    blocks = read.select("_key", F.posexplode("_whole").alias("pos", "_block"))
    blocks = blocks.withColumn("_kind", F.lower(F.regexp_extract("_block", r"^<([A-Za-z]+)", 1)))
    is_list = F.col("_kind") == "ul"
    inner = _tokens(blocks, F.when(is_list, F.col("_block")).otherwise(""))
    item = """transform(found, f -> concat(gaps[f.first + 1], array_join(transform(
      slice(tags, f.first + 2, f.last - f.first - 1), (tag, k) -> concat(tag, gaps[f.first + k + 2])), '')))"""
    inner = bind(inner, "found", F.expr(_ITEMS))
    pieces = F.when(is_list, F.expr(item)).otherwise(F.array("_block"))
    items = inner.select(
        "_key", "pos", F.when(is_list, "li").otherwise(F.col("_kind")).alias("kind"),
        F.posexplode(pieces).alias("item", "_piece"))
    is_image = F.col("kind") == "img"
    src = F.when(is_image, _attribute(F.col("_piece"), "src"))
    return items.select(
        F.col("_key").alias(key), "pos", "item", "kind",
        F.when(~is_image, html_text(F.col("_piece"))).alias("text"),
        src.alias("src"),
        F.when(is_image, _attribute(F.col("_piece"), "alt")).alias("alt"),
        F.when(is_image, F.coalesce(F.endswith(src, F.lit(".svg")), F.lit(False))).alias("is_svg"),
    )
