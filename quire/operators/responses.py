"""What language models answer: lines, loops, and layout as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X

# Fixed values
MOST_REPEATS = 20
WRAPPERS = ("results", "blocks", "layout", "layout_details", "items")


def running(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`lines` with the how-manieth equal line of its response each one is."""
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "text").orderBy(order)))


def clipped(lines: DataFrame, keys: list[str], order: str, most: int = MOST_REPEATS) -> DataFrame:
    """Each line of a response at most so often, in order."""
    return running(lines, keys, order).where(F.col("nth") <= most).drop("nth")


def repeats(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, text, n, first): how often a line occurs in a response, and where first."""
    return lines.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def most_repeated(lines: DataFrame, keys: list[str], order: str, top: int = 5) -> DataFrame:
    """The lines that occur most in each response; the earlier of equals first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return repeats(lines, keys, order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def axis_order(boxes: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, portrait, counted, axes): 'yxyx' if most boxes with a width and height stand upright."""
    tall = G.portrait(F.col("box"))
    votes = boxes.groupBy(group).agg(F.count_if(tall).alias("portrait"), F.count(tall).alias("counted"))
    return votes.withColumn("axes", F.when(F.col("portrait") > F.col("counted") / 2, "yxyx").otherwise("xyxy"))


def unfenced(raw: Column) -> Column:
    """The JSON in a fenced block, or what follows a fence that never closes, or the text."""
    x = X.strip(raw)
    inner = F.regexp_extract(x, X.FENCE, 1)
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^`+", ""), "^[json]+", ""), f"^{X.SPACE}+", "")
    cut = F.regexp_replace(F.regexp_replace(cut, "`+$", ""), f"{X.SPACE}+$", "")
    return F.when(inner != "", inner).when(F.startswith(x, F.lit("```")), cut).otherwise(x)


def loose_json(x: Column) -> Column:
    """A text as a variant, or the widest array in it; null if there is none."""
    array = F.nullif(F.regexp_extract(x, r"(\[[\s\S]*\])", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(array))


def freeform_blocks(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_idx, box, text) from raw answers `raw` with img_w and img_h: blocks with four rising numbers and a text."""
    parsed = raw.withColumn("v", loose_json(unfenced(F.col("raw"))))
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in WRAPPERS]
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists, F.when(is_object, F.array("v")))
    one = parsed.select(*keys, "img_w", "img_h", F.posexplode(items).alias("block_idx", "item"))
    pick = lambda name, kind: F.try_variant_get("item", f"$.{name}", kind)
    filled = lambda c: F.when(F.size(c) > 0, c)
    corners = F.coalesce(filled(pick("bbox_2d", "array<variant>")), filled(pick("bbox", "array<variant>")))
    numbers = F.transform(corners, lambda v: F.try_variant_get(v, "$", "double"))
    said = F.coalesce(F.nullif(pick("content", "string"), F.lit("")), pick("text", "string"), F.lit(""))
    found = one.select(*keys, "img_w", "img_h", "block_idx", numbers.alias("b"), X.strip(said).alias("text"))
    fits = (F.size("b") == 4) & F.forall("b", lambda x: x.isNotNull()) & (F.get("b", F.lit(2)) > F.get("b", F.lit(0))) & (F.get("b", F.lit(3)) > F.get("b", F.lit(1))) & (F.col("text") != "")
    kept = found.where(F.col("b").isNotNull() & fits)
    b = G.box(*(F.get("b", F.lit(i)) for i in range(4)))
    return kept.select(*keys, "block_idx", G.normalized(b, F.col("img_w"), F.col("img_h")).alias("box"), "text")


HOSTED = "struct<data:struct<layout:array<struct<block_content:string,bbox:array<double>,block_id:int,page_index:int,block_label:string,score:double>>,data_info:struct<pages:array<struct<width:int,height:int>>,num_pages:int>>>"


def envelope(raw: Column) -> Column:
    """The hosted form's inner object, with or without its envelope."""
    inner = HOSTED.removeprefix("struct<data:")[:-1]
    return F.coalesce(F.from_json(raw, HOSTED)["data"], F.from_json(raw, inner))


def hosted_items(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Items of content with the document's pages, and its boxes turned to x before y if most are upright."""
    d = raw.select(*keys, envelope(F.col("raw")).alias("d"))
    items = d.select(*keys, F.col("d.data_info.pages").alias("pages"), F.posexplode("d.layout").alias("block_idx", "i"))
    items = items.where(~F.coalesce(F.col("i.block_label"), F.lit("text")).isin(X.NON_CONTENT))
    b = G.box(*(F.get("i.bbox", F.lit(k)) for k in range(4)))
    items = items.withColumn("box", F.when(F.size("i.bbox") == 4, b))
    return items.join(axis_order(items, keys[0]).select(keys[0], "axes"), keys[0]).withColumn(
        "box", F.when(F.col("axes") == "yxyx", G.swapped(F.col("box"))).otherwise(F.col("box"))
    )


def hosted_blocks(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_idx, page_index, box, text, label) of the hosted form: by own page, without blank texts or missing pages."""
    items = hosted_items(raw, keys).withColumn("page_index", F.coalesce("i.page_index", F.lit(0)))
    at = F.when(F.col("page_index") < 0, F.size("pages") + F.col("page_index")).otherwise(F.col("page_index"))
    items = items.withColumn("page", F.get("pages", at)).withColumn("text", X.strip(F.coalesce("i.block_content", F.lit(""))))
    kept = items.where(F.col("page").isNotNull() & (F.col("text") != ""))
    return kept.select(*keys, "block_idx", "page_index", G.normalized(F.col("box"), F.col("page.width"), F.col("page.height")).alias("box"), "text", F.coalesce("i.block_label", F.lit("text")).alias("label"))


def truth_blocks(raw: DataFrame, keys: list[str]) -> DataFrame:
    """The same of ground truth: sizes of the first page for all pages, blank texts kept; no pages raises."""
    items = hosted_items(raw, keys).withColumn("page_index", F.coalesce("i.page_index", F.lit(0)))
    first = F.when(F.size("pages") > 0, F.get("pages", F.lit(0))).otherwise(F.raise_error(F.lit("no pages")))
    items = items.withColumn("page", first).withColumn("text", X.strip(F.coalesce("i.block_content", F.lit(""))))
    return items.select(*keys, "block_idx", "page_index", G.normalized(F.col("box"), F.col("page.width"), F.col("page.height")).alias("box"), "text", F.coalesce("i.block_label", F.lit("text")).alias("label"))


BLOCK = "struct<label:string,content:string,bbox_2d:array<double>>"


def detail_blocks(raw: DataFrame, keys: list[str], page_index: int = 0) -> DataFrame:
    """(keys, block_idx, box, text) of layout_details, flat or by page: only blocks labelled text; no pages raises."""
    v = raw.select(*keys, F.try_parse_json(F.col("raw")).alias("v"))
    pages = F.try_variant_get("v", "$.data_info.pages", "array<struct<width:int,height:int>>")
    page = F.when(F.size(pages) > page_index, F.get(pages, F.lit(page_index))).otherwise(F.raise_error(F.lit("no such page")))
    nested = F.try_variant_get("v", "$.layout_details[0]", "array<variant>").isNotNull()
    of_page = F.try_variant_get("v", f"$.layout_details[{page_index}]", f"array<{BLOCK}>")
    flat = F.try_variant_get("v", "$.layout_details", f"array<{BLOCK}>")
    one = v.select(*keys, page.alias("page"), F.posexplode(F.when(nested, of_page).otherwise(flat)).alias("block_idx", "i"))
    text = X.strip(F.coalesce("i.content", F.lit("")))
    b = G.box(*(F.get("i.bbox_2d", F.lit(k)) for k in range(4)))
    kept = one.where(F.col("i.label") == "text").withColumn("text", text).where("text <> ''")
    return kept.select(*keys, "block_idx", G.normalized(b, F.col("page.width"), F.col("page.height")).alias("box"), "text")
