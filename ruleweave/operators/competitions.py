"""Competition records from server-rendered lists and card pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruleweave import vocab
from ruleweave.functions import arrays
from ruleweave.functions.classify import subject_tags
from ruleweave.functions.text import casefold, let, strip_tags, unescape
from ruleweave.operators.ordered import keep_first
from ruleweave.operators.stages import settle

ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"


def _numbered(records: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Serial number of a page's records; a page is one document, so the window is bounded by it."""
    return records.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def _tags(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("subjects", subject_tags(value)).withColumn("subject", F.get("subjects", F.lit(0)))


def list_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of the approved list; a row with a number opens a title, shorter rows continue it."""
    body = settle(pages, [key], {"body": F.regexp_extract(html, vocab.LIST_TABLE, 1)}).filter("body != ''")
    read = F.transform(
        F.regexp_extract_all("body", F.lit(ROW), 1),
        lambda row: F.transform(F.regexp_extract_all(row, F.lit(CELL), 1), lambda cell: strip_tags(cell)),
    )
    rows = settle(body, [key], {"rows": read})
    marked = settle(
        rows, [key, "rows"],
        {"opens": F.transform("rows", lambda r: (F.size(r) >= 5) & F.coalesce(F.get(r, F.lit(0)).rlike(r"^\d+$"), F.lit(False)))},
    )
    opened = settle(marked, [key, "rows", "opens"], {"opener": arrays.last_position(F.col("opens"))})
    items = F.transform(
        F.arrays_zip("rows", "opens", "opener"),
        lambda item: F.struct(
            item["rows"].alias("rows"), item["opens"].alias("opens"), item["opener"].alias("opener"),
            F.slice(F.coalesce(F.get("rows", item["opener"] - 1), F.array()), 1, 2).alias("above"),
        ),
    )
    each = opened.select(key, F.posexplode(items).alias("row_no", "item"))
    cells, opens, above = F.col("item.rows"), F.col("item.opens"), F.col("item.above")
    shift = F.when(opens, 2).otherwise(0)
    records = each.filter(F.col("item.opener").isNotNull() & (F.size(cells) >= 3)).select(
        key,
        "row_no",
        F.get(above, F.lit(0)).alias("number"),
        F.get(above, F.lit(1)).alias("title"),
        F.get(cells, shift).alias("profile"),
        F.get(cells, shift + 1).alias("subject_detail"),
        F.get(cells, shift + 2).alias("level_text"),
    ).filter("title != ''")
    unique = keep_first(
        records.withColumns({"_t": F.lower("title"), "_p": F.lower("profile")}), [key, "_t", "_p"], ["row_no"]
    ).drop("_t", "_p")
    level = F.regexp_extract("level_text", "[123]", 0)
    numbered = _tags(_numbered(unique, key, "row_no", "record_no"), F.concat_ws(" ", "profile", "subject_detail"))
    return numbered.select(
        key,
        "record_no",
        F.concat(F.lit("rsosh-"), "number", F.lit("-"), F.col("record_no")).alias("id"),
        "title",
        F.lit("school").alias("audience"),
        "subject",
        "subjects",
        "subject_detail",
        "profile",
        F.when(level != "", level).otherwise("—").alias("level"),
        F.lit(vocab.LIST_SOURCE).alias("source"),
        F.lit(vocab.LIST_SOURCE_URL).alias("source_url"),
    )


def card_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One record per direction card; hashed class names are matched by their stable prefix."""
    season = F.regexp_extract(strip_tags(html), vocab.SEASON_PATTERN, 0)
    read_pages = settle(
        pages, [key], {"season": season, "cards": F.regexp_extract_all(html, F.lit(vocab.CARD_PATTERN), 0)}
    )
    cards = read_pages.select(key, "season", F.posexplode("cards").alias("card_no", "card"))
    years = F.regexp_extract_all("season", F.lit(r"20\d{2}"), 0)
    link = unescape(F.regexp_extract("card", vocab.CARD_PATTERN, 1))
    read = settle(
        cards,
        [key, "card_no", F.when(F.col("season") != "", F.array_join(years, "/")).otherwise(vocab.CURRENT_SEASON).alias("season")],
        {
            "profile": strip_tags(F.regexp_extract("card", vocab.CARD_PATTERN, 2)),
            "organizer": strip_tags(F.regexp_extract("card", vocab.CARD_PATTERN, 3)),
            "source_url": let(
                link, lambda to: F.when(F.startswith(to, F.lit("/")), F.concat(F.lit(vocab.CARD_SOURCE_BASE), to)).otherwise(to)
            ),
        },
    ).filter("profile != ''")
    unique = keep_first(read.withColumn("_p", casefold("profile")), [key, "_p"], ["card_no"]).drop("_p")
    numbered = _tags(_numbered(unique, key, "card_no", "record_no"), F.col("profile"))
    return numbered.select(
        key,
        "record_no",
        F.concat(F.lit("ya-professional-"), F.col("record_no")).alias("id"),
        F.concat(F.lit("Я — профессионал · "), "profile").alias("title"),
        F.lit("student").alias("audience"),
        "subject",
        "subjects",
        F.col("profile").alias("subject_detail"),
        "profile",
        "organizer",
        F.concat(F.lit("Я — профессионал · направления "), "season").alias("source"),
        "source_url",
    )


def merge_key(title: str = "title", audience: str = "audience", profile: str = "profile") -> list[Column]:
    """Key under which records of several sources replace each other, the last one staying."""
    return [F.lower(title), F.col(audience), F.lower(F.coalesce(F.col(profile), F.lit("")))]


