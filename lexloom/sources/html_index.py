"""Index pages of court sites: tables, link lists and archive volumes."""

from __future__ import annotations

import functools
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.text import (
    loose_date,
    squash,
    start_year,
    tags_to_spaces,
    unescape_entities,
)
from lexloom.operators.ordering import first_per_key
from lexloom.session import durable

# Markup of the index pages.
ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
CELL = r"(?s)<td[^>]*>(.*?)</td>"
ORDER_LINK = r'order-pdf/([A-Z0-9]+)/(\d{4}-\d{2}-\d{2})\?path=([^"&\s]+)'
DAY_IN_ROW = r"(\d{2}/\d{2}/\d{4})"
LATEST_ENTRY = (
    r'(?s)<li>\s*<a href="https://www\.sci\.gov\.in/view-pdf/'
    r'\?diary_no=(\d+)&type=([a-z])&order_date=(\d{4}-\d{2}-\d{2})[^"]*"[^>]*>(.*?)</a>\s*</li>'
)
PDF_LINK = r'(?i)<a\s+[^>]*href="([^"]+\.pdf)"[^>]*>([^<]*)</a>'
ANY_LINK = r'(?is)<a\s+[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
PAGE_LINK = r'(?i)<a\s+[^>]*href="([^"]+\.html?)"[^>]*>'
VOLUME_ENTRY = (
    r'(?is)<a\s+[^>]*href="([^"]+\.pdf)"[^>]*>(.*?)</a>(.*?)(?=<a\s|</tr>|</table>|\z)'
)
VOLUME_CITATION = r"(?i)(\d{4}-\d{4}\s*\(\d+\)\s*BHCR\s+[A-Z]?\d+[A-Z]?)"


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Every link of each page: key, position in the page, href, text without tags."""
    pairs = F.arrays_zip(_all(F.col(html), ANY_LINK, 1), _all(F.col(html), ANY_LINK, 2))
    return pages.select(key, F.posexplode(pairs).alias("i", "p")).select(
        key, "i", F.col("p")["0"].alias("href"), tags_to_spaces(F.col("p")["1"]).alias("label")
    )


def clean_text(c: Column) -> Column:
    """Decode entities, then drop tags and collapse whitespace."""
    return squash(F.regexp_replace(unescape_entities(c), r"<[^>]+>", " "))


def recent_judgments(pages: DataFrame, page: str, html: str, min_date: date) -> DataFrame:
    """Judgment rows of paged tables, first entry per case number.

    Reading stops at the first row older than ``min_date``: that row, the rest of
    its page and all later pages are left out. Rows with fewer than four cells, no title,
    no order link or no date are skipped.
    """
    rows = pages.select(page, F.posexplode(_all(F.col(html), ROW, 1)).alias("i", "row"))
    cells = rows.select(page, "i", _all(F.col("row"), CELL, 1).alias("td")).where(F.size("td") >= 4)
    last = F.element_at("td", -1)
    fields = cells.select(
        page, "i",
        tags_to_spaces(F.col("td")[1]).alias("matter"),
        tags_to_spaces(F.col("td")[2]).alias("title"),
        tags_to_spaces(F.col("td")[3]).alias("judge"),
        F.nullif(loose_date(F.regexp_extract(last, DAY_IN_ROW, 1)), F.lit("")).alias("decision_date"),
        F.regexp_extract(last, ORDER_LINK, 1).alias("cnr"),
        F.regexp_extract(last, ORDER_LINK, 2).alias("pdf_date"),
        F.regexp_extract(last, ORDER_LINK, 3).alias("pdf_path"),
        last.contains("order-pdf").alias("linked"),
    ).where("title <> '' AND linked AND decision_date IS NOT NULL")
    at = F.struct(F.col(page), F.col("i"))
    stop = fields.where(F.col("decision_date") < F.lit(str(min_date))).agg(F.min(at)).scalar()
    kept = fields.where((F.col("cnr") != "") & (stop.isNull() | (at < stop)))
    carry = [page, "i", "matter", "title", "judge", "decision_date", "pdf_date", "pdf_path"]
    return first_per_key(kept, ["cnr"], [page, "i"], carry)


def latest_orders(pages: DataFrame, key: str, html: str, min_date: date) -> DataFrame:
    """Entries of a link list, first per diary number and type."""
    groups = [_all(F.col(html), LATEST_ENTRY, g) for g in (1, 2, 3, 4)]
    entries = pages.select(key, F.posexplode(F.arrays_zip(*groups)).alias("i", "e")).select(
        key, "i",
        F.col("e")["0"].alias("diary"), F.col("e")["1"].alias("kind"),
        F.col("e")["2"].alias("decision_date"),
        tags_to_spaces(F.col("e")["3"]).alias("description"),
    )
    title = F.regexp_replace(
        F.substring_index("description", " - (Uploaded", 1), r"\s*-\s*Diary Number.*$", ""
    )
    title = F.regexp_replace(title, r"\s*-\s*\d{2}-[A-Za-z]{3}-\d{4}\s*$", "")
    named = entries.where(F.col("decision_date") >= F.lit(str(min_date))).select(
        key, "i", "decision_date", "description",
        F.concat(F.lit("sc"), F.col("diary"), F.lit("_"), F.col("kind"), F.lit(".pdf")).alias("doc_name"),
        F.coalesce(F.nullif(title, F.lit("")), F.substring("description", 1, 80)).alias("title"),
        F.regexp_extract("description", r"-\s*([A-Za-z().]+ No\.?\s*[\d/-]+)\s*-", 1).alias("citation"),
    )
    return first_per_key(
        named, ["doc_name"], [key, "i"], ["decision_date", "title", "citation", "description"]
    )


def volume_cases(pages: DataFrame, key: str, html: str, label: str, first_year: int = 1862) -> DataFrame:
    """Cases of a reports volume: the link, its title and the text up to the next link."""
    groups = [_all(F.col(html), VOLUME_ENTRY, g) for g in (1, 2, 3)]
    rows = pages.select(key, label, F.posexplode(F.arrays_zip(*groups)).alias("i", "e")).select(
        key, label, "i", F.col("e")["0"].alias("href"),
        clean_text(F.col("e")["1"]).alias("title"), clean_text(F.col("e")["2"]).alias("trailing"),
    )
    cited = F.regexp_extract("trailing", VOLUME_CITATION, 1)
    year = F.coalesce(start_year(F.col(label)), F.lit(first_year))
    citation = F.when(cited != "", cited).otherwise(F.col(label))
    return rows.select(
        key, "i", "href", "title", citation.alias("citation"),
        F.trim(F.replace("trailing", citation, F.lit(""))).alias("description"),
        year.alias("year"), F.concat(year.cast("string"), F.lit("-01-01")).alias("decision_date"),
    )


def ledger_cases(pages: DataFrame, key: str, html: str, series: str, year: int) -> DataFrame:
    """Cases of a ledger page: one per PDF link, named by the link text or the file."""
    groups = [_all(F.col(html), PDF_LINK, g) for g in (1, 2)]
    rows = pages.select(key, F.posexplode(F.arrays_zip(*groups)).alias("i", "e")).select(
        key, "i", F.col("e")["0"].alias("href"), clean_text(F.col("e")["1"]).alias("label")
    )
    name = F.url_decode(F.regexp_extract("href", r"[^/]*$", 0))
    title = F.when(F.col("label") != "", F.col("label")).otherwise(
        F.concat(F.lit(f"{series.title()} decision "), name)
    )
    return rows.select(
        key, "i", "href", title.alias("title"),
        F.concat(F.lit(f"{series.title()} "), title).alias("citation"),
        F.lit(year).alias("year"), F.lit(f"{year}-01-01").alias("decision_date"),
    )


def law_report_cases(pages: DataFrame, key: str, html: str, label: str) -> DataFrame:
    """Cases of a law-reports index; the page number comes from the file name."""
    groups = [_all(F.col(html), PDF_LINK, g) for g in (1, 2)]
    rows = pages.select(key, label, F.posexplode(F.arrays_zip(*groups)).alias("i", "e")).select(
        key, label, "i", F.col("e")["0"].alias("href"), F.col("e")["1"].alias("text")
    ).where("text <> ''")
    page = F.regexp_extract("href", r"(?i)Bom(\d+)\.pdf$", 1)
    year = F.coalesce(start_year(F.col(label)), F.lit(1876))
    return rows.select(
        key, "i", "href", clean_text(F.col("text")).alias("title"),
        F.concat(
            F.lit("ILR Bombay "), F.col(label),
            F.when(page != "", F.concat(F.lit(" p."), page)).otherwise(""),
        ).alias("citation"),
        year.alias("year"), F.concat(year.cast("string"), F.lit("-01-01")).alias("decision_date"),
    )


def _chains(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(url, head, steps): pages with one way in and one way out, and the nearest other page before them.

    Found by pointer doubling: each round looks twice as far back, so a chain of n pages takes the logarithm of n rounds. Pages
    of a closed ring have no such page before them, and none leads to them; they are left out.
    """
    only_out = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst")).where("n = 1").select(F.col("src").alias("url"))
    only_in = edges.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("head")).where("n = 1").select(F.col("dst").alias("url"), "head")
    inner = durable(only_in.join(only_out, "url", "left_semi").join(start.select("url"), "url", "left_anti"))
    back = inner.withColumn("steps", F.lit(1).cast("bigint")).withColumn("open", F.lit(True))
    known = inner.select(F.col("url").alias("head"))
    # Which heads are within chains themselves, once; later rounds carry it along.
    back = back.drop("open").join(known.withColumn("open", F.lit(True)), "head", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    back = durable(back.select("url", "head", "steps", "open"))
    left = back.where("open").count()
    while left:
        further = back.select(F.col("url").alias("head"), F.col("head").alias("then"), F.col("steps").alias("more"), F.col("open").alias("again"))
        moved = back.where("open").join(further, "head").select(
            "url", F.col("then").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.col("again").alias("open")
        )
        back = durable(back.where("not open").unionByName(moved))
        still = back.where("open").agg(F.count("*").alias("n"), F.max("steps").alias("most")).first()
        # A ring is all that stays open once the look back is as long as there are pages.
        if still.n and still.most > 2 * left:
            return back.where("not open").drop("open")
        left = still.n if still.n == 0 else max(left, still.n)
    return back.drop("open")


def reachable_pages(start: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Pages reachable from ``start.url`` along ``edges`` (src, dst), with their depth, the least number of links.

    Chains of pages with one way in and out are contracted to one link with their length first (``_chains``); then one join per
    round goes on from the pages whose depth has improved, until none does, and the pages of chains get
    their depth from the page before the chain. Every round's pages are a table of their own in the shared folder, so the
    plan does not grow and nothing is written twice. If pages lie beyond ``max_depth`` the crawl fails
    rather than end early.
    """
    links = durable(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    seeds = start.select("url").distinct()
    chains = durable(_chains(links, seeds))
    inside = chains.select("url")
    # What leaves a chain, or never was in one.
    ends = links.join(chains, F.col("src") == F.col("url")).select(
        F.col("head").alias("src"), "dst", (F.col("steps") + 1).alias("steps")
    )
    plain = links.withColumn("steps", F.lit(1).cast("bigint")).join(inside, F.col("src") == F.col("url"), "left_anti")
    whole = durable(
        plain.unionByName(ends).join(inside, F.col("dst") == F.col("url"), "left_anti")
        .groupBy("src", "dst").agg(F.min("steps").alias("steps"))
    )
    rounds = [durable(seeds.withColumn("depth", F.lit(0).cast("bigint")))]
    while True:
        seen = functools.reduce(DataFrame.unionByName, rounds).groupBy("url").agg(F.min("depth").alias("known"))
        reached = (
            rounds[-1].join(whole, F.col("url") == F.col("src"))
            .groupBy("dst").agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
            .withColumnRenamed("dst", "url")
        )
        fresh = durable(
            reached.join(seen, "url", "left").where(F.col("known").isNull() | (F.col("depth") < F.col("known"))).select("url", "depth")
        )
        if fresh.isEmpty():
            break
        rounds.append(fresh)
    found = seen.withColumnRenamed("known", "depth")
    within = chains.join(found.withColumnRenamed("url", "head"), "head").select("url", (F.col("depth") + F.col("steps")).alias("depth"))
    pages = found.unionByName(within).select("url", F.col("depth").cast("int").alias("depth"))
    if max_depth is not None:
        pages = durable(pages)
        if not pages.where(F.col("depth") > max_depth).isEmpty():
            raise InvalidRequest(f"pages lie beyond depth {max_depth}")
    return pages
