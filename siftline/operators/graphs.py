"""Links between stored pages, and how many clicks a page is from its site's root (SRC-22, TXT-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.html import ANCHOR, clean
from siftline.functions.links import resolved
from siftline.functions.text import bare_host, company_emails
from siftline.session import cut

L = F.lit


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every link of pages (page_id, url, html), its address resolved; links that lead nowhere are left out."""
    html = F.coalesce("html", L(""))
    found = F.arrays_zip(F.regexp_extract_all(html, L(ANCHOR), L(1)).alias("h"), F.regexp_extract_all(html, L(ANCHOR), L(2)).alias("t"))
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(found).alias("x"))
    return rows.select("page_id", resolved(F.col("x.h"), F.col("base")).alias("url"), clean(F.col("x.t")).alias("text")).where("url is not null")


def sites(pages: DataFrame) -> DataFrame:
    """(page_id, address, host, root): the page of each host whose path is ``/`` is its root, else the one with the smallest id."""
    p = pages.select("page_id", resolved(L(""), F.col("url")).alias("address"), bare_host(F.col("url")).alias("host")).where("address is not null")
    at_root = F.col("address").rlike("^https?://[^/]+/$")
    return p.withColumn("root", F.min_by("page_id", F.struct(~at_root, "page_id")).over(Window.partitionBy("host")))


def clicks(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, clicks): least number of links from a root (page_id) to each page reached by edges (src, dst).

    One join for each click, of the pages found last; it ends when none is new, so no depth is
    set.  What is found is cut from its lineage, so plans stay as small as the first.
    """
    edges = cut(edges.distinct())
    front = seen = cut(roots.select("page_id", L(0).alias("clicks")).distinct())
    step = 0
    while not front.isEmpty():
        step += 1
        reached = edges.join(front.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).distinct()
        front = cut(reached.join(seen, "page_id", "left_anti").withColumn("clicks", L(step)))
        seen = seen.unionAll(front)
    return seen


def contact_channels(pages: DataFrame, most: int = 6) -> DataFrame:
    """One row per site: host, root, pages (reached from the root), contact_page, contact_url, clicks, emails.

    The contact page is the one with fewest clicks from the root (then the smallest id) among
    those whose address or a link to them says contact.  E-mails are those of the site's own
    host on the root and the contact page, recruiting ones first.
    """
    known = cut(sites(pages))
    found = links(pages)
    target = known.select(F.col("address").alias("url"), F.col("page_id").alias("dst"), F.col("host").alias("to_host"))
    inner = cut(found.join(known.select("page_id", "host"), "page_id").join(target, "url").where("host = to_host").select(F.col("page_id").alias("src"), "dst", F.lower("text").contains("contact").alias("says")))
    reached = clicks(inner.select("src", "dst"), known.select(F.col("root").alias("page_id")))
    named = inner.groupBy(F.col("dst").alias("page_id")).agg(F.bool_or("says").alias("says"))
    rows = known.join(reached, "page_id").join(named, "page_id", "left")
    is_contact = F.coalesce("says", L(False)) | F.lower("address").contains("contact")
    best = F.min(F.when(is_contact, F.struct("clicks", "page_id", "address")))
    per = rows.groupBy("host", "root").agg(F.count(L(1)).alias("pages"), best.alias("c")).select("host", "root", "pages", F.col("c.page_id").alias("contact_page"), F.col("c.address").alias("contact_url"), F.col("c.clicks").alias("clicks"))
    asked = per.select("host", F.explode(F.array_distinct(F.array_compact(F.array("root", "contact_page")))).alias("page_id"))
    told = asked.join(pages.select("page_id", "html"), "page_id").select("host", F.explode(_emails(F.col("html"), F.col("host"))).alias("e")).distinct()
    gathered = told.groupBy("host").agg(F.slice(F.array_sort(F.collect_set("e")), 1, most).alias("e")).select("host", F.transform("e", lambda e: e["address"]).alias("emails"))
    return per.join(gathered, "host", "left").withColumn("emails", F.coalesce("emails", F.array().cast("array<string>")))


def _emails(html: Column, host: Column) -> Column:
    return company_emails(F.coalesce(html, L("")), host, 1 << 20)
