"""Archives as rows: guards by running windows, rendering of entries, book metadata and spines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_path, trim_ws


@dataclass(frozen=True)
class ArchiveLimits:
    """Limits of each archive, and of the bytes that a source's archives are inflated to on all levels together."""

    entries: int = 256
    entry_bytes: int = 8 << 20
    total_bytes: int = 32 << 20
    depth: int = 4
    tree_bytes: int = 128 << 20


def first_violation(entries: DataFrame, archive: str, position: str, size: str, limits: ArchiveLimits | None = None) -> DataFrame:
    """(archive, entry, violation) of the first entry that breaks a limit, in order of position; for one entry the
    number of entries counts before its own size, and that before the running total."""
    limits = limits or ArchiveLimits()
    running = Window.partitionBy(archive).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = entries.withColumns({"__n": F.count("*").over(running), "__total": F.sum(size).over(running)})
    kind = F.when(F.col("__n") > limits.entries, "entry limit").when(F.col(size) > limits.entry_bytes, "entry size limit").when(F.col("__total") > limits.total_bytes, "total size limit")
    broken = seen.withColumn("__kind", kind).where(F.col("__kind").isNotNull())
    return broken.groupBy(archive).agg(F.min(F.struct(position, "__kind")).alias("f")).select(archive, F.col(f"f.{position}").alias("entry"), F.col("f.__kind").alias("violation"))


def archive_label(url: Column, local_path: Column, filename: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(url), blank(local_path), blank(filename), F.lit("archive.zip"))


def render_entries(entries: DataFrame, archive: str, position: str, name: str, markdown: str, label: Column) -> DataFrame:
    """(archive, markdown): a line with the label, then a section for each entry that isn't blank, in order."""
    body = trim_ws(F.col(markdown))
    section = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("## File: "), F.col(name), F.lit("\n\n"), body))
    own = entries.select(F.col(archive), F.col(position).alias("__p"), section.alias("__s"), label.alias("__l"))
    made = own.groupBy(archive).agg(F.first("__l", ignorenulls=True).alias("label"), F.array_sort(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct("__p", "__s")))).alias("s"))
    head = F.array(F.concat(F.lit("Content from zip file `"), F.col("label"), F.lit("`")))
    return made.select(archive, F.array_join(F.concat(head, F.transform("s", lambda x: x["__s"])), "\n\n").alias("markdown"))


def book_metadata(title: Column, creators: Column, language: Column, publisher: Column, date: Column, description: Column, identifier: Column) -> Column:
    """One line for each field that isn't blank; creators (an array) share one."""
    names = F.array_join(F.filter(F.transform(creators, trim_ws), lambda c: c != ""), ", ")
    line = lambda label, value: F.when(F.coalesce(trim_ws(value), F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), trim_ws(value)))
    return F.concat_ws("\n", line("Title", title), line("Authors", names), line("Language", language), line("Publisher", publisher), line("Date", date), line("Description", description), line("Identifier", identifier))


def spine_entries(spine: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Chapters in reading order: spine (book, seq, idref), manifest (book, id, href), members (book, name, ...): what
    is missing at any step is left out."""
    hrefs = manifest.select("book", F.col("id").alias("idref"), clean_path(F.col("href")).alias("name"))
    return spine.join(hrefs, ["book", "idref"]).join(members, ["book", "name"])


def relationship_target(base: Column, target: Column) -> Column:
    """http, https and mailto as they are, anything else cleaned; a leading slash stands for the package's root."""
    web = target.startswith("http://") | target.startswith("https://") | target.startswith("mailto:")
    rooted = target.startswith("/")
    joined = F.when(rooted, F.regexp_replace(target, r"\A/+", "")).otherwise(F.concat(base, F.lit("/"), target))
    return F.when(web, target).otherwise(clean_path(joined))
