"""Acts as nested JSON, one file per Act."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import SourceUnavailable
from lexloom.functions.text import act_key, section_key
from lexloom.operators.statutes import AUTHENTIC
from lexloom.sources import schemas
from lexloom.sources.files import any_file


def read_acts(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Raw Acts with their file name; unreadable or malformed files are left out.

    A file holds one Act, or with ``lines`` one in each line.
    """
    if not any_file(spark, f"{folder}/*.json"):
        raise SourceUnavailable(f"no Act files in {folder}")
    raw = (
        spark.read.schema(schemas.ACT)
        .option("multiLine", "false" if lines else "true")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("file", F.input_file_name())
    )
    return well_formed(raw)


def well_formed(raw: DataFrame) -> DataFrame:
    """Acts with a slug, a title and a number on every section."""
    numbered = ~F.exists(
        F.coalesce("sections", F.array()), lambda s: s["number"].isNull()
    )
    return raw.where(F.col("slug").isNotNull() & F.col("title").isNotNull() & numbered)


def acts_table(raw: DataFrame) -> DataFrame:
    """One row per Act."""
    return raw.select(
        "slug", "title", "short_title", "year", "act_number",
        F.coalesce("coverage", F.lit("partial")).alias("coverage"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("india_code_url", F.lit("")).alias("url"), "note",
    )


def sections_table(raw: DataFrame) -> DataFrame:
    """One row per section; of repeated numbers in an Act the last one stays."""
    rows = raw.select(
        "slug", F.col("title").alias("act_title"), "text_kind", "india_code_url",
        F.posexplode("sections").alias("ordinal", "s"),
    )
    filled = rows.select(
        "slug", "act_title", "ordinal",
        F.col("s.number").alias("number"),
        F.coalesce("s.heading", F.lit("")).alias("heading"),
        F.coalesce("s.text", F.lit("")).alias("text"),
        F.col("s.chapter").alias("chapter"),
        F.coalesce("s.text_kind", "text_kind", F.lit(AUTHENTIC)).alias("text_kind"),
        F.coalesce(F.nullif("s.url", F.lit("")), "india_code_url", F.lit("")).alias("url"),
    )
    fields = [c for c in filled.columns if c != "slug"]
    return (
        filled.groupBy("slug", section_key(F.col("number")).alias("key"))
        .agg(F.max_by(F.struct(*fields), "ordinal").alias("s"))
        .select("slug", "s.*")
        .drop("ordinal")
    )


def alias_table(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """(alias, slug, ordinal): names an Act answers to.

    A name that two Acts claim belongs to the later one but keeps the place of
    the earlier.
    """
    names = F.concat(
        F.array("short_title", "title", F.regexp_replace("slug", "-", " ")),
        F.coalesce("aliases", F.array().cast("array<string>")),
    )
    place = order if order is not None else F.col("file")
    rows = raw.select("slug", place.alias("place"), F.posexplode(names).alias("i", "name"))
    keyed = rows.where(F.col("name").isNotNull()).withColumn("alias", act_key(F.col("name")))
    at = F.struct("place", "i")
    return (
        keyed.where("alias <> ''").groupBy("alias")
        .agg(F.max_by("slug", at).alias("slug"), F.min(at).alias("ordinal"))
    )


def upstream_rows(entries: DataFrame, number: Column, carry: list[str]) -> DataFrame:
    """Sections in one form from upstream entries, with the columns ``carry``; entries without a number are dropped."""
    return entries.where(number.isNotNull()).select(
        *carry,
        F.trim(number).alias("number"),
        F.trim(F.coalesce("section_title", F.lit(""))).alias("heading"),
        F.trim(F.coalesce("section_desc", F.lit(""))).alias("text"),
        F.coalesce(F.nullif("chapter_title", F.lit("")), F.nullif("chapter", F.lit(""))).alias("chapter"),
    )


def upstream_sections(entries: DataFrame, slug: str) -> DataFrame:
    """Sections of an upstream file, whose keys vary in case.

    ``entries`` is read with ``spark.sql.caseSensitive`` on. Entries without a
    number are dropped; a file without any section is an error.
    """
    rows = upstream_rows(entries.withColumn("slug", F.lit(slug)), F.coalesce("section", "Section"), ["slug"])
    if rows.isEmpty():
        raise SourceUnavailable(f"no sections in the upstream file of {slug}")
    return rows


def normalised_act(sections: DataFrame, acts: DataFrame) -> DataFrame:
    """Acts as they are stored: one row per Act of ``acts`` with its upstream sections nested, in their ``ordinal``.

    ``sections`` is what :func:`upstream_sections` gives, with an ordinal; ``acts`` has slug and title and may have
    short_title, year, act_number, aliases, source, india_code_url and note. Upstream Acts are complete. An Act
    without sections is left out: its file has changed its form.
    """
    nested = sections.groupBy("slug").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "number", "heading", "text", "chapter"))),
            lambda s: F.struct(
                s["number"].alias("number"), s["heading"].alias("heading"), s["text"].alias("text"), s["chapter"].alias("chapter"),
                F.lit(None).cast("string").alias("text_kind"), F.lit(None).cast("string").alias("url"),
            ),
        ).alias("sections")
    )
    kinds = dict(zip(("short_title", "year", "act_number", "source", "india_code_url", "note"), ("string", "int", *["string"] * 4)))
    given = {c: F.col(c) if c in acts.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()}
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in acts.columns else F.array().cast("array<string>")
    return acts.join(nested, "slug").select(
        "slug", "title", given["short_title"], given["year"], given["act_number"], aliases.alias("aliases"),
        F.lit("full").alias("coverage"), F.lit(None).cast("string").alias("text_kind"),
        given["source"], F.coalesce(given["india_code_url"], F.lit("")).alias("india_code_url"), given["note"], "sections",
    )


def write_acts(acts: DataFrame, folder: str) -> None:
    """Write Acts as JSON, one line each; :func:`read_acts` with ``lines`` reads them."""
    acts.write.mode("overwrite").json(folder)
