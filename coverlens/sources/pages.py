"""Landed study pages: JSON documents with a ``studies`` array, batch or stream."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.functions import vocab
from coverlens.functions.dates import year_of
from coverlens.functions.labels import Rules, area_of, parse_flag, phase_of_code, phase_of_codes
from coverlens.functions.nested import variant_list, variant_text
from coverlens.functions.text import joined_lower
from coverlens.sources.contracts import require_path


_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


# A number at the end of a file's name, before suffixes of formats and compressions.
_IN_NAME = r"(\d+)(?:\.(?:jsonl?|ndjson|txt|gz|bz2|deflate|lz4|snappy|zst|xz))*$"


def _numbered(raw: DataFrame, multi_line: bool) -> DataFrame:
    """Adds where each page stands: its own ``pageNo``; a page that is a whole file may be numbered by the file's name."""
    in_name = F.regexp_extract(F.col("_metadata.file_name"), _IN_NAME, 1).try_cast("bigint")
    return raw.select(
        (F.coalesce("pageNo", in_name) if multi_line else F.col("pageNo")).alias("page_no"),
        F.col("_metadata.file_path").alias("page_file"),
        "studies",
        "_corrupt_record",
    )


def read_pages(spark: SparkSession, path: str, max_pages: int | None = None, multi_line: bool = True) -> DataFrame:
    """One row per page. Pages are numbered from 1, so ``max_pages`` keeps the first ones.

    ``multi_line=True`` reads one page per file in any layout. For one page per line pass ``False``: such
    files can be split among tasks, which is the form to land large crawls in; each line then carries ``pageNo``.
    A page without a number is an error if a cap is asked for.
    """
    require_path(spark, path)
    raw = spark.read.schema(schema.PAGE).options(multiLine=multi_line, **_JSON).json(path)
    pages = _numbered(raw, multi_line)
    if max_pages is None:
        return pages
    nameless = F.raise_error(F.concat(F.lit("A page without a number cannot be capped: "), "page_file"))
    return pages.where(F.when(F.col("page_no").isNull(), nameless.cast("boolean")).otherwise(F.col("page_no") <= max_pages))


def stream_pages(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, multi_line: bool = True
) -> DataFrame:
    """The same rows as :func:`read_pages`, as a stream of newly landed files."""
    reader = spark.readStream.schema(schema.PAGE).options(multiLine=multi_line, **_JSON)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _numbered(reader.json(path), multi_line)


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """Pages whose text is not a page at all; they yield no studies and would otherwise go unnoticed."""
    return pages.where(F.col("_corrupt_record").isNotNull() & F.col("studies").isNull()).drop("studies")


def readable_pages(pages: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """The pages that could be read. One that could not fails the job, unless ``skip_unreadable`` is set; the caller then
    keeps :func:`unreadable_pages`, as they hold studies that are missing."""
    unreadable = F.col("_corrupt_record").isNotNull() & F.col("studies").isNull()
    if skip_unreadable:
        return pages.where(~unreadable)
    # In the column itself, since a filter beside it may be applied after rows without studies are gone.
    failed = F.raise_error(F.concat(F.lit("A page cannot be read: "), "page_file"))
    return pages.withColumn("studies", F.when(unreadable, failed).otherwise(F.col("studies")))


def _studies(pages: DataFrame) -> DataFrame:
    """One row per study, or page without studies: ``study``, and ``known``, its fields in one pass (``schema.STUDY``).

    They are taken out before the pages are unfolded, as filters on them would otherwise be applied with all the taking out again.
    """
    each = F.transform("studies", lambda v: F.struct(v.alias("study"), F.try_variant_get(v, "$", schema.STUDY).alias("known")))
    rows = pages.select("page_no", "page_file", "_corrupt_record", F.col("studies").isNull().alias("bare"), F.posexplode_outer(each).alias("pos", "each"))
    return rows.select("page_no", "page_file", "_corrupt_record", "bare", "pos", "each.study", "each.known")


def _known(path: str) -> Column:
    return F.col(f"known.{path}")


def _study_faults() -> Column:
    """Paths where a study has a scalar or a list instead of an object, or an ID that is no scalar; empty for a sound one."""
    study = F.col("study")
    whole = F.when(F.col("known").isNotNull(), None).when(variant_text(study).isNotNull(), F.lit("study"))
    parts = [
        F.when(_known(path).isNotNull(), None).when(variant_text(study, path).isNotNull(), F.lit(path)) for path in schema.OBJECTS
    ]
    nested = _known(schema.STUDY_ID).substr(1, 1).isin("{", "[")
    # A study that has every part is sound at a glance.
    full = reduce(and_, [_known(path).isNotNull() for path in schema.OBJECTS]) & ~F.coalesce(nested, F.lit(False))
    found = F.array_compact(F.array(whole, *parts, F.when(nested, F.lit(schema.STUDY_ID))))
    return F.when(full, F.array().cast("array<string>")).otherwise(found)


def _with_faults(pages: DataFrame) -> DataFrame:
    """The rows of :func:`_studies`: ``faults`` is empty for what can be read, ``record`` the text of what cannot."""
    broken = F.col("bare") & F.col("_corrupt_record").isNotNull()
    faults = F.when(broken, F.array(F.lit("page"))).otherwise(_study_faults())
    record = F.when(broken, F.col("_corrupt_record")).when(F.size(faults) > 0, variant_text("study"))
    return _studies(pages).withColumns({"faults": faults, "record": record})


def rejected(pages: DataFrame) -> DataFrame:
    """What of the pages cannot be read, in one scan: whole pages (``pos`` is null) and single studies with the paths at fault."""
    return _with_faults(pages).where("size(faults) > 0").select(*schema.REJECTED)


def pick_or_reject(pages: DataFrame, kept: Column) -> DataFrame:
    """The studies of :func:`pick_studies` that are ``kept`` and the rows of :func:`rejected`, in one scan; the former have no ``faults``."""
    picked = _with_faults(pages).select(*schema.REJECTED, *_picked())
    # Faults last, as they take longest to find.
    return picked.where(((F.col("nct_id") != "") & kept) | (F.size("faults") > 0))


def _picked() -> list[Column]:
    """The arriving columns of a study."""

    def part(path: str) -> Column:
        return _known(f"protocolSection.{path}")

    phases = part("designModule.phases")
    phase_list = F.try_variant_get(phases, "$", "array<string>")
    return [
        _known(schema.STUDY_ID).alias("nct_id"),
        parse_flag(part("oversightModule.oversightHasDmc")).alias("has_dmc"),
        F.when(phase_list.isNotNull(), phase_of_codes(phase_list)).otherwise(phase_of_code(variant_text(phases))).alias("phase"),
        part("designModule.studyType").alias("study_type"),
        part("sponsorCollaboratorsModule.leadSponsor.class").alias("sponsor_class"),
        F.upper(part("statusModule.overallStatus")).alias("overall_status"),
        part("statusModule.whyStopped").alias("why_stopped"),
        part("statusModule.startDateStruct.date").alias("start_date"),
        part("statusModule.primaryCompletionDateStruct.date").alias("primary_completion_date"),
        variant_list(part("conditionsModule.conditions")).alias("conditions"),
    ]


def pick_studies(pages: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """One row per study that has an ID: the arriving columns, with the arrival order (``schema.ARRIVAL``).

    A study in which a part is no object, or the ID no scalar, fails the job; ``skip_unreadable`` leaves it out alone, and the
    caller keeps :func:`rejected`.
    """
    sound, (nct_id, *others) = F.size(_study_faults()) == 0, _picked()
    if skip_unreadable:
        nct_id = F.when(sound, nct_id)
    else:
        failed = F.raise_error(F.concat(F.lit("A study cannot be read: "), "page_file", F.lit(", place "), F.col("pos").cast("string")))
        nct_id = F.when(sound, nct_id).otherwise(failed.cast("string"))
    return _studies(pages).select(*schema.ARRIVAL, nct_id.alias("nct_id"), *others).where("nct_id <> ''")


def with_derived(studies: DataFrame, rules: Rules = vocab.AREA_RULES) -> DataFrame:
    """Adds the area, classified by the rules, and the start year."""
    return studies.withColumns(
        {"therapeutic_area": area_of(joined_lower("conditions"), rules), "start_year": year_of("start_date")}
    )


def flatten_studies(pages: DataFrame) -> DataFrame:
    """One complete tidy row per study on the pages, with its arrival order."""
    return with_derived(pick_studies(pages))
