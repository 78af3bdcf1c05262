"""Fixed schemas. Nothing in the package infers a schema from data."""

from coverlens.functions import vocab

# A landed page. Each study is a VARIANT, so that one of an unexpected form costs itself and not its page, and fields that
# arrive either as a scalar or as a list, and the flag (boolean or text), may have either form.
PAGE = """
    pageNo bigint,
    studies array<variant>,
    nextPageToken string,
    _corrupt_record string
"""

# The fields of a study that are kept, where they stand in it.
STUDY = """struct<protocolSection: struct<
    identificationModule: struct<nctId: string>,
    oversightModule: struct<oversightHasDmc: string>,
    designModule: struct<studyType: string, phases: variant>,
    sponsorCollaboratorsModule: struct<leadSponsor: struct<class: string>>,
    statusModule: struct<overallStatus: string, whyStopped: string,
        startDateStruct: struct<date: string>, primaryCompletionDateStruct: struct<date: string>>,
    conditionsModule: struct<conditions: variant>>>"""

# The objects of a study that hold the fields kept, and the paths of the plain texts among these.
OBJECTS = [
    "protocolSection",
    "protocolSection.identificationModule",
    "protocolSection.oversightModule",
    "protocolSection.designModule",
    "protocolSection.sponsorCollaboratorsModule",
    "protocolSection.sponsorCollaboratorsModule.leadSponsor",
    "protocolSection.statusModule",
    "protocolSection.statusModule.startDateStruct",
    "protocolSection.statusModule.primaryCompletionDateStruct",
    "protocolSection.conditionsModule",
]
STUDY_ID = "protocolSection.identificationModule.nctId"

# One row per study: the columns that come from the page itself, and all of them.
PICKED = """
    nct_id string, has_dmc boolean, phase string, study_type string, sponsor_class string,
    overall_status string, why_stopped string, start_date string, primary_completion_date string,
    conditions array<string>
"""

TIDY = PICKED + ", therapeutic_area string, start_year int"

TIDY_COLUMNS = [
    "nct_id",
    "has_dmc",
    "phase",
    "study_type",
    "sponsor_class",
    "overall_status",
    "why_stopped",
    "start_date",
    "primary_completion_date",
    "conditions",
    "therapeutic_area",
    "start_year",
]

# Columns that a record table must have; the others have defaults.
REQUIRED = ["nct_id", "has_dmc", "sponsor_class", "study_type", "phase", "overall_status"]

# What an absent optional column holds; null if not listed.
DEFAULTS = {"therapeutic_area": vocab.DEFAULT_AREA}

# Order in which a study arrived: page, then file (equal page numbers), then place on the page.
ARRIVAL = ["page_no", "page_file", "pos"]

# What is kept of a page or study that cannot be read: where it stood, the paths at fault, its text.
REJECTED = [*ARRIVAL, "faults", "record"]
