"""Published aggregate tables, and record tables rebuilt from them.

Each table is expanded to one row per record; running the metric on the rows must give the table back.
"""

OVERALL = (262125, 74881, 187244, 28.57)

# label, total, with flag, without flag, percentage
PHASE = [
    ("Phase 2/Phase 3", 2915, 1593, 1322, 54.65),
    ("Phase 1/Phase 2", 6477, 3229, 3248, 49.85),
    ("Phase 2", 24836, 11672, 13164, 47.0),
    ("Phase 3", 16260, 7235, 9025, 44.5),
    ("Early Phase 1", 2713, 1079, 1634, 39.77),
    ("Phase 4", 15202, 5198, 10004, 34.19),
    ("Phase 1", 25411, 6649, 18762, 26.17),
    (None, 168311, 38226, 130085, 22.71),
]
SPONSOR = [
    ("Academic", 1629, 677, 952, 41.56),
    ("Other", 190693, 58071, 132622, 30.45),
    ("NIH", 2489, 608, 1881, 24.43),
    ("Industry", 67314, 15525, 51789, 23.06),
]
STUDY_TYPE = [
    ("Interventional", 205213, 65734, 139479, 32.03),
    ("Observational", 56912, 9147, 47765, 16.07),
]
AREA = [
    ("Genetic/Rare", 526, 218, 308, 41.44),
    ("Oncology", 33747, 13030, 20717, 38.61),
    ("Hematology", 3074, 1111, 1963, 36.14),
    ("Infectious Disease", 16290, 5584, 10706, 34.28),
    ("Cardiovascular", 17618, 5515, 12103, 31.3),
    ("Gastroenterology", 3236, 1002, 2234, 30.96),
    ("Psychiatry", 8757, 2495, 6262, 28.49),
    ("Neurology", 9608, 2679, 6929, 27.88),
    ("Respiratory", 7089, 1950, 5139, 27.51),
    ("Rheumatology/Immunology", 6021, 1570, 4451, 26.08),
    ("Endocrine/Metabolic", 15640, 4029, 11611, 25.76),
    ("Obstetrics/Gynecology", 3231, 827, 2404, 25.6),
    ("Other/Unclassified", 133148, 33983, 99165, 25.52),
    ("Ophthalmology", 1738, 426, 1312, 24.51),
    ("Dermatology", 2402, 462, 1940, 19.23),
]
# subgroup, total, without flag, percentage
GAPS = [
    ("All Phase III/IV • Interventional • Industry", 13883, 9133, 65.79),
    ("Cardiovascular • Phase III/IV • Interventional • Industry", 828, 540, 65.22),
    ("Infectious Disease • Phase III/IV • Interventional • Industry", 1465, 908, 61.98),
    ("Oncology • Phase III/IV • Interventional • Industry", 1283, 552, 43.02),
]
# label, total, terminated, completed, percentage
OUTCOMES = [("With DMC", 74881, 13869, 61012, 18.52), ("No DMC", 187244, 23575, 163669, 12.59)]
# label, records, safety hits, futility hits, percentages
WHY_STOPPED = [("With DMC", 74881, 914, 456, 1.22, 0.61), ("No DMC", 187244, 1093, 302, 0.58, 0.16)]


def expand(spark, counted, columns):
    """Rows ``(count, value, value, ...)`` repeated ``count`` times, with an ID per record."""
    df = spark.createDataFrame(counted, f"_n bigint, {columns}").where("_n > 0")
    return df.selectExpr("* except (_n)", "explode(sequence(1, _n)) AS _i").selectExpr(
        "* except (_i)", "concat('R', monotonically_increasing_id()) AS nct_id"
    )


def with_and_without(table):
    return [(w, label, True) for label, _, w, _, _ in table] + [(n, label, False) for label, _, _, n, _ in table]
