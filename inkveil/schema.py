"""Labels, policies and dictionaries: the engine's small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
LABELS = (
    "Aadhaar number", "VID", "PAN", "Date of birth", "Address", "Photograph", "QR code",
    "Name", "Phone number", "Roll number", "Account number", "Signature", "Other",
)
BLOCK_ONLY = (
    "Aadhaar number", "VID", "QR code", "PAN", "Date of birth", "Phone number", "Roll number", "Account number",
)
PRESETS = (
    ("Bank KYC", ("Name", "Photograph", "Date of birth", "Address", "PAN")),
    ("Rental agreement", ("Name", "Photograph", "Address")),
    ("College admission", ("Name", "Photograph", "Date of birth", "Roll number")),
    ("SIM verification", ("Name", "Photograph", "Address")),
    ("Hotel check-in", ("Name", "Photograph")),
)
NUMBER_LABELS = {
    "Roll number": (
        "rollno", "roll", "rollnumber", "regno", "regdno", "regd", "registrationno", "registration", "enrolment",
        "enrollment", "enrolmentno", "enrollmentno", "seat", "seatno", "index", "indexno", "prn", "hallticket",
        "admission", "admissionno", "grno", "studentid", "certificateno", "serialno",
    ),
    "Account number": ("ac", "acno", "accountno", "account"),
    "Phone number": ("mobile", "phone", "mob"),
}
NAME_LABELS = (
    "name", "candidate", "candidates", "student", "students", "father", "fathers", "mother", "mothers", "guardian", "guardians",
)
NOT_A_PERSON = (
    "school", "examination", "exam", "board", "college", "institute", "institution", "university", "course", "subject", "centre", "center",
)
FILLER = ("of", "the", "no", "number", "name", "names", "mr", "mrs", "ms", "shri", "smt", "sri", "kumari")
DATE_LABELS = ("dob", "dateofbirth", "birth", "जन्मतिथि", "जन्म", "yearofbirth", "year")
ADDRESS_LABELS = ("address", "पता", "s/o", "d/o", "w/o", "c/o")
HOLDER_TYPES = ("P", "C", "H", "F", "A", "T", "B", "L", "J", "G")
CODE_FORMATS = ("qr_code", "aztec", "data_matrix", "pdf417")
ACCEPTED_IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")
ACCEPTED_TYPES = (*ACCEPTED_IMAGE_TYPES, "application/pdf")
MAX_FILE_BYTES = 25 * 1024 * 1024
CDN_HOSTS = (
    "cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "fonts.googleapis.com", "fonts.gstatic.com", "storage.googleapis.com",
)

#: Emission order of the detectors: the smaller wins an overlap.
PRIORITY = {"ids": 1, "pan": 2, "dates": 3, "numbers": 4, "names": 5, "address": 6, "extra": 7}


def presets(spark: SparkSession) -> DataFrame:
    """name, reveal: which labels each recipient may read; all others stay hidden."""
    return spark.createDataFrame([(n, list(r)) for n, r in PRESETS], "name string, reveal array<string>")


def labels(spark: SparkSession) -> DataFrame:
    """label, rank, block_only."""
    return spark.createDataFrame([(n, i, n in BLOCK_ONLY) for i, n in enumerate(LABELS)], "label string, rank int, block_only boolean")
