"""Column layout of the event and finding tables."""

from pyspark.sql import types as T

# Position of a line in its source: file, split start, row within the split.
POSITION = ["src_file", "block_start", "seq"]

EVENT_COLUMNS = ["ts", "ip", "method", "referrer", "status", "bytes", "url",
                 "domain", "ua", "raw", *POSITION]

LINE_SCHEMA = T.StructType([
    T.StructField("src_file", T.StringType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("line", T.StringType()),
])

FINDING_COLUMNS = ["case_id", "rule", "severity", "description", "source_ip", "count",
                   "sample", "first_seen", "last_seen", "created_at"]

REPUTATION_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("abuse_score", T.IntegerType()),
    T.StructField("total_reports", T.IntegerType()),
    T.StructField("country", T.StringType()),
    T.StructField("isp", T.StringType()),
    T.StructField("usage_type", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("is_tor", T.BooleanType()),
    T.StructField("last_reported_at", T.StringType()),
    T.StructField("checked_at", T.TimestampType()),
    T.StructField("raw", T.StringType()),
])

# Length limits of the stored text columns (fixed values).
MAX_URL = 4096
MAX_DOMAIN = 255
MAX_UA = 1024
MAX_RAW = 8192
MAX_SAMPLE = 2048
MAX_SESSION_UA = 200
MAX_SAMPLE_URL = 300
