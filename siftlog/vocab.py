"""Closed vocabularies, limits and state machines shared by every operator.

Everything in this module is a fixed value: the names, limits and edges below
have to match the data already stored by other producers of these tables.
"""

from __future__ import annotations

# --- fixed values: interpretation, receipt and delivery states -------------
STATUSES = ["PARSED", "PARTIALLY_PARSED", "UNPARSED", "INVALID", "ERROR"]
RECEIPT_STATES = ["ACCEPTED", "PROCESSING", "REVISION_COMMITTED", "DELIVERY_PENDING", "DELIVERED", "DEAD_LETTER"]
TERMINAL_STATES = ["DELIVERED", "DEAD_LETTER"]
ACTIVE_STATES = [s for s in RECEIPT_STATES if s not in TERMINAL_STATES]
DELIVERY_STATES = ["PENDING", "PROCESSING", "RETRY", "DELIVERED", "DEAD_LETTER"]
DELIVERY_OPEN = ["PENDING", "PROCESSING", "RETRY"]

RECEIPT_EDGES = [
    ("ACCEPTED", "PROCESSING"),
    ("PROCESSING", "ACCEPTED"),
    ("PROCESSING", "REVISION_COMMITTED"),
    ("PROCESSING", "DEAD_LETTER"),
    ("REVISION_COMMITTED", "DELIVERY_PENDING"),
    ("REVISION_COMMITTED", "DELIVERED"),
    ("DELIVERY_PENDING", "DELIVERED"),
    ("DELIVERY_PENDING", "DEAD_LETTER"),
    ("DELIVERED", "DELIVERY_PENDING"),
    ("DEAD_LETTER", "ACCEPTED"),
    ("DEAD_LETTER", "DELIVERY_PENDING"),
]

# --- fixed values: transports and framings ---------------------------------
TRANSPORTS = ["http", "syslog_udp", "syslog_tcp"]
FRAMINGS = ["datagram", "octet_counting", "non_transparent", "http_octets"]
LEGAL_FRAMING = [
    ("http", "http_octets"),
    ("syslog_udp", "datagram"),
    ("syslog_tcp", "octet_counting"),
    ("syslog_tcp", "non_transparent"),
]
DEFAULT_FRAMING = {"http": "http_octets", "syslog_udp": "datagram"}

# --- fixed values: parser limits -------------------------------------------
MAX_INPUT_BYTES = 1 << 20
MAX_FIELDS = 4096
MAX_DEPTH = 64
MAX_TOKENS = 16384

# --- fixed values: detection ------------------------------------------------
SAMPLE_BYTES = 64 << 10
SAMPLE_HARD_MAX = 1 << 20
MINIMUM_SCORE = 800
AMBIGUITY_MARGIN = 100
MAX_SCORE = 1000
PIN_BONUS = 100
# (parser id, format, specificity)
BUILTIN_PARSERS = [
    ("generic-cef", "cef", 100),
    ("generic-leef", "leef", 100),
    ("generic-syslog", "syslog", 90),
    ("generic-json", "json", 80),
    ("generic-xml", "xml", 80),
    ("generic-router-text", "delimited_text", 70),
    ("generic-csv", "csv", 60),
    ("generic-kv", "key_value", 60),
    ("generic-text", "text", 0),
]
PARSER_VERSION = "1.0.0"

# --- fixed values: mapping ---------------------------------------------------
MAX_RULES = 512
MAX_TAXONOMIES = 128
MAX_ALIASES = 4096
CONVERSIONS = ["string", "ip", "integer", "port", "uint16", "timestamp", "lowercase"]
ACTIONS = ["allow", "deny", "observe", "quarantine", "reset", "redirect", "unknown"]
DEVICE_TYPES = ["firewall", "router", "switch", "ids", "ips", "proxy", "vpn", "unknown"]
SEVERITIES = ["unknown", "informational", "low", "medium", "high", "critical"]
# canonical event leaf -> kind of value it accepts
TARGETS = {
    "event.class_uid": "non_negative",
    "event.class_name": "string128",
    "event.activity_id": "non_negative",
    "event.activity": "string128",
    "event.time": "timestamp",
    "event.action": "action",
    "event.status": "string64",
    "event.severity_id": "severity_id",
    "event.severity": "severity",
    "event.src_endpoint.ip": "ip",
    "event.src_endpoint.port": "port",
    "event.src_endpoint.hostname": "string255",
    "event.src_endpoint.mac": "mac",
    "event.dst_endpoint.ip": "ip",
    "event.dst_endpoint.port": "port",
    "event.dst_endpoint.hostname": "string255",
    "event.dst_endpoint.mac": "mac",
    "event.connection_info.protocol_name": "protocol",
    "event.connection_info.protocol_num": "protocol_num",
    "event.device.type": "device",
    "event.device.hostname": "string255",
    "event.device.vendor_name": "string128",
    "event.device.product_name": "string128",
    "event.finding.signature": "string512",
    "event.finding.signature_id": "non_negative",
}
EXTENSION_PREFIX = "event.extensions."
IDENTIFIER = r"^[a-z][a-z0-9]*(?:[-_.][a-z0-9]+)*$"
VERSION = r"^[0-9]+\.[0-9]+\.[0-9]+(?:[-+][0-9A-Za-z.-]+)?$"
RECORD_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DIGEST = r"^[0-9a-f]{64}$"
ISSUE_CODE = r"^[A-Z][A-Z0-9_]{1,63}$"
PROTOCOL = r"^[a-z][a-z0-9._-]{0,31}$"
STAGES = ["detection", "parsing", "mapping", "validation", "enrichment", "delivery"]
MAX_ISSUES = 1024
MAX_MESSAGE_BYTES = 1024

# --- fixed values: dashboards -------------------------------------------------
ACTIVITY_BUCKET_SECONDS = 300
ACTIVITY_BUCKETS = 12
RECENT_LIMIT = 20
STALE_AFTER_SECONDS = 120
CLOCK_SKEW_SECONDS = 60
PAGE_DEFAULT, PAGE_MAX = 50, 200

# --- fixed values: connectors --------------------------------------------------
BATCH_MAX_RECORDS = 10_000
BATCH_MAX_BYTES = 16 << 20

# --- fixed values: dataset export ----------------------------------------------
SPLIT_ALGORITHM = "sha256_revision_id_v1"
LINEAGE_FIELDS = [
    "receipt_id", "revision_id", "raw_sha256", "pipeline_version", "parser_id", "parser_version",
    "mapping_version", "schema_version", "quality_score", "issue_codes", "split",
]
FEATURE_TYPES = ["boolean", "integer", "number", "string", "timestamp", "ip"]
FEATURE_META_PATHS = [
    "quality.score", "quality.required_present", "quality.required_total",
    "quality.provenance_present", "quality.provenance_total",
    "processing.status", "processing.confidence",
]
MAX_FEATURES = 256

# --- fixed values: audit --------------------------------------------------------
SENSITIVE_FIELDS = [
    "payload", "raw", "raw_payload", "raw_bytes", "body", "event.body", "event.original", "http.body",
]
SENSITIVE_SUFFIXES = [".payload", "_payload"]

# Contract names written into new tables. They name this engine's own contracts.
SCHEMA_VERSION = "envelope/1.0.0"
PIPELINE_VERSION = "1.0.0"
FEATURE_SET_CONTRACT = "feature-set/1.0.0"
DATASET_CONTRACT = "dataset-manifest/1.0.0"
