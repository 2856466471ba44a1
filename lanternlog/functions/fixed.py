"""Word lists, weights and patterns that results depend on."""

# Levels that count as errors.
ERROR_LEVELS = ["ERROR", "FATAL", "CRITICAL"]

# The six canonical levels.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]

# Level names that normalise to FATAL.
FATAL_ALIASES = ["CRITICAL", "ALERT", "EMERGENCY"]

# Severity signal by level.
SEVERITY_WEIGHTS = {
    "FATAL": 1.0,
    "CRITICAL": 0.95,
    "ERROR": 0.70,
    "WARN": 0.30,
    "WARNING": 0.30,
}

# Named message patterns with their signal weight.
PATTERNS = [
    ("oom", r"out.?of.?memory|oom|heap.?space|memory.?limit|gc.?overhead|java\.lang\.OutOfMemoryError", 0.95),
    ("crash", r"segfault|sigsegv|sigabrt|sigkill|panic:|fatal error|core.?dump|stack.?overflow|process.?died|killed", 0.95),
    ("resource", r"resource.?exhausted|no.?space.?left|disk.?full|too.?many.?open.?files|file.?descriptor|ulimit", 0.80),
    ("dependency", r"service.?unavailable|bad.?gateway|upstream.?connect|upstream.?unavailable|circuit.?break|502|503|504", 0.75),
    ("db", r"deadlock|lock.?timeout|duplicate.?key|constraint.?violation|sql.?exception|transaction.?abort|connection.?pool.?exhausted|too.?many.?connections", 0.75),
    ("timeout", r"timeout|timed?.?out|deadline.?exceeded|context.?deadline|read.?timeout|write.?timeout|connect.?timeout|operation.?timed", 0.70),
    ("connection", r"econnrefused|econnreset|broken.?pipe|connection.?refused|connection.?reset|socket.?closed|eof.?error|network.?unreachable", 0.65),
    ("auth", r"unauthorized|forbidden|access.?denied|invalid.?token|signature.?verification|jwt.?expired|permission.?denied", 0.40),
]

# Patterns reported at once, without waiting for window statistics.
IMMEDIATE_PATTERNS = ["oom", "crash", "resource"]

# Share of each signal category in the composite score.
CATEGORY_WEIGHTS = {
    "pattern": 0.30,
    "statistical": 0.25,
    "context": 0.15,
    "http": 0.10,
    "severity": 0.10,
    "structural": 0.10,
}

# Error categories by keyword; the first category with a hit wins.
ERROR_CATEGORIES = [
    ("timeout", ["timeout", "timed out", "deadline exceeded", "context deadline"]),
    ("connection_refused", ["connection refused", "connect error", "econnrefused", "connection reset"]),
    ("authentication", ["unauthorized", "forbidden", "auth failed", "invalid token", "401", "403"]),
    ("rate_limit", ["rate limit", "too many requests", "429", "throttl"]),
    ("out_of_memory", ["out of memory", "oom", "heap space", "memory limit"]),
    ("null_pointer", ["null pointer", "nil pointer", "nonetype", "undefined is not", "cannot read prop"]),
    ("validation", ["validation", "invalid", "malformed", "bad request", "400"]),
    ("not_found", ["not found", "404", "no such", "does not exist"]),
    ("database", ["deadlock", "lock timeout", "duplicate key", "constraint violation", "sql"]),
    ("resource_exhausted", ["disk full", "no space", "resource exhausted", "too many open"]),
]

# Message parts replaced by a placeholder, in this order.
UUID_PART = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
IP_PART = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?"
TIME_PART = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?"
HEX_PART = r"\b[0-9a-f]{16,}\b"
NUMBER_PART = r"(?<=[/=:# ])\d{4,}"
QUOTED_PART = r'"[^"]{20,}"'

# HTTP status signals.
HTTP_SIGNALS = [
    (503, "http:service_unavailable", 0.90),
    (502, "http:bad_gateway", 0.80),
    (504, "http:gateway_timeout", 0.85),
]
HTTP_SERVER_ERROR = ("http:server_error", 0.70)
HTTP_RATE_LIMIT = (429, "http:rate_limit", 0.50)
HTTP_AUTH = ([401, 403], "http:auth_error", 0.40)

# Stack frame markers and the weight from a frame count upwards.
FRAME_MARKERS = ["\n\tat ", "\n  File ", "\ngoroutine ", "\n    at "]
FRAME_WEIGHTS = [(16, 0.30), (6, 0.15), (2, 0.05)]

# Structural weight of a known error category.
CATEGORY_SIGNAL = 0.30

# Composite severity labels from a score upwards.
COMPOSITE_SEVERITY = [(0.85, "critical"), (0.65, "high"), (0.45, "medium")]

# Characters of an error that are looked up among stored incidents.
DUPLICATE_TEXT = 100

# Fields of a flat log that have a place of their own in a batch.
FLAT_FIELDS = ["message", "level", "service", "timestamp", "trace_id", "span_id", "host"]

# Attributes that may hold a request's time in milliseconds, the first one counts.
LATENCY_ATTRIBUTES = ["latency_ms", "response_time_ms", "duration_ms"]

# A standard deviation below this counts as none.
FLAT_STD = 1e-9

# z-score labels and confidences from a z-score upwards.
ZSCORE_LABELS = [(4.0, "critical", 0.98), (3.0, "high", 0.90), (2.5, "medium", 0.80)]

# Blast radius weight from a number of erroring services upwards.
BLAST_WEIGHTS = [(5, 0.90), (3, 0.60), (2, 0.30)]

# Velocity weights: by error count when the mean is below 1, else by ratio.
VELOCITY_COUNT_WEIGHTS = [(10, 0.80), (5, 0.60), (2, 0.40)]
VELOCITY_RATIO_WEIGHTS = [(5.0, 0.80), (3.0, 0.50), (2.0, 0.30)]

# Recurrence weight of the first and of the second to fifth occurrence.
RECURRENCE_FIRST = 0.30
RECURRENCE_NEXT = 0.10
RECURRENCE_LAST = 5

# Rule scorer: level scores, alert patterns and their scores.
RULE_LEVELS = [("FATAL", 0.5, "fatal_error"), ("ERROR", 0.4, "error"), ("WARN", 0.15, "warning")]
RULE_CRITICAL = (
    r"(?i)(OutOfMemory|OOM|heap space|connection refused|ECONNREFUSED|"
    r"timeout|timed out|deadline exceeded|circuit.?breaker|"
    r"authentication fail|unauthorized|403 forbidden|"
    r"rate.?limit|throttl|too many requests|429|"
    r"segfault|SIGSEGV|panic|fatal|crash|core dump|"
    r"disk full|no space left|quota exceeded|"
    r"certificate.?(expir|invalid|mismatch)|SSL|TLS)"
)
RULE_CRITICAL_SCORE = 0.35
RULE_ERROR = (
    r"(?i)(exception|error|fail|denied|reject|abort|"
    r"refused|broken pipe|reset by peer|"
    r"null.?pointer|index.?out.?of.?bound|"
    r"deadlock|lock.?timeout|conflict)"
)
RULE_ERROR_SCORE = 0.15
RULE_TYPES = [
    ("memory_exhaustion", ["outofmemory", "oom", "heap"]),
    ("timeout", ["timeout", "timed out", "deadline"]),
    ("connection_failure", ["connection refused", "econnrefused"]),
    ("auth_failure", ["auth", "unauthorized", "forbidden"]),
    ("rate_limit", ["rate", "throttl", "429"]),
    ("tls_error", ["certificate", "ssl", "tls"]),
    ("resource_exhaustion", ["disk", "space", "quota"]),
    ("crash", ["crash", "panic", "segfault"]),
]
RULE_FEATURE_SCORE = 0.1
RULE_ERROR_RATE_LIMIT = 0.1
RULE_HISTORY_LIMIT = 5
RULE_SEVERITY = [(0.85, "critical"), (0.7, "high")]

# Request-failure severity and score by the level of the triggering row.
FAILURE_LEVELS = [("FATAL", "critical", 0.98), ("CRITICAL", "critical", 0.95)]
FAILURE_DEFAULT = ("high", 0.90)

# Incident states, urgencies, severities and the priority matrix.
STATES = ["identified", "acknowledged", "investigating", "mitigated", "resolved"]
UNRESOLVED_STATES = ["identified", "acknowledged", "investigating"]
RESOLVED_STATES = ["mitigated", "resolved"]
SEVERITIES = ["critical", "high", "medium", "low"]
URGENCIES = ["high", "medium", "low"]
PRIORITY_MATRIX = {
    ("critical", "high"): "P1", ("critical", "medium"): "P1", ("critical", "low"): "P2",
    ("high", "high"): "P2", ("high", "medium"): "P2", ("high", "low"): "P3",
    ("medium", "high"): "P3", ("medium", "medium"): "P3", ("medium", "low"): "P4",
    ("low", "high"): "P4", ("low", "medium"): "P4", ("low", "low"): "P5",
}
DEFAULT_PRIORITY = "P3"
PLATFORMS = ["pagerduty", "jira", "servicenow", "opsgenie", "slack", "email"]
ACTIONS = {
    "acknowledge": "acknowledged",
    "investigate": "investigating",
    "mitigate": "mitigated",
    "resolve": "resolved",
}
PATCH_FIELDS = [
    "assigned_to", "commander", "urgency", "impact",
    "root_cause", "communication_channel", "runbook_url",
]

# DNS namespace of name-based UUIDs.
UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

# Upload checks.
REQUIRED_FIELDS = ["message"]
RECOMMENDED_FIELDS = ["level", "service", "timestamp"]
UPLOAD_LEVELS = ["DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL"]

# Fields of a flat log that are not turned into attributes on re-encoding.
RESERVED_FIELDS = ["message", "level", "service", "timestamp", "trace_id", "span_id", "host"]

# Tenant field names a caller may not set.
TENANT_FIELDS = ["tenant_id", "tenantId"]
