"""Fixed values of the log formats: they must be exactly these for right results.

The line patterns are written in the dialect users write their own patterns in
(``\\s`` covers all Unicode white space, ``.`` stops at a line break) and are turned into
Java patterns by :func:`logweir.functions.regexes.to_java`.
"""

# --- fixed values: line patterns -------------------------------------------------------

# ip, ident, user, date, request, status, size, referer, user agent
APACHE_LINE = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"?\s+(\d{3})\s+(\d+|-)\s*(?:"([^"]*)")?\s*(?:"([^"]*)")?'
# ip, user, date, request, status, size, referer, user agent, response time
NGINX_ACCESS_LINE = r'^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"?\s+(\d{3})\s+(\d+|-)\s*"([^"]*)"\s*"([^"]*)"(?:\s+(\S+))?'
# date, level, process id, thread id, connection id, message
NGINX_ERROR_LINE = r'^(\d{4}\/\d{2}\/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#(\d+):\s*(?:\*(\d+)\s+)?(.+)'
# date, host, process, process id, message
SYSLOG_LINE = r'^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*)'
# date, level, message
TIMESTAMPED_LINE = r'^(\d{4}[-/]\d{2}[-/]\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+\[?(\w+)\]?\s*(.*)'
# date, level, message
BRACKETED_LINE = r'^(?:\[([^\]]+)\])?\s*\[(\w+)\]\s*(.*)'
# the part of an access date that is read; the zone offset may follow it
ACCESS_DATE = r'(\d{2})\/(\w{3})\/(\d{4}):(\d{2}):(\d{2}):(\d{2})'

# --- fixed values: names of months in access dates -------------------------------------

MONTHS = {
    "Jan": "01", "Feb": "02", "Mar": "03", "Apr": "04", "May": "05", "Jun": "06",
    "Jul": "07", "Aug": "08", "Sep": "09", "Oct": "10", "Nov": "11", "Dec": "12",
}

# --- fixed values: levels --------------------------------------------------------------

NUMERIC_LEVELS = {10: "trace", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}
LEVEL_ALIASES = {
    "err": "error",
    "warning": "warn",
    "critical": "fatal",
    "crit": "fatal",
    "emergency": "fatal",
    "emerg": "fatal",
    "notice": "info",
    "verbose": "debug",
    "silly": "trace",
}
LEVEL_KEYWORDS = {
    "error": ["error", "exception", "fatal", "critical"],
    "warn": ["warn"],
    "debug": ["debug", "trace"],
}

# --- fixed values: JSON field names, in order of preference ----------------------------

JSON_TIMESTAMP = ["timestamp", "time", "datetime", "date", "@timestamp", "ts", "created_at", "createdAt"]
JSON_LEVEL = ["level", "severity", "logLevel", "log_level"]
JSON_MESSAGE = ["message", "msg", "text", "log", "body", "description"]
JSON_NOT_IN_MESSAGE = ["timestamp", "time", "level", "severity"]
JSON_IP = ["ip", "remoteAddress", "remote_addr", "clientIp"]
JSON_METHOD = ["method", "httpMethod", "req.method"]
JSON_PATH = ["path", "url", "uri", "req.url"]
JSON_STATUS = ["status", "statusCode", "res.statusCode", "responseCode"]
JSON_SIZE = ["size", "contentLength", "content_length", "res.contentLength"]
JSON_USER_AGENT = ["userAgent", "user_agent", "req.headers.user-agent"]
JSON_RESPONSE_TIME = ["responseTime", "response_time", "duration", "elapsed"]

# A number above this is an epoch time in milliseconds, else in seconds; and the largest
# distance from the epoch, in milliseconds, that is still a time.
EPOCH_MILLIS_ABOVE = 1e12
EPOCH_MILLIS_LIMIT = 8.64e15

# --- fixed values: white space and line breaks -----------------------------------------

# code points, first and last of each run
WHITE_SPACE_RUNS = [
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
]
LINE_BREAK_RUNS = [(0x0A, 0x0A), (0x0D, 0x0D), (0x2028, 0x2029)]

# --- fixed values: report sizes --------------------------------------------------------

DETECTION_LINES = 5
PREVIEW_LINES = 50
TOP_ENTRIES = 10
FOLLOW_LINES = 10
PATH_WIDTH = 40
MESSAGE_WIDTH = 80
STATS_PATH_WIDTH = 35
