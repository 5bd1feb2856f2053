"""Fields each kind of log is expected to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Server types, and per field its key, label, category and the
# ECS name it maps to. Descriptions are ours.
SERVER_TYPES = {
    "apache": "Apache httpd",
    "nginx": "Nginx",
    "iis": "Microsoft IIS (W3C)",
    "aws_alb": "AWS Application/Elastic Load Balancer",
    "haproxy": "HAProxy",
    "squid": "Squid proxy",
    "generic": "Generic / other (CLF-like)",
}
_COMBINED = (
    ("remote_ip", "Client IP (%a/%h)", "core", "source.ip", "Address the request came from"),
    ("ident", "Identd (%l)", "optional", "—", "Identity by RFC 1413, rarely filled"),
    ("remote_user", "Auth user (%u)", "optional", "user.name", "User name of HTTP authentication"),
    ("timestamp", "Timestamp (%t)", "core", "@timestamp", "Time of the request, with its offset"),
    ("method", "HTTP method", "core", "http.request.method", "First word of the request line"),
    ("uri", "URL / URI", "core", "url.original", "Path and query asked for"),
    ("protocol", "Protocol/version", "recommended", "http.version", "Last word of the request line"),
    ("status", "Status code (%>s)", "core", "http.response.status_code", "Status of the response"),
    ("bytes", "Response bytes (%b/%O)", "core", "http.response.body.bytes", "Size of the response"),
    ("referer", "Referer", "recommended", "http.request.referrer", "Page that led here"),
    ("user_agent", "User-Agent", "recommended", "user_agent.original", "Client software"),
    ("vhost", "Virtual host (%v)", "optional", "url.domain", "Site name on shared servers"),
    ("x_forwarded_for", "X-Forwarded-For", "recommended", "—", "Client address behind a proxy"),
    ("response_time", "Response time (%D/%T)", "optional", "—", "Time taken to answer"),
)
_NGINX = (
    ("request_time", "$request_time", "optional", "—", "Whole time of the request"),
    ("upstream_addr", "$upstream_addr", "optional", "—", "Server the request was passed to"),
    ("upstream_time", "$upstream_response_time", "optional", "—", "Time that server took"),
)
_IIS = (
    ("date", "date", "core", "@timestamp", "Date in UTC"),
    ("time", "time", "core", "@timestamp", "Time of day in UTC"),
    ("c-ip", "c-ip", "core", "source.ip", "Client address"),
    ("cs-method", "cs-method", "core", "http.request.method", "Request method"),
    ("cs-uri-stem", "cs-uri-stem", "core", "url.original", "Path without the query"),
    ("cs-uri-query", "cs-uri-query", "recommended", "url.query", "Query; holds most injections"),
    ("sc-status", "sc-status", "core", "http.response.status_code", "Status of the response"),
    ("sc-substatus", "sc-substatus", "optional", "—", "Detail of the status"),
    ("sc-win32-status", "sc-win32-status", "optional", "—", "Windows status"),
    ("sc-bytes", "sc-bytes", "recommended", "http.response.body.bytes", "Bytes sent"),
    ("cs-bytes", "cs-bytes", "optional", "—", "Bytes received"),
    ("time-taken", "time-taken", "recommended", "—", "Time taken in milliseconds"),
    ("cs(User-Agent)", "cs(User-Agent)", "recommended", "user_agent.original", "Client software"),
    ("cs(Referer)", "cs(Referer)", "recommended", "http.request.referrer", "Page that led here"),
    ("cs-username", "cs-username", "optional", "user.name", "Authenticated user"),
    ("cs-host", "cs-host", "optional", "url.domain", "Host header"),
    ("s-ip", "s-ip", "optional", "—", "Server address"),
    ("s-port", "s-port", "optional", "—", "Server port"),
)
_ALB = (
    ("type", "type", "optional", "—", "Kind of listener"),
    ("timestamp", "time", "core", "@timestamp", "Time in UTC, ISO 8601"),
    ("elb", "elb", "optional", "—", "Name of the balancer"),
    ("client_ip", "client:port", "core", "source.ip", "Client address, port removed"),
    ("target_ip", "target:port", "recommended", "—", "Server the request went to"),
    ("request_time", "request_processing_time", "optional", "—", "Time inside the balancer"),
    ("target_time", "target_processing_time", "recommended", "—", "Time the server took"),
    ("elb_status", "elb_status_code", "core", "http.response.status_code", "Status sent to the client"),
    ("target_status", "target_status_code", "recommended", "—", "Status of the server"),
    ("received_bytes", "received_bytes", "optional", "—", "Bytes from the client"),
    ("sent_bytes", "sent_bytes", "recommended", "http.response.body.bytes", "Bytes to the client"),
    ("request", "request", "core", "url.original", "Quoted request line"),
    ("user_agent", "user_agent", "recommended", "user_agent.original", "Client software"),
    ("ssl_cipher", "ssl_cipher", "optional", "—", "Cipher agreed on"),
    ("ssl_protocol", "ssl_protocol", "optional", "—", "TLS version agreed on"),
)
_HAPROXY = (
    ("client_ip", "client_ip", "core", "source.ip", "Client address"),
    ("accept_date", "accept_date", "core", "@timestamp", "Time the connection was accepted"),
    ("frontend", "frontend_name", "optional", "—", "Front end that took it"),
    ("backend", "backend/server", "recommended", "—", "Back end and server that answered"),
    ("timers", "Tq/Tw/Tc/Tr/Tt", "recommended", "—", "Timers in milliseconds"),
    ("status", "status_code", "core", "http.response.status_code", "Status of the response"),
    ("bytes", "bytes_read", "core", "http.response.body.bytes", "Bytes to the client"),
    ("request", "http_request", "core", "url.original", "Quoted request line"),
)
_SQUID = (
    ("epoch", "time", "core", "@timestamp", "Seconds since 1970"),
    ("elapsed", "elapsed", "recommended", "—", "Time taken in milliseconds"),
    ("client_ip", "remotehost", "core", "source.ip", "Client address"),
    ("status", "code/status", "core", "http.response.status_code", "Cache result and status"),
    ("bytes", "bytes", "core", "http.response.body.bytes", "Size of the reply"),
    ("method", "method", "core", "http.request.method", "Request method"),
    ("uri", "URL", "core", "url.original", "URL asked for"),
    ("user", "rfc931", "recommended", "user.name", "Authenticated user"),
    ("hierarchy", "peerstatus/peerhost", "optional", "—", "Where the reply came from"),
    ("content_type", "type", "optional", "—", "Media type of the reply"),
)
CATALOGUES = {"apache": _COMBINED, "nginx": _COMBINED + _NGINX, "iis": _IIS, "aws_alb": _ALB,
              "haproxy": _HAPROXY, "squid": _SQUID, "generic": _COMBINED}

# Field with the client address, field with the time, its kind.
CLIENT_KEY = {"apache": "remote_ip", "nginx": "remote_ip", "generic": "remote_ip",
              "aws_alb": "client_ip", "haproxy": "client_ip", "squid": "client_ip", "iis": "c-ip"}
TIME_KEY = {"apache": "timestamp", "nginx": "timestamp", "generic": "timestamp",
            "aws_alb": "timestamp", "haproxy": "accept_date", "squid": "epoch"}
TIME_KIND = {"apache": "clf", "nginx": "clf", "generic": "clf", "aws_alb": "iso",
             "haproxy": "clf_ms", "squid": "epoch", "iis": "iis"}


def keys_of(server_type: str) -> list[str]:
    return [row[0] for row in CATALOGUES[server_type]]


def field_catalog(spark: SparkSession) -> DataFrame:
    """All catalogues as one small table."""
    rows = [(server, place, *row) for server, fields in CATALOGUES.items()
            for place, row in enumerate(fields)]
    return spark.createDataFrame(
        rows, "server_type string, place int, key string, label string, category string, "
              "ecs string, description string")
