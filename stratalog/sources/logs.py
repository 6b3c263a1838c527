"""Access logs: lines of text to typed columns, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import SourceError

# The fields of each format in order, with a kind where it isn't text.
FIELDS = {
    "elb": """timestamp:datetime elbname client_and_port:host backend_and_port:host request_processing_time:float
        backend_processing_time:float response_processing_time:float elb_status_code backend_status_code
        received_bytes:int sent_bytes:int request:request user_agent ssl_cipher ssl_protocol target_group_arn trace_id""",
    "alb": """type timestamp:datetime elb client_and_port:host target_and_port:host request_processing_time:float
        target_processing_time:float response_processing_time:float elb_status_code target_status_code
        received_bytes:int sent_bytes:int request:request user_agent ssl_cipher ssl_protocol target_group_arn trace_id
        domain_name chosen_cert_arn matched_rule_priority request_creation_time action_executed redirect_url error_reason""",
    "s3": """bucket_owner bucket time remote_ip requester request_id operation key request_uri http_status error_code
        bytes_sent object_size total_time turn_around_time refererr user_agent version_id host_id signature_version
        cipher_suite authentication_type host_header tls_version""",
    "squid": "timestamp elapsed remote_host code_and_status bytes method url rfc931 peer_status_and_peer_host type",
}
#: Names of kinds as `schema` shows them.
KINDS = {"": "String", "datetime": "DateTime", "host": "Host", "float": "Float", "int": "Integral", "request": "HttpRequest"}
_TOKEN = r""""[^"]*"?|'[^']*'?|\[[^\]]*\]?|[^\s"'\[]\S*"""
METHODS, VERSIONS = ("GET", "POST", "DELETE", "HEAD", "PUT", "PATCH"), ("HTTP/1.0", "HTTP/1.1", "HTTP/2.0")


def fields(fmt: str) -> list[tuple[str, str]]:
    """(name, kind) of a format's fields."""
    if fmt not in FIELDS:
        raise SourceError(f"unknown log format {fmt}")
    return [tuple(f.partition(":")[::2]) for f in FIELDS[fmt].split()]


def typed(token: Column, kind: str, parts: Column | None = None) -> Column:
    """A bare token as a value of the kind; null where it isn't one. parts: a request's token
    cut at blanks, a host's last part."""
    if kind == "datetime":
        return token.try_cast("timestamp")
    if kind == "int":
        return token.try_cast("bigint")
    if kind == "float":
        return token.try_cast("double")
    if kind == "host":
        port = F.when(F.contains(token, F.lit(":")), parts.try_cast("int"))
        name = F.left(token, F.length(token) - F.length(parts) - 1)
        return F.when(port.between(0, 65535), F.struct(name.alias("hostname"), port.alias("port")))
    if kind == "request":
        method, url, version = (F.get(parts, F.lit(k)) for k in range(3))
        whole = (F.size(parts) == 3) & method.isin(*METHODS) & version.isin(*VERSIONS) & (url != "") & (F.translate(url, "\t\n\x0b\f\r", "") == url)
        return F.when(whole, F.struct(method.alias("http_method"), url.alias("url"), version.alias("http_version"), token.alias("raw")))
    return token


#: What a kind's token is cut into before it is typed.
CUT = {"request": lambda token: F.split(token, " ", -1), "host": lambda token: F.substring_index(token, ":", -1)}


def bare(token: Column) -> Column:
    """A token without one quote or bracket at either end."""
    opened = token.startswith('"') | token.startswith("'") | token.startswith("[")
    closed = token.endswith('"') | token.endswith("'") | token.endswith("]")
    stripped = F.substring(token, F.when(opened, 2).otherwise(1), F.length(token) - opened.cast("int") - closed.cast("int"))
    return F.when(opened | closed, stripped).otherwise(token)


def parse(lines: DataFrame, fmt: str, line_col: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """Lines of a log format as columns.

    Quoted and bracketed tokens lose their marks; short lines end in nulls, further tokens are
    left out, blank lines skipped. A token that doesn't fit its field is null, or with mode
    FAILFAST an error; `-` for a host is null either way.
    """
    named = list(enumerate(fields(fmt)))
    # Each step is a projection of its own, so that nothing is worked out twice.
    tokens = lines.where(F.length(F.trim(F.col(line_col))) > 0).select(F.regexp_extract_all(F.col(line_col), F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    bares = tokens.select(*(bare(F.get("tokens", F.lit(k))).alias(f"t{k}") for k, _ in named))
    found = bares.select("*", *(CUT[kind](F.col(f"t{k}")).alias(f"p{k}") for k, (_, kind) in named if kind in CUT))
    out = []
    for k, (name, kind) in named:
        token = F.col(f"t{k}")
        value = typed(token, kind, F.col(f"p{k}") if kind in CUT else None)
        if mode.upper() == "FAILFAST" and kind:
            bad = token.isNotNull() & value.isNull() & (token != "-" if kind == "host" else F.lit(True))
            value = F.when(bad, F.raise_error(F.concat(F.lit(f"not a {KINDS[kind]} in {name}: "), token)).cast("void")).otherwise(value)
        out.append(value.alias(name))
    return found.select(*out)


def read(spark: SparkSession, fmt: str, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Files of a log format, as Spark splits and decompresses them."""
    fields(fmt)
    return parse(spark.read.text(path), fmt, mode=mode)


def describe(fmt: str) -> list[tuple[str, str]]:
    return [(name, KINDS[kind]) for name, kind in fields(fmt)]


def rendered(df: DataFrame, fmt: str) -> DataFrame:
    """The reverse of parse: rows with a format's columns as lines; nulls as `-`."""

    def token(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "datetime":
            text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif kind == "host":
            text = F.concat_ws(":", c["hostname"], c["port"])
        elif kind == "request":
            text = F.concat(F.lit('"'), c["raw"], F.lit('"'))
        else:
            text = c.cast("string")
        text = F.coalesce(F.when(c.isNotNull(), text), F.lit("-"))
        return text if kind else F.when(F.regexp_like(text, F.lit(r"^$|[\s\[\]]")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(" ", *(token(n, k) for n, k in fields(fmt))).alias("value"))
