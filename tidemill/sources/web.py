"""HTTP sources and sinks: paged REST and GraphQL, and posting of rows."""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError, PublishError, TidemillError
from tidemill.functions.columns import col
from tidemill.sources.base import SINKS, SOURCES

#: Answers that are worth another try.
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)
_RETRIES = 3


def _headers(headers: dict | None, auth: str | None, credentials: dict) -> dict:
    out = {"Accept": "application/json", "User-Agent": "tidemill"} | (headers or {})
    if auth == "bearer":
        out["Authorization"] = f"Bearer {credentials['token']}"
    elif auth == "basic":
        out["Authorization"] = "Basic " + base64.b64encode(f"{credentials['username']}:{credentials['password']}".encode()).decode()
    elif auth == "api_key":
        out[credentials.get("header", "X-API-Key")] = credentials["key"]
    elif auth == "oauth2":
        form = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": credentials["client_id"], "client_secret": credentials["client_secret"]})
        answer, _ = request("POST", credentials["token_url"], {"Content-Type": "application/x-www-form-urlencoded"}, form.encode())
        out["Authorization"] = f"Bearer {answer['access_token']}"
    elif auth not in (None, "none"):
        raise ConfigurationError(f"unknown auth {auth!r}")
    return out


def request(method: str, url: str, headers: dict, body: bytes | None = None, timeout: float = 30.0, max_bytes: int = 100 << 20):
    """(parsed body, headers) of a call, tried again after answers that may pass."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ConfigurationError(f"{url!r} isn't an http address")
    for attempt in range(_RETRIES + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=timeout) as answer:  # noqa: S310
                raw = answer.read(max_bytes + 1)
                if len(raw) > max_bytes:
                    raise TidemillError(f"{url}: more than {max_bytes} bytes")
                return (json.loads(raw) if raw.strip() else None), dict(answer.headers)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == _RETRIES:
                raise TidemillError(f"{url}: HTTP {e.code}") from e
        except urllib.error.URLError as e:
            if attempt == _RETRIES:
                raise TidemillError(f"{url}: {e.reason}") from e
        time.sleep(0.2 * 2**attempt)


def dig(value, path: str | None):
    """The part of a document at a dotted path."""
    for part in (path or "").split("."):
        if part:
            value = value.get(part) if isinstance(value, dict) else value[int(part)] if isinstance(value, list) and part.isdigit() and int(part) < len(value) else None
    return value


def _records(found) -> list:
    rows = found if isinstance(found, list) else [] if found is None else [found]
    return [r if isinstance(r, dict) else {"value": r} for r in rows]


def _pages(url: str, method: str, params: dict, headers: dict, paging: dict, timeout: float):
    """The records of one page after another; the last page may be any that is short, and None follows where ``max_pages`` ends it."""
    kind, size = paging["pagination"], paging["page_size"]
    query, at = dict(params), paging.get("start", 0)
    for _ in range(paging["max_pages"]):
        if kind == "page":
            query |= {paging["page_param"]: at + paging["first_page"], paging["size_param"]: size}
        elif kind == "offset":
            query |= {paging["offset_param"]: at * size, paging["limit_param"]: size}
        target = url + ("&" if "?" in url else "?") + urllib.parse.urlencode(query) if query else url
        body, answered = request(method, target, headers, timeout=timeout)
        rows = _records(dig(body, paging["data_path"]))
        yield rows
        if paging["rate_limit"]:
            time.sleep(1 / paging["rate_limit"])
        at += paging.get("step", 1)
        if kind == "none" or (kind in ("page", "offset") and len(rows) < size):
            return
        if kind == "cursor":
            cursor = dig(body, paging["cursor_path"])
            if not cursor:
                return
            query[paging["cursor_param"]] = cursor
        if kind == "link":
            found = re.search(r'<([^>]+)>\s*;[^,]*rel="?next"?', answered.get("Link", ""))
            following = found[1] if found else dig(body, paging["next_path"])
            if not following:
                return
            url, query = urllib.parse.urljoin(url, following), {}
    yield None


def _frame(spark: SparkSession, schema: str | None, tasks: list[dict], fetch) -> DataFrame:
    """Records that ``fetch`` gives for each task; without a schema, it is inferred from all records.

    Where a task stops with pages left, a warning says so.
    """
    cut = spark.sparkContext.accumulator(0)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for task in pdf["task"]:
                for rows in fetch(json.loads(task)):
                    if rows is None:
                        cut.add(1)
                        continue
                    yield pd.DataFrame({"value": [json.dumps(r) for r in rows]}, columns=["value"], dtype=object)

    from tidemill.plans.staging import staging_dir

    raw = spark.createDataFrame([(json.dumps(t),) for t in tasks], "task string").repartition(len(tasks)).mapInPandas(run, "value string")
    path = f"{staging_dir(spark)}/fetched/{uuid.uuid4().hex}"
    raw.write.text(path)  # records are fetched once, and read again for their schema
    if cut.value:
        warnings.warn("max_pages ended the reading; more pages may follow", stacklevel=3)
    return (spark.read.schema(schema) if schema else spark.read).json(path)


@SOURCES.register("rest", "http", "api")
def read_rest(spark: SparkSession, url: str, method: str = "GET", params: dict | None = None, headers: dict | None = None, data_path: str | None = None, auth: str | None = None, credentials: dict | None = None, pagination: str = "none", page_size: int = 100, max_pages: int = 10_000, page_param: str = "page", size_param: str = "page_size", first_page: int = 1, offset_param: str = "offset", limit_param: str = "limit", cursor_param: str = "cursor", cursor_path: str = "next_cursor", next_path: str = "next", rate_limit: float = 0, timeout: float = 30, schema: str | None = None, parallel: int = 1) -> DataFrame:
    """Records of a paged JSON service.

    Page and offset paging may run in ``parallel`` tasks that take every so-manieth page;
    cursors and links follow one another.  Records are fetched in tasks, not by the driver.
    """
    if pagination not in ("none", "page", "offset", "cursor", "link"):
        raise ConfigurationError(f"unknown pagination {pagination!r}")
    heads = _headers(headers, auth, credentials or {})
    paging = {"pagination": pagination, "page_size": page_size, "max_pages": max_pages, "page_param": page_param, "size_param": size_param, "first_page": first_page, "offset_param": offset_param, "limit_param": limit_param, "cursor_param": cursor_param, "cursor_path": cursor_path, "next_path": next_path, "rate_limit": rate_limit, "data_path": data_path}
    step = parallel if pagination in ("page", "offset") else 1
    return _frame(spark, schema, [{"start": i, "step": step} for i in range(step)], lambda task: _pages(url, method, params or {}, heads, paging | task, timeout))


@SOURCES.register("graphql")
def read_graphql(spark: SparkSession, url: str, query: str, variables: dict | None = None, data_path: str | None = None, headers: dict | None = None, auth: str | None = None, credentials: dict | None = None, pagination: str = "none", page_size: int = 100, max_pages: int = 1000, cursor_path: str = "pageInfo.endCursor", has_next_path: str = "pageInfo.hasNextPage", timeout: float = 30, schema: str | None = None) -> DataFrame:
    """Records of a GraphQL query; edges give their nodes, and an ``errors`` answer is an error."""
    heads = _headers(headers, auth, credentials or {}) | {"Content-Type": "application/json"}

    def pages(_task):
        given = dict(variables or {})
        if pagination == "cursor":
            given |= {"first": page_size, "after": None}
        for _ in range(max_pages):
            body, _ = request("POST", url, heads, json.dumps({"query": query, "variables": given}).encode(), timeout)
            if body.get("errors"):
                raise TidemillError(f"{url}: {body['errors']}")
            found = dig(body.get("data"), data_path)
            rows = found.get("edges", found.get("nodes", found)) if isinstance(found, dict) else found
            yield [r["node"] if set(r) <= {"node", "cursor"} and isinstance(r.get("node"), dict) else r for r in _records(rows)]
            if pagination != "cursor" or not dig(found, has_next_path):
                return
            given["after"] = dig(found, cursor_path)
        yield None

    return _frame(spark, schema, [{}], pages)


@SINKS.register("rest", "http", "api", "webhook")
def write_rest(df: DataFrame, url: str, method: str = "POST", mode: str | None = None, payload_mode: str = "batch", wrapper_key: str | None = None, batch_rows: int = 500, headers: dict | None = None, auth: str | None = None, credentials: dict | None = None, rate_limit: float = 0, timeout: float = 30) -> None:
    """Post rows from each partition, in batches or one by one; a retried task may send some again."""
    if payload_mode not in ("batch", "record"):
        raise ConfigurationError("payload_mode is batch or record")
    heads = _headers(headers, auth, credentials or {}) | {"Content-Type": "application/json"}
    size = batch_rows if payload_mode == "batch" else 1

    def send(rows):
        held = []

        def post():
            payload = held[0] if payload_mode == "record" else "[" + ",".join(held) + "]"
            payload = f"{{{json.dumps(wrapper_key)}: {payload}}}" if wrapper_key else payload
            try:
                request(method, url, heads, payload.encode(), timeout)
            except TidemillError as e:
                raise PublishError(str(e)) from e
            if rate_limit:
                time.sleep(1 / rate_limit)

        for r in rows:
            held.append(r["value"])
            if len(held) >= size:
                post()
                held = []
        if held:
            post()

    df.select(F.to_json(F.struct(*(col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("value")).foreachPartition(send)
