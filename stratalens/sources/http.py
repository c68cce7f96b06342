"""JSON over HTTP as a Spark data source: ``spark.read.format("jsonhttp")``.

One request a page. Answers are bounded, redirects stay on the host, and
credentials never go into an error.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES, TIMEOUT = 128 << 20, 300


class HttpError(RuntimeError):
    """A request failed; the text has no credentials."""


class _SameOrigin(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        here, there = urlsplit(req.full_url), urlsplit(newurl)
        if (here.scheme, here.netloc) != (there.scheme, there.netloc):
            raise HttpError("redirected to another host")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def split_credentials(url: str) -> tuple[str, str | None, str | None]:
    """(url without credentials, user, password)."""
    parts = urlsplit(url)
    host = parts.netloc.rpartition("@")[2]
    return parts._replace(netloc=host).geturl(), parts.username, parts.password


def fetch(url: str, body: str | None = None, user: str | None = None, password: str | None = None, most: int = MOST_BYTES, timeout: float = TIMEOUT):
    """The JSON answer of GET, or of POST where there is a body."""
    clean, own_user, own_password = split_credentials(url)
    user, password = user or own_user, password or own_password
    request = urllib.request.Request(clean, data=body.encode() if body is not None else None, headers={"Accept": "application/json", "Content-Type": "application/json"})
    if user:
        request.add_header("Authorization", "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode())
    try:
        with urllib.request.build_opener(_SameOrigin).open(request, timeout=timeout) as answer:
            data = answer.read(most + 1)
    except urllib.error.HTTPError as error:
        raise HttpError(f"{clean.split('?')[0]} answered {error.code}") from None
    except (urllib.error.URLError, OSError) as error:
        raise HttpError(f"{clean.split('?')[0]} can't be reached: {getattr(error, 'reason', error)}") from None
    if len(data) > most:
        raise HttpError(f"the answer is above {most} bytes")
    try:
        return json.loads(data)
    except ValueError as error:
        raise HttpError(f"the answer is no JSON: {error}") from None


class _Page(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Page]:
        urls = json.loads(self.options["urls"]) if "urls" in self.options else [self.options["path"]]
        return [_Page(u) for u in urls]

    def read(self, partition: _Page) -> Iterator[tuple[str, str]]:
        found = fetch(partition.url, self.options.get("body"), self.options.get("user"), self.options.get("password"), int(self.options.get("maxBytes", MOST_BYTES)), float(self.options.get("timeout", TIMEOUT)))
        for part in (self.options.get("records") or "").split("."):
            found = found.get(part, []) if part and isinstance(found, dict) else found
        for record in found if isinstance(found, list) else [found]:
            yield split_credentials(partition.url)[0], json.dumps(record, ensure_ascii=False)


class JsonHttp(DataSource):
    """Rows (url, record): one for each record of each answer, as JSON text for from_json.

    Options: ``path`` or ``urls`` (a JSON list), ``records`` (the dotted place of
    the list in an answer), ``body`` (makes it a POST), ``user``, ``password``,
    ``maxBytes``, ``timeout``.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonhttp"

    def schema(self) -> str:
        return "url string, record string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
