"""Fetching: what a board is asked, how its pages follow each other, and at what pace a host is asked.

A board is a dictionary: company, ats, token, and optionally ``offset`` (where to go on) and anything of :class:`Endpoint`
in place of its source's (``url``, ``method``, ``body``, ``accept``, and ``paging`` as a dictionary of :class:`Paging`).
Everything runs inside one task, a board at a time, page by page until its source's stop rule ends it. A page that fails
ends its own board with an error row at its offset; a later run may go on there.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from importlib import import_module
from urllib.parse import quote, urlsplit

#: (status, text) of (method, url, body, headers, timeout).
Transport = Callable[[str, str, str | None, dict[str, str], float], tuple[int, str]]


@dataclass(frozen=True)
class Paging:
    """Stop rules; each holds where its field is set, and the first that holds ends the board.

    ``size``: a page with fewer items is the last. ``most``: no page starts at this offset or beyond (0: none does).
    ``total``: member with the number of all items; the page that reaches it is the last. ``follow``: member with the next
    page's token or address; a page without one is the last. ``stale``: so many pages in a row without a new ``key``
    among their items, counted after the first ``patience`` pages. An empty page is always the last.

    ``first`` and ``step`` count offsets or page numbers. Items are the list at ``items`` of a JSON page, or what
    ``pattern`` finds in any other.
    """

    step: int
    size: int = 0
    most: int = 0
    items: str = ""
    total: str = ""
    follow: str = ""
    key: str = ""
    stale: int = 0
    patience: int = 0
    first: int = 0
    pattern: str = ""


@dataclass(frozen=True)
class Endpoint:
    """``url`` and ``body`` may name {token}, {offset}, {limit}, {cursor}, and the parts {base}, {tenant} and {site} of an address."""

    url: str
    method: str = "GET"
    body: str | None = None
    accept: str = "application/json"
    paging: Paging | None = None
    gone: tuple[int, ...] = ()


#: The public addresses of boards by source, and the paging of the one that has pages.
ENDPOINTS: dict[str, Endpoint] = {
    "greenhouse": Endpoint("https://boards-api.greenhouse.io/v1/boards/{token}/jobs"),
    "lever": Endpoint("https://api.lever.co/v0/postings/{token}?mode=json"),
    "ashby": Endpoint("https://jobs.ashbyhq.com/{token}", accept="text/html"),
    "workable": Endpoint("https://apply.workable.com/api/v3/accounts/{token}/jobs", method="POST", body="{}"),
    "smartrecruiters": Endpoint("https://api.smartrecruiters.com/v1/companies/{token}/postings?limit=500"),
    "personio": Endpoint("https://{token}.jobs.personio.de/xml?language=en", accept="application/xml"),
    "rippling": Endpoint("https://api.rippling.com/platform/api/ats/v1/board/{token}/jobs"),
    "teamtailor": Endpoint("https://{token}.teamtailor.com/jobs.rss", accept="application/rss+xml, application/xml"),
    "breezyhr": Endpoint("https://{token}.breezy.hr/"),
    "onlyfy": Endpoint("https://{token}.onlyfy.jobs/en"),
    "mailto": Endpoint("{token}", accept="text/html"),
    "workday": Endpoint(
        "{base}/wday/cxs/{tenant}/{site}/jobs", method="POST", body='{"limit": {limit}, "offset": {offset}, "searchText": "", "facets": []}',
        paging=Paging(step=20, size=20, most=500, items="jobPostings"), gone=(404,),
    ),
}


class FetchError(Exception):
    """A request that brought no page; ``status`` is 0 where no answer came."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.status = status


def http(method: str, url: str, body: str | None, headers: dict[str, str], timeout: float) -> tuple[int, str]:
    """A request by the standard library; an answer of any status is returned, no answer raises OSError."""
    request = urllib.request.Request(url, None if body is None else body.encode(), headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


def endpoint_of(board: dict) -> Endpoint:
    found = ENDPOINTS.get(board["ats"], Endpoint("{token}"))
    own = {k: board[k] for k in ("url", "method", "body", "accept") if board.get(k)}
    if board.get("paging"):
        own["paging"] = board["paging"] if isinstance(board["paging"], Paging) else Paging(**board["paging"])
    return replace(found, **own)


def _fill(template: str, values: dict[str, str]) -> str:
    """Only the known names are filled in, so that a JSON body keeps its braces."""
    return re.sub(r"\{(" + "|".join(values) + r")\}", lambda m: values[m[1]], template)


def address_parts(token: str) -> dict[str, str]:
    """base, tenant and site of a careers address; all empty where it has no host or no path."""
    at = urlsplit(token) if "://" in token else None
    steps = [x for x in at.path.split("/") if x] if at else []
    if not at or not at.hostname or not steps:
        return {"base": "", "tenant": "", "site": ""}
    return {"base": f"{at.scheme}://{at.netloc}", "tenant": at.hostname.split(".")[0], "site": steps[0]}


def url_of(board: dict, offset: int = 0, cursor: str = "") -> str:
    return _request(board, endpoint_of(board), offset, cursor)[0]


def _request(board: dict, endpoint: Endpoint, offset: int, cursor: str) -> tuple[str, str | None]:
    token = board.get("token") or ""
    limit = endpoint.paging.size or endpoint.paging.step if endpoint.paging else 0
    parts = address_parts(token) if "{base}" in endpoint.url else {}
    if "{base}" in endpoint.url and not parts["base"]:
        raise FetchError(f"no host and site in the address {token!r}")
    values = {"token": token if "://" in token else quote(token, safe=""), "offset": str(offset), "limit": str(limit), "cursor": quote(cursor, safe=""), **parts}
    url = cursor if "://" in cursor else _fill(endpoint.url, values)
    body = None if endpoint.body is None else _fill(endpoint.body, values | {"cursor": json.dumps(cursor)[1:-1], "token": json.dumps(token)[1:-1]})
    return url, body


def member(value: object, path: str) -> object:
    """The member at a dotted path; None where there is none. An empty path is the value itself."""
    for name in path.split(".") if path else ():
        value = value.get(name) if isinstance(value, dict) else None
    return value


class Fetcher:
    """One task's requests: retries, and at most ``rate`` requests a second to each host, shared by ``lanes`` tasks.

    Everything but a missing page (404) and what a source calls gone is tried ``retries`` times more, ``wait`` seconds apart.
    """

    def __init__(self, transport: Transport | str = http, agent: str = "heddle", retries: int = 2, wait: float = 1.0, timeout: float = 20.0, rate: float = 0.0, lanes: int = 1, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        if isinstance(transport, str):
            module, _, name = transport.rpartition(".")
            transport = getattr(import_module(module), name)
        self.transport, self.agent, self.retries, self.wait, self.timeout = transport, agent, retries, wait, timeout
        self.gap, self.sleep, self.clock, self.last = lanes / rate if rate else 0.0, sleep, clock, {}

    def _pace(self, url: str) -> None:
        if self.gap:
            host = urlsplit(url).netloc
            early = self.last.get(host, -self.gap) + self.gap - self.clock()
            if early > 0:
                self.sleep(early)
            self.last[host] = self.clock()

    def get(self, endpoint: Endpoint, url: str, body: str | None) -> tuple[int, str]:
        headers = {"User-Agent": self.agent, "Accept": endpoint.accept} | ({"Content-Type": "application/json"} if body is not None else {})
        status, why = 0, ""
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(self.wait)
            self._pace(url)
            try:
                status, text = self.transport(endpoint.method, url, body, headers, self.timeout)
            except Exception as error:  # whatever a transport raises is a failed request
                status, why = 0, f"{type(error).__name__}: {error}"
                continue
            if 200 <= status < 300:
                return status, text
            why = f"HTTP {status}"
            if status == 404 or status in endpoint.gone:
                break
        raise FetchError(f"{url}: {why}", status)

    def pages(self, board: dict) -> Iterator[tuple[str, int, int, str | None, str | None]]:
        """(url, offset, status, payload, error) of each page, from the board's ``offset`` on, until its stop rule holds."""
        endpoint, url = endpoint_of(board), ""
        paging, cursor, seen, stale, n, met = endpoint.paging, "", set(), 0, 0, 0
        at = int(board.get("offset") or (paging.first if paging else 0))
        while not (paging and paging.most and at >= paging.most):
            try:
                url, body = _request(board, endpoint, at, cursor)
                status, text = self.get(endpoint, url, body)
                items, told = _items(text, paging) if paging else ([], None)
            except FetchError as error:
                if n and error.status in endpoint.gone:
                    return  # no page here: the one before was the last
                yield url, at, error.status, None, str(error)
                return
            except ValueError as error:
                yield url, at, status, None, f"{url}: no such listing: {error}"
                return
            yield url, at, status, text, None
            if not paging or not items or (paging.size and len(items) < paging.size):
                return
            n += 1
            new = {_key(x, paging.key) for x in items} - seen
            seen |= new
            stale = 0 if new or n <= paging.patience else stale + 1
            if paging.stale and stale >= paging.stale:
                return
            if paging.follow:
                cursor = str(member(told, paging.follow) or "")
                if not cursor:
                    return
            met += len(items)
            total = member(told, paging.total) if paging.total else None
            if isinstance(total, int) and met >= total:
                return
            at += paging.step


def _key(item: object, key: str) -> str:
    return json.dumps(member(item, key), sort_keys=True)


def _items(text: str, paging: Paging) -> tuple[list, object]:
    """(items of a page, what it was parsed to); matches of ``pattern`` where one is given, else a list in JSON."""
    if paging.pattern:
        return re.findall(paging.pattern, text), None
    told = json.loads(text)
    items = member(told, paging.items)
    if items is not None and not isinstance(items, list):
        raise ValueError(f"{paging.items or 'payload'} is no list")
    return items or [], told
