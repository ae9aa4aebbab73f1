"""Driver-side download of files that a manifest lists: throttled, retried, resumable, logged.

A rate limit holds for the whole program, so this isn't spread over executors.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

GAP_SECONDS, TRIES, LONGEST_WAIT = 0.1, 6, 60.0


def check_agent(agent: str | None) -> str:
    """A declared user agent must name a contact."""
    if not agent or "@" not in agent:
        raise ValueError("declare a user agent with a contact address")
    return agent


class Throttle:
    def __init__(self, gap: float = GAP_SECONDS, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.last = gap, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.gap - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


def decode_body(body: bytes, encoding: str | None) -> bytes:
    if encoding == "gzip":
        return gzip.decompress(body)
    if encoding == "deflate":
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -zlib.MAX_WBITS)
    return body


def get(url: str, agent: str, opener=urllib.request.urlopen, throttle: Throttle | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a URL; busy servers and broken connections are tried again, each time after a longer wait."""
    throttle = throttle or Throttle()
    for n in range(TRIES):
        throttle.wait()
        pause = min(LONGEST_WAIT, 2.0**n)
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip, deflate"})) as r:
                return decode_body(r.read(), r.headers.get("Content-Encoding"))
        except urllib.error.HTTPError as e:
            if e.code not in (429, 503) or n == TRIES - 1:
                raise
            after = (e.headers or {}).get("Retry-After", "")
            pause = min(LONGEST_WAIT, float(after)) if str(after).isdigit() else pause
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if n == TRIES - 1:
                raise
        sleep(pause)
    raise AssertionError("unreachable")


def write_whole(path: str, data: bytes) -> str:
    """Write a file so that it is there whole or not at all; its SHA-256."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
    return hashlib.sha256(data).hexdigest()


def is_present(path: str) -> bool:
    return os.path.isfile(path) and os.path.getsize(path) > 0


def fetch(rows: Iterable[dict], root: str, url_of: Callable[[dict], str], agent: str, log: str | None = None, limit: int | None = None, dry_run: bool = False, getter=None) -> dict[str, int]:
    """Download what is missing of ``rows`` (accession_number, cik, archive_path); one failure doesn't stop the rest."""
    agent = check_agent(agent)
    throttle = Throttle()
    getter = getter or (lambda u: get(u, agent, throttle=throttle))
    out = {"present": 0, "fetched": 0, "failed": 0, "left": 0}
    for r in rows:
        path = os.path.join(root, r["archive_path"])
        if is_present(path):
            out["present"] += 1
            continue
        if dry_run or (limit is not None and out["fetched"] + out["failed"] >= limit):
            out["left"] += 1
            continue
        line = {"accession": r["accession_number"], "cik": r["cik"], "url": url_of(r), "timestamp": datetime.now(UTC).isoformat()}
        try:
            data = getter(line["url"])
            line |= {"bytes": len(data), "sha256": write_whole(path, data)}
            out["fetched"] += 1
        except Exception as e:  # noqa: BLE001
            line |= {"bytes": None, "sha256": None, "error": repr(e)[:200]}
            out["failed"] += 1
        if log:
            with open(log, "a") as f:
                f.write(json.dumps(line) + "\n")
    return out
