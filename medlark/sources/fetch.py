"""Source files over HTTP, on the driver: whole or not at all, with checksums kept beside them, and safe unpacking.

A file that the record beside the folder knows is used again if it still has its checksum; one that it doesn't know is never
overwritten. Errors that pass (429, 5xx, lost connections) are tried again after 1, 2, 4, ... seconds, 8 at most."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass

from .delimited import SourceError

#: Answers of a server after which a request may be tried again.
PASSING = (429, 500, 502, 503, 504)
BLOCK, WAIT = 1 << 20, 8
_QUARTER = re.compile(r"(\d{4}q[1-4])", re.IGNORECASE)
_LINK = re.compile(r"""href\s*=\s*["']([^"']+\.zip)["']""", re.IGNORECASE)


@dataclass(frozen=True)
class Fetched:
    name: str
    url: str
    path: str
    bytes: int
    sha256: str
    cached: bool = False


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _records(path: str) -> dict[str, dict]:
    if not os.path.exists(path):
        return {}
    try:
        with open(path) as f:
            return dict(json.load(f))
    except (ValueError, TypeError) as e:
        raise SourceError(f"{path} isn't a record of fetched files") from e


def _stream(url: str, path: str, opener: Callable, retries: int, sleep: Callable) -> str:
    for attempt in range(retries + 1):
        try:
            h = hashlib.sha256()
            with opener(url) as answer, open(path, "wb") as out:
                while block := answer.read(BLOCK):
                    out.write(block)
                    h.update(block)
            return h.hexdigest()
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or attempt == retries:
                raise SourceError(f"{url}: {e.code}") from e
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if attempt == retries:
                raise SourceError(f"{url} can't be fetched") from e
        sleep(min(2**attempt, WAIT))
    raise AssertionError


def fetch(name: str, url: str, path: str, sha256: str | None = None, retries: int = 3, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> Fetched:
    """The file of a url at path. `sha256` is the checksum it should have."""
    if retries < 0:
        raise ValueError("retries can't be negative")
    beside = os.path.join(os.path.dirname(os.path.abspath(path)), "fetched.json")
    known = _records(beside)
    had = known.get(name)
    if had and had["url"] == url and had["path"] == path and os.path.exists(path):
        if _digest(path) != had["sha256"] or sha256 and sha256.lower() != had["sha256"]:
            raise SourceError(f"{path} doesn't have its checksum")
        return Fetched(**{**had, "cached": True})
    if os.path.exists(path):
        raise SourceError(f"{path} is there, but nobody knows where it is from; it isn't overwritten")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.part"
    try:
        digest = _stream(url, part, opener, retries, sleep)
        if sha256 and digest != sha256.lower():
            raise SourceError(f"{url} has checksum {digest}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    done = Fetched(name, url, path, os.path.getsize(path), digest)
    known[name] = asdict(done)
    with open(f"{beside}.tmp", "w") as f:
        json.dump(known, f, indent=2, sort_keys=True)
    os.replace(f"{beside}.tmp", beside)
    return done


def quarters(page: str, base: str) -> dict[str, str]:
    """Archives by quarter out of a page's links; the last link of a quarter counts."""
    found = {}
    for link in _LINK.findall(page):
        if m := _QUARTER.search(link.rsplit("/", 1)[-1]):
            found[m[1].upper()] = urllib.parse.urljoin(base, link)
    return found


def quarter_of(quarter: str | None, url: str | None, known: dict[str, str] | None = None) -> tuple[str, str]:
    """(quarter, url): as given, the quarter that the url names, or of the known archives the one asked for or the latest."""
    if quarter is not None and not _QUARTER.fullmatch(quarter):
        raise ValueError("a quarter is written as 2024Q1")
    if url:
        m = _QUARTER.search(url)
        if quarter is None and m is None:
            raise ValueError("the url doesn't name its quarter")
        return (quarter or m[1]).upper(), url
    if not known:
        raise SourceError("no archive is known")
    q = (quarter or max(known)).upper()
    if q not in known:
        raise SourceError(f"there is no archive of {q}")
    return q, known[q]


def unpack(archive: str, folder: str) -> list[str]:
    """The members of a zip below folder, once: a folder that is complete is left as it is, one that isn't is refused, and
    so is an archive with a member that would leave the folder."""
    mark = os.path.join(folder, ".complete")
    if os.path.exists(mark):
        with open(mark) as f:
            return json.load(f)
    if os.path.isdir(folder) and os.listdir(folder):
        raise SourceError(f"{folder} has files of an unpacking that didn't end")
    root = os.path.realpath(folder)
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            target = os.path.realpath(os.path.join(root, info.filename))
            if os.path.isabs(info.filename) or os.path.commonpath([root, target]) != root or (info.external_attr >> 16) & 0o170000 == 0o120000:
                raise SourceError(f"{archive} has an unsafe member: {info.filename}")
        os.makedirs(root, exist_ok=True)
        z.extractall(root)
        names = sorted(i.filename for i in z.infolist() if not i.is_dir())
    with open(mark, "w") as f:
        json.dump(names, f)
    return names


#: Questions a second that a name service is asked at most.
FASTEST = 20.0


def ask(names: list[str], kept: str, one: Callable[[str], list[dict]], per_second: float = 10.0, batch: int = 250, clock: Callable = time.monotonic, sleep: Callable = time.sleep) -> int:
    """Asks a name service for what the JSON lines in `kept` don't have yet (query_name, candidates) and adds its answers, a
    batch at a time, so that a run that is stopped goes on where it was. `one` gives the candidates of a name. Returns the
    number of questions."""
    if not 0 < per_second <= FASTEST or batch < 1:
        raise ValueError("the rate or the batch is out of range")
    known = set()
    if os.path.exists(kept):
        with open(kept, encoding="utf-8") as f:
            for n, line in enumerate(f, 1):
                try:
                    known.add(json.loads(line)["query_name"])
                except (ValueError, KeyError, TypeError) as e:
                    raise SourceError(f"line {n} of {kept} is no answer") from e
    asked = sorted({n for n in names if n and n not in known})
    due = clock()
    for lo in range(0, len(asked), batch):
        lines = []
        for name in asked[lo : lo + batch]:
            if (wait := due - clock()) > 0:
                sleep(wait)
            due = max(due, clock()) + 1 / per_second
            lines.append(json.dumps({"query_name": name, "candidates": one(name)}, sort_keys=True))
        with open(kept, "a", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
            f.flush()
            os.fsync(f.fileno())
    return len(asked)
