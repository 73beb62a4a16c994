"""Fetching with retries and checksums, archives by quarter, safe unpacking."""

from __future__ import annotations

import hashlib
import io
import urllib.error
import zipfile

import pytest

from medlark.sources import fetch
from medlark.sources.delimited import SourceError


def server(*answers):
    left, waits = list(answers), []

    def opener(url):
        a = left.pop(0)
        if isinstance(a, int):
            raise urllib.error.HTTPError(url, a, "no", {}, None)
        if isinstance(a, Exception):
            raise a
        return io.BytesIO(a)

    return {"opener": opener, "sleep": waits.append}, waits, left


def test_fetch(tmp_path):
    path = str(tmp_path / "in" / "a.zip")
    talk, waits, _ = server(503, urllib.error.URLError("lost"), b"hello")
    one = fetch.fetch("a", "http://x/a.zip", path, hashlib.sha256(b"hello").hexdigest(), **talk)
    assert waits == [1, 2] and one.bytes == 5 and not one.cached and open(path, "rb").read() == b"hello"
    assert fetch.fetch("a", "http://x/a.zip", path, **server()[0]).cached
    with pytest.raises(SourceError):
        fetch.fetch("a", "http://x/other.zip", path, **server()[0])
    with open(path, "wb") as f:
        f.write(b"changed")
    with pytest.raises(SourceError):
        fetch.fetch("a", "http://x/a.zip", path, **server()[0])


@pytest.mark.parametrize("answers", [(404,), (500, 500), (b"other",)])
def test_fetch_leaves_nothing_behind(tmp_path, answers):
    path = tmp_path / "b.zip"
    with pytest.raises(SourceError):
        fetch.fetch("b", "http://x/b.zip", str(path), "0" * 64, retries=1, **server(*answers)[0])
    assert list(tmp_path.iterdir()) == []


def test_quarters():
    page = '<a href="/d/ascii_2023q4.zip">x</a> <A HREF=\'http://y/z/ascii_2024Q1.zip\'> <a href="xml_2024.zip">'
    known = fetch.quarters(page, "http://x/list")
    assert known == {"2023Q4": "http://x/d/ascii_2023q4.zip", "2024Q1": "http://y/z/ascii_2024Q1.zip"}
    assert fetch.quarter_of(None, None, known)[0] == "2024Q1" and fetch.quarter_of("2023q4", None, known)[1].endswith("2023q4.zip")
    assert fetch.quarter_of(None, "http://x/f_2020q2.zip") == ("2020Q2", "http://x/f_2020q2.zip")
    for bad in (("2024Q5", None), (None, "http://x/f.zip")):
        with pytest.raises(ValueError):
            fetch.quarter_of(*bad)
    with pytest.raises(SourceError):
        fetch.quarter_of("2019Q1", None, known)


def test_unpack(tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("ascii/demo.txt", "a$b\n")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../out.txt", "x")
    assert fetch.unpack(str(good), str(tmp_path / "g")) == ["ascii/demo.txt"] == fetch.unpack(str(good), str(tmp_path / "g"))
    assert (tmp_path / "g" / "ascii" / "demo.txt").read_text() == "a$b\n"
    with pytest.raises(SourceError):
        fetch.unpack(str(bad), str(tmp_path / "b"))
    assert not (tmp_path / "out.txt").exists()
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "x").write_text("x")
    with pytest.raises(SourceError):
        fetch.unpack(str(good), str(tmp_path / "half"))


def test_name_service_is_asked_once_and_slowly(tmp_path):
    now, asked = [0.0], []
    wait = lambda s: now.__setitem__(0, now[0] + s)
    one = lambda name: asked.append((name, round(now[0], 3))) or [{"name": name.upper(), "rxcui": "1", "rank": 1}]
    kept = str(tmp_path / "answers.jsonl")
    assert fetch.ask(["b", "a", "a", ""], kept, one, 4.0, 1, lambda: now[0], wait) == 2
    assert asked == [("a", 0.0), ("b", 0.25)] and fetch.ask(["a", "b", "c"], kept, one, 4.0, 250, lambda: now[0], wait) == 1
    with open(kept, "a") as f:
        f.write("half a li")
    with pytest.raises(SourceError):
        fetch.ask(["d"], kept, one)
    with pytest.raises(ValueError):
        fetch.ask([], kept, one, 21)
