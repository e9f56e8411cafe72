"""A local stand-in for the vendor's server: files below a folder, with answers that fail a number of times first."""

from __future__ import annotations

import os


def get(url: str) -> tuple[int, bytes]:
    """<file>.script, if there, lists answers for the first tries: codes, or 'down' for a network error."""
    path = url.removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.tries", "a") as f:
        f.write("x")
    tries = os.path.getsize(f"{path}.tries")
    if os.path.exists(f"{path}.script"):
        with open(f"{path}.script") as f:
            answers = f.read().split()
        if tries <= len(answers):
            if answers[tries - 1] == "down":
                raise ConnectionError(url)
            return int(answers[tries - 1]), b""
    if not os.path.exists(path):
        return 404, b""
    with open(path, "rb") as f:
        return 200, f.read()


def sleep(seconds: float) -> None:
    """Nothing waits in a test."""
    assert seconds >= 0
