"""The control plane: a folder that commands are dropped into, and a lock for the one writer. Plain files on the
machine that runs the driver; no data goes this way."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

VERSION, TTL = 1, 300.0


def drop_command(folder: str, name: str, args: dict | None = None, now: float | None = None) -> str:
    """Puts a command into the folder, under a draft's name first, and returns its id."""
    at, key = Path(folder), uuid.uuid4().hex
    at.mkdir(parents=True, exist_ok=True)
    draft = at / f".{key}"
    draft.write_text(json.dumps({"version": VERSION, "id": key, "name": name, "args": args or {}, "at": time.time() if now is None else now}))
    draft.rename(at / f"{key}.json")
    return key


def run_commands(folder: str, handlers: dict[str, Callable], now: float | None = None, ttl: float = TTL) -> dict[str, str]:
    """Runs what waits in the folder, oldest first, one at a time, each id once: its answer is a file beside it, and a
    command that has one is not run again. States: done, failed, expired (older than ``ttl``), unknown (no such
    handler, another version or not readable)."""
    now, found, out = time.time() if now is None else now, [], {}
    for f in Path(folder).glob("*.json"):
        if f.with_suffix(".answer").exists():
            continue
        try:
            c = json.loads(f.read_text())
            found.append((c["at"], c["id"], c, f))
        except (ValueError, KeyError, TypeError):
            found.append((0.0, f.stem, None, f))
    for at, key, c, f in sorted(found, key=lambda x: x[:2]):
        value = None
        if c is None or c.get("version") != VERSION or c.get("name") not in handlers:
            state = "unknown"
        elif now - at > ttl:
            state = "expired"
        else:
            try:
                state, value = "done", handlers[c["name"]](**c["args"])
            except Exception as e:  # a command that fails must not stop the queue
                state, value = "failed", str(e)
        draft = f.with_suffix(".draft")
        draft.write_text(json.dumps({"version": VERSION, "id": key, "state": state, "value": value}))
        draft.rename(f.with_suffix(".answer"))
        out[key] = state
    return out


def answer(folder: str, key: str) -> dict | None:
    f = Path(folder) / f"{key}.answer"
    return json.loads(f.read_text()) if f.exists() else None


class WriterLock:
    """One writer at a time on this machine: a file with the owner's process id. A process may take it several times;
    a lock whose process is gone is taken over."""

    def __init__(self, path: str):
        self.path, self.depth = Path(path), 0

    def _owner(self) -> int | None:
        try:
            return int(self.path.read_text())
        except (OSError, ValueError):
            return None

    def acquire(self) -> bool:
        if self.depth:
            self.depth += 1
            return True
        for _ in range(2):
            try:
                with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(str(os.getpid()))
                self.depth = 1
                return True
            except FileExistsError:
                owner = self._owner()
                if owner is not None and _alive(owner):
                    return False
                # the one that renames it away may try again; others find the file gone or new
                try:
                    os.rename(self.path, f"{self.path}.{uuid.uuid4().hex}.stale")
                except FileNotFoundError:
                    pass
        return False

    def release(self) -> None:
        self.depth -= 1
        if self.depth == 0 and self._owner() == os.getpid():
            self.path.unlink()

    def __enter__(self) -> WriterLock:
        if not self.acquire():
            raise BlockingIOError(f"another process writes ({self.path})")
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True
