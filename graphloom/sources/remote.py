"""Call-outs to outside services. How bytes travel is the caller's: every function takes its transport."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path
from typing import Any, Protocol

from graphloom.sources.readers import content_list, unpack


class ParserTransport(Protocol):
    """What a hosted parser must offer."""

    def create(self, name: str) -> tuple[str, str]:
        """Opens a batch: its id and the address the file goes to."""

    def put(self, address: str, data: bytes) -> None: ...

    def state(self, batch: str) -> tuple[str, str]:
        """'done' and the archive's address, 'failed' and why, or anything else while it works."""

    def fetch(self, address: str) -> bytes: ...


def parse_remotely(
    path: str, target: str, transport: ParserTransport, interval: float = 5.0, deadline: float = 900.0,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> str:
    """Sends a PDF, waits until it is parsed, unpacks the result and returns its block list."""
    batch, address = transport.create(Path(path).name)
    transport.put(address, Path(path).read_bytes())
    began = clock()
    while True:
        state, detail = transport.state(batch)
        if state == "done":
            break
        if state == "failed":
            raise RuntimeError(f"the parser failed: {detail}")
        if clock() - began > deadline:
            raise TimeoutError("the parser did not finish in time")
        sleep(interval)
    folder = Path(target)
    folder.mkdir(parents=True, exist_ok=True)
    archive = folder / "result.zip"
    archive.write_bytes(transport.fetch(detail))
    unpack(str(archive), target)
    return content_list(target)


def ordered_vectors(response: list[dict[str, Any]], count: int, dimensions: int) -> list[list[float]]:
    """An embedding service's rows (index, embedding) in order, held against what was asked for."""
    rows = [r["embedding"] for r in sorted(response, key=lambda r: r["index"])]
    if len(rows) != count or any(len(v) != dimensions for v in rows):
        raise ValueError("the service returned other vectors than asked for")
    return rows


def remote_embedder(post: Callable[[list[str], int], list[dict[str, Any]]], dimensions: int) -> Callable[[list[str]], list[list[float]]]:
    """A provider for ``embed.with_provider`` around a service's call."""
    if dimensions not in (256, 512, 1024, 2048):
        raise ValueError("embedding dimensions are 256, 512, 1024 or 2048")
    return lambda texts: ordered_vectors(post(texts, dimensions), len(texts), dimensions)
