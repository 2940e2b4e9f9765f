"""A streaming source for nodes that send audio over TCP in frames of a fixed size."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Bytes of a frame: 50 ms of 16-bit samples at 16 kHz.
FRAME = 1600


class TcpFrames(DataSource):
    """(seq, samples): frames read from `host`:`port`; a frame that isn't whole waits for the rest. Options: host, port, frame."""

    @classmethod
    def name(cls) -> str:
        return "tcp_frames"

    def schema(self) -> str:
        return "seq bigint, samples array<smallint>"

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    """Frames are kept until their batch is committed, so a batch that is read again has the same rows. Lost connections are made anew."""

    def __init__(self, options: dict):
        self.host, self.port, self.size = options.get("host", "127.0.0.1"), int(options.get("port", 0)), int(options.get("frame", FRAME))
        self.link: socket.socket | None = None
        self.rest, self.kept, self.next = b"", {}, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def _pull(self) -> None:
        try:
            if self.link is None:
                self.link = socket.create_connection((self.host, self.port), timeout=0.5)
            while data := self.link.recv(65536):
                self.rest += data
            self.link = None  # the node closed it
        except TimeoutError:
            pass
        except OSError:
            self.link = None
        while len(self.rest) >= self.size:
            self.kept[self.next], self.rest = self.rest[: self.size], self.rest[self.size :]
            self.next += 1

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._pull()
        rows = [(k, memoryview(self.kept[k]).cast("h").tolist()) for k in range(start["seq"], self.next)]
        return iter(rows), {"seq": self.next}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(k, memoryview(self.kept[k]).cast("h").tolist()) for k in range(start["seq"], end["seq"])])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.kept if k < end["seq"]]:
            del self.kept[k]
