"""A gate for calls to an outside service: so many at once, however many tasks want to call."""

from __future__ import annotations

import hmac
import secrets
import socket
import socketserver
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import SparkSession


class Closed(Exception):
    """Nothing may be called any more; the reason is its text."""


class Address(NamedTuple):
    """What a task needs to know of a gate."""

    host: str
    port: int
    token: str


class Lease:
    """One of the gate's places. It ends with the block that holds it."""

    def __init__(self, line):
        self._line, self._said = line, b"done\n"

    def close_gate(self, reason: str) -> None:
        """Nobody gets a place after this one."""
        self._said = b"close " + reason.replace("\n", " ").encode() + b"\n"


class Gate:
    """Gives out `at_once` places to tasks of any executor. Its server is a thread of the driver,
    so it is there as long as a job can run at all. A place is held over a connection: when a task
    or its executor is lost the connection ends, and the place is free again; there is no clock to
    set. Used as a context; `address` is sent to the tasks."""

    def __init__(self, spark: SparkSession, at_once: int = 2):
        if at_once < 1:
            raise ValueError("a gate has at least one place")
        conf = spark.sparkContext.getConf()
        host = conf.get("spark.driver.host", "127.0.0.1")
        self.reason: str | None = None
        self.n_calls = 0
        self._places, self._lock = threading.BoundedSemaphore(at_once), threading.Lock()
        token, gate = secrets.token_hex(16), self

        class Visit(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                self.connection.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
                self.connection.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                if not hmac.compare_digest(self.rfile.readline(200).strip(), token.encode()):
                    return
                asked = b"ask\n"
                while asked == b"ask\n":
                    with gate._places:
                        if gate.reason is not None:
                            self.wfile.write(b"closed " + gate.reason.encode() + b"\n")
                        else:
                            with gate._lock:
                                gate.n_calls += 1
                            self.wfile.write(b"go\n")
                            said = self.rfile.readline(10_000)  # nothing where the caller is lost
                            if said.startswith(b"close "):
                                gate.reason = said[6:].decode().strip()
                    asked = self.rfile.readline(200)

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads, allow_reuse_address, request_queue_size = True, True, 1024

            def handle_error(self, request, client_address) -> None:
                pass  # a caller that was lost between two lines

        self._server = Server((conf.get("spark.driver.bindAddress", host), 0), Visit)
        self.address = Address(host, self._server.server_address[1], token)

    def __enter__(self) -> Gate:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._server.shutdown()
        self._server.server_close()


class Visitor:
    """A task's connection to a gate, for one call after another."""

    def __init__(self, line, token: str):
        self._line, self._next = line, token.encode() + b"\n"  # the token asks for the first place

    @contextmanager
    def place(self) -> Iterator[Lease]:
        """Waits for a place. Closed is raised where the gate has been closed."""
        self._line.write(self._next)
        self._line.flush()
        self._next = b"ask\n"
        answer = self._line.readline()
        if answer.startswith(b"closed"):
            raise Closed(answer[7:].decode().strip())
        if answer != b"go\n":
            raise ConnectionError("the gate's driver is gone")
        lease = Lease(self._line)
        try:
            yield lease
        finally:
            self._line.write(lease._said)
            self._line.flush()


@contextmanager
def visit(address: Address) -> Iterator[Visitor]:
    """A connection for many calls: it is made once, and a place is asked for and given back with each."""
    with socket.create_connection((address.host, address.port)) as s, s.makefile("rwb") as line:
        s.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        yield Visitor(line, address.token)


@contextmanager
def place(address: Address) -> Iterator[Lease]:
    """Waits for a place for one call, in a task. Closed is raised where the gate has been closed."""
    with visit(address) as visitor, visitor.place() as lease:
        yield lease
