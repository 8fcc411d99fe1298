"""HTTP source: posts to ``/input`` are spooled as files, and a file stream reads them."""

from __future__ import annotations

import os
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def serve(spool: str, port: int = 0, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """Take POST /input with octets as one payload (another type: 415) and answer GET / with 200.

    A post that does not tell its length, as chunked ones do, gets 411: nothing of it is taken. ``spool`` is a folder that the cluster shares. A payload is there, whole, before the answer.
    """
    os.makedirs(spool, exist_ok=True)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int) -> None:
            self.send_response(code)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def do_GET(self):
            self._answer(200 if self.path == "/" else 404)

        def do_POST(self):
            length = self.headers.get("Content-Length") or ""
            if not length.isdigit():
                self.close_connection = True
                return self._answer(411)
            body = self.rfile.read(int(length))
            if self.path != "/input":
                return self._answer(404)
            if (self.headers.get("Content-Type") or "").split(";")[0].strip() != "application/octet-stream":
                return self._answer(415)
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
            # a name with a leading dot is not read until it is renamed
            with open(f"{spool}/.{name}", "wb") as f:
                f.write(body)
            os.rename(f"{spool}/.{name}", f"{spool}/{name}.payload")
            self._answer(200)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def read_stream(spark: SparkSession, spool: str, max_files: int = 10_000) -> DataFrame:
    """The spooled payloads as a stream: value, source_ts. Files of committed batches are deleted as the stream goes on."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.payload").option("maxFilesPerTrigger", max_files).option("cleanSource", "delete").load(spool)
    return stream.select(F.col("content").alias("value"), F.col("modificationTime").alias("source_ts"))
