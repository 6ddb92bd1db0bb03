"""What leaves the engine: one compressed response. Not a query operator: it runs on the driver over a finished result."""

from __future__ import annotations

import base64
import gzip
import json

from pyspark.sql import DataFrame


def response(rows: DataFrame, column: str = "json") -> str:
    """The JSON rows as one array, gzipped, in base64. For results that one client can take."""
    body = "[" + ",".join(r[0] for r in rows.select(column).toLocalIterator()) + "]"
    return base64.b64encode(gzip.compress(body.encode())).decode()


def decoded(response_text: str) -> list[dict]:
    return json.loads(gzip.decompress(base64.b64decode(response_text)))
