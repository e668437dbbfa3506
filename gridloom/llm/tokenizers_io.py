"""Tokenizer files, read once on the driver and shared with the workers.

A file is at most a few megabytes, which bounds the broadcast; ``MAX_FILE`` is
checked.  Workers keep what they built from it, by content digest, while they live.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import SparkSession

MAX_FILE = 64 << 20
_built: dict[tuple[str, str], Any] = {}


def public_path(name: str) -> str:
    """Where the installed public vocabulary file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Let go of what earlier tasks built in this worker; for operators that need the memory for something else."""
    _built.clear()


class Shared:
    """A file's bytes on every worker, and what a worker makes of them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read(MAX_FILE + 1)
        if len(data) > MAX_FILE:
            raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
        self.digest = hashlib.sha256(data).hexdigest()
        self.data: Broadcast[bytes] = spark.sparkContext.broadcast(data)

    def build(self, kind: str, make: Callable[[bytes], Any]) -> Any:
        key = (kind, self.digest)
        if key not in _built:
            _built[key] = make(self.data.value)
        return _built[key]


def library_tokenizer(data: bytes) -> Any:
    """The file's tokenizer without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def spec(data: bytes) -> dict[str, Any]:
    return json.loads(data)
