"""Out-of-order parts of images: each is handed on once all before it are there.

State for each image is the next wanted number and the early parts, bounded in bytes; watermarks and
time play no role. The same rule in batch is the query part_reorder_prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "image_id long, part long, payload string"
STATE = "wanted long, numbers array<long>, payloads array<string>"
#: Characters of early parts that one image may hold; beyond it the stream stops with an error.
MOST_PENDING = 16_000_000


def _assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    wanted, early = 0, {}
    if state.exists:
        wanted, numbers, payloads = state.get
        early = dict(zip(numbers, payloads, strict=True))
    out = []
    for batch in batches:
        for part, payload in zip(batch["part"], batch["payload"], strict=True):
            if part >= wanted:  # a part that comes twice counts once
                early.setdefault(int(part), payload)
    while wanted in early:
        out.append((key[0], wanted, early.pop(wanted)))
        wanted += 1
    if sum(len(p or "") for p in early.values()) > MOST_PENDING:
        raise ValueError(f"image {key[0]} waits for part {wanted} with too much pending")
    state.update((wanted, list(early), list(early.values())))
    yield pd.DataFrame(out, columns=["image_id", "part", "payload"])


def in_order(parts: DataFrame) -> DataFrame:
    """parts: a stream of (image_id, part, payload). The stream of parts in order, each once."""
    return parts.select("image_id", "part", "payload").groupBy("image_id").applyInPandasWithState(_assemble, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
