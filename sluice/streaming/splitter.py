"""Decoding files that are still arriving.

Rows (file_id, seq, data, last) of a streaming DataFrame are appended per file in the order of seq; what is
whole comes out as soon as it is there. The state is plain bytes and numbers (never a live decoder), so a
query restarts from its checkpoint. A row with last = true says that no more comes: an incomplete file is then
reported as truncated.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.errors import StreamError
from sluice.operators.codec import Limits, SequentialDecoder
from sluice.sources.lzma2 import RunScanner

INPUT_DDL = "file_id string, seq long, data binary, last boolean"
DECODED_DDL = "file_id string, out_offset long, data binary, error string"
RUNS_DDL = "file_id string, run_no long, in_offset long, packed_len long, out_offset long, unpacked_len long, error string"
_STATE_DDL = "state binary"


def _ordered(held: dict, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, bool]]:
    """The portions that follow without a gap; the others wait in held."""
    for batch in batches:
        for seq, data, last in zip(batch["seq"], batch["data"], batch["last"], strict=True):
            if seq >= held["next"]:
                held["wait"].setdefault(int(seq), (bytes(data) if data is not None else b"", bool(last)))
    while held["next"] in held["wait"]:
        yield held["wait"].pop(held["next"])
        held["next"] += 1


def _load(state: GroupState, make) -> dict:
    return pickle.loads(state.get[0]) if state.exists else {"next": 0, "wait": {}, "at": 0, "error": None, "ended": False, "core": make()}


def decode_arriving(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    """.xz: file_id, out_offset, data per whole and checked block, in file order; after an error nothing more of
    that file but the row with the error."""

    def step(key, batches, state):
        s = _load(state, lambda: SequentialDecoder(limits))
        out = []
        try:
            for data, last in _ordered(s, batches):
                if s["error"] or s["ended"]:
                    continue
                for got in s["core"].push(data):
                    out.append((key[0], s["at"], got, None))
                    s["at"] += len(got)
                if last:
                    s["ended"] = True
                    s["core"].finish()
        except StreamError as e:
            s["error"] = e.kind
            s["core"].held = bytearray()
            out.append((key[0], s["at"], None, e.kind))
        state.update((pickle.dumps(s),))
        yield pd.DataFrame(out, columns=["file_id", "out_offset", "data", "error"])

    return rows.groupBy("file_id").applyInPandasWithState(step, DECODED_DDL, _STATE_DDL, "append", GroupStateTimeout.NoTimeout)


def runs_arriving(rows: DataFrame) -> DataFrame:
    """Raw LZMA2: the runs as they become whole. The state is a chunk header and a few numbers."""

    def step(key, batches, state):
        s = _load(state, RunScanner)
        out = []
        try:
            for data, last in _ordered(s, batches):
                if s["error"] or s["ended"]:
                    continue
                s["core"].feed(data)
                out += [(key[0], r.run_no, r.in_offset, r.packed_len, r.out_offset, r.unpacked_len, None) for r in s["core"].runs()]
                if last:
                    s["ended"] = True
                    s["core"].end()
        except StreamError as e:
            s["error"] = e.kind
            out.append((key[0], None, e.offset, None, None, None, e.kind))
        state.update((pickle.dumps(s),))
        names = [c.split()[0] for c in RUNS_DDL.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[1:-1]})

    return rows.groupBy("file_id").applyInPandasWithState(step, RUNS_DDL, _STATE_DDL, "append", GroupStateTimeout.NoTimeout)
