"""Error kinds, as they appear in `error.kind`."""

from __future__ import annotations

#: The kinds of container errors, then those of the codec layer.
CONTAINER_KINDS = (
    "BadMagic", "BadFooterMagic", "BadStreamFlags", "StreamFlagsMismatch", "HeaderCrc", "UnsupportedCheck", "CheckMismatch",
    "UnsupportedFilter", "BadFilterChain", "BadVli", "TruncatedVli", "BadPadding", "BadBlockHeader", "SizeMismatch",
    "IndexMismatch", "TruncatedInput", "TrailingGarbage", "MemoryLimit", "TooMuchOutput", "Lzma",
)
CODEC_KINDS = ("UnsupportedProps", "CorruptData", "CorruptRun", "Truncated", "MemoryLimit", "Param")


class StreamError(ValueError):
    """A located error: kind, and where known stream, block, byte offset, bytes needed and the limit."""

    def __init__(self, kind: str, stream: int | None = None, block: int | None = None, offset: int | None = None, needed: int | None = None, limit: int | None = None):
        self.kind, self.stream, self.block, self.offset, self.needed, self.limit = kind, stream, block, offset, needed, limit
        where = ", ".join(f"{k} {v}" for k, v in (("stream", stream), ("block", block), ("offset", offset), ("needed", needed), ("limit", limit)) if v is not None)
        super().__init__(kind + (f" ({where})" if where else ""))

    def __reduce__(self):
        return StreamError, (self.kind, self.stream, self.block, self.offset, self.needed, self.limit)

    def at(self, stream: int | None = None, block: int | None = None, offset: int | None = None) -> StreamError:
        """The same error with what was not known before filled in."""
        pick = lambda a, b: b if a is None else a
        return StreamError(self.kind, pick(self.stream, stream), pick(self.block, block), pick(self.offset, offset), self.needed, self.limit)

    def as_row(self) -> dict:
        return {"kind": self.kind, "stream": self.stream, "block": self.block, "offset": self.offset, "needed": self.needed, "limit": self.limit}


ERROR_DDL = "struct<kind:string,stream:long,block:long,offset:long,needed:long,limit:long>"
